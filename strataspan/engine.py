"""The engine's API over a table store: admission, lookup, search, gathering, traversal, recall, retention and feedback."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataspan.functions import columns as cx
from strataspan.functions import text as tx
from strataspan.operators import anchors as anchors_
from strataspan.operators import bm25f, context, exact, feedback, hints, lexical, lifecycle, protection, ranking, segments, semantic, session, simhash, stored, structure
from strataspan.sources.tables import TableStore


#: Index handlers that admission runs by default, besides the lexical index: name and DataFrame transform.
HANDLERS = {
    "chunks": segments.physical_chunks, "windows": segments.byte_windows, "signatures": lambda docs: simhash.signatures(docs, "version"), "anchors": lambda docs: exact.postings(anchors_.extracted(docs)),
    "relations": structure.stored_relations,
}
#: How index tables are written: the order of rows within a file.
LAYOUTS = {"relations": {"order": ("relation", "project", "session_id")}}
#: Attempts to write what another writer's commits have overtaken.
ATTEMPTS = 16


class LocatorError(ValueError):
    """A locator that this engine didn't sign, or that names nothing readable."""


def sign_locator(secret: bytes, payload: dict) -> str:
    body = base64.urlsafe_b64encode(json.dumps(payload, sort_keys=True).encode()).decode().rstrip("=")
    return f"ev1.{body}.{hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()}"


def verify_locator(secret: bytes, locator: str) -> dict:
    try:
        head, body, sig = locator.split(".")
        if head != "ev1" or not hmac.compare_digest(sig, hmac.new(secret, body.encode(), hashlib.sha256).hexdigest()):
            raise LocatorError(locator)
        return json.loads(base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)))
    except (ValueError, TypeError) as e:
        raise LocatorError(str(e)) from e


DOCUMENT_SCHEMA = "document_id long, project string, session_id string, kind string, created_at long, text string, subject_key string, supersedes long, protect boolean, tool string, messages array<struct<role:string,score:int,text:string>>"
#: Defaults of a packet by intent: documents before and after an anchor.
PRESETS = {"state": (0, 0), "workflow": (1, 8), "auto": (1, 3)}
#: A lexical result below this score or coverage asks for other ways to search.
WEAK_SCORE, WEAK_COVERAGE = 0.55, 0.5


class Engine:
    """Documents are (document_id, version, project, session_id, kind, created_at, text, subject_key, supersedes, protect, tool, messages). Nothing is updated in place: versions,
    retirements, pins, protections, leases and renewals are rows, of which the newest holds. Every index table carries document and version."""

    def __init__(self, spark: SparkSession, path: str, secret: bytes = b"local", own_tools: tuple[str, ...] = (), embedder: Callable = semantic.hashed_words):
        self.spark, self.store, self.secret, self.own_tools, self.embedder = spark, TableStore(spark, path), secret, own_tools, embedder

    # Admission

    def _whole(self, docs: DataFrame) -> DataFrame:
        """docs with all columns of a document; those that are missing are null."""
        schema = T.StructType.fromDDL(DOCUMENT_SCHEMA)
        return docs.select(*[F.col(f.name).cast(f.dataType) if f.name in docs.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema], *(["version"] if "version" in docs.columns else []))

    def _appended(self, name: str, rows: DataFrame) -> int:
        generation = self.store.claim()
        self.store.append(name, rows, generation)
        self.store.commit(generation)
        return generation

    def admit(self, docs: DataFrame, handlers: dict | None = None) -> int:
        """Appends documents whose content isn't the newest one of their id, as the next versions, builds their index tables and publishes the generation.

        Several contents of one id in a batch become versions in order of source time, then of content. Output of the archive's own tools is stored, but not indexed. If another writer commits documents,
        retirements or centroids meanwhile, the work is done again on what is there then, so no two writers give one version number and statistics count each version once.
        """
        for _ in range(ATTEMPTS):
            since, generation = self.store.last_commit(), self.store.claim()
            self._admit(docs, handlers, generation)
            if self.store.commit(generation, lambda since=since: not self.store.touched(("documents", "retired", "centroids"), since)):
                return generation
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def _admit(self, docs: DataFrame, handlers: dict | None, generation: int) -> None:
        fresh = self._whole(docs.drop("version")).withColumn("content_hash", F.sha2(F.coalesce("text", F.lit("")), 256)).dropDuplicates(["document_id", "content_hash"])
        old = self._optional("documents")
        if old is not None:
            last = old.groupBy("document_id").agg(F.max(F.struct("version", "content_hash")).alias("last"))
            fresh = fresh.join(last, "document_id", "left").where("last IS NULL OR last.content_hash != content_hash").withColumn("base", F.coalesce("last.version", F.lit(0))).drop("last")
        else:
            fresh = fresh.withColumn("base", F.lit(0))
        order = Window.partitionBy("document_id").orderBy("created_at", "content_hash")
        fresh = fresh.withColumn("version", (F.col("base") + F.row_number().over(order)).cast("int")).drop("base")
        self.store.append("documents", fresh, generation)
        written = self._written("documents", generation)
        visible = written.where(~cx.echo_of(F.col("kind"), F.col("tool"), self.own_tools)) if self.own_tools else written
        for name, build in (HANDLERS if handlers is None else handlers).items():
            self.store.append(name, build(visible), generation, **LAYOUTS.get(name, {}))
        centres = self._centres() if handlers is None else None
        if centres is not None:
            self.store.append("vectors", semantic.listed(semantic.indexed(visible, self.embedder), centres), generation, order=("list",))
        gone = []
        if old is not None:
            known = self.documents().select("document_id", "version", F.col("project").alias("_p"), F.col("created_at").alias("_t"))
            gone.append(known.join(written.select("document_id").distinct(), "document_id", "left_semi").select("document_id", "version"))
            explicit = written.where("supersedes IS NOT NULL").select(F.col("supersedes").alias("document_id"), "project", "created_at", F.col("document_id").alias("by"))
            if not explicit.isEmpty():
                named = explicit.join(known, "document_id").where("project = _p AND created_at > _t AND by != document_id").select("document_id", "version").distinct()
                self.store.append("retired", named.withColumn("status", F.lit("superseded")), generation)
                gone.append(named)
        if handlers is None:
            self._index_terms(visible, written, gone, generation)

    def _written(self, name: str, generation: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.store.path}/{name}/generation={generation}")

    def _index_terms(self, visible: DataFrame, written: DataFrame, gone: list[DataFrame], generation: int) -> None:
        """Forward rows, and from these postings, blocks and the statistics' deltas: of the newest versions written, and of those that they replace."""
        self.store.append("forward", stored.forward(visible), generation, order=("document_id", "version"))
        fwd = self._written("forward", generation)
        self.store.append("postings", stored.postings(fwd), generation, **stored.LAYOUT)
        self.store.append("blocks", stored.blocks(self._written("postings", generation)), generation, order=("bucket", "term"))
        newest = written.groupBy("document_id").agg(F.max("version").alias("version"))
        added = fwd.join(newest, ["document_id", "version"], "left_semi")
        self._count(added, gone, generation)

    def _count(self, added: DataFrame | None, gone: list[DataFrame], generation: int) -> None:
        """Appends the statistics' deltas of forward rows that are added and of versions (document_id, version) that were live and are so no longer."""
        signed = [] if added is None else [(added, 1)]
        if gone and self.store.has("forward"):
            lost = gone[0]
            for more in gone[1:]:
                lost = lost.unionByName(more)
            signed.append((self.store.read("forward").join(lost.distinct(), ["document_id", "version"], "left_semi"), -1))
        if signed:
            for name, build, keys in (("term_stats", stored.term_deltas, ("bucket", "term")), ("corpus_stats", stored.corpus_deltas, ())):
                parts = [build(rows, sign) for rows, sign in signed]
                self.store.append(name, parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]), generation, order=keys)

    def commit(self, name: str, records: DataFrame, request_id: str, must_be_absent: DataFrame | None = None, keys: tuple[str, ...] = ("document_id",), must_match: DataFrame | None = None) -> str:
        """Appends records to a table as one generation: committed, or duplicate if this request was committed before, or conflict if a key that must be absent is there or a row that must match
        isn't. Whatever another writer commits before is seen: the conditions hold at the commit itself."""
        said = []

        def allowed() -> bool:
            said[:] = ["committed"]
            done, there = self._optional("requests"), self._optional(name)
            if done is not None and not done.where(F.col("request_id") == request_id).isEmpty():
                said[:] = ["duplicate"]
            elif must_be_absent is not None and there is not None and not there.join(must_be_absent.select(*keys).distinct(), list(keys), "left_semi").isEmpty():
                said[:] = ["conflict"]
            elif must_match is not None:
                none = must_match if there is None else must_match.exceptAll(there.select(*must_match.columns).distinct())
                if not none.isEmpty():
                    said[:] = ["conflict"]
            return said[0] == "committed"

        if allowed():
            generation = self.store.claim()
            self.store.append(name, records, generation)
            self.store.append("requests", self.spark.range(1).select(F.lit(request_id).alias("request_id")), generation)
            self.store.commit(generation, allowed)
        return said[0]

    def checkpoint(self, path: str) -> list[str]:
        """Copies every table, as published, to another folder; returns their names."""
        return self.store.copy(path)

    # Reading

    def _optional(self, name: str) -> DataFrame | None:
        return self.store.read(name) if self.store.has(name) else None

    def _rows(self, name: str, schema: str) -> DataFrame:
        """A table's rows, or none of them."""
        found = self._optional(name)
        return self.spark.createDataFrame([], schema) if found is None else found.select(*T.StructType.fromDDL(schema).names)

    def retired(self) -> DataFrame:
        """(document_id, version, status) of all versions that aren't live: retired ones, and those before the newest."""
        return self._rows("retired", "document_id long, version int, status string").distinct()

    def documents(self, live: bool = True) -> DataFrame:
        docs = self.store.read("documents")
        return lifecycle.live(lifecycle.newest_versions(docs), self.retired()) if live else docs

    def _live(self, index: DataFrame) -> DataFrame:
        return index.join(self.documents().select("document_id", "version"), ["document_id", "version"], "left_semi")

    def _scoped(self, docs: DataFrame, project: str | None, sessions: list[str] | None, without: list[int] | None = None) -> DataFrame:
        docs = docs if project is None else docs.where(F.col("project") == project)
        docs = docs if sessions is None else docs.where(F.col("session_id").isin(sessions))
        return docs if not without else docs.where(~F.col("document_id").isin(without))

    def retire(self, documents: DataFrame, status: str) -> int:
        """Appends tombstones for (document_id, version): superseded, expired or deleted. What was live leaves the statistics of the lexical index."""
        for _ in range(ATTEMPTS):
            since, generation = self.store.last_commit(), self.store.claim()
            self.store.append("retired", documents.select("document_id", "version", F.lit(status).alias("status")), generation)
            lost = self.documents().select("document_id", "version").join(self._written("retired", generation).select("document_id", "version").distinct(), ["document_id", "version"], "left_semi")
            self._count(None, [lost], generation)
            if self.store.commit(generation, lambda since=since: not self.store.touched(("documents", "retired"), since)):
                return generation
        raise RuntimeError(f"other writers were first {ATTEMPTS} times")

    def status(self, asked: DataFrame) -> DataFrame:
        """(document_id, version, status) of asked versions: resolved, superseded (also by a newer version), expired, deleted or missing."""
        there = self.store.read("documents").select("document_id", "version").distinct()
        newest = there.groupBy("document_id").agg(F.max("version").alias("newest"))
        gone = self.retired().groupBy("document_id", "version").agg(F.max("status").alias("gone"))
        met = asked.select("document_id", "version").distinct().join(there.withColumn("there", F.lit(True)), ["document_id", "version"], "left").join(newest, "document_id", "left").join(gone, ["document_id", "version"], "left")
        status = F.when(F.col("there").isNull(), "missing").when(F.col("gone").isNotNull(), F.col("gone")).when(F.col("version") < F.col("newest"), "superseded").otherwise("resolved")
        return met.select("document_id", "version", status.alias("status"))

    def get(self, document_id: int, version: int | None = None) -> DataFrame:
        """One row: the asked version, or the newest one, with its status. Content is shown of resolved versions, and of superseded ones that are asked for by version."""
        own = self.store.read("documents").where(F.col("document_id") == document_id)
        own = own.where(F.col("version") == version) if version else lifecycle.newest_versions(own)
        ask = own.select("document_id", "version")
        if ask.isEmpty():
            return self.spark.createDataFrame([(document_id, version, None, "missing")], "document_id long, version int, text string, status string")
        shown = F.col("status").isin("resolved", "superseded") if version else F.col("status") == "resolved"
        return own.join(self.status(ask), ["document_id", "version"]).withColumn("text", F.when(shown, F.col("text")))

    def count(self, project: str | None = None, sessions: list[str] | None = None) -> int:
        return self._scoped(self.documents(), project, sessions).count()

    # Search

    def _page(self, rows: DataFrame) -> DataFrame:
        """The rows of one page, which a limit bounds, by value: what follows doesn't search again for every use."""
        return self.spark.createDataFrame(rows.collect(), rows.schema)

    def candidates(self, query: str, project: str | None = None, limit: int = 10, sessions: list[str] | None = None, without: list[int] | None = None) -> DataFrame:
        """(id, mode, norm, version, coverage, max_idf, margin, match_start, match_end) of the stored indexes: those with the query's exact anchors, and the best by stemmed BM25F; a document may be found by
        both. Only live documents in scope take part. The bytes of the first match come from the postings."""
        docs = self._scoped(self.documents(), project, sessions, without).select("document_id", "version")
        plan, found = exact.plan(self.spark, [(0, query)]), None
        if not plan.isEmpty():
            buckets = [r[0] for r in plan.select(bm25f.bucket(F.col("folded"))).distinct().collect()]  # at most 32 anchors
            post = self.store.read("anchors").where(F.col("bucket").isin(buckets)).join(docs, ["document_id", "version"], "left_semi")
            first = post.join(F.broadcast(plan.select("folded").distinct()), "folded").groupBy("document_id", "version").agg(F.min(F.struct("start_byte", F.octet_length("normalized").alias("n"))).alias("p"))
            hits = exact.lookup(post, plan, k=limit).join(first, ["document_id", "version"])
            found = hits.select(F.col("document_id").alias("id"), F.lit("exact").alias("mode"), F.col("score").alias("norm"), "version", "coverage", F.lit(1.0).alias("max_idf"), F.lit(1.0).alias("margin"), F.col("p.start_byte").cast("long").alias("match_start"), (F.col("p.start_byte") + F.col("p.n")).cast("long").alias("match_end"))
        asked = self.spark.createDataFrame([(0, t) for t in tx.query_terms(query)], "query_id int, term string")
        best = self._lexical(asked, project, docs, limit)
        order = best.orderBy(F.desc("score"), "document_id").limit(limit)
        words = order.select(F.col("document_id").alias("id"), F.lit("lexical").alias("mode"), F.col("normalized").alias("norm"), "version", "coverage", "max_idf", "margin", F.col("match_start").cast("long"), F.col("match_end").cast("long"))
        return words if found is None else found.unionByName(words)

    def _lexical(self, asked: DataFrame, project: str | None, docs: DataFrame, limit: int) -> DataFrame:
        """stored.search() of terms (query_id, term), from the folders of their buckets only."""
        buckets = [r[0] for r in asked.select(bm25f.bucket(F.col("term"))).distinct().collect()] or [-1]  # BUCKETS at most
        tables = [self.store.read(n).where(F.col("bucket").isin(buckets)) for n in ("postings", "blocks", "term_stats")] + [self.store.read("corpus_stats")]
        if project is not None:
            tables = [t.where(F.col("project") == project) for t in tables]
        return stored.search(*tables, asked, limit, docs)

    def related(self, relation: str, query: str = "", project: str | None = None, sessions: list[str] | None = None, without: list[int] | None = None, limit: int = 3) -> DataFrame:
        """structure.lookup() of one relation in the stored index: sessions are the lineage, nearest first. Files are in order of relation, project and session, so most row groups of other ones aren't read."""
        asked = self.spark.createDataFrame([(0, relation, structure.words(query))], "query_id int, relation string, asked_words array<string>")
        rows = self._rows("relations", structure.ROWS).where(F.col("relation") == relation)
        rows = rows if project is None else rows.where(F.col("project") == project)
        lineage = None
        if sessions is not None:
            rows = rows.where(F.col("session_id").isin(sessions))
            lineage = self.spark.createDataFrame([(0, s, d) for d, s in enumerate(dict.fromkeys(sessions))], "query_id int, session_id string, depth int")
        live = self._scoped(self.documents(), project, sessions, without).select("document_id", "version")
        return structure.lookup(rows.join(live, ["document_id", "version"], "left_semi"), asked, lineage, limit)

    def _centres(self) -> np.ndarray | None:
        """The centroids of the newest fitting, if there was one; they are a few hundred rows."""
        found = self._optional("centroids")
        if found is None:
            return None
        rows = found.where(F.col("generation") == found.agg(F.max("generation")).first()[0]).orderBy("list").collect()
        return np.array([r["v"] for r in rows])

    def fit_semantic(self, lists: int = 64) -> int:
        """Fits centroids on a bounded sample of the live documents' spans and writes all of these by list; admissions then add their own. Done again it replaces lists and vectors. Returns the number of lists, 0 if
        there is no span, or another writer committed documents meanwhile."""
        since, generation = self.store.last_commit(), self.store.claim()
        docs = self.documents()
        visible = docs.where(~cx.echo_of(F.col("kind"), F.col("tool"), self.own_tools)) if self.own_tools else docs
        index = semantic.indexed(visible, self.embedder)
        centres = semantic.fitted(index, lists)
        if not len(centres):
            return 0
        replaces = {n: self.store.generations(n) for n in ("vectors", "centroids") if self.store.has(n)}
        self.store.append("vectors", semantic.listed(index, centres), generation, order=("list",))
        self.store.append("centroids", self.spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "list int, v array<double>"), generation)
        if not self.store.commit(generation, lambda: not self.store.touched(("documents", "vectors"), since), replaces):
            return 0
        for name, old in replaces.items():
            self.store.delete(name, old)
        return len(centres)

    def broadened(self, query: str, project: str | None = None, limit: int = 10, sessions: list[str] | None = None, without: list[int] | None = None) -> DataFrame:
        """semantic.probed() of one query over the stored vectors in scope: live documents of the project and the sessions only. Without a fitting nothing is found."""
        docs, centres = self._scoped(self.documents(), project, sessions, without).select("document_id", "version"), self._centres()
        v = self.embedder()([query])[0]
        if centres is None or not np.any(v):
            return self.spark.createDataFrame([], "query_id int, rank int, document_id long, version int, ordinal int, start_byte long, end_byte long, score double")
        rows = self.store.read("vectors")
        rows = rows if project is None else rows.where(F.col("project") == project)
        asked = self.spark.createDataFrame([(0, v.tolist())], "query_id int, v array<double>")
        return semantic.probed(rows.join(docs, ["document_id", "version"], "left_semi"), centres, asked, limit)

    def snippets(self, rows: DataFrame, most: int = 280) -> DataFrame:
        """(document_id, version, snippet) of a page of rows (document_id, version, match_start, match_end): up to most characters with the match in brackets. Only the chunks around it are read."""
        page = self._page(rows.select("document_id", "version", "match_start", "match_end").where("match_start IS NOT NULL"))
        ids = [r["document_id"] for r in page.select("document_id").distinct().collect()]
        left = page.select("document_id", "version", F.greatest(F.lit(0), F.col("match_start") - 3 * most).alias("start"), F.col("match_start").alias("end"))
        right = page.select("document_id", "version", F.col("match_start").alias("start"), (F.col("match_end") + 3 * most).alias("end"))
        chunks = self.store.read("chunks").where(F.col("document_id").isin(ids))
        got = segments.read_range(chunks, left.unionByName(right).where("start < end").distinct())
        before = got.select("document_id", "version", F.col("end").alias("match_start"), F.col("content").alias("before"))
        behind = got.select("document_id", "version", F.col("start").alias("match_start"), F.col("content").alias("behind"))
        met = page.join(before, ["document_id", "version", "match_start"], "left").join(behind, ["document_id", "version", "match_start"])

        @F.pandas_udf("string")
        def shown(before: pd.Series, behind: pd.Series, size: pd.Series) -> pd.Series:
            return pd.Series([tx.excerpt((a or "") + b, len(a or ""), len(a or "") + len(b.encode()[:n].decode("utf-8", "ignore")), most) for a, b, n in zip(before, behind, size, strict=True)])

        return met.select("document_id", "version", shown("before", "behind", F.col("match_end") - F.col("match_start")).alias("snippet"))

    def search(self, query: str, project: str | None = None, limit: int = 10, now: int | None = None, sessions: list[str] | None = None, without: list[int] | None = None, working_set: list[str] | None = None, context_terms: list[str] | None = None, expand: bool = False, snippet_chars: int = 280, relation: str | None = None, broaden: bool = False) -> DataFrame:
        """(document_id, version, score, mode, ranking_score, rank, match_start, match_end, snippet): the pool of candidates of all modes, with expansion of weak results, decay, importance and bounded boosts, fused and cut to the limit.

        score is what the mode says, decayed by age if now is given; ranking_score is the fused one after all boosts, by which rows are ordered.
        With relation (as latest-request) the stored relations take part, as a tier between exact matches and the rest; sessions are then the lineage, nearest first. Their range is the message.
        With broaden documents that a span's meaning brings in join the pool, in a mode of their own (after fit_semantic()).
        """
        pool = self.candidates(query, project, cx.pool_size(limit), sessions, without).withColumn("query_id", F.lit(0))
        places = {}
        if relation is not None:
            best = self.related(relation, query, project, sessions, without, cx.pool_size(limit)).groupBy("document_id", "version").agg(F.max(F.struct("confidence", (-F.col("rank")).alias("r"), "start_byte", "end_byte")).alias("b"))
            best = self._page(best)
            places = {r["document_id"]: -r["b"]["r"] for r in best.collect()}  # a page; rows of one confidence keep their order
            of = best.select(F.col("document_id").alias("id"), F.lit("structural").alias("mode"), (F.col("b.confidence") / 100).alias("norm"), "version", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("max_idf"), F.lit(1.0).alias("margin"), F.col("b.start_byte").alias("match_start"), F.col("b.end_byte").alias("match_end"), F.lit(0).alias("query_id"))
            pool = pool.unionByName(of)
        pool = self._page(pool)
        if broaden:
            near = self.broadened(query, project, cx.pool_size(limit), sessions, without)
            pool = self._page(pool.unionByName(near.select(F.col("document_id").alias("id"), F.lit("semantic").alias("mode"), F.col("score").alias("norm"), "version", F.lit(1.0).alias("coverage"), F.lit(1.0).alias("max_idf"), F.lit(1.0).alias("margin"), F.col("start_byte").alias("match_start"), F.col("end_byte").alias("match_end"), "query_id")))
        found = pool.collect()
        lexical_only = all(r["mode"] == "lexical" for r in found)
        if lexical_only and (expand or found and (max(r["norm"] for r in found) < WEAK_SCORE or max(r["coverage"] for r in found) < WEAK_COVERAGE)):
            more = self.expansion(query, pool, project)
            if more:
                again = self.candidates(" ".join(more), project, cx.pool_size(limit), sessions, without).withColumn("query_id", F.lit(0))
                pool = self._page(pool.unionByName(again.where("mode = 'lexical'").join(pool.select("id"), "id", "left_anti")))
        docs = lifecycle.retention(self.documents().where(F.col("document_id").isin([r[0] for r in pool.select("id").collect()]))).select(F.col("document_id").alias("id"), "created_at", "retention_class", "kind", "session_id")
        met = pool.join(docs, "id")
        if now is not None:
            met = met.withColumn("norm", F.when(F.col("mode") == "lexical", F.round(F.col("norm") * ranking.decay(F.lit(now) - F.col("created_at"), F.col("retention_class")), 6)).otherwise(F.col("norm")))
        pins = protection.pinned(self._rows("pins", "pin_id string, document_id long, seq long, active boolean")).select(F.col("document_id").alias("id"), F.lit(True).alias("pin"))
        met = self._page(met.join(pins, "id", "left"))
        factor = ranking.importance(F.col("kind") == "decision-candidate", F.coalesce("pin", F.lit(False)), F.lit(0), F.lit(0))
        boost = met.select("query_id", "mode", "id", F.least(F.lit(1.0), F.round(F.col("norm") * factor, 6)).alias("norm"))
        if context_terms:
            own = self.store.read("postings").where(F.col("term").isin([t for w in context_terms for t, _ in tx.analysed(w)])).select(F.col("document_id").alias("id")).distinct()
            boost = context.boosted(boost, own.withColumn("query_id", F.lit(0)), context.CONTEXT_BOOST)
        if working_set:
            entries = self.spark.createDataFrame([(0, k, v) for k, v in tx.working_set(working_set)], "query_id int, type string, normalized string")
            boost = context.boosted(boost, exact.working_set_matches(self._live(self.store.read("anchors")), entries).select("query_id", "id"), context.WORKING_SET_BOOST)
        behind = F.coalesce(F.create_map(*[F.lit(x) for i, n in places.items() for x in (i, 1e-6 * n)])[F.col("id")], F.lit(0.0)) if places else F.lit(0.0)
        tiers = ranking.tiered(boost.where("mode = 'exact'").select("query_id", "id", F.col("norm").alias("score")), boost.where("mode = 'structural'").select("query_id", "id", F.round(F.col("norm") - behind, 9).alias("score")), boost.where("mode NOT IN ('exact', 'structural')").select("query_id", "mode", "id", "norm"), limit)
        shown = met.groupBy("id").agg(F.max(F.struct(F.when(F.col("mode") == "exact", 2).when(F.col("mode") == "structural", 1).otherwise(0).alias("tier"), "norm", "mode", "version", "match_start", "match_end")).alias("b"))
        out = tiers.join(shown, "id").select(F.col("id").alias("document_id"), "b.version", F.col("b.norm").alias("score"), "b.mode", F.col("fusion_score").alias("ranking_score"), "rank", "b.match_start", "b.match_end")
        if snippet_chars:
            page = self._page(out)
            out = page.join(self.snippets(page, snippet_chars), ["document_id", "version"], "left")
        return out.orderBy("rank")

    def expansion(self, query: str, pool: DataFrame, project: str | None = None, feedback_docs: int = 3, most: int = 8) -> list[str]:
        """The rarest terms of the best documents that the query doesn't have."""
        top = pool.orderBy(F.desc("norm"), "id").limit(feedback_docs).select(F.col("id").alias("document_id"), "version")
        ids = [r[0] for r in top.select("document_id").collect()]  # feedback_docs at most
        own = self.store.read("forward").where(F.col("document_id").isin(ids)).join(F.broadcast(top), ["document_id", "version"], "left_semi")
        terms = own.select(F.explode("terms.term").alias("term")).distinct().where(~F.col("term").isin(tx.query_terms(query) or [""]) & (F.length("term") > 3))
        stats = self.store.read("term_stats")
        stats = stats if project is None else stats.where(F.col("project") == project)
        df = stats.join(terms, "term").groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")
        return [r["term"] for r in df.orderBy("df", "term").limit(most).collect()]

    def gather(self, query: str, intent: str = "auto", before: int | None = None, after: int | None = None, anchors: int = 5, most: int = 24, max_tokens: int | None = None, **options) -> DataFrame:
        """Best documents and their neighbours in time, each once by its best priority, as far as they fit the tokens, in order of time; with conflicts, an array of ids."""
        a, b = PRESETS[intent]
        before, after = a if before is None else before, b if after is None else after
        docs = self.documents()
        best = self._page(self.search(query, limit=anchors, snippet_chars=0, **options).select(F.col("document_id").alias("anchor_id"), F.col("rank").alias("anchor_rank")))
        near = lifecycle.neighbours(docs, best.select(F.col("anchor_id").alias("document_id")), before, after).join(best, "anchor_id")
        relation = F.when(F.col("distance") == 0, "anchor").when(F.col("distance") > 0, "after").otherwise("before")
        placed = near.withColumn("relation", relation).withColumn("priority", cx.gather_priority(relation, F.col("anchor_rank"), F.abs("distance"), intent == "workflow"))
        once = placed.groupBy("document_id").agg(F.min(F.struct("priority", "relation", "distance")).alias("p")).orderBy("p.priority", "document_id").limit(most)
        rows = self._page(once.select("document_id", "p.priority", "p.relation", "p.distance")).join(docs, "document_id")
        if max_tokens is not None:
            sized = rows.select(F.lit(0).alias("packet_id"), F.row_number().over(Window.orderBy("priority", "document_id")).alias("place"), cx.estimated_tokens(F.col("text")).alias("tokens"), "document_id")
            rows = rows.join(self._page(sized.join(session.filled(sized, max_tokens), ["packet_id", "place"]).select("document_id")), "document_id", "left_semi")
        strong = anchors_.extracted(rows.select("document_id", "version", "text")).where("type != 'value'").groupBy("document_id").agg(F.collect_set("folded").alias("anchors"))
        items = rows.join(strong, "document_id", "left").select(F.lit(0).alias("packet_id"), F.col("document_id").alias("item_id"), F.col("subject_key").alias("subject"), "text", "anchors")
        links = docs.where("supersedes IS NOT NULL").select(F.col("document_id").alias("id"), "supersedes")
        pairs = self._page(feedback.possible_conflicts(items, links))
        both = pairs.select(F.col("left_id").alias("document_id"), F.col("right_id").alias("o")).union(pairs.select("right_id", "left_id"))
        out = rows.join(both.groupBy("document_id").agg(F.array_sort(F.collect_set("o")).alias("conflicts")), "document_id", "left")
        return out.select("document_id", "version", "relation", "distance", "created_at", "text", F.coalesce("conflicts", F.array().cast("array<bigint>")).alias("conflicts")).orderBy("created_at", "document_id")

    def traverse(self, document_id: int, direction: str = "after", limit: int = 16) -> DataFrame:
        """Documents of the same project next to one in order of (created_at, document_id)."""
        docs = self.documents()
        at = docs.where(F.col("document_id") == document_id).select(F.col("project"), F.col("created_at").alias("t"), F.col("document_id").alias("i"))
        here, there = F.struct("created_at", "document_id"), F.struct("t", "i")
        ahead = direction == "after"
        met = docs.join(at, "project").where(here > there if ahead else here < there)
        order = [F.asc("created_at"), F.asc("document_id")] if ahead else [F.desc("created_at"), F.desc("document_id")]
        return met.orderBy(*order).limit(limit).select("document_id", "created_at", F.substring("text", 1, 512).alias("snippet"))

    # Recall

    def locate(self, document_id: int, start: int, end: int, version: int | None = None, now: int | None = None, lease_ms: int = protection.LEASE_MS) -> str:
        """A signed locator of bytes of a version (the newest one if none is named). With now, a lease keeps the version until it runs out, and the locator asks for it."""
        if version is None:
            version = self.store.read("documents").where(F.col("document_id") == document_id).agg(F.max("version")).first()[0]
        lease = None
        if now is not None:
            lease = f"{document_id}:{version}:{now}"
            until = now + min(lease_ms, protection.MOST_LEASE_MS)
            self._appended("leases", self.spark.createDataFrame([(lease, document_id, version, now, until, True)], "owner_id string, document_id long, version int, seq long, until long, active boolean"))
        return sign_locator(self.secret, {"document_id": document_id, "version": version, "start": start, "end": end, "lease": lease})

    def release(self, locator: str, now: int) -> None:
        p = verify_locator(self.secret, locator)
        if p["lease"]:
            self._appended("leases", self.spark.createDataFrame([(p["lease"], p["document_id"], p["version"], now, now, False)], "owner_id string, document_id long, version int, seq long, until long, active boolean"))

    def recall(self, locator: str, now: int | None = None, neighbors: int | None = None, max_tokens: int = 4_000) -> DataFrame:
        """One row (document_id, version, start, end, content, status): the bytes that a signed locator names, or with neighbors the stored windows around them that fit the budget.

        status: superseded, expired, deleted, lease-expired, missing, locator-invalid (no such bytes) or resolved. Content is only given when resolved.
        """
        p = verify_locator(self.secret, locator)
        ask = self.spark.createDataFrame([(p["document_id"], p["version"], p["start"], p["end"])], "document_id long, version int, start long, end long")
        own = (F.col("document_id") == p["document_id"]) & (F.col("version") == p["version"])
        if neighbors is not None:
            wins = self.store.read("windows").where(own)
            at = segments.window_for_range(wins, ask).withColumn("neighbors", F.lit(neighbors)).withColumn("max_bytes", F.lit(4 * max_tokens))
            ask = segments.recall_windows(wins, at).select("document_id", "version", F.col("start_byte").alias("start"), F.col("end_byte").alias("end"))
        got = segments.read_range(self.store.read("chunks").where(own), ask)
        state = self.status(ask)
        lease = F.lit(None).cast("string")
        if p["lease"] and now is not None:
            rows = self._rows("leases", "owner_id string, document_id long, version int, seq long, until long, active boolean")
            found = protection.lease_status(rows, self.spark.createDataFrame([(p["lease"],)], "owner_id string"), now).first()["status"]
            lease = F.lit(None if found == "active" else "lease-expired").cast("string")
        met = ask.join(state, ["document_id", "version"], "left").join(got, ["document_id", "version", "start", "end"], "left")
        status = F.when(F.col("status").isin("superseded", "expired", "deleted"), F.col("status")).when(lease.isNotNull(), lease).when(F.col("status") != "resolved", F.col("status")).when(F.col("content").isNull(), "locator-invalid").otherwise("resolved")
        return met.withColumn("status", status).withColumn("content", F.when(F.col("status") == "resolved", F.col("content")))

    def evidence(self, locator: str, fenced: bool = False, **options) -> DataFrame:
        """recall() with rendered: the content within an envelope that marks it as quoted data."""
        got = self.recall(locator, **options).join(self.store.read("documents").select("document_id", "version", "created_at"), ["document_id", "version"], "left")
        render = cx.rendered_fenced if fenced else cx.rendered_json
        return got.withColumn("rendered", F.when(F.col("status") == "resolved", render(F.col("document_id"), F.col("created_at"), F.col("content"))))

    # Protection and retention

    def pin(self, pin_id: str, document_id: int, seq: int, active: bool = True) -> str:
        """pinned, already-pinned, unpinned or not-found."""
        asked = self.spark.createDataFrame([(pin_id, document_id, seq, active)], "pin_id string, document_id long, seq long, active boolean")
        status = protection.pin_status(self._rows("pins", "pin_id string, document_id long, seq long, active boolean"), asked).first()["status"]
        if status in ("pinned", "unpinned"):
            self._appended("pins", asked)
        return status

    def protect(self, owner_id: str, seq: int, document_id: int | None = None, session_id: str | None = None, until: int | None = None, active: bool = True) -> int:
        """Keeps a document or a session's documents for an owner until a time, or with active false lets go of them."""
        return self._appended("protections", self.spark.createDataFrame([(owner_id, document_id, session_id, seq, until, active)], "owner_id string, document_id long, session_id string, seq long, until long, active boolean"))

    def protected(self, now: int) -> DataFrame:
        return protection.protected(
            self.documents().withColumn("protect", F.coalesce("protect", F.lit(False))), now, self._rows("pins", "pin_id string, document_id long, seq long, active boolean"),
            self._rows("protections", "owner_id string, document_id long, session_id string, seq long, until long, active boolean"), self._rows("leases", "owner_id string, document_id long, version int, seq long, until long, active boolean"),
        )

    def renew(self, document_id: int, version: int, expires_at: int | None, generation: int) -> int:
        return self._appended("renewals", self.spark.createDataFrame([(document_id, version, generation, expires_at)], "document_id long, version int, generation int, expires_at long"))

    def expire(self, now: int, protected: DataFrame | None = None, batch: int = 100_000, forced: bool = False) -> int:
        """Retires up to batch documents that are due at now and that nothing keeps; returns how many."""
        kept = self.protected(now).select("document_id")
        kept = kept if protected is None else kept.union(protected.select("document_id"))
        renewals = self._rows("renewals", "document_id long, version int, generation int, expires_at long")
        due = protection.due(self.documents(), now, kept, renewals, forced).orderBy("expires_at", "document_id").limit(batch).select("document_id", "version")
        n = due.count()
        if n:
            self.retire(due, "expired")
        return n

    def redact(self, project: str, batch: int | None = None) -> int:
        """Retires a project's documents for good, kept or not; returns how many."""
        docs = self._scoped(self.store.read("documents"), project, None).select("document_id", "version").join(self.retired().where("status = 'deleted'"), ["document_id", "version"], "left_anti")
        docs = docs if batch is None else docs.orderBy("document_id", "version").limit(batch)
        n = docs.count()
        if n:
            self.retire(docs, "deleted")
        return n

    def collectable(self) -> DataFrame:
        """(chunk_id, bytes) of stored chunks that no version refers to that is still to be read: all but expired and deleted ones."""
        gone = self.retired().where("status IN ('expired', 'deleted')")
        kept = self.store.read("documents").select("document_id", "version").join(gone, ["document_id", "version"], "left_anti")
        return protection.unreferenced_chunks(self.store.read("chunks"), kept)

    def reclaim(self) -> int:
        """Rewrites the index without what no reader can ask for any more, and removes the old files; returns the bytes that this frees, 0 if another writer committed meanwhile.

        Texts, chunks, windows, signatures and anchors of expired and deleted versions go, and forward rows and postings of all versions that aren't live; statistics are folded. Nobody may be reading the old
        generations, so this is for times without searches.
        """
        since, generation = self.store.last_commit(), self.store.claim()
        hidden = self.retired().where("status IN ('expired', 'deleted')").select("document_id", "version").distinct()
        key = ["document_id", "version"]
        live = self.documents().select(*key)
        changes = {n: lambda t: t.join(hidden, key, "left_anti") for n in ("chunks", "windows", "signatures", "anchors", "relations")} | {n: lambda t: t.join(live, key, "left_semi") for n in ("forward", "postings", "vectors")}
        changes |= {"term_stats": stored.folded_terms, "corpus_stats": stored.folded_corpus, "blocks": lambda _: stored.blocks(self._written("postings", generation))}
        changes["documents"] = lambda t: t.join(hidden.withColumn("_gone", F.lit(True)), key, "left").withColumns({c: F.when(F.col("_gone").isNull(), F.col(c)) for c in ("text", "messages", "content_hash")}).drop("_gone")
        layout = {"postings": stored.LAYOUT, "blocks": {"order": ("bucket", "term")}, "term_stats": {"order": ("bucket", "term")}, "forward": {"order": tuple(key)}} | {"vectors": {"order": ("list",)}} | LAYOUTS
        replaces = {n: self.store.compact(n, change, generation, **layout.get(n, {})) for n, change in changes.items() if self.store.has(n)}
        if not self.store.commit(generation, lambda: not self.store.touched((*changes, "retired"), since), replaces):
            for n in replaces:
                self.store.delete(n, [generation])
            return 0
        made = sum(self.store.bytes(n, [generation]) for n in replaces)
        return sum(self.store.delete(n, old) for n, old in replaces.items()) - made

    def resolve_subject(self, project: str, subject_key: str) -> DataFrame:
        return lifecycle.live_subjects(self.documents()).where((F.col("project") == project) & (F.col("subject_key") == subject_key))

    # Hints

    def preflight(self, messages: DataFrame, now: int, project: str, days: dict[str, int], budget_tokens: int = 120) -> DataFrame:
        """(session_id, message_id, message_hash, outcome, reason, document_id, text, tokens) for user messages (session_id, message_id, text) that have no decision yet; the decisions are
        stored, and with them what was shown. Messages are few: one search each."""
        asked = messages.withColumn("message_hash", F.sha2("text", 256))
        stored = self._rows("hints", "session_id string, message_id long, message_hash string, outcome string, reason string, document_id long, text string, tokens long, at_ms long")
        fresh, conflicts = hints.frozen(asked, stored)
        if not conflicts.isEmpty():
            raise ValueError("a message with a stored decision was asked for again with another text")
        found = []
        for row in fresh.collect():  # user messages of one call
            best = self.candidates(row["text"], project, 2).orderBy(F.desc("norm"), "id").limit(2).collect()
            if best:
                top, plan = best[0], [v for _, v, _ in tx.planned(row["text"])]
                margin = top["norm"] - (best[1]["norm"] if len(best) > 1 else 0.0)
                n_words = round(top["coverage"] * len(tx.query_terms(row["text"])))
                found.append((row["message_id"], row["session_id"], top["id"], top["version"], top["mode"], n_words, top["coverage"], top["max_idf"], margin, plan or tx.query_terms(row["text"])[:n_words], now))
        schema = "message_id long, lineage string, document_id long, version int, mode string, words int, coverage double, max_idf double, margin double, anchors array<string>, at_ms long"
        pool = self.spark.createDataFrame(found, schema)
        judged = hints.eligible(pool, self.store.read("documents"), self.retired(), now, days)
        judged = hints.surfaced(judged, self._rows("exposures", "lineage string, document_id long, shown_ms long"))
        texts = self.documents().select("document_id", "version", "kind", "created_at", F.substring("text", 1, 280).alias("excerpt"))
        made = hints.decided(fresh, judged.join(texts, ["document_id", "version"], "left"), budget_tokens)
        out = fresh.select("session_id", "message_id", "message_hash").join(made, "message_id").withColumn("at_ms", F.lit(now)).select(*stored.columns)
        generation = self.store.claim()
        self.store.append("hints", out, generation)
        done = self.spark.read.parquet(f"{self.store.path}/hints/generation={generation}")
        self.store.append("exposures", done.where("document_id IS NOT NULL").select(F.col("session_id").alias("lineage"), "document_id", F.col("at_ms").alias("shown_ms")), generation)
        self.store.commit(generation)
        return done

    def statistics(self) -> DataFrame:
        return lexical.corpus_statistics(self.documents())

    def inventory(self) -> DataFrame:
        return protection.inventory({n: t for n in self.store.names() if (t := self._optional(n)) is not None})
