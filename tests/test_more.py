"""Operators of the stored indexes, protection, feedback, sessions, semantic search and evaluation, on small fixtures."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataspan.functions import columns as cx
from strataspan.functions import text as tx
from strataspan.operators import anchors, bm25f, evaluation, exact, feedback, hints, protection, ranking, segments, semantic, session
from strataspan.streaming import outbox


def chains_in_order(events):
    """Reformulation chains by walking the events: what a hit ends, it ends in all sessions."""
    open_, out = {}, set()
    for seq, key, hit, sessions in sorted(events):
        for s in dict.fromkeys(sessions):
            own = open_.setdefault(s, {})
            if not hit:
                own[key] = (seq, sessions)
                continue
            for k, (miss, where) in list(own.items()):
                if k != key:
                    out.add((miss, seq, k, key))
                for w in where:
                    if open_.get(w, {}).get(k, (None,))[0] == miss:
                        del open_[w][k]
    return out


def test_reformulations_against_a_walk(spark):
    rng = random.Random(5)
    events = [(i, rng.choice("abcd"), rng.random() < 0.3, rng.sample(["s1", "s2", "s3", "s4"], rng.randrange(0, 4))) for i in range(300)]
    df = spark.createDataFrame(events, "seq long, query_key string, hit boolean, sessions array<string>")
    chains = feedback.reformulations(df)
    assert {tuple(r) for r in chains.collect()} == chains_in_order(events)
    assert feedback.chain_rate(df, chains).first()["events"] == 300


def test_bm25f_fields_and_windows(spark):
    messages = [{"role": "user", "score": 10, "text": "red fox"}, {"role": "assistant", "score": 90, "text": "blue foxes"}]
    docs = spark.createDataFrame(
        [(1, 1, "p", 5, "turn", "red fox\n-- tool red\nblue foxes", messages), (2, 1, "p", 6, "decision-candidate", "red", None), (3, 1, "p", 7, "turn", None, None)],
        "document_id long, version int, project string, created_at long, kind string, text string, messages array<struct<role:string,score:int,text:string>>",
    )
    tokens = {r["document_id"]: [(t["term"], t["w"]) for t in r["tokens"]] for r in bm25f.field_tokens(docs).collect()}
    assert tokens[1] == [("red", 2.25), ("fox", 2.25), ("tool", 0.4), ("red", 0.4), ("blue", 2.5), ("fox", 2.5)] and tokens[2] == [("red", 2.5)] and tokens[3] == []
    wins = bm25f.windows(bm25f.field_tokens(docs).join(docs.select("document_id", "project", "created_at"), "document_id"), size=4, step=3)
    assert sorted((r["document_id"], r["ordinal"], round(r["wlen"], 6)) for r in wins.collect()) == [(1, 0, 5.3), (1, 1, 5.4), (2, 0, 2.5), (3, 0, 0.0)]
    post, asked = bm25f.postings(wins), spark.createDataFrame([(0, "red"), (0, "none")], "query_id int, term string")
    got = bm25f.search(post, bm25f.lengths(wins), asked).collect()
    assert [r["document_id"] for r in got] == [2, 1] and got[0]["coverage"] == 0.5
    gone = spark.createDataFrame([(2, 1)], "document_id long, version int")
    assert [r["document_id"] for r in bm25f.search(post, bm25f.lengths(wins), asked, retired=gone).collect()] == [1]
    assert {r["status"] for r in bm25f.index_status(wins).collect()} == {"complete"}
    assert bm25f.located("ab ab c", ["ab", "ab", "x", "c"]) == [(0, 2), (3, 5), None, (6, 7)]


def test_exact_two_passes(spark):
    docs = spark.createDataFrame([(1, 1, "see src/A.py and DEADBEEF12"), (2, 1, "see src/a.py"), (3, 1, "fooBar src/A.py")], "document_id long, version int, text string")
    post = exact.postings(anchors.extracted(docs))

    def ask(query, retired=None):
        return [(r["document_id"], r["exact"], r["matched"], r["coverage"]) for r in exact.lookup(post, exact.plan(spark, [(0, query)]), retired).orderBy("rank").collect()]

    assert ask("src/A.py") == [(1, True, 1, 1.0), (3, True, 1, 1.0)] and ask("SRC/A.PY") == [(1, False, 1, 1.0), (2, False, 1, 1.0), (3, False, 1, 1.0)]
    assert ask("deadbeef12") == [(1, True, 1, 1.0)] and ask("fooBar in src/A.py")[0] == (3, True, 3, 1.0)  # the path holds a dotted name too
    gone = spark.createDataFrame([(1, 1)], "document_id long, version int")
    assert ask("src/A.py", gone) == [(3, True, 1, 1.0)] and exact.expired(post, exact.plan(spark, [(0, "src/A.py")]), gone).first()["n_expired"] == 1


def test_ranges_and_windows(spark):
    text = "aé日😀z" * 40
    docs = spark.createDataFrame([(1, 1, text), (1, 2, "other")], "document_id long, version int, text string")
    cut = segments.physical_chunks(docs, 64, 16)
    rng, raw = random.Random(3), text.encode()
    spans = sorted({tuple(sorted(rng.sample(range(len(raw)), 2))) for _ in range(40)})
    asked = spark.createDataFrame([(1, 1, a, b) for a, b in spans], "document_id long, version int, start long, end long")

    def inner(a, b):
        while a < b and raw[a] & 0xC0 == 0x80:
            a += 1
        return raw[a:b].decode(errors="ignore")

    assert {(r["start"], r["end"]): r["content"] for r in segments.read_range(cut, asked).collect()} == {(a, b): inner(a, b) for a, b in spans}
    wins = spark.createDataFrame([(1, 1, i, 100 * i, 100 * i + 120) for i in range(6)], "document_id long, version int, ordinal int, start_byte long, end_byte long")
    ask = spark.createDataFrame([(1, 1, 2, 2, 1000), (1, 1, 3, 2, 330), (1, 1, 0, 1, 50)], "document_id long, version int, ordinal int, neighbors int, max_bytes long")
    got = sorted((r["ordinal"], r["first"], r["last"]) for r in segments.recall_windows(wins, ask).collect())
    assert got == [(0, 0, 0), (2, 0, 4), (3, 2, 4)]
    c = spark.range(1).select(segments.clipped(F.lit(100), F.lit(400), F.lit(1000), 100).alias("c"), segments.clipped(F.lit(0), F.lit(50), F.lit(60), 100).alias("d")).first()
    assert tuple(c["c"]) == (200, 300) and tuple(c["d"]) == (0, 50)


def test_retention_run_and_purge(spark):
    docs = spark.createDataFrame([(i, 1, "p", "s", "tool-result", i) for i in range(5)], "document_id long, version int, project string, session_id string, kind string, created_at long")
    now, none = 15 * ranking.DAY_MS, spark.createDataFrame([], "document_id long")
    taken, state = protection.retention_run(docs, now, none, 2)
    assert [r["document_id"] for r in taken.collect()] == [0, 1] and tuple(state.first()) == ("more-work", 2, 3)
    assert protection.retention_run(docs, now, docs.select("document_id"), 2)[1].first()["status"] == "blocked" and protection.retention_run(docs, 0, none, 2)[1].first()["status"] == "complete"
    assert [r["project"] for r in protection.purgeable(docs, docs.select("document_id", "version")).collect()] == ["p"]


def test_hint_decisions(spark):
    schema = "message_id long, document_id long, kind string, mode string, words int, coverage double, max_idf double, margin double, anchors array<string>, excerpt string, created_at long, reason string, seen boolean"
    base = ("turn", "lexical", 3, 0.9, 0.9, 0.5, ["a"], "x" * 900, 0)
    rows = [(1, 10, *base, None, False), (2, 10, *base, None, False), (3, 10, *base, "retention-policy", False), (4, 10, *base, None, True), (5, 10, "turn", "lexical", 1, 0.9, 0.9, 0.5, ["a"], "x", 0, None, False), (6, 10, "turn", "lexical", 3, 0.9, 0.9, 0.05, ["a"], "x", 0, None, False)]
    messages = spark.createDataFrame([(1, "what did we say earlier"), (2, "tell me more on a"), (3, "earlier"), (4, "earlier"), (5, "earlier"), (6, "earlier"), (7, "no candidate")], "message_id long, text string")
    got = {r["message_id"]: (r["outcome"], r["reason"], r["tokens"]) for r in hints.decided(messages, spark.createDataFrame(rows, schema), 120).collect()}
    assert got[1][:2] == ("historical-snippet", "explicit-history-strong-evidence") and 0 < got[1][2] <= 120
    assert {k: v[:2] for k, v in got.items() if k > 1} == {2: ("continuity-marker", "implicit-concept-continuity"), 3: ("suppress", "retention-policy"), 4: ("suppress", "source-cooldown"), 5: ("suppress", "weak-evidence"), 6: ("continuity-marker", "ambiguous-history-continuity"), 7: ("suppress", "no-candidate")}
    line = spark.createDataFrame([("s", "p", 1), ("s", "q", 2)], "session_id string, ancestor_id string, depth int")
    stored = spark.createDataFrame([("p", 1, "h1"), ("q", 1, "h2")], "session_id string, message_id long, text string")
    assert hints.from_lineage(spark.createDataFrame([("s", 1)], "session_id string, message_id long"), stored, line).first()["text"] == "h1"
    assert hints.removed(stored, stored.where("session_id = 'p'")).count() == 1


def test_session_walk(spark):
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", 50) for i in range(12)]
    states = session.epochs(spark.createDataFrame(rows, "conv_id long, turn long, role string, tokens long"), rotation_tokens=250, retain_turns=1, reserve=50)
    got = [(r["turn"], r["epoch"], r["archived_at"]) for r in states.orderBy("turn").collect()]
    assert got == [(i, i // 4, i // 4 + 1 if i < 8 else None) for i in range(12)]
    messages = spark.createDataFrame([(c, t, r, f"line {t}") for c, t, r, _ in rows], "conv_id long, turn long, role string, text string")
    parts = session.checkpoints(messages, states).orderBy("epoch").collect()
    assert [r["n_messages"] for r in parts] == [4, 4] and parts[0]["text"].startswith("[user]\nline 0\n\n[assistant]\nline 1\n\n[user]") and parts[0]["topic"] == "line 0"
    bad = spark.createDataFrame([("assistant", "error", " "), ("assistant", "error", "x"), ("user", None, None)], "role string, stop_reason string, text string")
    assert session.without_empty_errors(bad).count() == 2


def test_semantic_index(spark):
    docs = spark.createDataFrame([(1, 1, "p", "s", "the database migration was slow " * 40), (2, 1, "p", "s", "garden flowers bloom"), (3, 1, "q", "s", ""), (4, 1, "q", "s", None)], "document_id long, version int, project string, session_id string, text string")
    index = semantic.indexed(docs)
    rows = index.collect()
    assert {r["document_id"] for r in rows} == {1, 2} and all(abs(np.linalg.norm(r["vector"]) - 1) < 1e-9 for r in rows) and len(rows) == 3
    asked = spark.createDataFrame([(7, semantic.hashed_words()(["database migration slow"])[0].tolist()), (8, [0.0] * semantic.DIMENSIONS), (9, None)], "query_id long, v array<double>")
    got = semantic.search(index, asked, 2).collect()
    assert [(r["query_id"], r["document_id"], r["ordinal"]) for r in got] == [(7, 1, 0)]
    assert [tuple(r) for r in semantic.maintenance(index, docs.where("document_id = 2")).collect()] == [("p", 3, 2, False)]
    assert semantic.rebuilt(index, docs.where("document_id = 2")).count() == 1 and semantic.without_project(index, "p").count() == 0


def test_nearest_takes_bad_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, []), (None, [1.0, 0.0])], "id long, v array<double>")
    assert [(r["query_id"], r["vec_id"]) for r in ranking.nearest(df, df).orderBy("query_id").collect()] == [(1, 2), (2, 1)]


def test_evaluation(spark):
    docs = evaluation.documents_for_timing(spark, 1001).select("document_id", F.length("text").alias("n")).collect()
    assert [r["n"] for r in docs[:2]] == [160, 160] and docs[999]["n"] == 10 << 10
    base = spark.createDataFrame([(1, 5, 10), (2, 1, 20)], "query_id int, rank int, document_id int")
    rel = spark.createDataFrame([(1, 10), (2, 20)], "query_id int, document_id int")
    assert evaluation.compared_rankings(base, base.withColumn("rank", F.lit(1)), rel).first()["take"] and not evaluation.compared_rankings(base, base, rel).first()["take"]
    wins = spark.createDataFrame([(1, 1, 10, 0, 100), (2, 4, 20, 0, 100)], "query_id int, rank int, document_id int, start_byte int, end_byte int")
    want = spark.createDataFrame([(1, 10, 5, 50), (2, 20, 5, 50)], "query_id int, document_id int, start int, end int")
    assert tuple(evaluation.window_rate(wins, want).first()) == (2, 0.5)


def test_columns(spark):
    row = spark.range(1).select(
        cx.query_key(F.lit("  A \n b  ")).alias("key"), cx.response_mode(F.array(F.lit("a"), F.lit("b"), F.lit("a"))).alias("mode"), cx.mode_score(F.lit("structural"), F.lit(85)).alias("score"),
        cx.strong_lexical(F.lit(3), F.lit(0.6), F.lit(0.1), F.lit(True)).alias("strong"), cx.ambiguous(F.lit(0.1)).alias("amb"), cx.semantic_identifier(F.lit(" a\x01")).alias("bad"),
        cx.rendered_fenced(F.lit(1), F.lit(0), F.lit("a ```` b")).alias("fence"), cx.staleness(F.lit(3 * 86_400_000)).alias("old"), cx.workflow_reuse(F.lit("do it like we did before")).alias("flow"), cx.contains_term(F.lit("A-b c"), F.array(F.lit("a-b"))).alias("has"),
    ).first()
    assert (row["key"], row["mode"], row["score"], row["strong"], row["amb"], row["bad"], row["old"], row["flow"], row["has"]) == ("a b", "hybrid", 0.85, True, True, None, "3 days old", True, True)
    assert "`````" in row["fence"] and "``````" not in row["fence"]
    assert (cx.pool_size(10), cx.pool_size(50, wide=True), cx.pool_size(5, rerank=True), cx.recall_scope("auto", "auto", "project"), cx.recall_scope("project", "session"), cx.recall_scope()) == (30, 200, 40, "project", "session", "session")


@pytest.mark.parametrize("slide", [None, "30 minutes"])
def test_hourly_stream(spark, tmp_path, slide):
    def put(rows):
        spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0)])
    schema = spark.read.parquet(f"{tmp_path}/in").schema

    def run():
        out = outbox.hourly(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), slide=slide)
        write = out.writeStream.foreachBatch(lambda b, i: b.select("window.start", "n").write.mode("append").parquet(f"{tmp_path}/out")).outputMode("append")
        write.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)

    run()
    put([("2024-01-01 05:00:00", "a", 1.0)])
    run()
    put([("2024-01-01 00:20:00", "a", 9.0), ("2024-01-01 09:00:00", "a", 1.0)])  # the first is later than the watermark
    run()
    got = {str(r["start"]): r["n"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got["2024-01-01 00:00:00"] == 2 and (slide is None or got["2024-01-01 00:30:00"] == 1)


def test_ring_and_idempotent(spark, tmp_path):
    e = spark.createDataFrame([("p", i) for i in range(5)] + [("q", 1)], "project string, seq int")
    assert sorted((r["project"], r["seq"]) for r in feedback.ring(e, 2).collect()) == [("p", 3), ("p", 4), ("q", 1)]
    spark.createDataFrame([("r1", "2024-01-01 00:00:00"), ("r1", "2024-01-01 00:00:01"), ("r2", "2024-01-01 00:00:02")], "request_id string, ts string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/in")
    stream = outbox.idempotent(spark.readStream.schema("request_id string, ts timestamp").parquet(f"{tmp_path}/in"))
    stream.writeStream.format("memory").queryName("once").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == 2


def test_conflicts_by_anchor_and_link(spark):
    items = spark.createDataFrame([(1, 1, None, "we decided to use it", ["src/a.py"]), (1, 2, None, "we chose B instead of A", ["src/a.py"]), (1, 3, None, "we will not do it, decided", ["other"])], "packet_id int, item_id int, subject string, text string, anchors array<string>")
    assert [tuple(r) for r in feedback.possible_conflicts(items).collect()] == [(1, 1, 2)]
    assert feedback.possible_conflicts(items, spark.createDataFrame([(2, 1)], "id int, supersedes int")).isEmpty()


def test_tiers_and_boosts(spark):
    pool = spark.createDataFrame([(0, "lexical", i, 0.9 - i / 10) for i in range(4)], "query_id int, mode string, id int, norm double")
    ex = spark.createDataFrame([(0, 2, 0.99)], "query_id int, id int, score double")
    none = spark.createDataFrame([], "query_id int, id int, score double")
    assert [r["id"] for r in ranking.tiered(ex, none, pool, 3).orderBy("rank").collect()] == [2, 0, 1]
    up = ranking.demoted(pool, spark.createDataFrame([(3, 1.5)], "id int, factor double"))
    assert up.where("id = 3").first()["norm"] == 0.9
    assert [r["margin"] for r in ranking.margins(pool).orderBy("id").collect()] == [0.1, 0.1, 0.1, 0.6]
    assert tx.query_terms("What is the running server") == ["run", "server"]
