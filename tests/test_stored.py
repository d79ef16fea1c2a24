"""The stored lexical index: statistics that follow deletes, bounds, places, pruning; commits of several writers; reclaiming."""

import os
import random
import threading

import pytest
from pyspark.sql import functions as F

from strataspan import engine
from strataspan.functions import text as tx
from strataspan.operators import bm25f, stored
from strataspan.sources.tables import TableStore

SCHEMA = "document_id long, project string, session_id string, kind string, created_at long, text string, subject_key string"
MESSAGES = "array<struct<role:string,score:int,text:string>>"


def rows(spark, docs):
    df = spark.createDataFrame([(i, 1, p, i * 1000, "turn", t) for i, p, t in docs], "document_id long, version int, project string, created_at long, kind string, text string")
    return df.withColumn("messages", F.lit(None).cast(MESSAGES))


def asked(spark, queries):
    return spark.createDataFrame([(i, t) for i, q in enumerate(queries) for t in tx.query_terms(q)], "query_id int, term string")


def corpus(n, seed=1):
    rng = random.Random(seed)
    vocab = ["fox", "dog", "running", "cache", "redis", "fooBar", "naïve", "Größe", "日本", "snake_case"] + [f"word{i}" for i in range(60)]
    return [(i, "pq"[i % 2], " ".join(rng.choice(vocab[: 5 + i % 66]) for _ in range(rng.choice([0, 3, 20, 300])))) for i in range(n)]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    at, docs = str(tmp_path_factory.mktemp("index")), corpus(150)
    store = TableStore(spark, at)
    store.append("forward", stored.forward(rows(spark, docs), 50, 40), 0)
    store.publish(0)
    fwd = store.read("forward")
    store.append("postings", stored.postings(fwd), 0, **stored.LAYOUT)
    return docs, store, fwd, store.read("postings")


QUERIES = ["running foxes", "redis cache word3 word50", "foo bar naïve größe", "日本 snake case fox", "nothing here"]


def found(df):
    return sorted(map(str, df.collect()))


def test_skipping_and_deltas(spark, index):
    docs, store, fwd, post = index
    block, ask = stored.blocks(post).cache(), asked(spark, QUERIES).cache()
    terms, sums = stored.term_deltas(fwd, 1), stored.corpus_deltas(fwd, 1)
    for k in (1, 5, 1000):
        assert found(stored.search(post, block, terms, sums, ask, k)) == found(stored.search(post, block, terms, sums, ask, k, skip=False))
    lens = fwd.select("project", "document_id", "version", "ordinal", "wlen")
    assert found(stored.search(post, block, terms, sums, ask, 7).drop("match_start", "match_end")) == found(bm25f.search(post, lens, ask, 7))
    # what is taken away: the same as an index that never had it, though its postings and blocks are still there
    gone = spark.createDataFrame([(i, 1) for i, *_ in docs if i % 3], "document_id long, version int")
    lost, key = fwd.join(gone, ["document_id", "version"], "left_semi"), ["document_id", "version"]
    left = stored.search(post, block, terms.unionByName(stored.term_deltas(lost, -1)), sums.unionByName(stored.corpus_deltas(lost, -1)), ask, 7, live=fwd.select(*key).join(gone, key, "left_anti"))
    fresh = fwd.join(gone, key, "left_anti")
    own = stored.postings(fresh)
    assert found(left) == found(stored.search(own, stored.blocks(own), stored.term_deltas(fresh, 1), stored.corpus_deltas(fresh, 1), ask, 7))
    none = stored.folded_corpus(sums.unionByName(stored.corpus_deltas(fwd, -1)))
    assert none.isEmpty() and stored.folded_terms(terms.unionByName(stored.term_deltas(fwd, -1))).isEmpty()
    read = stored.bounds(block, stored.weights(terms, sums, ask), ask)
    assert read.where("bound + rest < 1e-9").isEmpty() and read.count() > 20


def test_places_are_those_of_the_text(spark, index):
    docs, store, fwd, post = index
    texts = {i: t for i, _, t in docs}
    got = {}
    for r in post.select("document_id", "ordinal", "term", "tf", stored.places(F.col("gaps")).alias("at")).collect():
        raw = texts[r["document_id"]].encode()
        assert r["tf"] == len(r["at"])
        for a, b in r["at"]:
            assert r["term"] in bm25f.terms_of(raw[a:b].decode(), {})
            got.setdefault((r["document_id"], r["term"]), set()).add((a, b))
    for i, t in texts.items():
        for m in tx._WORD.finditer(t):
            span = (len(t[: m.start()].encode()), len(t[: m.end()].encode()))
            assert all(span in got[i, term] for term in bm25f.terms_of(m.group(), {}))


def scanned(spark, make):
    """(files, bytes) that the scans of a plan read."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that the plan's leaves are its scans
    try:
        df = make()
        df._jdf.collectToPython()
        leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
        metrics = [leaves.apply(i).metrics() for i in range(leaves.size())]
        return tuple(sum(m.apply(name).value() for m in metrics if m.contains(name)) for name in ("numFiles", "filesSize"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_search_reads_the_folders_of_its_buckets(spark, index):
    _, store, _, post = index
    every, size = scanned(spark, lambda: store.read("postings").groupBy().sum("tf"))
    buckets = [r[0] for r in asked(spark, ["redis"]).select(bm25f.bucket(F.col("term"))).distinct().collect()]
    one, least = scanned(spark, lambda: store.read("postings").where(F.col("bucket").isin(buckets)).groupBy().sum("tf"))
    assert one == len(buckets) == 1 and every > 20 and 0 < least < size / 5


def test_limits_are_reported(spark):
    long = " ".join(f"w{i}" for i in range(5000))
    got = {r["document_id"]: (r["status"], r["reason"]) for r in stored.forward(rows(spark, [(1, "p", long), (2, "p", None), (3, "p", "a b")])).collect()}
    assert got == {1: ("skipped", "term-windows"), 2: ("complete", None), 3: ("complete", None)}


def test_two_writers_lose_nothing(spark, tmp_path):
    stores = [TableStore(spark, str(tmp_path / "s")) for _ in range(4)]
    held = []

    def write(k):
        for i in range(3):
            g = stores[k].claim()
            stores[k].append("t", spark.createDataFrame([(k, i)], "k int, i int"), g)
            held.append(stores[k].commit(g))

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert all(held) and sorted(map(tuple, stores[0].read("t").select("k", "i").collect())) == [(k, i) for k in range(4) for i in range(3)]
    assert sorted(stores[1].commits()) == list(range(12))
    # what is claimed and not committed isn't seen, though later generations are
    lost, kept = stores[0].claim(), stores[1].claim()
    for g in (lost, kept):
        stores[0].append("t", spark.createDataFrame([(9, g)], "k int, i int"), g)
    stores[1].commit(kept)
    assert [r["i"] for r in stores[2].read("t").where("k = 9").collect()] == [kept]
    assert not stores[0].commit(lost, lambda: False) and stores[3].touched(["t"], 11) and not stores[3].touched(["other"], 11)


def test_one_of_two_conflicting_commits_wins(spark, tmp_path):
    a, b = (engine.Engine(spark, str(tmp_path / "s")) for _ in range(2))
    rec = spark.createDataFrame([(1, "x")], "document_id long, note string")
    # b commits the same key between a's check and a's commit
    plain, once = a.store.commit, []

    def raced(generation, check=None, replaces=None):
        if not once:
            once.append(b.commit("notes", rec, "rb", must_be_absent=rec))
        return plain(generation, check, replaces)

    a.store.commit = raced
    assert a.commit("notes", rec, "ra", must_be_absent=rec) == "conflict" and once == ["committed"]
    assert b.store.read("notes").count() == 1
    assert a.commit("notes", spark.createDataFrame([(2, "y")], rec.schema), "rc", must_match=rec) == "committed"
    assert a.commit("notes", rec, "rd", must_match=spark.createDataFrame([(1, "z")], rec.schema)) == "conflict"


def test_engine_follows_deletes_and_reclaims(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "s"))
    docs = [(i, "p", "s", "turn", i * 1000, f"hidden{i} fox number{i % 4} " + "fox " * i + "cache", None) for i in range(8)]
    e.admit(spark.createDataFrame(docs, SCHEMA))
    e.admit(spark.createDataFrame([(7, "p", "s", "turn", 9000, "a fox of the second version", None)], SCHEMA))
    gone = spark.createDataFrame([(i, 1) for i in range(5)], "document_id long, version int")
    e.retire(gone, "deleted")
    e.retire(gone, "deleted")  # counts once

    def scores():
        return {r["id"]: r["norm"] for r in e.candidates("fox cache", "p").collect()}

    live = e.documents().withColumn("messages", F.lit(None).cast(MESSAGES))
    fwd = stored.forward(live).cache()
    post = stored.postings(fwd)
    fresh = stored.search(post, stored.blocks(post), stored.term_deltas(fwd, 1), stored.corpus_deltas(fwd, 1), asked(spark, ["fox cache"]))
    exp = {r["document_id"]: r["normalized"] for r in fresh.collect()}
    assert scores() == exp and set(exp) == {5, 6, 7}

    def holds(word):
        return any(word.encode() in spark.read.format("binaryFile").load(os.path.join(d, f)).first()["content"] for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))

    assert holds("hidden1") and e.reclaim() > 0 and not holds("hidden1") and holds("hidden5")
    assert scores() == exp and e.get(1).first()["status"] == "deleted" and e.get(7, 1).first()["text"].startswith("hidden7")
    shown = {r["document_id"]: (r["mode"], r["snippet"]) for r in e.search("second version", "p").collect()}
    assert shown[7] == ("lexical", "a fox of the [second] version")
