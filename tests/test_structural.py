"""Stored relations of messages, their places, lookup along a lineage, the structural tier of a search; the merge of a lineage's sessions."""

import random

from pyspark.sql import functions as F

from strataspan import engine
from strataspan.operators import context, structure

DOCS = "document_id long, version int, project string, session_id string, kind string, created_at long, text string, messages array<struct<role:string,score:int,text:string>>"


def merge(sessions, budget):
    """Brute force: a merge that holds the next row of every session, in order of the lineage, and reads on where it took one."""
    held, rest, out = {}, {k: sorted(v, reverse=True) for k, v in enumerate(sessions)}, []
    while True:
        for k in rest:
            if k not in held and rest[k] and budget:
                held[k], budget = rest[k].pop(0), budget - 1
        if not held:
            return out
        k = max(held, key=held.get)
        out.append((k, held.pop(k)[1]))


def test_merge_of_sessions(spark):
    rng = random.Random(5)
    sessions = {f"s{i}": [(rng.randrange(40), 1000 * i + j) for j in range(rng.choice([0, 1, 3, 30, 200]))] for i in range(12)}
    roots = {r: rng.sample(sorted(sessions), rng.choice([1, 3, 8, 12])) for r in range(15)}
    rows = spark.createDataFrame([(s, t, i) for s, own in sessions.items() for t, i in own] + [(None, 1, 1)], "session_id string, created_at long, id long")
    line = spark.createDataFrame([(r, s, d) for r, own in roots.items() for d, s in enumerate(own)] + [(0, roots[0][0], 9)], "root int, session_id string, depth int")
    for budget in (1, 5, 9, 40, 10_000):
        got = {}
        for r in context.merged_newest(rows, line, budget).orderBy("root", "rank").collect():
            got.setdefault(r["root"], []).append((roots[r["root"]].index(r["session_id"]), r["id"]))
            assert r["rank"] == len(got[r["root"]])
        assert got == {r: m for r, own in roots.items() if (m := merge([sessions[s] for s in own], budget))}
    assert context.merged_newest(rows.limit(0), line, 3).isEmpty() and context.merged_newest(rows, line.limit(0), 3).isEmpty()


def test_places_in_order():
    raw = "aa naïve aa bb aa".encode()
    assert structure.message_places(raw, [b"aa", b"aa", b"aa"]) == [(0, 2), (10, 12), (16, 18)]
    assert structure.message_places(raw, ["naïve".encode(), b"aa"]) == [(3, 9), (10, 12)]
    assert structure.message_places(raw, [b"bb", "naïve".encode()]) is None and structure.message_places(raw, [b""]) is None and structure.message_places(b"aaa", [b"aa", b"aa"]) is None
    long = b"x" * 3_000_000 + b"needle" + b"y" * 3_000_000
    assert structure.message_places(long, [b"needle", b"yyy"]) == [(3_000_000, 3_000_006), (3_000_006, 3_000_009)]


def document(i, session, turns, kind="turn", text=None, created=None):
    text = "\n".join(f"[{r}] {t}" for r, t in turns or ()) if text is None else text
    return (i, 1, "p", session, kind, i * 1000 if created is None else created, text, None if turns is None else [(r, 0, t) for r, t in turns])


def asked(spark, relation, query=""):
    return spark.createDataFrame([(0, relation, structure.words(query))], "query_id int, relation string, asked_words array<string>")


def test_lookup(spark):
    docs = spark.createDataFrame([
        document(1, "old", [("user", "what is the cache size?"), ("assistant", "it is 5 naïve units")]), document(2, "new", [("user", "please fix the cache"), ("assistant", "done"), ("tool", "noise"), ("assistant", "fixed the cache")]),
        document(3, "new", [("user", "missing one")], text="nothing of it"), document(4, "old", None, text="an old text on cache"), document(5, "new", None, kind="decision-candidate", text="we chose redis"), document(6, "new", None, kind="manual", text="cache"),
        document(7, "z", [("user", None), ("assistant", "")]), document(8, None, [], text=""),
    ], DOCS)
    rows = structure.stored_relations(docs.repartition(3)).cache()
    assert rows.schema.simpleString() == spark.createDataFrame([], structure.ROWS).schema.simpleString()
    texts = {r["document_id"]: r["text"].encode() for r in docs.collect()}
    at = {(r["document_id"], r["message"]): texts[r["document_id"]][r["start_byte"] : r["end_byte"]].decode() for r in rows.collect()}
    assert at[1, 1] == "it is 5 naïve units" and at[2, 3] == "fixed the cache" and at[4, 0] == "an old text on cache" and {d for d, _ in at} == {1, 2, 4, 5}
    line = spark.createDataFrame([(0, "new", 0), (0, "old", 1)], "query_id int, session_id string, depth int")

    def got(*a, lineage=line, limit=3):
        return [(r["document_id"], r["message"], r["confidence"], r["status"]) for r in structure.lookup(rows, asked(spark, *a), lineage, limit).orderBy("rank").collect()]

    # the last answer of each document first, the nearest session before; the legacy text is newer than the best row, so it comes second
    assert got("latest-answer") == [(2, 3, 100, "ambiguous"), (4, 0, 0, "ambiguous"), (1, 1, 100, "ambiguous")]
    assert got("latest-answer", "naïve") == [(1, 1, 100, "ambiguous")]
    assert got("latest-answer", lineage=line.where("depth = 0")) == [(2, 3, 100, "resolved"), (2, 1, 75, "resolved")]
    assert got("latest-question", "size")[0] == (1, 0, 100, "ambiguous") and got("latest-correction") == [(4, 0, 0, "legacy-fallback")]
    assert got("latest-decision", "redis") == [(5, 0, 100, "resolved")] and got("latest-answer", "absent") == [] and got("no-such") == []
    assert got("latest-answer", lineage=None, limit=1) == [(2, 3, 100, "ambiguous")]
    assert structure.lookup(rows.limit(0), asked(spark, "latest-answer"), line).isEmpty()


def test_structural_tier_of_a_search(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "s"))
    only = {"chunks": engine.HANDLERS["chunks"]}
    docs = [document(i, f"s{i % 2}", [("user", f"please deploy service{i}"), ("assistant", f"deploy of service{i} done")]) for i in range(4)]
    e.admit(spark.createDataFrame(docs, DOCS))
    got = e.search("deploy service3", "p", relation="latest-request", sessions=["s1", "s0"]).collect()
    assert [(r["document_id"], r["mode"]) for r in got][:2] == [(3, "structural"), (1, "structural")] and "[please deploy service3]" in got[0]["snippet"]
    assert e.related("latest-answer", "", "p", ["s0"]).first()["status"] == "resolved" and e.related("latest-answer", "", "p").first()["status"] == "ambiguous"
    e.retire(spark.createDataFrame([(3, 1)], "document_id long, version int"), "deleted")
    assert [r["document_id"] for r in e.related("latest-answer", "", "p", ["s1"]).collect()] == [1]
    assert e.reclaim() > 0 and e.store.read("relations").where("document_id = 3").isEmpty()
    plain = engine.Engine(spark, str(tmp_path / "t"))
    plain.admit(spark.createDataFrame(docs, DOCS), only)
    assert plain.related("latest-answer").isEmpty()
