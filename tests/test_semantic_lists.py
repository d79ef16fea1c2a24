"""Search over spans: whole documents in exact search, lists by centroid, refilling, scopes, the engine's broadening."""

import random

import numpy as np
from pyspark.sql import functions as F

from strataspan import engine
from strataspan.operators import semantic

DOCS = "document_id long, version int, project string, session_id string, kind string, created_at long, text string"


def vectors(spark, rows):
    return spark.createDataFrame([("pq"[d % 2], d, 1, "s", o, 0, 1, (np.array(v) / np.linalg.norm(v)).tolist()) for d, o, v in rows], "project string, document_id long, version int, session_id string, ordinal int, start_byte long, end_byte long, vector array<double>")


def brute(rows, q, want, least):
    best = {}
    for d, o, v in rows:
        s = round(float(np.dot(v, q) / np.linalg.norm(v) / np.linalg.norm(q)), 6)
        if s >= least and s > best.get(d, (-2, 0))[0]:
            best[d] = (s, o)
    return [(d, o, s) for d, (s, o) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:want]]


def test_exact_and_lists(spark, monkeypatch):
    rng = np.random.default_rng(3)
    tops = rng.normal(size=(8, 12))
    rows = [(d, o, tops[d % 8] + 0.5 * rng.normal(size=12)) for d in range(120) for o in range(rng.integers(1, 5))]
    rows += [(500, o, tops[0] + 0.01 * rng.normal(size=12)) for o in range(400)]  # one document with more spans than any page
    monkeypatch.setattr(semantic, "BLOCK", 100)
    index = vectors(spark, rows).cache()
    asked = [tops[i % 8] + 0.4 * rng.normal(size=12) for i in range(24)] + [3 * tops[0]]
    queries = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(asked)] + [(90, [0.0] * 12), (91, None), (None, [1.0] * 12)], "query_id long, v array<double>")

    def got(df):
        out = {}
        for r in df.orderBy("query_id", "rank").collect():
            out.setdefault(r["query_id"], []).append((r["document_id"], r["ordinal"], r["score"]))
        return out

    exact = got(semantic.search(index, queries, 3, 0.5))
    assert exact == {i: b for i, v in enumerate(asked) if (b := brute(rows, v, 9, 0.5))} and len(exact[24]) == 9
    centres = semantic.fitted(index, 8)
    assert np.array_equal(centres, semantic.fitted(index.repartition(5), 8)) and centres.shape == (8, 12)
    listed = semantic.listed(index, centres).cache()
    assert listed.count() == len(rows) and listed.where("list IS NULL").isEmpty()
    near = got(semantic.probed(listed, centres, queries, 3, 0.5, 2))
    both = sum(len({d for d, *_ in near[i]} & {d for d, *_ in e}) for i, e in exact.items())
    assert both >= 0.9 * sum(map(len, exact.values())) and all(len(near[i]) == len(e) for i, e in exact.items())
    # a query that can't be filled from its lists gives what exact search gives; a scope is part of the scan
    assert got(semantic.probed(listed, centres, queries, 1000, 0.5, 1)) == got(semantic.search(index, queries, 1000, 0.5))
    odd = got(semantic.probed(listed.where("project = 'q'"), centres, queries, 3, 0.5, 2))
    assert all(d % 2 for own in odd.values() for d, *_ in own) and {i: len(x) for i, x in odd.items()} == {i: len(b) for i, v in enumerate(asked) if (b := brute([r for r in rows if r[0] % 2], v, 9, 0.5))}
    none = listed.limit(0)
    assert semantic.probed(none, centres, queries).isEmpty() and semantic.search(none, queries).isEmpty() and semantic.search(index, queries.limit(0)).isEmpty() and len(semantic.fitted(none, 4)) == 0


def test_engine_broadens(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "s"))
    rng = random.Random(2)
    words = [f"term{i}" for i in range(40)]
    docs = [(i, 1, "pq"[i % 2], "s", "turn", i * 1000, " ".join(rng.sample(words[10 * (i % 4) : 10 * (i % 4) + 10], 6))) for i in range(24)]
    e.admit(spark.createDataFrame(docs, DOCS))
    assert e.broadened("term1 term2", "p").isEmpty() and e.fit_semantic(4) == 4
    e.admit(spark.createDataFrame([(50, 1, "p", "s", "turn", 90_000, " ".join(words[:9]))], DOCS))
    got = [r["document_id"] for r in e.broadened(" ".join(words[:9]), "p", 10).orderBy("rank").collect()]
    assert got[0] == 50 and set(got) == {50, 0, 4, 8, 12, 16, 20}
    e.retire(spark.createDataFrame([(50, 1), (4, 1)], "document_id long, version int"), "deleted")
    assert {r["document_id"] for r in e.broadened(" ".join(words[:9]), "p", 10).collect()} == {0, 8, 12, 16, 20}
    found = {r["document_id"]: r["mode"] for r in e.search(" ".join(words[:9]), "p", broaden=True, snippet_chars=0).collect()}
    assert set(found) == {0, 8, 12, 16, 20} and set(found.values()) <= {"lexical", "semantic"}
    assert e.fit_semantic(2) == 2 and e.store.read("vectors").where(F.col("document_id") == 50).isEmpty()
