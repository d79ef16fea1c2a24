"""Findings of the fourth review."""

import random

import numpy as np

import __spark_entry__
from strataspan.functions import text as tx
from strataspan.operators import analysis, lexical, ranking, semantic, simhash
from test_round3 import rows_of

DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_rows_of_one_id_are_put_together_apart(spark, tmp_path):
    """Repeated ids with other or equal texts, ids beyond doubles beside null ones, null, empty and long texts."""
    big = (1 << 53) + 1
    texts = [(1, "a\n" * 3000), (1, "é" * 5000), (1, "é" * 5000), (2, None), (2, ""), (3, ""), (big, "x"), (None, "y"), (None, None)]
    got, want = rows_of(spark, tmp_path, "chunks_reconstructed", {"documents": ([(i, x, "en", "s") for i, x in texts], DOCUMENTS)})
    assert got == want and len(got) == len(texts)


def written(spark, tmp_path, **tables):
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{t}.parquet")
    return str(tmp_path)


def test_stemmed_queries_ask_for_all_terms(spark, tmp_path):
    """The word that only one document has stands behind more terms than were asked for once."""
    words = [f"w{i}" for i in range(40)]
    docs = [(1, words[0], "en", "s"), (2, "Stations " + words[39], "en", "s"), (3, "else", "en", "s")]
    at = written(spark, tmp_path, documents=(docs, DOCUMENTS), benchmark=([(7, " ".join(words) + " station")], "item_id long, text string"))
    got = {r["document_id"]: r["coverage"] for r in __spark_entry__.queries()["bm25_porter_topk"](spark, at).collect()}
    assert got == {1: round(1 / 41, 6), 2: round(2 / 41, 6)}


def test_semantic_queries_are_whole_texts(spark, tmp_path):
    """Documents are like the beginning and the end of a text that is longer than a span."""
    first, last = [" ".join(f"{c}{i}" for i in range(60)) for c in ("alpha", "omega")]
    middle = "filler " * 200
    at = written(spark, tmp_path, documents=([(1, first, "en", "s"), (2, last, "en", "s")], DOCUMENTS), benchmark=([(7, f"{first} {middle} {last}"), (8, None)], "item_id long, text string"))
    got = __spark_entry__.queries()["semantic_search"](spark, at).collect()
    assert {(r["query_id"], r["document_id"]) for r in got} == {(7, 1), (7, 2)}
    q, d = semantic.hashed_words()([f"{first} {middle} {last}", last])
    assert {r["document_id"]: r["score"] for r in got}[2] == round(float(q @ d / (q @ q) ** 0.5 / (d @ d) ** 0.5), 6)


def test_purity_is_that_of_every_vector(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [float(rng.randrange(-3, 4)) + 0.1 for _ in range(4)], rng.randrange(3)) for i in range(150)]
    got, want = rows_of(spark, tmp_path, "knn_label_purity", {"embeddings": (rows, "vec_id long, embedding array<float>, label int")})
    assert got == want and len(got) == 150


def test_nearest_in_parts_against_all_pairs(spark, monkeypatch):
    """Ties, repeated ids, fewer rows than are asked for, several parts and blocks."""
    for name, value in {"BLOCK": 40, "PART": 50, "SCORES": 100, "GROUP": 4}.items():
        monkeypatch.setattr(ranking, name, value)
    rng = random.Random(5)
    rows = [(i % 280, [float(rng.randrange(-1, 2)) for _ in range(3)] + [1.0]) for i in range(300)]
    frame = spark.createDataFrame(rows, "id long, v array<double>")
    for least, n in ((-1.0, 5), (0.9, 5), (-1.0, 400)):
        got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ranking.nearest(frame, frame.where("id >= 20 AND id < 100"), n, least).collect()}
        unit = np.array([v for _, v in rows]) / np.linalg.norm([v for _, v in rows], axis=1, keepdims=True)
        want = set()
        for i in range(20, 100):
            near = sorted(((-round(float(unit[i] @ unit[j]), 9), rows[j][0]) for j in range(300) if rows[j][0] != i))
            want |= {(i, k + 1, j, round(-s, 6)) for k, (s, j) in enumerate([x for x in near if -x[0] >= least][:n])}
        assert got == want


def test_signatures_meet_by_a_shuffle(spark):
    sigs = spark.range(30).selectExpr("id AS simhash", "'complete' AS status")  # of a known, small size
    plan = simhash.similar_pairs(sigs)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_stemmed_search_scores_as_over_joined_terms(spark, monkeypatch):
    """Odd words, repeated and null ids, null and empty texts, small slices, against lexical.search over the terms of each document."""
    for name, value in {"SLICE": 7, "DOCS": 3, "HELD": 20, "REMEMBERED": 15}.items():
        monkeypatch.setattr(analysis, name, value)
    rng = random.Random(6)
    words = ["stations", "station", "HTTPServer", "fooBar_baz", "ﬁne", "x" * 200, "Éa", "the", "running", "__", *[f"w{i}" for i in range(20)]]
    texts = [(i, " ".join(rng.choices(words, k=rng.randrange(30)))) for i in range(60)] + [(60, None), (61, ""), (None, "station w1 w2")]
    asked = [(q, " ".join(rng.choices(words, k=12))) for q in range(8)] + [(8, None), (9, "the")]
    docs, queries = spark.createDataFrame(texts, "document_id long, text string").repartition(3), spark.createDataFrame(asked, "query_id int, text string")
    kept = lambda t: dict.fromkeys(x for w in (t or "").split() if w != "the" for x, _ in tx.analysed(w))
    terms = spark.createDataFrame([(q, x) for q, t in asked for x in kept(t)], "query_id int, term string")
    joined = spark.createDataFrame([(i, " ".join(x for w in (t or "").split() for x, _ in tx.analysed(w))) for i, t in texts], "document_id long, text string")
    want = {tuple(r) for r in lexical.search(joined, terms, 4).collect()}
    assert {tuple(r) for r in analysis.search(docs, queries, 4).collect()} == want and len(want) == 32
    assert analysis.search(docs, queries.limit(0)).isEmpty() and analysis.search(docs.limit(0), queries).isEmpty()
