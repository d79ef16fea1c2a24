"""Findings of the third review: results as the SQL's on odd inputs, and operators that hold no more than a batch."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from strataspan.functions.batches import map_slices
from strataspan.operators import analysis, bm25f, context, lexical, segments, semantic, simhash, stored, structure


def rows_of(spark, tmp_path, name, tables):
    """Rows of a query and of its SQL over small tables (name: list of rows, schema)."""
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    with duckdb.connect() as db:
        for t in tables:
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
        want = db.execute(__spark_entry__.oracle_sql()[name])
        names = [c[0] for c in want.description]
        return sorted(map(str, (tuple(r) for r in got.select(*names).collect()))), sorted(map(str, want.fetchall()))


TURNS = ["Doñue ez", "doé x", "is it", "dо it", "  what now", "　add this", "ſhould we", "actuallyé", "add́ x", "what_ is", "Is", "\tdo it", "no, éactually that", "checK it", "historyé", "pre recalled", "right now é", "  in general", "hİstory", ""]


@pytest.mark.parametrize("name", ["structural_scores", "latest_relations", "message_intents"])
def test_cues_end_at_ascii_edges(spark, tmp_path, name):
    talk = [(i, 0, "user", t) for i, t in enumerate(TURNS)] + [(i, 1, "assistant", t) for i, t in enumerate(TURNS)] + [(99, 0, "user", None)]
    got, want = rows_of(spark, tmp_path, name, {"conversations": (talk, "conv_id long, turn long, role string, text string")})
    assert got == want and len(got) > 20


EDGES = ["2024-01-01 00:59:59.9994", "2024-01-01 00:59:59.9995", "2024-01-01 00:59:59.9999", "2024-01-01 01:00:00", "1969-12-31 23:59:59.9996", "1969-12-31 23:59:59.9995", "1969-12-31 22:59:59.9994"]


@pytest.mark.parametrize("name", ["access_buckets", "hour_buckets", "lineage_merge"])
def test_milliseconds_are_rounded(spark, tmp_path, name):
    events = [(i, 7 + i % 2, t, "view", float(i)) for i, t in enumerate(EDGES)]
    df = [r[:2] + (spark.sql(f"SELECT TIMESTAMP_NTZ '{r[2]}'").first()[0],) + r[3:] for r in events]
    got, want = rows_of(spark, tmp_path, name, {"events": (df, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double")})
    assert got == want and got


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().sparkPlan().toString()


def documents(spark):
    rows = [(i, 1, "p", 1, "turn", "one two two three " * (i % 4)) for i in range(40)]
    return spark.createDataFrame(rows, "document_id long, version int, project string, created_at long, kind string, text string")


def test_signatures_group_once(spark):
    assert plan_of(simhash.signatures(documents(spark)))[0].count("Aggregate") == 1


def test_window_postings_are_not_shuffled(spark):
    post = bm25f.postings(bm25f.windows(bm25f.plain_tokens(documents(spark))))
    assert "Exchange" not in post._jdf.queryExecution().executedPlan().toString()
    assert {(r["term"], r["tf"], r["wtf"]) for r in post.where("document_id = 3").collect()} == {("one", 3, 3.0), ("two", 6, 6.0), ("three", 3, 3.0)}


@pytest.mark.parametrize("kind", ["lexical", "bm25f", "stored"])
def test_scores_are_summed_without_lists(spark, kind):
    docs, asked = documents(spark), spark.createDataFrame([(0, "two"), (0, "one")], "query_id long, term string")
    wins = bm25f.windows(bm25f.plain_tokens(docs))
    post, lens = bm25f.postings(wins), bm25f.lengths(wins)
    if kind == "lexical":
        got = lexical.search(docs, asked)
    elif kind == "bm25f":
        got = bm25f.search(post, lens, asked)
    else:
        post = post.withColumns({"level": stored.level(F.col("wtf"), F.col("wlen")), "gaps": F.lit(None).cast("array<int>")})
        df = post.groupBy("bucket", "project", "term").agg(F.count(F.lit(1)).alias("df"))
        got = stored.search(post, stored.blocks(post), df, lens.groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("wlen").alias("total")), asked)
    assert "collect_list" not in plan_of(got)[0]
    assert [r["document_id"] for r in got.orderBy("rank").collect()][:3] in ([3, 7, 11], [39, 35, 31], [1, 5, 9]) or got.count() == 10


def test_expansion_explodes_first_documents_only(spark):
    docs, asked = documents(spark), spark.createDataFrame([(0, "two")], "query_id long, term string")
    best = spark.createDataFrame([(0, 1, 3)], "query_id long, rank int, document_id long")
    tree = plan_of(lexical.expansion_terms(docs, best, asked))[0]
    assert tree.rindex("Join Inner, (document_id") > tree.index("Generate explode(array_distinct")
    assert {r["term"] for r in lexical.expansion_terms(docs, best, asked).collect()} == {"one", "three"}


def test_python_sees_slices(spark):
    def run(frames):
        for b in frames:
            yield b.assign(n=len(b))[["id", "n"]]

    got = map_slices(spark.range(0, 1000, 1, 1), run, "id long, n long", 300).groupBy("n").count().collect()
    assert {tuple(r) for r in got} == {(300, 900), (100, 100)}


def test_operators_take_slices(spark):
    docs = documents(spark).withColumn("session_id", F.lit("s")).withColumn("messages", F.lit(None).cast("array<struct<role:string,text:string>>"))
    for df in (segments.physical_chunks(docs), structure.stored_relations(docs), analysis.search(docs, docs.select(F.col("document_id").alias("query_id"), "text"))):
        assert "MapInPandas" not in plan_of(df)[0] and "MapInArrow" in plan_of(df)[0]


def test_spans_meet_a_page_of_queries_where_they_are(spark):
    index = semantic.indexed(documents(spark).withColumn("session_id", F.lit("s")))
    asked = index.where("ordinal = 0 AND document_id < 9").select(F.col("document_id").alias("query_id"), F.col("vector").alias("v"))
    found = semantic.search(index, asked, 2)
    rest = semantic._ranked(semantic._best_documents(index.withColumn("list", F.lit(0)), semantic._asked(asked).withColumn("list", F.lit(0)), 6, semantic.LEAST_COSINE), 6)
    assert "CoGroup" not in plan_of(found)[0] and sorted(map(tuple, found.collect())) == sorted(map(tuple, rest.collect()))


def test_dependents_against_all_pairs(spark):
    rng = random.Random(3)
    docs = {d: rng.randrange(12) for d in range(60)}
    keys = {(d, f"k{rng.randrange(4)}") for d in docs} | {(d, f"k{rng.randrange(4)}") for d in range(0, 60, 7)}
    cites, links = {(rng.randrange(60), rng.randrange(60)) for _ in range(80)}, {(rng.randrange(60), rng.randrange(60)) for _ in range(40)}
    targets = range(0, 60, 3)
    want = {}
    for t in targets:
        of = {d for d, k in keys if (t, k) in keys} | {a for a, b in cites | links if b == t}
        later = sorted((docs[d], d) for d in of - {t} if docs[d] > docs[t])
        if later:
            want[t] = (len(later), [d for _, d in later[:5]])
    frame = spark.createDataFrame
    args = frame([(t,) for t in targets], "document_id long"), frame(sorted(docs.items()), "document_id long, created_at long"), frame(sorted(keys), "document_id long, source_key string"), frame(sorted(cites), "document_id long, cited_id long"), frame(sorted(links), "id long, supersedes long")
    got = context.dependents(*args, most=5)
    assert {r["target_id"]: (r["n"], list(r["first"])) for r in got.collect()} == want
