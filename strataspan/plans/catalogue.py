"""Queries of the library over the driver tables, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataspan.adapters import EPOCH_MS, STEP_MS, Tables
from strataspan.functions import columns as cx
from strataspan.functions import text as tx
from strataspan.operators import context, feedback, lexical, lifecycle, ranking, segments, simhash, structure

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


_EV = f"""ev AS (SELECT doc_id AS document_id, 1 AS version, source AS project, lang AS session_id,
  CASE doc_id % 4 WHEN 0 THEN 'turn' WHEN 1 THEN 'tool-result' WHEN 2 THEN 'decision-candidate' ELSE 'manual' END AS kind,
  {EPOCH_MS} + doc_id * {STEP_MS} AS created_at, text FROM documents)"""
_TOK = rf"tok AS (SELECT document_id, project, regexp_extract_all(lower(text), '{tx.TERM_TOKEN}') AS ts FROM ev)"
_POST = "post AS (SELECT document_id, project, term, count(*) AS tf FROM (SELECT document_id, project, unnest(ts) AS term FROM tok) GROUP BY ALL)"


def _asked(t: Tables) -> DataFrame:
    return lexical.first_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


_STOPS = ", ".join(f"'{w}'" for w in sorted(tx.STOP_WORDS))
_ASKED = rf"""q0 AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(text), '{tx.TERM_TOKEN}'), lambda x: x NOT IN ({_STOPS})) AS ts FROM benchmark),
q1 AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM q0),
q2 AS (SELECT query_id, term, min(pos) AS pos FROM q1 GROUP BY ALL),
asked AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM q2) WHERE n <= 20)"""
_BM25 = f"""WITH {_EV}, {_TOK}, {_POST}, {_ASKED},
st AS (SELECT count(*) AS n, avg(len(ts)) AS av FROM tok), ln AS (SELECT document_id, len(ts) AS len FROM tok),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), qn AS (SELECT query_id, count(*) AS n_terms FROM asked GROUP BY 1),
parts AS (SELECT query_id, document_id, term, tf, df, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / av)) AS part
  FROM asked JOIN post USING (term) JOIN df USING (term) JOIN ln USING (document_id), st),
hits AS (SELECT query_id, document_id, round(sum(part ORDER BY term), 6) AS score, count(*) AS matched FROM parts GROUP BY ALL),
rk AS (SELECT *, row_number() OVER w AS rank, round(score - lead(score, 1, 0.0) OVER w, 6) AS margin FROM hits WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, matched DESC, document_id)),
best AS (SELECT query_id, CAST(rank AS INTEGER) AS rank, document_id, score, round(matched / n_terms, 6) AS coverage, round(score / (score + 1), 6) AS normalized, margin FROM rk JOIN qn USING (query_id) WHERE rank <= 10)
"""


@query(_BM25 + "SELECT * FROM best")
def bm25_topk(t):
    return lexical.search(t.evidence(), _asked(t))


@query(_BM25 + "SELECT query_id, document_id, term, tf, df, round(part, 6) AS part FROM best JOIN parts USING (query_id, document_id)")
def bm25_explain(t):
    return lexical.search(t.evidence(), _asked(t), explain=True)


@query(f"WITH {_EV}, {_TOK}, {_POST} SELECT project, term, count(*) AS df FROM post GROUP BY ALL")
def term_df(t):
    return lexical.term_statistics(lexical.postings(t.evidence()))


@query(f"WITH {_EV}, {_TOK} SELECT project, count(*) AS n_windows, CAST(sum(len(ts)) AS BIGINT) AS total_len, round(avg(len(ts)), 6) AS avg_len FROM tok GROUP BY 1")
def corpus_stats(t):
    return lexical.corpus_statistics(t.evidence()).withColumn("avg_len", F.round("avg_len", 6))


@query(f"""WITH {_EV}, {_TOK}, w AS (SELECT document_id, ts, unnest(range(CAST(greatest(0, ceil((len(ts) - 900) / 765.0)) AS BIGINT) + 1)) AS ordinal FROM tok),
x AS (SELECT document_id, ordinal, unnest(ts[ordinal * 765 + 1 : ordinal * 765 + 900]) AS term FROM w)
SELECT document_id, CAST(ordinal AS INTEGER) AS ordinal, term, count(*) AS tf FROM x GROUP BY ALL""")
def window_term_tf(t):
    tok = t.evidence().select("document_id", tx.terms(F.col("text")).alias("ts"))
    last = F.greatest(F.lit(0), F.ceil((F.size("ts") - 900) / 765)).cast("int")
    each = tok.withColumn("ordinal", F.explode(F.sequence(F.lit(0), last))).select("document_id", "ordinal", F.explode(F.slice("ts", F.col("ordinal") * 765 + 1, F.lit(900))).alias("term"))
    return each.groupBy("document_id", "ordinal", "term").agg(F.count(F.lit(1)).alias("tf"))


def _windows_sql(size: int, step: int) -> str:
    return rf"""WITH c AS (SELECT doc_id AS document_id, CAST(len(regexp_extract_all(text, '{tx.WINDOW_TOKEN}')) AS INTEGER) AS n FROM documents),
e AS (SELECT document_id, n, CAST(unnest(range(CAST(greatest(0, ceil((n - {size}) / {step}.0)) AS BIGINT) + 1)) AS INTEGER) AS ordinal FROM c)
SELECT document_id, ordinal, ordinal * {step} AS start_token, least(n, ordinal * {step} + {size}) AS end_token FROM e"""


@query(_windows_sql(900, 765))
def windows_900_15(t):
    return segments.token_windows(t.evidence())


@query(_windows_sql(160, 136))
def semantic_spans(t):
    return segments.token_windows(t.evidence(), 160, 24)


@query("SELECT doc_id AS document_id, octet_length(encode(text)) AS byte_length, sha256(text) AS content_hash, TRUE AS gap_free FROM documents")
def chunks_reconstructed(t):
    docs = t.evidence().withColumn("row", F.monotonically_increasing_id())  # rows of one id are texts of their own
    cut = segments.physical_chunks(docs, 4_096, 1_024, "row")
    whole = segments.reconstructed(cut, "row").select("document_id", "byte_length", "content_hash", "gap_free")
    blank = docs.where("text IS NULL OR octet_length(text) = 0")  # no chunks, so nothing to put together
    return whole.unionByName(blank.select("document_id", F.octet_length("text").cast("long").alias("byte_length"), F.sha2("text", 256).alias("content_hash"), F.lit(True).alias("gap_free")))


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def exact_dup_groups(t):
    keyed = t.documents.select("doc_id", F.sha2(F.col("text"), 256).alias("content_hash"))
    return keyed.groupBy("content_hash").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")


_SIG = f"""WITH {_EV}, {_TOK}, {_POST}, fp AS (SELECT document_id, tf, ('0x' || substr(sha1(term), 1, 16))::UBIGINT AS f FROM post),
b AS (SELECT document_id, bit, sum(CASE WHEN (f >> bit) & 1 = 1 THEN tf ELSE -tf END) AS s FROM fp, (SELECT unnest(range(64)) AS bit) GROUP BY ALL),
u AS (SELECT document_id, sum(CASE WHEN s > 0 THEN 1::HUGEINT << bit ELSE 0 END) AS u FROM b GROUP BY 1),
sig AS (SELECT t.document_id, CAST(len(ts) AS BIGINT) AS token_count, CAST(CASE WHEN coalesce(u, 0) >= 9223372036854775808 THEN u - 18446744073709551616 ELSE coalesce(u, 0) END AS BIGINT) AS simhash,
  CASE WHEN len(ts) = 0 THEN 'empty' ELSE 'complete' END AS status FROM tok t LEFT JOIN u ON t.document_id = u.document_id)
"""


@query(_SIG + "SELECT * FROM sig")
def simhash_sig(t):
    return simhash.signatures(t.evidence())


@query(_SIG + """, d AS (SELECT DISTINCT simhash FROM sig WHERE status = 'complete')
SELECT a.simhash AS left_simhash, b.simhash AS right_simhash, CAST(bit_count(xor(a.simhash, b.simhash)) AS BIGINT) AS distance FROM d a JOIN d b ON a.simhash < b.simhash AND bit_count(xor(a.simhash, b.simhash)) <= 3""")
def near_dup_pairs(t):
    return simhash.similar_pairs(simhash.signatures(t.evidence()))


_URLS = """anchors AS (SELECT page_id AS document_id, url AS value FROM pages), asked AS (SELECT page_id AS query_id, CASE WHEN page_id % 2 = 0 THEN url ELSE upper(url) END AS value FROM pages)"""


@query(f"""WITH {_URLS}, x AS (SELECT query_id, document_id, a.value, TRUE AS exact FROM asked q JOIN anchors a ON q.value = a.value),
y AS (SELECT query_id, document_id, a.value, FALSE AS exact FROM asked q JOIN anchors a ON lower(q.value) = lower(a.value) WHERE query_id NOT IN (SELECT query_id FROM x))
SELECT DISTINCT *, round(least(1.0, 0.55::DOUBLE + 0.25::DOUBLE * CASE WHEN exact THEN 1.0 ELSE 0.72 END + 0.12::DOUBLE + 0.08::DOUBLE * 0.91), 6) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y)""")
def exact_url_lookup(t):
    anchors = t.pages.select(F.col("page_id").alias("document_id"), F.col("url").alias("value"), F.lit(0.91).alias("specificity"))
    asked = t.pages.select(F.col("page_id").alias("query_id"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.upper("url")).alias("value"))
    return ranking.exact_lookup(anchors, asked)


_CORR, _QUES, _REQ = (x.replace("'", "''") for x in (tx.CORRECTION_CUE, tx.QUESTION_PREFIX, tx.REQUEST_PREFIX))
_SCORES = rf"""m AS (SELECT conv_id, turn, role, trim(coalesce(text, '')) AS t, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS n FROM conversations),
scores AS (SELECT conv_id, turn,
 CASE WHEN t = '' OR role != 'user' THEN 0 WHEN contains(t, '?') THEN 100 WHEN regexp_matches(t, '(?i){_QUES}') THEN 85 ELSE 10 END AS question,
 CASE WHEN t = '' OR role != 'user' THEN 0 WHEN regexp_matches(t, '(?i){_REQ}') THEN 100 ELSE 10 END AS request,
 CASE WHEN t != '' AND role = 'user' AND regexp_matches(t, '(?i){_CORR}') THEN 100 ELSE 0 END AS correction,
 CASE WHEN t = '' OR role != 'assistant' THEN 0 WHEN n = 1 THEN 100 ELSE 75 END AS answer FROM m)"""


@query(f"WITH {_SCORES} SELECT * FROM scores")
def structural_scores(t):
    return structure.structural_scores(t.conversations)


@query(f"""WITH {_SCORES}, r AS (UNPIVOT scores ON question, request, correction, answer INTO NAME relation VALUE confidence),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, relation ORDER BY confidence DESC, turn DESC) AS n FROM r WHERE confidence > 0)
SELECT conv_id, 'latest-' || relation AS relation, turn, confidence, CASE WHEN confidence >= 50 THEN 'resolved' ELSE 'ambiguous' END AS status FROM k WHERE n = 1""")
def latest_relations(t):
    return structure.latest(structure.relations(structure.structural_scores(t.conversations)))


@query("""WITH g AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_group FROM conversations)
SELECT conv_id, CAST(turn_group AS BIGINT) AS turn_group, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n_messages FROM g GROUP BY conv_id, turn_group""")
def turn_groups(t):
    return structure.turn_groups(t.conversations)


_SENTENCES = r"""s0 AS (SELECT conv_id, turn, string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM conversations),
s1 AS (SELECT conv_id, turn, trim(unnest(ss), ' ') AS sentence, generate_subscripts(ss, 1) AS pos FROM s0)"""


@query(rf"""WITH {_SENTENCES}, f AS (SELECT conv_id, turn, sentence, min(pos) AS pos FROM s1 WHERE length(sentence) BETWEEN 15 AND 300 AND NOT ends_with(sentence, '?') AND regexp_matches(sentence, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:the|des|und|que)(?:$|[^\p{{L}}\p{{N}}_])') GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos) AS rank FROM f) SELECT conv_id, turn, CAST(rank AS INTEGER) AS rank, sentence FROM k WHERE rank <= 5""")
def decision_candidates(t):
    # the tables hold no English cues: common words stand in for them
    return structure.decision_sentences(t.conversations, cues=["the", "des", "und", "que"])


_KNN = """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, c.label = q.label AS same, round(list_cosine_similarity(q.e, c.e), 9) AS s FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id != c.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s)
"""


_KNN_ALL = _KNN.replace("q.vec_id % 20 = 0 AND ", "", 1)


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(_KNN + "SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, round(s, 6) AS score FROM k WHERE rank <= 10")
def knn_cosine(t):
    rows = _vectors(t)
    return ranking.nearest(rows, rows.where("id % 20 = 0"))


@query(_KNN_ALL + "SELECT query_id, round(avg(CASE WHEN same THEN 1.0 ELSE 0.0 END), 6) AS purity FROM k WHERE rank <= 10 GROUP BY 1")
def knn_label_purity(t):
    labels = t.embeddings.select("vec_id", "label")
    own = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    rows = _vectors(t)  # each vector is asked for
    return ranking.nearest(rows, rows).join(labels, "vec_id").join(own, "query_id").groupBy("query_id").agg(F.round(F.avg(F.when(F.col("label") == F.col("own"), 1.0).otherwise(0.0)), 6).alias("purity"))


_FUSE = """pool AS (SELECT query_id, 'lexical' AS mode, document_id AS id, normalized AS norm FROM best UNION ALL SELECT query_id, 'coverage', document_id, coverage FROM best),
r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id, mode ORDER BY norm DESC) AS r FROM pool),
f AS (SELECT *, sum(1.0::DOUBLE / (60 + r)) OVER (PARTITION BY query_id, id) AS rrf, min(r) OVER (PARTITION BY query_id, id) AS b FROM r),
w AS (SELECT *, CASE WHEN b <= 3 THEN 0.75::DOUBLE WHEN b <= 10 THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w, max(rrf) OVER (PARTITION BY query_id) AS top FROM f),
x AS (SELECT *, round(w * rrf / top + (1 - w) * norm, 9) AS blend FROM w),
c AS (SELECT *, min(blend) OVER (PARTITION BY query_id, mode ORDER BY norm DESC, id ROWS UNBOUNDED PRECEDING) AS c FROM x),
fin AS (SELECT query_id, id, round(max(c), 6) AS fusion_score FROM c GROUP BY ALL)
"""


def _pool(t):
    best = lexical.search(t.evidence(), _asked(t))
    return best.select("query_id", F.explode(F.array(F.struct(F.lit("lexical").alias("mode"), F.col("normalized").alias("norm")), F.struct(F.lit("coverage").alias("mode"), F.col("coverage").alias("norm")))).alias("m"), F.col("document_id").alias("id")).select("query_id", "m.mode", "id", "m.norm")


@query(_BM25.rstrip() + ", " + _FUSE + "SELECT query_id, id, fusion_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, id) AS INTEGER) AS fused_rank FROM fin")
def rrf_fusion(t):
    return ranking.fused(_pool(t))


@query(_BM25.rstrip() + """, vocab AS (SELECT DISTINCT document_id, term FROM post WHERE TRUE), vdf AS (SELECT term, count(*) AS vdf FROM vocab GROUP BY 1),
fd AS (SELECT DISTINCT b.query_id, v.term FROM best b JOIN vocab v USING (document_id) WHERE b.rank <= 3 AND NOT EXISTS (SELECT 1 FROM asked a WHERE a.query_id = b.query_id AND a.term = v.term)),
sc AS (SELECT query_id, term, round(ln(1 + (n - vdf + 0.5::DOUBLE) / (vdf + 0.5::DOUBLE)), 6) AS idf FROM fd JOIN vdf USING (term), st),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY idf DESC, term) AS rank FROM sc) SELECT query_id, CAST(rank AS INTEGER) AS rank, term, idf FROM k WHERE rank <= 8""")
def rm3_terms(t):
    docs, asked = t.evidence(), _asked(t)
    return lexical.expansion_terms(docs, lexical.search(docs, asked), asked)


_NOW = EPOCH_MS + 30 * ranking.DAY_MS
_CLASS = "CASE kind WHEN 'tool-result' THEN 'ephemeral-payload' WHEN 'decision-candidate' THEN 'derived-evidence' WHEN 'manual' THEN 'durable-evidence' ELSE 'conversation-source' END"
_KEPT = f"""kept AS (SELECT *, {_CLASS} AS retention_class, created_at + CASE {_CLASS} WHEN 'ephemeral-payload' THEN 14 WHEN 'conversation-source' THEN 90 WHEN 'derived-evidence' THEN 30 END * 86400000::BIGINT AS expires_at,
 octet_length(encode(coalesce(text, ''))) AS bytes FROM ev)"""


@query(f"""WITH {_EV}, {_KEPT} SELECT document_id, round(coalesce(pow(2.0::DOUBLE, -greatest(0, {_NOW} - created_at)::DOUBLE / (CASE retention_class WHEN 'ephemeral-payload' THEN 3 WHEN 'conversation-source' THEN 21 WHEN 'derived-evidence' THEN 14 END * 86400000::BIGINT)), 1.0), 6) AS multiplier FROM kept""")
def recency_decay(t):
    kept = lifecycle.retention(t.evidence())
    return kept.select("document_id", F.round(ranking.decay(F.lit(_NOW) - F.col("created_at"), F.col("retention_class")), 6).alias("multiplier"))


@query("""SELECT c_custkey AS document_id, round(1 + least(0.15::DOUBLE, 0.06::DOUBLE * (c_custkey % 3 = 0)::INT + 0.06::DOUBLE * (c_custkey % 5 = 0)::INT + 0.05::DOUBLE * log2(1 + least(n, 32)) / log2(33.0::DOUBLE) + 0.05::DOUBLE * log2(1 + least(c_custkey % 40, 32)) / log2(33.0::DOUBLE)), 6) AS prior
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n0 FROM orders GROUP BY 1) ON c_custkey = o_custkey, LATERAL (SELECT coalesce(n0, 0) AS n)""")
def importance_prior(t):
    refs = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    c = t.customer.join(refs, "c_custkey", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return c.select(F.col("c_custkey").alias("document_id"), ranking.importance(F.col("c_custkey") % 3 == 0, F.col("c_custkey") % 5 == 0, F.col("n"), F.col("c_custkey") % 40).alias("prior"))


@query(f"WITH {_EV} SELECT project, count(*) AS n FROM ev WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) GROUP BY 1")
def live_documents(t):
    retired = t.labels.where("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"))
    return lifecycle.live(t.evidence(), retired).groupBy("project").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey AS document_id, max(o_orderkey) AS version, max_by(o_totalprice, o_orderkey) AS o_totalprice FROM orders GROUP BY 1")
def version_supersede(t):
    v = t.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("version"), "o_totalprice")
    return lifecycle.newest_versions(v)


_LINKS = "links AS (SELECT doc_id AS id, doc_id - 1 AS supersedes FROM documents WHERE doc_id % 5 != 0)"


@query(f"""WITH RECURSIVE {_LINKS}, ends AS (SELECT id FROM links UNION SELECT supersedes FROM links),
b AS (SELECT id, id AS at, 0 AS n FROM ends UNION ALL SELECT b.id, l.supersedes, n + 1 FROM b JOIN links l ON l.id = b.at),
a AS (SELECT id, id AS at, 0 AS n FROM ends UNION ALL SELECT a.id, l.id, n + 1 FROM a JOIN links l ON l.supersedes = a.at)
SELECT id, CAST(max(b.n) + 1 AS BIGINT) AS position, CAST(max(b.n) + 1 + any_value(m) AS BIGINT) AS total FROM b JOIN (SELECT id, max(n) AS m FROM a GROUP BY 1) USING (id) GROUP BY id""")
def chain_view(t):
    links = t.documents.where("doc_id % 5 != 0").select(F.col("doc_id").alias("id"), (F.col("doc_id") - 1).alias("supersedes"))
    return lifecycle.chain_view(links, rounds=4)


@query(f"WITH {_EV} SELECT project, session_id AS subject_key, max_by(document_id, created_at) AS document_id FROM ev WHERE session_id IS NOT NULL GROUP BY 1, 2")
def subject_live(t):
    return lifecycle.live_subjects(t.evidence().withColumn("subject_key", F.col("session_id")))


@query(f"""WITH {_EV}, p AS (SELECT project, document_id, row_number() OVER (PARTITION BY project ORDER BY created_at, document_id) AS n FROM ev)
SELECT a.document_id AS anchor_id, b.document_id, CAST(b.n - a.n AS BIGINT) AS distance FROM p a JOIN p b ON a.project = b.project AND b.n BETWEEN a.n - 1 AND a.n + 3""")
def gather_neighbours(t):
    docs = t.evidence()
    return lifecycle.neighbours(docs, docs)


@query(f"""WITH {_EV} SELECT document_id, lag(document_id) OVER w AS before_id, lead(document_id) OVER w AS after_id FROM ev WINDOW w AS (PARTITION BY project, session_id ORDER BY created_at, document_id)""")
def traverse_before_after(t):
    w = Window.partitionBy("project", "session_id").orderBy("created_at", "document_id")
    return t.evidence().select("document_id", F.lag("document_id").over(w).alias("before_id"), F.lead("document_id").over(w).alias("after_id"))


@query(f"WITH {_EV}, {_KEPT} SELECT document_id, retention_class, expires_at FROM kept WHERE expires_at <= {_NOW} AND document_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def expiry_due(t):
    pins = t.labels.where("toxic = 1").select(F.col("doc_id").alias("document_id"))
    return lifecycle.due(t.evidence(), _NOW, pins).select("document_id", "retention_class", "expires_at")


@query(f"WITH {_EV}, {_KEPT} SELECT retention_class, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes, count(*) FILTER (expires_at <= {_NOW}) AS n_due, CAST(coalesce(sum(bytes) FILTER (expires_at <= {_NOW}), 0) AS BIGINT) AS bytes_due FROM kept GROUP BY 1")
def retention_status(t):
    return lifecycle.retention_status(t.evidence(), _NOW)


@query(f"""WITH {_EV}, r AS (SELECT session_id, document_id, CASE kind WHEN 'tool-result' THEN 0 WHEN 'turn' THEN 1 WHEN 'decision-candidate' THEN 2 ELSE 4 END AS p, created_at, octet_length(encode(coalesce(text, ''))) AS bytes FROM ev),
c AS (SELECT session_id, document_id, CAST(coalesce(sum(bytes) OVER (PARTITION BY session_id ORDER BY p, created_at, document_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS freed_before FROM r)
SELECT * FROM c WHERE freed_before < 100000""")
def eviction_cumulative(t):
    return lifecycle.evicted(t.evidence(), 100_000)


_SHOWN = "shown AS (SELECT event_type AS mode, CAST(event_id % 10 + 1 AS BIGINT) AS rank, value > 50 AS recalled FROM events)"


@query(f"WITH {_SHOWN} SELECT mode, rank, count(*) AS shown, count(*) FILTER (recalled) AS recalled FROM shown GROUP BY GROUPING SETS ((mode), (rank), ())")
def feedback_by_mode_rank(t):
    e = t.events.select(F.col("event_type").alias("mode"), (F.col("event_id") % 10 + 1).alias("rank"), (F.col("value") > 50).alias("recalled"))
    return feedback.feedback_statistics(e)


@query("SELECT CAST(floor(epoch_ms(ts) / 3600000) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def hour_buckets(t):
    return t.events.groupBy(F.floor(cx.epoch_ms(F.col("ts")) / 3_600_000).alias("hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS s FROM events),
c AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM c GROUP BY user_id, k""")
def session_windows(t):
    e = t.events.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    return e.groupBy("user_id", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.unix_micros("w.start").alias("start_us"), "n")


@query(_BM25.rstrip() + """, rel AS (SELECT query_id, min(document_id) AS document_id FROM hits h GROUP BY 1), g AS (SELECT r.query_id, min(b.rank) AS rank FROM rel r LEFT JOIN best b USING (query_id, document_id) GROUP BY 1)
SELECT count(*) AS n_queries, round(avg(CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_k, round(avg(coalesce(1.0::DOUBLE / rank, 0.0)), 6) AS mrr FROM g""")
def recall_at_3_mrr(t):
    docs, asked = t.evidence(), _asked(t)
    words = docs.select("document_id", F.explode(F.array_distinct(tx.terms(F.col("text")))).alias("term"))
    post = words.join(F.broadcast(asked), "term").groupBy("query_id").agg(F.min("document_id").alias("document_id"))
    return feedback.recall_and_mrr(lexical.search(docs, asked), post)


@query("""SELECT c_custkey, CASE WHEN NOT (c_custkey % 2 = 0) AND (c_custkey % 3 = 0 OR c_custkey % 7 = 0) THEN 'suppress' WHEN c_custkey % 11 = 0 OR c_acctbal < 1000 THEN 'suppress'
 WHEN c_custkey % 2 = 0 AND c_acctbal >= 5000 THEN 'historical-snippet' WHEN NOT (c_custkey % 2 = 0) AND c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN 'suppress' ELSE 'continuity-marker' END AS decision FROM customer""")
def disclosure_decisions(t):
    k, b = F.col("c_custkey"), F.col("c_acctbal")
    kind = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), "turn").otherwise("manual")
    return t.customer.select("c_custkey", feedback.disclosure(k % 2 == 0, k % 3 == 0, k % 7 == 0, k % 11 != 0, b >= 1000, b < 5000, kind).alias("decision"))


@query("""WITH a AS (SELECT doc_id, lang AS v FROM documents WHERE doc_id % 10 != 0), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' ELSE lang END AS v FROM documents WHERE doc_id % 9 != 0)
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id""")
def copy_compared(t):
    d = t.documents.select("doc_id", "lang")
    return feedback.compared(d.where("doc_id % 10 != 0"), d.where("doc_id % 9 != 0").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("lang"))), ["doc_id"], "lang")


@query("""WITH r AS (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, sha256(props) ORDER BY event_id) AS n FROM events) SELECT event_id FROM r WHERE n > 1""")
def repeated_tool_results(t):
    w = Window.partitionBy("user_id", "event_type", "h").orderBy("event_id")
    return t.events.withColumn("h", F.sha2("props", 256)).withColumn("n", F.row_number().over(w)).where("n > 1").select("event_id")


@query("""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def lineitem_pricing(t):
    li = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count(F.lit(1)).alias("n"))


_TURNS = r"""g AS (SELECT conv_id, turn, text, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS turn_group FROM conversations),
tg AS (SELECT conv_id, CAST(turn_group AS BIGINT) AS turn_group, CAST(sum(ceil(length(coalesce(text, '')) / 4.0)) AS BIGINT) AS tokens FROM g GROUP BY ALL)"""


def _turns(t):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = t.conversations.withColumn("turn_group", F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w))
    return marked.groupBy("conv_id", "turn_group").agg(F.sum(F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0)).alias("tokens"))


@query(f"""WITH {_TURNS}, p AS (SELECT *, count(*) OVER w AS k, sum(tokens) OVER w AS s FROM tg WINDOW w AS (PARTITION BY conv_id ORDER BY turn_group DESC ROWS UNBOUNDED PRECEDING)),
a AS (SELECT conv_id, max(k) AS n, min(turn_group) FILTER (k <= 3 AND s + 100 <= 400) AS first_kept, count(*) FILTER (k <= 3 AND s + 100 <= 400) AS kept FROM p GROUP BY 1)
SELECT conv_id, first_kept, kept, CASE WHEN kept = 0 THEN 'compaction' WHEN kept = least(n, 3) THEN 'normal' ELSE 'emergency-retention' END AS mode FROM a""")
def window_rotation(t):
    return context.rotation(_turns(t), target=400, retain=3, reserve=100)


@query(f"""WITH RECURSIVE m AS (SELECT conv_id, turn, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations),
r AS (SELECT conv_id, turn, tokens, n, tokens > 120 AS external, CASE WHEN tokens > 120 THEN 0 ELSE tokens END AS used FROM m WHERE n = 1
 UNION ALL SELECT m.conv_id, m.turn, m.tokens, m.n, m.tokens > CASE WHEN r.used >= 150 THEN 40 ELSE 120 END, r.used + CASE WHEN m.tokens > CASE WHEN r.used >= 150 THEN 40 ELSE 120 END THEN 0 ELSE m.tokens END FROM r JOIN m ON m.conv_id = r.conv_id AND m.n = r.n + 1)
SELECT conv_id, turn, tokens, external FROM r""")
def externalized_results(t):
    sized = t.conversations.select("conv_id", "turn", F.ceil(F.length(F.coalesce("text", F.lit(""))) / 4.0).alias("tokens"))
    return context.externalized(sized, each=120, floor=40, share=150)


@query(f"""WITH {_EV}, tg AS (SELECT document_id AS target_id, created_at AS t FROM ev WHERE document_id % 40 = 0),
f AS (SELECT document_id AS target_id, document_id + 1 AS d FROM ev WHERE document_id % 40 = 0 UNION SELECT a.document_id, b.document_id FROM ev a JOIN ev b ON a.session_id = b.session_id AND a.project = b.project WHERE a.document_id % 40 = 0),
x AS (SELECT f.target_id, e.document_id, e.created_at FROM f JOIN ev e ON e.document_id = f.d JOIN tg ON tg.target_id = f.target_id AND e.created_at > t)
SELECT target_id, count(*) AS n, min(document_id) AS first_id FROM x GROUP BY 1""")
def dependent_documents(t):
    docs = t.evidence()
    targets = docs.where("document_id % 40 = 0").select("document_id")
    sources = docs.select("document_id", F.concat_ws("/", "project", "session_id").alias("source_key"))
    cites = docs.select((F.col("document_id") + 1).alias("document_id"), F.col("document_id").alias("cited_id"))
    links = docs.select((F.col("document_id") + 1).alias("id"), F.col("document_id").alias("supersedes"))
    return context.dependents(targets, docs, sources, cites, links).select("target_id", "n", F.get("first", F.lit(0)).alias("first_id"))


@query(_BM25.rstrip() + """, b AS (SELECT query_id, document_id AS id, CASE WHEN document_id % 3 = 0 THEN least(1.0, round(normalized * 1.12::DOUBLE, 6)) ELSE normalized END AS norm FROM best) SELECT * FROM b""")
def working_set_boost(t):
    pool = lexical.search(t.evidence(), _asked(t)).select("query_id", F.col("document_id").alias("id"), F.col("normalized").alias("norm"))
    return context.boosted(pool, pool.where("id % 3 = 0"), context.WORKING_SET_BOOST)


@query()
def anchors_extracted(t):
    """Typed anchors of page URLs and markup; the families use lookarounds, which DuckDB's patterns lack."""
    from strataspan.operators import anchors

    return anchors.extracted(t.pages.select(F.col("page_id").alias("document_id"), F.concat_ws("\n", "url", "html").alias("text")))


@query()
def bm25_porter_topk(t):
    """BM25 with the stemming analyser."""
    from strataspan.operators import analysis

    return analysis.search(t.evidence(), t.benchmark.select(F.col("item_id").alias("query_id"), "text"))


@query()
def byte_windows_900(t):
    return segments.byte_windows(t.evidence())
