"""Further queries of the library over the driver tables, and the same in DuckDB SQL: stored indexes, protection, hints, feedback, sessions, evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strataspan.adapters import EPOCH_MS, STEP_MS
from strataspan.functions import columns as cx
from strataspan.functions import text as tx
from strataspan.operators import anchors, bm25f, context, evaluation, exact, feedback, hints, lifecycle, protection, ranking, segments, semantic, session, stored, structure
from strataspan.plans.catalogue import _CLASS, _EV, _KEPT, _NOW, _SCORES, QUERIES, query  # noqa: F401

_STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOP_WORDS))
_WINS = rf"""tk AS (SELECT document_id, project, created_at, CASE WHEN kind = 'decision-candidate' THEN 2.5::DOUBLE ELSE 1.0::DOUBLE END AS w, regexp_extract_all(lower(coalesce(text, '')), '{tx.TERM_TOKEN}') AS ts FROM ev),
wn AS (SELECT *, unnest(range(CAST(greatest(0, ceil((len(ts) - 900) / 765.0)) AS BIGINT) + 1)) AS ordinal FROM tk),
ln AS (SELECT document_id, project, created_at, CAST(ordinal AS INTEGER) AS ordinal, ts[ordinal * 765 + 1 : ordinal * 765 + 900] AS part, w, w * len(ts[ordinal * 765 + 1 : ordinal * 765 + 900]) AS wlen FROM wn)"""
_ASK20 = rf"""a0 AS (SELECT item_id AS query_id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '{tx.TERM_TOKEN}'), lambda x: x NOT IN ({_STOP})) AS ts FROM benchmark),
a1 AS (SELECT query_id, unnest(ts) AS term, generate_subscripts(ts, 1) AS pos FROM a0), a2 AS (SELECT query_id, term, min(pos) AS pos FROM a1 GROUP BY ALL),
ask AS (SELECT query_id, term FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM a2) WHERE n <= 20)"""


def _index(t):
    wins = bm25f.windows(bm25f.plain_tokens(t.evidence()))
    return bm25f.postings(wins), bm25f.lengths(wins)


_TOP10 = f"""st AS (SELECT project, count(*) AS n, avg(wlen) AS av FROM ln GROUP BY 1),
po AS (SELECT project, document_id, created_at, ordinal, wlen, term, count(*) AS tf, sum(w) AS wtf FROM (SELECT project, document_id, created_at, ordinal, wlen, w, unnest(part) AS term FROM ln) WHERE term IN (SELECT term FROM ask) GROUP BY ALL),
df AS (SELECT project, term, count(*) AS df FROM po GROUP BY ALL), qn AS (SELECT query_id, count(*) AS n_terms FROM ask GROUP BY 1),
pt AS (SELECT query_id, project, document_id, created_at, ordinal, term, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS idf, ln(1 + (n - 0.5::DOUBLE) / 1.5::DOUBLE) AS top,
  wtf * 2.2::DOUBLE / (wtf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * wlen / av)) AS f FROM ask JOIN po USING (term) JOIN df USING (project, term) JOIN st USING (project)),
wi AS (SELECT query_id, project, document_id, created_at, ordinal, round(sum(idf * f ORDER BY term), 6) AS score, count(*) AS matched, round(max(idf / top), 6) AS max_idf FROM pt GROUP BY ALL),
be AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, project, document_id ORDER BY score DESC, matched DESC, ordinal) AS k FROM wi) WHERE k = 1),
rk AS (SELECT *, row_number() OVER w AS rank, round(score - lead(score, 1, 0.0) OVER w, 6) AS margin FROM be WINDOW w AS (PARTITION BY query_id, project ORDER BY score DESC, matched DESC, created_at DESC, document_id))
SELECT query_id, project, CAST(rank AS INTEGER) AS rank, document_id, ordinal, score, round(matched / n_terms, 6) AS coverage, max_idf, round(score / (score + 1), 6) AS normalized, margin FROM rk JOIN qn USING (query_id) WHERE rank <= 10"""
_LEFT = _WINS.replace("FROM ev)", "FROM ev WHERE document_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0))", 1)


@query(f"WITH {_EV}, {_WINS}, {_ASK20}, {_TOP10}")
def bm25f_topk(t):
    """BM25F over windows of weighted fields, the best window of a document; the statistics are those of each project's windows."""
    post, lens = _index(t)
    return bm25f.search(post, lens, bm25f.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))).drop("version")


@query(f"WITH {_EV}, {_LEFT}, {_ASK20}, {_TOP10}")
def search_after_delete(t):
    """The stored index after the documents of low quality were deleted: postings and block bounds are of all documents, statistics are carried on by signed deltas; scores are those of an index
    that never had what is gone."""
    post, lens = _index(t)
    post = post.withColumns({"level": stored.level(F.col("wtf"), F.col("wlen")), "gaps": F.lit(None).cast("array<int>")})
    gone = t.labels.where("quality = 0").select(F.col("doc_id").alias("document_id"))

    def terms(rows, sign):
        return rows.groupBy("bucket", "project", "term").agg((F.lit(sign) * F.count(F.lit(1))).alias("df"))

    def sums(rows, sign):
        return rows.groupBy("project").agg((F.lit(sign) * F.count(F.lit(1))).alias("n"), (F.lit(sign) * F.sum("wlen")).alias("total"))

    df = terms(post, 1).unionByName(terms(post.join(gone, "document_id", "left_semi"), -1))
    corpus = sums(lens, 1).unionByName(sums(lens.join(gone, "document_id", "left_semi"), -1))
    live = t.evidence().select("document_id", "version").join(gone, "document_id", "left_anti")
    asked = bm25f.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    return stored.search(post, stored.blocks(post), df, corpus, asked, live=live).drop("version", "match_start", "match_end")


@query(f"WITH {_EV}, {_WINS} SELECT project, document_id, ordinal, term, count(*) AS tf, sum(w) AS wtf FROM (SELECT project, document_id, ordinal, w, unnest(part) AS term FROM ln) GROUP BY ALL")
def bm25f_postings(t):
    return _index(t)[0].select("project", "document_id", "ordinal", "term", "tf", "wtf")


@query(f"""WITH {_EV}, {_WINS}, o AS (SELECT project, count(*) AS n, sum(wlen) AS total FROM ln WHERE document_id % 3 != 0 GROUP BY 1), ad AS (SELECT project, wlen FROM ln WHERE document_id % 3 = 0), re AS (SELECT project, wlen FROM ln WHERE document_id % 6 = 1),
s AS (SELECT project, n, total FROM o UNION ALL SELECT project, 1, wlen FROM ad UNION ALL SELECT project, -1, -wlen FROM re) SELECT project, CAST(sum(n) AS BIGINT) AS n, round(greatest(0.0, sum(total)), 6) AS total FROM s GROUP BY 1""")
def corpus_delta(t):
    """Corpus statistics carried on by what is added and removed."""
    lens = _index(t)[1]
    old = lens.where("document_id % 3 != 0").groupBy("project").agg(F.count(F.lit(1)).alias("n"), F.sum("wlen").alias("total"))
    return bm25f.statistics_delta(old, lens.where("document_id % 3 = 0"), lens.where("document_id % 6 = 1")).withColumn("total", F.round("total", 6))


@query(f"""WITH {_EV}, {_KEPT}, {_ASK20}, r AS (SELECT document_id, retention_class FROM kept JOIN labels ON doc_id = document_id WHERE quality = 0),
p AS (SELECT DISTINCT document_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{tx.TERM_TOKEN}')) AS term FROM ev)
SELECT query_id, count(DISTINCT document_id) AS n_expired, array_to_string(list_sort(list(DISTINCT retention_class)), ',') AS classes FROM ask JOIN p USING (term) JOIN r USING (document_id) GROUP BY 1""")
def expired_matches(t):
    """How many retired documents each query would have met, and of which classes."""
    retired = lifecycle.retention(t.evidence()).join(t.labels.where("quality = 0").select(F.col("doc_id").alias("document_id")), "document_id").select("document_id", "version", "retention_class")
    asked = bm25f.query_terms(t.benchmark.select(F.col("item_id").alias("query_id"), "text"))
    return bm25f.expired_matches(_index(t)[0], asked, retired).withColumn("classes", F.array_join("classes", ","))


_PIN = """pins AS (SELECT doc_id AS document_id FROM documents WHERE doc_id % 11 = 0 AND doc_id % 22 != 0), holds AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderkey % 7 = 0 AND o_orderstatus = 'O'),
leases AS (SELECT DISTINCT event_id AS document_id FROM events WHERE event_id % 13 = 0 AND value > 50)"""


def _keeps(t):
    pins = t.documents.where("doc_id % 11 = 0").select(F.concat(F.lit("p"), F.col("doc_id")).alias("pin_id"), F.col("doc_id").alias("document_id"), F.lit(1).alias("seq"), F.lit(True).alias("active"))
    pins = pins.unionByName(pins.where("document_id % 22 = 0").withColumn("seq", F.lit(2)).withColumn("active", F.lit(False)))
    orders = t.orders.where("o_orderkey % 7 = 0").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("owner_id"), F.col("o_orderkey").alias("document_id"), F.lit(None).cast("string").alias("session_id"), F.lit(1).alias("seq"), F.lit(None).cast("long").alias("until"), (F.col("o_orderstatus") == "O").alias("active"))
    sessions = t.spark.createDataFrame([("s1", None, "en", 1, _NOW - 1, True), ("s2", None, "de", 1, _NOW + 1, True)], "owner_id string, document_id long, session_id string, seq int, until long, active boolean")
    leases = t.events.where("event_id % 13 = 0").select(F.concat(F.lit("l"), F.col("event_id")).alias("owner_id"), F.col("event_id").alias("document_id"), F.lit(1).alias("seq"), F.when(F.col("value") > 50, _NOW + 1).otherwise(_NOW).alias("until"), F.lit(True).alias("active"))
    return pins, orders.unionByName(sessions), leases


@query(f"""WITH {_EV}, {_PIN}, m AS (SELECT document_id, 'admission' AS r FROM ev WHERE document_id % 17 = 0 UNION ALL SELECT e.document_id, 'pin' FROM ev e JOIN pins USING (document_id) UNION ALL SELECT e.document_id, 'document-protection' FROM ev e JOIN holds USING (document_id)
 UNION ALL SELECT document_id, 'session-protection' FROM ev WHERE session_id = 'de' UNION ALL SELECT e.document_id, 'lease' FROM ev e JOIN leases USING (document_id)) SELECT document_id, string_agg(r, ',' ORDER BY r) AS reasons FROM m GROUP BY 1""")
def protected_documents(t):
    """What keeps each document: admission, pins, protections of documents and sessions, leases."""
    docs = t.evidence().withColumn("protect", F.col("document_id") % 17 == 0)
    return protection.protected(docs, _NOW, *_keeps(t)).select("document_id", F.array_join("reasons", ",").alias("reasons"))


@query(f"""WITH {_EV}, {_KEPT}, {_PIN}, k AS (SELECT document_id FROM ev WHERE document_id % 17 = 0 OR session_id = 'de' UNION SELECT document_id FROM pins UNION SELECT document_id FROM holds UNION SELECT document_id FROM leases),
n AS (SELECT document_id, retention_class, kind, CASE WHEN document_id % 9 = 0 THEN NULL WHEN document_id % 9 = 1 THEN {_NOW} - 1 ELSE expires_at END AS e FROM kept)
SELECT document_id, e AS expires_at FROM n WHERE (e <= {_NOW} OR (retention_class = 'ephemeral-payload' AND kind = 'tool-result')) AND document_id NOT IN (SELECT document_id FROM k)""")
def forced_expiry(t):
    """What goes under disk pressure: what is due after renewals, and every tool result, unless something keeps it."""
    docs = t.evidence().withColumn("protect", F.col("document_id") % 17 == 0)
    kept = protection.protected(docs, _NOW, *_keeps(t))
    old = docs.where("document_id % 9 IN (0, 1)").select("document_id", "version", F.lit(1).alias("generation"), F.lit(5).cast("long").alias("expires_at"))
    new = old.withColumn("generation", F.lit(2)).withColumn("expires_at", F.when(F.col("document_id") % 9 == 1, _NOW - 1))
    return protection.due(docs, _NOW, kept, old.unionByName(new), forced=True).select("document_id", "expires_at")


@query("""WITH c AS (SELECT sha256(coalesce(text, '')) AS h, doc_id, octet_length(encode(coalesce(text, ''))) AS b FROM documents WHERE coalesce(text, '') != '') SELECT 'sha256:' || h AS chunk_id, CAST(max(b) AS BIGINT) AS bytes FROM c GROUP BY h HAVING count(*) FILTER (doc_id % 3 != 0) = 0""")
def collectable_chunks(t):
    """Chunks that no live document refers to any more."""
    docs = t.evidence()
    chunks = segments.physical_chunks(docs, most=1 << 30, least_line=1 << 29)
    return protection.unreferenced_chunks(chunks, docs.where("document_id % 3 != 0"))


@query("SELECT DISTINCT user_id AS document_id, CAST(1 AS INTEGER) AS version, CAST(floor(epoch_ms(ts) / 3600000) AS BIGINT) AS bucket FROM events")
def access_buckets(t):
    return protection.accesses(t.events.select(F.col("user_id").alias("document_id"), F.lit(1).alias("version"), cx.epoch_ms(F.col("ts")).alias("at_ms")))


@query(f"WITH {_EV}, r AS (SELECT session_id, document_id, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, document_id DESC) AS turn_rank FROM ev WHERE kind = 'turn') SELECT session_id, document_id, CAST(turn_rank AS INTEGER) AS turn_rank FROM r WHERE turn_rank <= 4")
def protected_turns(t):
    return protection.protected_turns(t.evidence())


@query(f"""WITH {_EV}, q AS (SELECT document_id, project, session_id AS subject_key, created_at, document_id - 1 - document_id % 4 AS target_id FROM ev WHERE document_id > 4), g AS (SELECT doc_id AS document_id FROM labels WHERE quality = 0),
j AS (SELECT q.document_id, target_id, CASE WHEN q.document_id = target_id THEN 'self' WHEN e.document_id IS NULL THEN 'missing' WHEN target_id IN (SELECT document_id FROM g) THEN 'not-live' WHEN e.project IS DISTINCT FROM q.project AND e.project IS NOT NULL AND q.project IS NOT NULL THEN 'project'
 WHEN e.created_at >= q.created_at THEN 'not-older' WHEN e.session_id IS NOT NULL AND e.session_id IS DISTINCT FROM q.subject_key THEN 'subject' END AS reason FROM q LEFT JOIN ev e ON e.document_id = target_id) SELECT * FROM j WHERE reason IS NOT NULL""")
def supersession_errors(t):
    docs = t.evidence().withColumn("subject_key", F.col("session_id"))
    asked = docs.where("document_id > 4").withColumn("target_id", F.col("document_id") - 1 - F.col("document_id") % 4)
    retired = t.labels.where("quality = 0").select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"))
    return protection.supersession_errors(asked, docs, retired)


_CUES = {k: v.replace("'", "''") for k, v in (("h", cx.HISTORICAL), ("c", cx.CURRENT_STATE), ("g", cx.GENERAL_KNOWLEDGE))}


@query(rf"""WITH m AS (SELECT conv_id, turn, coalesce(text, '') AS t FROM conversations WHERE role = 'user'), i AS (SELECT *, regexp_matches(t, '(?i){_CUES['h']}') AS historical FROM m)
SELECT conv_id, turn, historical, regexp_matches(t, '(?i){_CUES['c']}') AND NOT historical AS current_only, regexp_matches(trim(t), '(?i){_CUES['g']}') AND NOT historical AS general FROM i""")
def message_intents(t):
    return t.conversations.where("role = 'user'").select("conv_id", "turn", cx.intent(F.col("text")).alias("i")).select("conv_id", "turn", "i.historical", "i.current_only", "i.general")


@query("""WITH h AS (SELECT user_id AS lineage, event_id % 20 AS document_id, event_id, epoch_ms(ts) AS at_ms FROM events WHERE event_type != 'view'), x AS (SELECT user_id AS lineage, event_id % 20 AS document_id, epoch_ms(ts) AS shown_ms FROM events WHERE event_type = 'view')
SELECT event_id, EXISTS (SELECT 1 FROM x WHERE x.lineage = h.lineage AND x.document_id = h.document_id AND x.shown_ms < h.at_ms AND h.at_ms - x.shown_ms < 86400000) AS seen FROM h""")
def hint_cooldown(t):
    """Whether a source was shown in the same lineage within the day before."""
    at = cx.epoch_ms(F.col("ts"))
    e = t.events.select("event_id", "event_type", F.col("user_id").alias("lineage"), (F.col("event_id") % 20).alias("document_id"), at.alias("at_ms"))
    return hints.surfaced(e.where("event_type != 'view'").drop("event_type"), e.where("event_type = 'view'").select("lineage", "document_id", F.col("at_ms").alias("shown_ms"))).select("event_id", "seen")


@query("""WITH h AS (SELECT user_id AS session_id, event_id AS seq, CAST(floor(value) AS BIGINT) AS tokens, event_id % 3 = 0 AS live FROM events WHERE event_type = 'click'),
s AS (SELECT *, sum(tokens) OVER w AS spent, sum(CASE WHEN live THEN tokens ELSE 0 END) OVER w AS active_spent FROM h WINDOW w AS (PARTITION BY session_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) SELECT session_id, seq, CAST(spent AS BIGINT) AS spent, CAST(active_spent AS BIGINT) AS active_spent FROM s WHERE spent <= 300 AND active_spent <= 120""")
def hint_budgets(t):
    h = t.events.where("event_type = 'click'").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("seq"), F.col("event_id").alias("message_id"), F.floor("value").alias("tokens"))
    return hints.within_budget(h, h.where("message_id % 3 = 0"), 300, 120).select("session_id", "seq", "spent", "active_spent")


@query("""WITH h AS (SELECT user_id AS session_id, event_id AS message_id, epoch_ms(ts) AS at_ms FROM events), l AS (SELECT session_id, max(at_ms) AS last FROM h GROUP BY 1), n AS (SELECT max(at_ms) AS now FROM h) SELECT session_id, message_id FROM h JOIN l USING (session_id), n WHERE last < now - 86400000""")
def abandoned_hints(t):
    h = t.events.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("message_id"), cx.epoch_ms(F.col("ts")).alias("at_ms"))
    return hints.abandoned(h, h, h.agg(F.max("at_ms")).first()[0], 86_400_000).select("session_id", "message_id")


@query("""WITH e AS (SELECT event_id AS seq, CAST(event_id % 5 AS VARCHAR) AS key, event_type IN ('purchase', 'signup') AS hit, unnest([CAST(user_id AS VARCHAR), 'g' || user_id % 50]) AS s FROM events),
m AS (SELECT a.seq AS miss_id, a.key AS miss_key, a.s, (SELECT min(h.seq) FROM e h WHERE h.s = a.s AND h.hit AND h.seq > a.seq) AS hit_id FROM e a WHERE NOT a.hit),
v AS (SELECT * FROM m WHERE hit_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM e b WHERE b.s = m.s AND NOT b.hit AND b.key = m.miss_key AND b.seq > m.miss_id AND b.seq < m.hit_id)),
f AS (SELECT miss_id, miss_key, min(hit_id) AS hit_id FROM v GROUP BY ALL) SELECT DISTINCT miss_id, f.hit_id, miss_key, h.key AS hit_key FROM f JOIN e h ON h.seq = f.hit_id WHERE h.key != miss_key""")
def reformulation_lineages(t):
    """Misses and the hits that end them, over several sessions of an event."""
    e = t.events.select(F.col("event_id").alias("seq"), (F.col("event_id") % 5).cast("string").alias("query_key"), F.col("event_type").isin("purchase", "signup").alias("hit"), F.array(F.col("user_id").cast("string"), F.concat(F.lit("g"), F.col("user_id") % 50)).alias("sessions"))
    return feedback.reformulations(e)


@query("""WITH s AS (SELECT l_orderkey AS event_id, sha256('loc-' || l_partkey % 50) AS fp, 'K' || l_suppkey % 5 AS key FROM lineitem), r AS (SELECT l_orderkey AS event_id, sha256('loc-' || l_partkey % 50) AS fp, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY ALL),
q AS (SELECT lower(key) AS query_key, count(DISTINCT event_id) AS searches, count(*) AS shown, count(*) FILTER (n > 0) AS recalled FROM s JOIN r USING (event_id, fp) GROUP BY 1) SELECT * FROM q ORDER BY searches DESC, recalled DESC, shown DESC, query_key LIMIT 5""")
def feedback_queries(t):
    """Most frequent queries, with how many results were shown and recalled."""
    fp = cx.locator_fingerprint(F.concat(F.lit("loc-"), F.col("l_partkey") % 50))
    s = t.lineitem.select(F.col("l_orderkey").alias("event_id"), fp.alias("fingerprint"), cx.query_key(F.concat(F.lit("  K"), F.col("l_suppkey") % 5, F.lit(" "))).alias("query_key"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("missing").alias("status"))
    return feedback.query_totals(feedback.attributed(s.drop("status"), s.select("event_id", "fingerprint", "status")), 5)


@query("SELECT l_suppkey AS document_id, CAST(1 AS INTEGER) AS version, count(DISTINCT (l_orderkey, l_partkey)) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1")
def recall_counters(t):
    r = t.lineitem.select(F.col("l_suppkey").alias("document_id"), F.lit(1).alias("version"), F.col("l_orderkey").alias("event_id"), F.col("l_partkey").alias("fingerprint"), F.when(F.col("l_returnflag") == "R", "resolved").otherwise("missing").alias("status"))
    return feedback.recall_counts(r)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, count(*) AS n FROM events GROUP BY 1")
def latency_percentiles(t):
    return evaluation.nearest_rank(t.events, "value", ["event_type"], [0.5, 0.95])


@query(rf"""WITH {_SCORES}, g AS (SELECT conv_id, turn, greatest(question, request, correction, answer) AS best FROM scores), w AS (SELECT conv_id, turn, CASE WHEN contains(coalesce(text, ''), '?') AND role = 'user' THEN 100 ELSE 75 END AS want FROM conversations WHERE role IN ('user', 'assistant'))
SELECT count(*) AS n, count(*) FILTER (best = want) AS "right", count(*) FILTER (best IS NULL) AS missing, round(avg(CASE WHEN best = want THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM w LEFT JOIN g USING (conv_id, turn)""")
def structural_accuracy(t):
    rows = session.structural_rows(t.conversations, structure.structural_scores(t.conversations)).select("conv_id", "turn", "score")
    want = t.conversations.where("role IN ('user', 'assistant')").select("conv_id", "turn", F.when(F.contains(F.coalesce("text", F.lit("")), F.lit("?")) & (F.col("role") == "user"), 100).otherwise(75).alias("score"))
    return evaluation.accuracy(rows, want, ["conv_id", "turn"], "score")


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, CASE WHEN doc_id % 10 = 0 THEN 'x' ELSE lang END AS l2, lang FROM documents),
a AS (SELECT doc_id, lang AS v, h FROM d), b AS (SELECT doc_id, l2, h FROM d WHERE doc_id % 8 != 0), x AS ((SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) UNION ALL (SELECT *, 'extra' FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)))
SELECT doc_id, side FROM x WHERE doc_id % 4 != 0""")
def copy_differences(t):
    """Rows that a copy has too few or too many of, but for allowed ones."""
    d = t.documents.select("doc_id", "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    other = d.where("doc_id % 8 != 0").withColumn("lang", F.when(F.col("doc_id") % 10 == 0, "x").otherwise(F.col("lang")))
    return evaluation.allowed(evaluation.differences(d, other), t.documents.where("doc_id % 4 = 0"), ["doc_id"]).select("doc_id", "side")


_MSG = """ms AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, '[' || coalesce(role, 'unknown') || chr(93) || chr(10) || coalesce(text, '') AS s FROM conversations)"""


@query(f"""WITH {_MSG} SELECT conv_id, turn, role || ':' || turn || '::' || substr(sha256(s), 1, 12) AS key, CAST(ceil(length(s) / 4.0) AS BIGINT) AS tokens,
 CASE WHEN length(trim(split_part(trim(text), chr(10), 1))) > 80 THEN substr(trim(split_part(trim(text), chr(10), 1)), 1, 79) || '…' ELSE trim(split_part(trim(text), chr(10), 1)) END AS topic FROM ms""")
def message_keys(t):
    s = cx.serialized_message(F.col("role"), F.lit(None).cast("string"), F.col("text"))
    return t.conversations.select("conv_id", "turn", cx.message_key(F.col("role"), F.col("turn"), F.lit(None).cast("string"), s).alias("key"), cx.estimated_tokens(s).alias("tokens"), cx.topic(F.col("text")).alias("topic"))


@query("""WITH r AS (SELECT *, greatest(0, 1000 * (1 + conv_id % 200) - CASE WHEN conv_id % 3 = 0 THEN 0 ELSE 4000 END) AS room FROM (SELECT DISTINCT conv_id FROM conversations)), l AS (SELECT conv_id, greatest(1, floor(room * 0.8::DOUBLE)) AS hard, room FROM r)
SELECT conv_id, CAST(least(greatest(1, floor(room * 0.65::DOUBLE)), hard) AS BIGINT) AS rotation_tokens, CAST(hard AS BIGINT) AS hard_limit_tokens, CASE WHEN conv_id % 11 = 0 THEN 'forced' WHEN conv_id * 500 >= least(greatest(1, floor(room * 0.65::DOUBLE)), hard) THEN 'tokens' WHEN conv_id % 40 >= 25 THEN 'turns' END AS trigger FROM l""")
def rotation_limits(t):
    one = t.conversations.select("conv_id").distinct().withColumn("l", session.limits(1000 * (1 + F.col("conv_id") % 200), F.when(F.col("conv_id") % 3 != 0, 4000)))
    trigger = session.must_rotate(F.col("conv_id") * 500, F.col("conv_id") % 40, F.col("l.rotation_tokens"), 25, F.col("conv_id") % 11 == 0)
    return one.select("conv_id", "l.rotation_tokens", "l.hard_limit_tokens", trigger.alias("trigger"))


@query("""WITH b AS (SELECT conv_id, max(turn) AS m FROM conversations GROUP BY 1), x AS (SELECT conv_id, turn, m, conv_id % 5 AS k FROM conversations JOIN b USING (conv_id)) SELECT conv_id, turn, k != 1 AS found FROM x WHERE k IN (0, 1) OR turn >= m - 1""")
def boundary_slices(t):
    keyed = t.conversations.select("conv_id", "turn", F.concat_ws("/", "conv_id", "turn").alias("key"))
    at = keyed.groupBy("conv_id").agg(F.max("turn").alias("m")).where("conv_id % 5 != 0").select("conv_id", F.when(F.col("conv_id") % 5 == 1, "none").otherwise(F.concat_ws("/", "conv_id", F.col("m") - 1)).alias("boundary_key"))
    return session.from_boundary(keyed, at).select("conv_id", "turn", "found")


@query("""WITH c AS (SELECT user_id AS conv_id, event_id % 6 AS call_id, arg_min(event_type, event_id) AS tool FROM events WHERE event_id % 3 = 0 GROUP BY ALL) SELECT user_id AS conv_id, event_id AS turn, tool FROM events r LEFT JOIN c ON c.conv_id = r.user_id AND c.call_id = r.event_id % 6 WHERE event_id % 3 != 0""")
def tool_arguments(t):
    e = t.events.select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("turn"), (F.col("event_id") % 6).alias("call_id"), F.col("event_type").alias("tool"), F.lit("{}").alias("arguments"))
    return session.with_arguments(e.where("turn % 3 != 0").select("conv_id", "turn", "call_id"), e.where("turn % 3 = 0")).select("conv_id", "turn", "tool")


@query("""WITH RECURSIVE r AS (SELECT user_id AS packet_id, event_id AS place, CAST(floor(value) AS BIGINT) AS tokens, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT packet_id, place, n, tokens <= 60 AS taken, CASE WHEN tokens <= 60 THEN tokens ELSE 0 END AS used FROM r WHERE n = 1 UNION ALL SELECT r.packet_id, r.place, r.n, f.used + r.tokens <= 60, f.used + CASE WHEN f.used + r.tokens <= 60 THEN r.tokens ELSE 0 END FROM f JOIN r ON r.packet_id = f.packet_id AND r.n = f.n + 1)
SELECT packet_id, CAST(place AS INTEGER) AS place FROM f WHERE taken""")
def budget_fill(t):
    return session.filled(t.events.select(F.col("user_id").alias("packet_id"), F.col("event_id").alias("place"), F.floor("value").alias("tokens")), 60)


@query("""WITH e AS (SELECT conv_id, turn AS turn_group, 20 + length(coalesce(text, '')) % 60 + 1 AS chars FROM conversations), p AS (SELECT *, count(*) OVER w AS k, ceil((sum(chars) OVER w + 60) / 4.0) AS tokens FROM e WINDOW w AS (PARTITION BY conv_id ORDER BY turn_group DESC ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n, min(turn_group) AS first_kept, CAST(max(tokens) AS BIGINT) AS tokens FROM p WHERE tokens <= 50 OR k = 1 GROUP BY 1""")
def catalogue_trim(t):
    lines = t.conversations.select("conv_id", F.col("turn").alias("turn_group"), F.expr("repeat('x', 20 + length(coalesce(text, '')) % 60)").alias("line"))
    return session.catalogue(lines, 50).withColumn("tokens", F.col("tokens").cast("long"))


@query("SELECT conv_id, turn, CASE WHEN length(text) > 100 THEN substr(text, 1, 70) || chr(10) || '… ' || (length(text) - 100) || ' characters …' || chr(10) || right(text, 30) ELSE text END AS shown FROM conversations")
def result_previews(t):
    return t.conversations.select("conv_id", "turn", session.preview(F.col("text"), 100).alias("shown"))


_POOL2 = """pl AS (SELECT user_id AS query_id, event_id AS id, CASE WHEN event_type = 'view' THEN 'exact' ELSE 'lexical' END AS mode, event_id % 4 AS root, event_id AS rank, 1 - event_id / 1000000.0::DOUBLE AS norm FROM events)"""


@query(f"""WITH {_POOL2} SELECT a.query_id, a.id, round(a.norm - coalesce((SELECT arg_min(b.norm, b.rank) FROM pl b WHERE b.query_id = a.query_id AND b.mode = a.mode AND b.rank > a.rank AND b.root != a.root), 0), 6) AS evidence_margin FROM pl a""")
def evidence_margins(t):
    """Margin to the next result of the same mode that rests on other evidence."""
    e = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("id"), F.when(F.col("event_type") == "view", "exact").otherwise("lexical").alias("mode"), (F.col("event_id") % 4).alias("root"), F.col("event_id").alias("rank"), (1 - F.col("event_id") / 1_000_000).alias("norm"))
    return ranking.evidence_margins(e).select("query_id", "id", "evidence_margin")


@query("""WITH r AS (SELECT user_id AS query_id, event_id AS document_id, CASE WHEN event_id % 7 = 2 THEN 3 ELSE 1 END AS tier, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, CASE WHEN event_type != 'view' THEN value END AS s FROM events),
m AS (SELECT *, tier = 1 AND rank <= 40 AND max(s IS NOT NULL) OVER (PARTITION BY query_id) AS mv FROM r), p AS (SELECT *, row_number() OVER (PARTITION BY query_id, mv ORDER BY rank) AS k, row_number() OVER (PARTITION BY query_id, mv ORDER BY s DESC NULLS LAST, rank) AS n FROM m)
SELECT a.query_id, a.document_id, CAST(CASE WHEN a.mv THEN b.rank ELSE a.rank END AS INTEGER) AS new_rank FROM p a LEFT JOIN p b ON b.query_id = a.query_id AND b.mv AND b.k = a.n""")
def reranked(t):
    """Rows of the first tier in order of a second score, each in a place that such a row had."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t.events.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("document_id"), F.when(F.col("event_id") % 7 == 2, 3).otherwise(1).alias("tier"), rank.alias("rank"), "event_type", F.col("value").alias("score"))
    return semantic.reranked(e, e.where("event_type != 'view'").select("query_id", "document_id", "score")).select("query_id", "document_id", "new_rank")


@query("""WITH w AS (SELECT doc_id AS document_id, CAST(unnest(range(CAST(ceil(length(coalesce(text, '')) / 400.0) AS BIGINT) + 1)) AS INTEGER) AS ordinal FROM documents), x AS (SELECT document_id, ordinal, ordinal * 400 AS a, ordinal * 400 + 500 AS e FROM w),
r AS (SELECT doc_id AS document_id, doc_id % 900 AS s, doc_id % 900 + 120 AS t FROM documents), m AS (SELECT *, a <= s AND e >= t AS inside FROM r JOIN x USING (document_id) WHERE a < t AND e > s)
SELECT document_id, arg_min(ordinal, CASE WHEN inside THEN 0 ELSE 1000000 END + ordinal) AS ordinal FROM m GROUP BY 1""")
def windows_of_ranges(t):
    """The stored window that a byte range lies in, or else the first that it meets."""
    n = F.ceil(F.length(F.coalesce("text", F.lit(""))) / 400).cast("int")
    wins = t.documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), F.explode(F.sequence(F.lit(0), n)).alias("ordinal")).withColumn("start_byte", F.col("ordinal") * 400).withColumn("end_byte", F.col("ordinal") * 400 + 500)
    asked = t.documents.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("version"), (F.col("doc_id") % 900).alias("start"), (F.col("doc_id") % 900 + 120).alias("end"))
    return segments.window_for_range(wins, asked).select("document_id", "ordinal")


@query("SELECT 'sha256:' || sha256(text) AS chunk_id, octet_length(encode(text)) AS bytes FROM documents WHERE text != '' GROUP BY text")
def unique_chunks(t):
    one = protection.unique_chunks(segments.physical_chunks(t.evidence(), most=1 << 30, least_line=1 << 29))
    return one.select("chunk_id", F.octet_length("content").alias("bytes"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS behind FROM conversations) WHERE coalesce(behind, 0) < 2")
def last_two_turns(t):
    return session.last_turns(t.conversations, 2).select("conv_id", "turn", "role", "text")


@query(f"""WITH {_EV} SELECT document_id, CASE WHEN kind IN ('tool-result', 'tool-argument') AND (tool = 'archive_search' OR ends_with(tool, '__archive_search')) THEN TRUE ELSE FALSE END AS echo FROM (SELECT *, CASE document_id % 3 WHEN 0 THEN 'archive_search' WHEN 1 THEN 'client__archive_search' ELSE 'other' END AS tool FROM ev)""")
def echo_documents(t):
    tool = F.when(F.col("document_id") % 3 == 0, "Archive_Search").when(F.col("document_id") % 3 == 1, "client__archive_search").otherwise("other")
    return t.evidence().select("document_id", cx.echo_of(F.col("kind"), tool, ["archive_search"]).alias("echo"))


@query(f"""WITH {_EV} SELECT document_id, to_json({{'bytes': octet_length(encode(coalesce(text, ''))), 'kind': kind, 'project': project}}) AS json, substr(sha256(concat(coalesce(session_id, ''), chr(0), coalesce(project, ''), chr(0), kind, chr(0), created_at, chr(0), coalesce(text, ''))), 1, 20) AS key, strftime(make_timestamp(created_at * 1000), '%Y-%m-%d') AS day FROM ev""")
def document_keys(t):
    d = t.evidence()
    json = cx.stable_json(project=F.col("project"), kind=F.col("kind"), bytes=F.octet_length(F.coalesce("text", F.lit(""))))
    return d.select("document_id", json.alias("json"), cx.document_key(F.col("session_id"), F.col("project"), F.col("kind"), F.col("created_at"), F.col("text")).alias("key"), cx.source_date(F.col("created_at")).alias("day"))


@query()
def exact_anchor_lookup(t):
    """Anchors stored from pages, asked by each page's URL, half of them in capitals: two passes, coverage computed. Patterns with lookarounds are beyond DuckDB."""
    post = exact.postings(anchors.extracted(t.pages.select(F.col("page_id").alias("document_id"), "url", F.concat_ws("\n", "url", "html").alias("text"))))
    asked = t.pages.select(F.col("page_id").alias("query_id"), F.lit("url").alias("type"), F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise(F.upper("url")).alias("normalized")).withColumn("folded", F.lower("normalized")).withColumn("asked", F.lit(1))
    return exact.lookup(post, asked, k=10)


@query()
def fact_sentences(t):
    return session.fact_sentences(t.conversations)


@query()
def salient_terms(t):
    return session.salient(t.conversations)


@query()
def session_epochs(t):
    """Epoch and archive state of every message, by walking each conversation."""
    sized = t.conversations.withColumn("tokens", cx.estimated_tokens(F.col("text")))
    return session.epochs(sized, rotation_tokens=300, retain_turns=2, reserve=50)


@query()
def session_checkpoints(t):
    sized = t.conversations.withColumn("tokens", cx.estimated_tokens(F.col("text")))
    return session.checkpoints(t.conversations, session.epochs(sized, rotation_tokens=300, retain_turns=2, reserve=50))


@query()
def semantic_search(t):
    """Spans of all documents embedded, asked by every benchmark text as a whole."""
    index = semantic.indexed(t.evidence())
    return semantic.search(index, semantic.embedded(t.benchmark.select(F.col("item_id").alias("query_id"), "text")), 3)


_BUDGET = 12


@query(f"""WITH RECURSIVE e AS (SELECT user_id AS s, epoch_ms(ts) AS t, event_id AS id FROM events WHERE user_id IS NOT NULL),
l AS (SELECT s, list({{'t': t, 'id': id}} ORDER BY t DESC, id DESC) AS r FROM e GROUP BY s),
line AS (SELECT a.s AS root, d AS depth, l.s, l.r FROM l a, (SELECT unnest(range(4)) AS d), l WHERE l.s = a.s - d),
st AS (SELECT root, list(r ORDER BY depth) AS rr, list(s ORDER BY depth) AS ss FROM line GROUP BY root),
m AS (SELECT root, 0 AS step, rr, ss, list_transform(ss, lambda x: 0) AS took, list_transform(ss, lambda x: 1) AS held, {_BUDGET} - len(ss) AS budget, 0 AS who FROM st
  UNION ALL SELECT root, step + 1, rr, ss, list_transform(range(1, len(ss) + 1), lambda i: took[i] + CAST(i = w AS INTEGER)),
    list_transform(range(1, len(ss) + 1), lambda i: held[i] + CAST(i = w AND budget > 0 AND held[i] < len(rr[i]) AS INTEGER)), budget - CAST(budget > 0 AND held[w] < len(rr[w]) AS INTEGER), w
  FROM (SELECT *, list_max(list_filter(list_transform(range(1, len(ss) + 1), lambda i: CASE WHEN took[i] < held[i] THEN {{'t': rr[i][took[i] + 1].t, 'id': rr[i][took[i] + 1].id, 'i': i}} END), lambda x: x IS NOT NULL)).i AS w FROM m) WHERE w IS NOT NULL)
SELECT root, CAST(step AS INTEGER) AS rank, ss[who] AS session_id, rr[who][took[who]].id AS id FROM m WHERE step > 0""")
def lineage_merge(t):
    """The rows that a newest-first merge of each user's and the three users' before sessions reads under one budget; the SQL merges step by step, holding a row of each session."""
    e = t.events.select(F.col("user_id").alias("session_id"), cx.epoch_ms(F.col("ts")).alias("created_at"), F.col("event_id").alias("id"))
    users = e.select(F.col("session_id").alias("root")).distinct().where("root IS NOT NULL")
    lineage = users.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in range(4)]))).withColumn("session_id", F.col("root") - F.col("depth"))
    return context.merged_newest(e, lineage, _BUDGET)


@query(rf"""WITH {_SCORES}, o AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, row_number() OVER w - 1 AS message, coalesce(sum(strlen(coalesce(text, '')) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
r AS (SELECT * FROM (UNPIVOT scores ON question, request, correction, answer INTO NAME relation VALUE confidence) WHERE confidence > 0),
x AS (SELECT o.conv_id, relation, confidence, message, role, a, a + strlen(text) AS b, list_distinct(regexp_extract_all(lower(text), '{structure.WORD}')) AS ws FROM o JOIN r USING (conv_id, turn) WHERE role IN ('user', 'assistant') AND text != ''),
q AS (SELECT conv_id AS c, min_by(regexp_extract_all(lower(text), '{structure.WORD}'), message) AS asked FROM o WHERE role = 'user' GROUP BY 1),
k AS (SELECT c, relation, confidence, message, role, a, b, c - conv_id AS depth, x.conv_id, row_number() OVER (PARTITION BY c, relation ORDER BY confidence DESC, c - conv_id, message DESC) AS rank
  FROM q JOIN x ON x.conv_id BETWEEN c - 2 AND c WHERE len(asked) = 0 OR list_has_any(ws, asked)),
t AS (SELECT c, relation, confidence < 50 OR depth > 0 AS unclear FROM k WHERE rank = 1)
SELECT c || ':latest-' || relation AS query_id, CAST(rank AS INTEGER) AS rank, conv_id AS document_id, CAST(message AS INTEGER) AS message, role, CAST(confidence AS INTEGER) AS confidence, CAST(depth AS INTEGER) AS depth,
  CAST(a AS BIGINT) AS start_byte, CAST(b AS BIGINT) AS end_byte, CASE WHEN unclear THEN 'ambiguous' ELSE 'resolved' END AS status FROM k JOIN t USING (c, relation) WHERE rank <= 3""")
def structural_tier(t):
    """Every conversation asks for its four relations with the words of its first question, over itself and the two before; messages are found again in the conversation's text, in order."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))))
    docs = t.conversations.groupBy(F.col("conv_id").cast("long").alias("document_id")).agg(turns.alias("m"))
    whole = docs.select(
        "document_id", F.lit(1).alias("version"), F.lit("p").alias("project"), F.col("document_id").cast("string").alias("session_id"), (F.lit(EPOCH_MS) + F.col("document_id") * STEP_MS).alias("created_at"), F.lit("turn").alias("kind"),
        F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("text"), F.transform("m", lambda x: F.struct(x["role"].alias("role"), F.lit(0).alias("score"), x["text"].alias("text"))).alias("messages"),
    )
    first = docs.select("document_id", F.get(F.filter("m", lambda x: x["role"] == "user"), F.lit(0))["text"].alias("t")).where("t IS NOT NULL")
    names = F.explode(F.array(*[F.lit(f"latest-{x}") for x in ("question", "request", "correction", "answer")]))
    asked = first.select("document_id", names.alias("relation"), F.regexp_extract_all(F.lower("t"), F.lit(structure.WORD), F.lit(0)).alias("asked_words")).withColumn("query_id", F.concat(F.col("document_id").cast("string"), F.lit(":"), "relation"))
    lineage = asked.select("query_id", F.explode(F.array(*[F.struct((F.col("document_id") - d).cast("string").alias("session_id"), F.lit(d).alias("depth")) for d in range(3)])).alias("l")).select("query_id", "l.*")
    found = structure.lookup(structure.stored_relations(whole), asked.drop("document_id"), lineage)
    return found.drop("version", "legacy")
