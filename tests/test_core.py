"""Text functions on golden values, operators on small fixtures, the engine and its streams end to end."""

import os

import pytest
from pyspark.sql import functions as F

from strataspan import engine
from strataspan.functions import text as tx
from strataspan.operators import feedback, lexical, lifecycle, ranking, segments, simhash, structure
from strataspan.sources import tables
from strataspan.streaming import outbox


@pytest.mark.parametrize("word,expected", [("caresses", "caress"), ("ponies", "poni"), ("cats", "cat"), ("agreed", "agre"), ("plastered", "plaster"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("conditional", "condit"), ("vietnamization", "vietnam"), ("triplicate", "triplic"), ("hopefulness", "hope"), ("adoption", "adopt"), ("probate", "probat"), ("controll", "control"), ("analogi", "analog"), ("by", "by"), ("x1", "x1")])
def test_stem(word, expected):
    assert tx.stem(word) == expected


def test_subtokens():
    assert tx.subtokens("HTTPServer") == ["HTTP", "Server"] and tx.subtokens("fooBar_baz") == ["foo", "Bar", "baz"] and tx.subtokens("plain") == []
    assert ("server", 0) in tx.analysed("HTTPServer") and tx.query_terms("What is the running server") == ["run", "server"]


def test_windows_and_chunks():
    text = " ".join(f"wé{i}" for i in range(2000))
    w, raw = tx.windows(text), text.encode()
    starts = [m.start() for m in tx._WINDOW.finditer(text)]
    assert [a for _, a, _ in w] == [0] + [len(text[: starts[k]].encode()) for k in (765, 1530)] and w[-1][2] == len(raw) and tx.windows("") == [(0, 0, 0)]
    cut = tx.chunks("aé\n" * 500, 64, 16)
    assert cut[0][1] == 0 and all(a[2] == b[1] for a, b in zip(cut, cut[1:])) and all(b - a <= 64 for _, a, b in cut)


def test_anchors():
    kinds = {(k, v) for k, v, *_ in tx.anchors('see https://x.org/a and src/app/main.py: MyError in foo_bar, fooBar, a.b.c, 3f2a9bc "quoted text" v1.2.3')}
    assert {("url", "https://x.org/a"), ("path", "src/app/main.py"), ("error", "MyError"), ("symbol", "foo_bar"), ("symbol", "fooBar"), ("dotted-name", "a.b.c"), ("commit", "3f2a9bc"), ("quoted-value", "quoted text"), ("value", "v1.2.3")} <= kinds
    kinds = {(k, v) for k, v, *_ in tx.anchors(r"CONN_TIMEOUT, E_NOT_FOUND and max_size; say 'it\'s' Pascal abc, x=1")}
    assert {("error", "CONN_TIMEOUT"), ("error", "E_NOT_FOUND"), ("symbol", "max_size"), ("quoted-value", r"it\'s"), ("value", "x=1")} <= kinds and ("symbol", "Pascal") not in kinds


@pytest.mark.parametrize("value,expected", [("'a b'", ("quoted-value", "a b")), ("https://x.y/z", ("url", "https://x.y/z")), ("./a/b.py", ("path", "./a/b.py")), ("deadbeef1", ("commit", "deadbeef1")), ("deadbee", None), ("READ_FAILED", ("error", "READ_FAILED")), ("a_b", ("symbol", "a_b")), ("IoError", ("error", "IoError")), ("a.b", ("dotted-name", "a.b")), ("fooBar", ("symbol", "fooBar")), ("a-b", ("value", "a-b")), ("v1.2", ("value", "v1.2")), ("two words", None), ("", None)])
def test_whole_values(value, expected):
    assert tx.classified(value) == expected


def test_planned_and_salient():
    assert tx.planned("src/a.py") == [("path", "src/a.py", 0.99)]
    assert [k for k, *_ in tx.planned("why does fooBar throw IoError in a.b.c")] == ["error", "symbol", "dotted-name"]
    assert tx.working_set(["src/a.py", "plain words", "fooBar", "fooBar"]) == [("path", "src/a.py"), ("symbol", "fooBar")]
    assert tx.salient_terms("use `npm run x` in src/config.js; config.js and fooBar, snake_case a.b") == ["npm run x", "src/config.js", "a.b", "fooBar", "snake_case"]
    assert tx.facts("The port is set to PORT=8080 here. Is it v1.2 or not? We use it a lot. The socket lives in /var/run/a.sock now.") == [("The port is set to PORT=8080 here.", "value", "PORT=8080"), ("The socket lives in /var/run/a.sock now.", "path", "/var/run/a.sock")]
    assert tx.sentences("We decided to keep it. Did we decide so? no", tx.any_of(tx.DECISION_CUES)) == ["We decided to keep it."]


def test_excerpts_and_budgets():
    text = "abc " * 100 + "needle" + " xyz" * 100
    got = tx.excerpt(text, 400, 406, 40)
    assert len(got) == 40 and "[needle]" in got and got[0] == got[-1] == "…" and tx.excerpt("a b", 0, 1) == "[a] b"
    wide = "é" * 300
    cut = tx.byte_excerpt(wide, 200, 204, 100)
    assert len(cut.encode()) <= 100 and cut.strip("…") == "é" * len(cut.strip("…")) and tx.byte_excerpt("ab", 0, 1) == "ab"
    assert (tx.visible_tokens("hello world"), tx.visible_tokens("{}"), tx.visible_tokens("日本"), tx.visible_tokens("")) == (5, 2, 6, 0)
    assert tx.visible_prefix("hello world", 4) == "hello worl"[:10] and tx.visible_prefix("a", 0, "b") == ""
    assert tx.centred(list("abcdefg"), 3, lambda t: len(t) <= 3) == (2, 5)


def test_scores(spark):
    row = spark.range(1).select(
        ranking.exact_score(F.lit(True), F.lit(1.0), F.lit(0.94)).alias("exact"), ranking.exact_score(F.lit(False), F.lit(1.0), F.lit(0.94)).alias("folded"),
        ranking.decay(F.lit(3 * ranking.DAY_MS), F.lit("ephemeral-payload")).alias("half"), ranking.decay(F.lit(-5), F.lit("ephemeral-payload")).alias("future"), ranking.decay(F.lit(10**12), F.lit("durable-evidence")).alias("durable"),
        ranking.importance(F.lit(True), F.lit(True), F.lit(32), F.lit(32)).alias("most"), ranking.importance(F.lit(False), F.lit(False), F.lit(0), F.lit(0)).alias("least"), *[ranking.relevance_band(F.lit(x)).alias(f"b{i}") for i, x in enumerate((0.8, 0.5, 0.2, 0.19))],
    ).first()
    assert tuple(row) == (0.9952, 0.9252, 0.5, 1.0, 1.0, 1.15, 1.0, "high", "moderate", "some", "low")


def test_bm25_against_python(spark):
    import math

    texts = {1: "red fox red", 2: "blue fox", 3: "green", 4: ""}
    docs = spark.createDataFrame(list(texts.items()), "document_id long, text string")
    asked = spark.createDataFrame([(1, "red"), (1, "fox"), (1, "none")], "query_id int, term string")
    got = {r["document_id"]: r for r in lexical.search(docs, asked).collect()}
    avg = 6 / 4

    def part(df, tf, n):
        return math.log(1 + (4 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / avg))

    assert set(got) == {1, 2} and got[1]["score"] == round(part(1, 2, 3) + part(2, 1, 3), 6) and got[2]["score"] == round(part(2, 1, 2), 6)
    assert got[1]["coverage"] == round(2 / 3, 6) and got[1]["margin"] == round(got[1]["score"] - got[2]["score"], 6)


def test_simhash(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "x y z"), (4, None)], "document_id long, text string")
    sigs = {r["document_id"]: r for r in simhash.signatures(docs).collect()}
    assert sigs[1]["simhash"] == sigs[2]["simhash"] != sigs[3]["simhash"] and sigs[4]["status"] == "empty"
    page = spark.createDataFrame([(1, 1, 0), (1, 2, 7), (1, 3, 255), (1, 4, 254)], "query_id int, rank int, simhash long")
    assert [tuple(r) for r in simhash.greedy_representatives(page).orderBy("rank").collect()] == [(1, 1, 1), (1, 2, 1), (1, 3, 3), (1, 4, 3)]


def test_structure_and_conflicts(spark):
    m = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "Can you fix it?"), (1, 2, "assistant", "We decided to keep it. Is it so? No."), (1, 3, "user", "actually stop"), (1, 4, "assistant", "done")], "conv_id int, turn int, role string, text string")
    s = {r["turn"]: r for r in structure.structural_scores(m).collect()}
    assert (s[1]["question"], s[1]["request"], s[3]["correction"], s[2]["answer"], s[4]["answer"], s[0]["answer"]) == (100, 100, 100, 75, 100, 0)
    assert [tuple(r)[1:] for r in structure.turn_groups(m).orderBy("turn_group").collect()] == [(0, 0, 0, 1), (1, 1, 2, 2), (2, 3, 4, 2)]
    assert [r["sentence"] for r in structure.decision_sentences(m).collect()] == ["We decided to keep it."]
    items = spark.createDataFrame([(1, 1, "k", "we decided to use it"), (1, 2, "k", "we chose B instead of A"), (1, 3, "j", "rejected"), (1, 4, "r", "we agreed on A"), (1, 5, "r", "we decided on reverting A, reverted")], "packet_id int, item_id int, subject string, text string")
    assert [tuple(r) for r in feedback.possible_conflicts(items).orderBy("left_id").collect()] == [(1, 1, 2), (1, 4, 5)]


def test_chain_ends_in_cycles(spark):
    links = spark.createDataFrame([(2, 1), (3, 2), (10, 11), (11, 10)], "id long, supersedes long")
    got = {r["id"]: (r["position"], r["total"]) for r in lifecycle.chain_view(links, rounds=3).collect()}
    assert got[1] == (1, 3) and got[2] == (2, 3) and got[3] == (3, 3) and len(got) == 5


SCHEMA = "document_id long, project string, session_id string, kind string, created_at long, text string, subject_key string"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    e = engine.Engine(spark, str(tmp_path_factory.mktemp("store")), own_tools=("archive_search",))
    docs = [(i, "p", "s", "turn", i * 1000, f"note {i} about topic{i % 3} and foxes running", None) for i in range(8)]
    docs += [(20, "q", "t", "turn", 20_000, "see src/app/Main.java for fooBar and IoError", None), (21, "q", "t", "manual", 21_000, "fooBar was renamed, see src/app/main.java", None)]
    e.admit(spark.createDataFrame(docs, SCHEMA))
    e.admit(spark.createDataFrame([(1, "p", "s", "turn", 1000, "changed text", "k"), (2, "p", "s", "turn", 2000, "note 2 about topic2 and foxes running", None)], SCHEMA))
    return e


def test_engine_versions(spark, store):
    e = store
    assert e.count("p") == 8 and e.count("none") == 0 and e.count() == 10
    assert e.get(1).first()["version"] == 2 and e.get(2).first()["version"] == 1 and e.get(99).first()["status"] == "missing"
    assert (e.get(1, 1).first()["status"], e.get(1, 1).first()["text"]) == ("superseded", "note 1 about topic1 and foxes running")
    assert e.resolve_subject("p", "k").first()["document_id"] == 1
    # two contents of one id in one batch are two versions, in order of time
    e.admit(spark.createDataFrame([(30, "r", "s", "turn", 2, "second", None), (30, "r", "s", "turn", 1, "first", None)], SCHEMA))
    assert [(r["version"], r["text"]) for r in e.store.read("documents").where("document_id = 30").orderBy("version").collect()] == [(1, "first"), (2, "second")]


def test_engine_search(spark, store):
    e = store
    found = [r["document_id"] for r in e.search("running fox topic1", project="p").collect()]
    assert found[0] in (4, 7) and 1 not in found  # the old version of 1 had these words
    exact = e.search("where is src/app/Main.java").collect()
    assert [(r["document_id"], r["mode"]) for r in exact] == [(20, "exact"), (21, "lexical")]  # an exact match, so the folded one isn't asked
    assert exact[0]["snippet"] == "see [src/app/Main.java] for fooBar and IoError" and (exact[0]["match_start"], exact[0]["match_end"]) == (4, 21)
    assert [r["id"] for r in e.candidates("SRC/APP/MAIN.JAVA").where("mode = 'exact'").orderBy(F.desc("norm"), "id").collect()] == [20, 21]
    assert e.candidates("topic0", project="p", without=[0, 3, 6]).where("id IN (0, 3, 6)").isEmpty()
    now = e.search("foxes topic0", project="p", now=21 * ranking.DAY_MS, working_set=["fooBar"], context_terms=["foxes"])
    assert now.count() > 0 and now.agg(F.max("score")).first()[0] <= 1
    assert [r["document_id"] for r in e.traverse(3, "after", 2).collect()] == [4, 5] and [r["document_id"] for r in e.traverse(3, "before", 1).collect()] == [2]
    got = e.gather("topic0 foxes", before=1, after=1, anchors=1, project="p", max_tokens=10).collect()
    assert [(r["relation"], r["distance"]) for r in got] == [("anchor", 0)]


def test_engine_recall(spark, store):
    e = store
    at = e.locate(3, 0, 6)
    assert tuple(e.recall(at).select("status", "content").first()) == ("resolved", "note 3")
    assert tuple(e.recall(e.locate(1, 0, 6)).select("status", "content").first()) == ("resolved", "change")
    assert tuple(e.recall(e.locate(1, 0, 6, version=1)).select("status", "content").first()) == ("superseded", None)
    assert e.recall(e.locate(3, 900, 910)).first()["status"] == "locator-invalid" and e.recall(e.locate(3, 0, 5, version=9)).first()["status"] == "missing"
    assert e.recall(at, neighbors=1).first()["content"].startswith("note 3 about") and "quoted data" in e.evidence(at, fenced=True).first()["rendered"]
    with pytest.raises(engine.LocatorError):
        e.recall(at[:-1] + "x")
    leased = e.locate(4, 0, 4, now=1_000)
    assert e.recall(leased, now=2_000).first()["status"] == "resolved"
    e.release(leased, 1_500)
    assert e.recall(leased, now=2_000).first()["status"] == "lease-expired"


def test_engine_keeps_and_forgets(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"), own_tools=("archive_search",))
    docs = spark.createDataFrame([(i, "p" if i < 6 else "q", f"s{i % 2}", "turn", i * 1000, f"secret note {i} here", None) for i in range(8)], SCHEMA).withColumn("tool", F.lit(None).cast("string"))
    echo = spark.createDataFrame([(50, "p", "s0", "tool-result", 1, "secret echo", None, "client__archive_search")], SCHEMA + ", tool string")
    e.admit(docs.unionByName(echo))
    assert 50 not in [r["document_id"] for r in e.search("secret echo", limit=20).collect()] and e.count() == 9
    assert (e.pin("a", 0, 1), e.pin("a", 0, 2), e.pin("a", 0, 3, False), e.pin("b", 1, 1), e.pin("c", 1, 1, False)) == ("pinned", "already-pinned", "unpinned", "pinned", "not-found")
    e.protect("o1", 1, document_id=2)
    e.protect("o2", 1, session_id="s1", until=10)
    e.protect("o3", 1, document_id=4)
    e.protect("o3", 2, document_id=4, active=False)
    held = e.locate(6, 0, 6, now=91 * ranking.DAY_MS - 5)
    now = 91 * ranking.DAY_MS
    assert {r["document_id"]: r["reasons"] for r in e.protected(now).collect()} == {1: ["pin"], 2: ["document-protection"], 6: ["lease"]}
    e.renew(3, 1, None, 1)
    assert e.expire(now, batch=1) == 1 and e.expire(now) == 4 and e.expire(now) == 0
    assert sorted(r["document_id"] for r in e.documents().collect()) == [1, 2, 3, 6]
    gone = e.get(5).first()
    assert (gone["status"], gone["text"]) == ("expired", None) and e.recall(e.locate(5, 0, 6)).first()["status"] == "expired"
    assert e.collectable().count() == 4  # the echo has no chunks
    copy = engine.Engine(spark, str(tmp_path / "copy"))
    assert "documents" in e.checkpoint(str(tmp_path / "copy")) and copy.count() == 4
    at = e.locate(1, 0, 6)
    assert e.redact("p", batch=2) == 2 and e.redact("p") == 5 and e.redact("p") == 0 and e.count("p") == 0  # what is kept goes too
    for i in (1, 2, 3):
        assert tuple(e.get(i).select("status", "text").first()) == ("deleted", None)
    assert tuple(e.recall(at).select("status", "content").first()) == ("deleted", None) and e.recall(held, now=now).first()["status"] == "resolved"
    assert e.search("secret note", project="p").isEmpty()
    # what is admitted again is a new version
    e.admit(spark.createDataFrame([(1, "p", "s1", "turn", 5, "back again", None)], SCHEMA))
    assert e.get(1).first()["status"] == "resolved" and e.get(1, 1).first()["text"] is None
    assert e.commit("notes", spark.createDataFrame([(1, "x")], "document_id long, note string"), "r1") == "committed"
    again = spark.createDataFrame([(1, "y")], "document_id long, note string")
    assert e.commit("notes", again, "r1") == "duplicate" and e.commit("notes", again, "r2", must_be_absent=again) == "conflict"
    assert {r["namespace"]: r["rows"] for r in e.inventory().collect()}["notes"] == 1


def test_engine_hints(spark, tmp_path):
    e = engine.Engine(spark, str(tmp_path / "store"))
    texts = ["we keep the cache in redis cluster mode with sharding", "billing invoices are sent monthly by the scheduler", "other words entirely about gardens", "more plain talk of weather"]
    e.admit(spark.createDataFrame([(i, "p", "s", "turn", 1_000 + i, t, None) for i, t in enumerate(texts)], SCHEMA))
    days = {"conversation-source": 30}
    asked = [("s", 1, "what did we decide on redis cluster sharding"), ("s", 2, "what is the current status of redis cluster sharding today"), ("s", 3, "unrelated zebra question")]
    got = {r["message_id"]: r for r in e.preflight(spark.createDataFrame(asked, "session_id string, message_id long, text string"), 2_000, "p", days).collect()}
    assert got[1]["outcome"] == "historical-snippet" and got[1]["document_id"] == 0 and "redis" in got[1]["text"]
    assert (got[2]["outcome"], got[2]["reason"], got[3]["reason"]) == ("suppress", "current-state-required", "no-candidate")
    once = spark.createDataFrame([("s", 1, asked[0][2]), ("s", 4, asked[0][2])], "session_id string, message_id long, text string")
    again = e.preflight(once, 3_000, "p", days).collect()
    assert [(r["message_id"], r["reason"]) for r in again] == [(4, "source-cooldown")]  # 1 is frozen, its source was just shown
    with pytest.raises(ValueError):
        e.preflight(spark.createDataFrame([("s", 1, "other text")], "session_id string, message_id long, text string"), 4_000, "p", days)


def test_reconstruction(spark):
    docs = spark.createDataFrame([(1, "aé\n" * 3000), (2, "x")], "document_id long, text string")
    for r in segments.reconstructed(segments.physical_chunks(docs, 1000, 100)).collect():
        assert r["version"] == 1 and r["gap_free"] and r["byte_length"] == {1: 12000, 2: 1}[r["document_id"]]


def test_streams(spark, tmp_path):
    schema = "document_id long, text string"
    for i in range(2):
        spark.createDataFrame([(i, f"text {i}")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    store = tables.TableStore(spark, f"{tmp_path}/out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    outbox.publish_stream(stream, store, {"documents": lambda b: b}, f"{tmp_path}/ck").awaitTermination(60)
    assert store.read("documents").count() == 2 and store.published() == 1
    hints = spark.createDataFrame([("s", 1, 0), ("s", 1, 5), ("s", 1, 90_000_000)], "session_id string, document_id long, at_ms long")
    hints.write.parquet(f"{tmp_path}/hints")
    q = outbox.not_surfaced_recently(spark.readStream.schema(hints.schema).parquet(f"{tmp_path}/hints")).writeStream.format("memory").queryName("seen").outputMode("append").option("checkpointLocation", f"{tmp_path}/ck2").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted(r["at_ms"] for r in spark.table("seen").collect()) == [0, 90_000_000]


def test_sources(spark):
    df = spark.createDataFrame([("a/1", "{}"), ("a/2", "[1]"), ("b/1", "{x"), ("a/3", None)], "k string, metadata string")
    assert [r["k"] for r in tables.scan(df, "k", "a/", after="a/1", limit=1).collect()] == ["a/2"]
    assert sorted((r["k"], r["metadata_status"]) for r in tables.with_metadata(df).collect()) == [("a/1", "valid"), ("a/2", "invalid-shape"), ("a/3", "valid"), ("b/1", "malformed-json")]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_catalogue_against_duckdb(spark):
    import duckdb

    from strataspan.plans import catalogue

    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}{'/*.parquet' if os.path.isdir(f'{sf}/{f}') else ''}'")
    for name in ("bm25_topk", "near_dup_pairs", "rrf_fusion", "latest_relations", "expiry_due", "chain_view"):
        got = catalogue.QUERIES[name](spark, sf).toPandas()
        ref = con.execute(catalogue.ORACLES[name]).fetchdf()[list(got.columns)]
        assert sorted(map(str, got.values.tolist())) == sorted(map(str, ref.values.tolist())), name


def test_context(spark):
    from strataspan.operators import context

    turns = spark.createDataFrame([(1, 0, ["a", "b"]), (1, 1, ["a", "c", "c"]), (1, 2, ["a"])], "conv_id int, turn_group int, terms array<string>")
    assert [r["term"] for r in context.context_terms(turns, last=2, most=2).orderBy("rank").collect()] == ["c", "a"]
    d = spark.createDataFrame([("s", 1, 5), ("s", 2, 9), ("p", 3, 1), ("x", 4, 1)], "session_id string, document_id int, sequence int")
    line = spark.createDataFrame([("s", "s", 0), ("s", "p", 1)], "root string, session_id string, depth int")
    assert [r["document_id"] for r in context.lineage_decisions(d, line, 3).orderBy("depth", "document_id").collect()] == [1, 2, 3]
    r = spark.createDataFrame([(1, 0, 50), (1, 1, 60), (1, 2, 30), (1, 3, 5)], "conv_id int, turn int, tokens int")
    assert [x["external"] for x in context.externalized(r, each=100, floor=10, share=100).orderBy("turn").collect()] == [False, False, True, False]
