"""Token alignment, decontamination and importance resampling against brute force, with nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from strataspan.llm import decontaminate, importance, token_align

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, uid string, at int, n_words double, score long, buckets string, groups string, pairs string"


def low(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "u", 1, 0.5, 7, "b", "g", "p") for i, t in rows], SCHEMA)


def prose(rng, n, alphabet="abcdefgh", longest=5):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(1, longest))) for _ in range(n))


# Decontamination


def brute_contamination(docs, items, window=10):
    own = defaultdict(set)
    for i, t in items:
        w = low(t)
        n = min(window, len(w))
        for p in range(len(w) - n + 1 if n else 0):
            own[tuple(w[p : p + n])].add("" if i is None else str(i))
    sizes, out = {len(k) for k in own}, []
    for d, t in docs:
        w, hit, found = low(t), set(), set()
        for n in sizes:
            for p in range(len(w) - n + 1):
                if (k := tuple(w[p : p + n])) in own:
                    hit |= set(range(p, p + n))
                    found |= own[k]
        spans = []
        for x in sorted(hit):
            if spans and spans[-1][1] == x:
                spans[-1][1] = x + 1
            else:
                spans.append([x, x + 1])
        out.append((d, len(w), hit, [tuple(s) for s in spans], sorted(found)))
    return out


def check_contamination(spark, docs, items, window=10, run=6):
    got = decontaminate.contamination(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), window, run).collect()
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_words"], sorted(x for s in r["spans"] for x in range(s["start"], s["end"])), list(r["item_ids"])) for r in got)
    exp = sorted(((d is None, d or 0), n, sorted(hit), names) for d, n, hit, _, names in brute_contamination(docs, items, window))
    assert got == exp
    return exp


def test_contamination(spark):
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(10, 40))) for i in range(30)]
    items += [(40, "Short ITEM words"), (41, "one"), (42, ""), (43, None), (None, prose(rng, 12)), (44, items[0][1]), (0, items[0][1]), (45, "... !?"), (46, "Ünïcode Ä ä " * 5)]
    docs = []
    for d in range(120):
        w = prose(rng, rng.randint(0, 80)).split(" ")
        for _ in range(d % 3):
            src = low(rng.choice(items)[1])
            if src:
                a, n = rng.randrange(len(src)), rng.randint(1, 25)
                at = rng.randrange(len(w) + 1)
                w[at:at] = src[a : a + n]
        docs.append((d, rng.choice([" ", ", ", "\n", "--"]).join(w)))
    docs += [(500, None), (501, ""), (502, "SHORT item\x00words, One."), (None, items[3][1].upper()), (503, docs[5][1]), (503, docs[5][1]), (504, prose(rng, 30_000)), (505, "é" * 300_000 + " " + items[5][1]), (506, (items[1][1] + " ") * 400), (507, "xx" * 700_000 + " short item words")]
    exp = check_contamination(spark, docs, items)
    assert sum(bool(x[2]) for x in exp) > 40
    check_contamination(spark, docs[:60], items, window=7, run=3)
    check_contamination(spark, docs[:60], items, window=4, run=4)
    assert all(not r["spans"] and not r["item_ids"] for r in decontaminate.contamination(frame(spark, docs[:5]), spark.createDataFrame([], "item_id long, text string")).collect())
    assert decontaminate.contamination(frame(spark, []), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    spans = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in decontaminate.contamination(frame(spark, docs[:60]), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert spans == {d: s for d, _, _, s, _ in brute_contamination(docs[:60], items)}


def test_words_are_hashed_alike_wherever_they_stand():
    import pyarrow as pa

    rng = random.Random(9)
    texts = ["", "Ab aB ab", "x" * 3, prose(rng, 300_000, longest=9), "é " * 5, "tail", None, "w" * 1_500_000 + " end"]
    words = decontaminate.Words(*decontaminate._texts(pa.array(texts)))
    seen = {}
    for i, t in enumerate(texts):
        own = low(t)
        assert words.first[i + 1] - words.first[i] == len(own)
        for k, w in enumerate(own[:2_000] + own[-2_000:]):
            at = words.first[i] + (k if k < min(2_000, len(own)) else len(own) - (min(4_000, 2 * len(own)) if len(own) < 2_000 else 4_000) + k)
            assert seen.setdefault(w, words.hashes[at]) == words.hashes[at]
    assert len(set(seen.values())) == len(seen) and words.text(int(words.first[1]), 3) == "ab ab ab"


def test_every_shared_window_shares_a_fingerprint():
    import pyarrow as pa

    rng = random.Random(5)
    shared = prose(rng, 10)
    for _ in range(200):
        a, b = (f"{prose(rng, rng.randint(0, 12))} {shared} {prose(rng, rng.randint(0, 12))}" for _ in "ab")
        prints = []
        for t in (a, b):
            _, _, fingerprints = decontaminate.least_runs(decontaminate.Words(*decontaminate._texts(pa.array([t]))), 10, 6)
            prints.append(set(fingerprints.tolist()))
        assert prints[0] & prints[1]


# Importance resampling


def brute_resampled(docs, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    def feats(t):
        w = low(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, longest + 1) for i in range(len(w) - n + 1)], len(w)

    own = [(d, *feats(t)) for d, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in feats(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for d, f, n in own:
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        out.append([d, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return out


@pytest.mark.parametrize("options", [{}, {"percent": 40, "buckets": 97, "longest": 3, "least_words": 5, "seed": 1}, {"percent": 100, "least_words": 0}])
def test_resampled(spark, options):
    rng = random.Random(11)
    docs = [(i, prose(rng, rng.randint(0, 60), "abcdÉé" if i % 3 else "ABab")) for i in range(400)]
    docs += [(1000, None), (1001, ""), (1002, "?!"), (None, prose(rng, 40)), (None, prose(rng, 40)), (7, docs[7][1]), (7, docs[7][1]), (1003, prose(rng, 50_000))]
    target = [prose(rng, 30, "ABab") for _ in range(20)] + [None, ""]
    got = importance.resampled(frame(spark, docs), spark.createDataFrame([(t, 1) for t in target], "text string, doc_id long"), **options).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:5], r[5] or 0)
    exp = brute_resampled(docs, target, **{"least" if k == "least_words" else k: v for k, v in options.items()})
    assert sorted((list(r) for r in got), key=key) == sorted(exp, key=key)


def test_resampled_edges(spark):
    none = spark.createDataFrame([], "text string")
    assert importance.resampled(frame(spark, []), none).count() == 0
    got = importance.resampled(frame(spark, [(1, "a b c " * 10), (2, None)]), none, percent=100).collect()
    exp = brute_resampled([(1, "a b c " * 10), (2, None)], [], percent=100)
    assert sorted(map(list, got)) == sorted(exp)


# Token alignment


@pytest.fixture(scope="module")
def files():
    tokenizers = pytest.importorskip("public_tokenizers")
    return tokenizers.path(token_align.A_FILE), tokenizers.path(token_align.B_FILE)


def brute_alignment(docs, files):
    """Whole texts by the libraries, ends by byte, links by comparing ranges."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_tok, b_tok = Tokenizer.from_file(files[0]), sentencepiece.SentencePieceProcessor(model_file=files[1])
    a_tok.encode_special_tokens = True
    alphabet = token_align.byte_alphabet()
    own = []
    for d, t in docs:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        ab = [bytes(alphabet[c] for c in a_tok.id_to_token(i)) for i in a]
        bb = [bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
        if not t or b"".join(ab) != (" " + t).encode() or b"".join(bb) != (" " + t).encode():
            own.append((d, [], [], [], []))
            continue
        ea, eb = np.cumsum([len(x) for x in ab]).tolist(), np.cumsum([len(x) for x in bb]).tolist()
        groups, i0, j0 = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            i, j = ea.index(e) + 1, eb.index(e) + 1
            groups.append((a[i0:i], b[j0:j]))
            i0, j0 = i, j
        links, starts, j = [], [0, *eb[:-1]], 0
        for i, x in enumerate(a):
            lo, hi = ea[i] - len(ab[i]), ea[i]
            j = next(k for k in range(j, len(b)) if eb[k] > lo)
            k = j
            while k < len(b) and starts[k] < hi:
                links.append((x, b[k]))
                k += 1
        own.append((d, a, b, groups, links))
    counts = Counter(p for *_, links in own for p in set(links))
    best_a, best_b = defaultdict(int), defaultdict(int)
    for (x, y), n in counts.items():
        best_a[x], best_b[y] = max(best_a[x], n), max(best_b[y], n)
    out = []
    for d, a, b, groups, links in own:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((d, len(a), len(b), len(groups), len(links), sum(counts[p] == best_a[p[0]] for p in links), sum(counts[p] for p in links), sum(counts[p] == best_b[p[1]] for p in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out


def test_alignment(spark, files, tmp_path, monkeypatch):
    rng = random.Random(2)
    bits = [" ", "  ", "\n", " \n", "\n ", "\t", " \t ", "　", "​", "\x1c", "\x85", "▁", "\r\n", "é", "a", "b1", "<|endoftext|>", "<s>", "<0x41>", "'s", "日本", "\x00", "İ", "🙂", " x", ",", "don't", "Größe"]
    docs = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(1, 14)))) for i in range(500)]
    docs += [(600 + i, prose(rng, 40, "aeinrst", 9)) for i in range(60)] + [(700, None), (701, ""), (702, " "), (703, "a "), (704, "z" * 20_000), (705, prose(rng, 8_000)), (None, "no id"), (706, docs[3][1]), (706, docs[3][1])]
    path = str(tmp_path / "d")
    frame(spark, docs).repartition(5).write.parquet(f"{path}/documents.parquet")
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    exp = sorted(brute_alignment(docs, files), key=key)

    def run():
        r = token_align.op11_token_alignment(spark, path)
        return sorted((tuple(x) for x in r.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_best_b", "groups_sha256").collect()), key=key)

    assert run() == exp
    monkeypatch.setattr(token_align, "MOST_HOT", 40)  # most pairs by the shuffle
    assert run() == exp
    empty = token_align.aligned(frame(spark, []), *files)
    assert empty.count() == 0
    got = {r["doc_id"]: r for r in token_align.aligned(frame(spark, [(1, "Größe don't"), (2, "▁")]), *files).collect()}
    assert got[2]["n_a"] == 0 and got[2]["groups"] == "" and got[2]["pairs"] == []
    assert sum(p["n"] for p in got[1]["pairs"]) == got[1]["n_links"] and got[1]["groups"].count(";") == got[1]["n_groups"] - 1


def test_aligner_forgets(files, monkeypatch):
    monkeypatch.setattr(token_align, "MOST_STRETCHES", 50)
    al, rng = token_align.Aligner(*files), random.Random(6)
    for _ in range(20):
        texts = [prose(rng, 30) for _ in range(4)]
        numbers, offsets = al.aligned(texts)
        for i, t in enumerate(texts):
            own = numbers[offsets[i] : offsets[i + 1]]
            assert al.totals[own, 1].sum() == len(al.a.encode(" " + t, add_special_tokens=False).ids)
    assert len(al.groups) < 400
