"""Findings of round 3's check, once more: time and memory of counting words, line dedup in DataFrame functions."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from strataspan.llm import line_dedup, similar, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(PATH)


def test_plain_words_are_counted_without_the_library(counter, monkeypatch):
    rng, tok = random.Random(5), Tokenizer.from_file(PATH)
    letters = "aeinrstzAEXéèßÉŁłǅƁɄ019.,;:-'\"(<|/_"
    texts = [" ".join("".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(40)) for _ in range(60)] + ["", "  ", "it's IT'S 'll''d --'s", "a" * 256]
    asked = []
    monkeypatch.setattr(counter, "_encode", asked.append)
    assert counter.totals(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]
    assert not asked and len(counter.words) == 1  # nothing is remembered


def test_other_words_are_left_to_the_library(counter):
    tok = Tokenizer.from_file(PATH)
    chars = [chr(c) for c in (*range(0x21, 0x7F), *range(0xA0, 0x2B0), 0x300, 0x307, 0x3A3, 0x4E00, 0xAC00, 0x1F600)]
    texts = [f"{form.format(c)} \t{c}\n" for c in chars for form in ("{}", "a{}b", "1{}'s", "E{}T", "x-{}")] + ["x\x01y", "a<|endoftext|>b", "<|startoftext|>", "é" * 200, "z" * 5000]
    assert counter.totals(pa.array(texts)).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("columns", [3, 2048])
def test_shared_grams_are_counted_for_all_pairs_at_once(monkeypatch, columns):
    """Frequent and rare elements, within one block and between two, against sets."""
    monkeypatch.setattr(similar, "COLUMNS", columns)
    rng = random.Random(6)
    own = [set(rng.sample(range(40), rng.randint(0, 12))) | {rng.randrange(1000, 1400) for _ in range(rng.randint(0, 30))} | {rng.randrange(1 << 40)} for _ in range(90)] + [set(), set()]
    sets = [np.array(sorted(s), dtype=np.uint64) for s in own]
    for left in (None, 30):
        both = similar.shared_counts(sets, left)
        pairs = [(i, j) for j in range(len(own)) for i in range(j) if left is None or i < left <= j]
        assert all(both[i, j] == len(own[i] & own[j]) for i, j in pairs) and max(both[i, j] for i, j in pairs) > 5
    assert similar.shared_counts([]).shape == (0, 0) and not list(similar.similar_in_cell([], 0.8)) and not list(similar.similar_in_cell(sets[-2:], 0.8))


def test_grams_of_many_lines(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(line_dedup, "CHUNK", 50)
    lines = ["x", "日本語", *["".join(rng.choices("abé ", k=rng.randint(0, 80))) for _ in range(40)]]
    of = line_dedup.line_grams()
    assert [s.tolist() for s in of.many(lines)] == [of(x).tolist() for x in lines] and of.many([]) == []


def test_line_dedup_runs_no_python_by_default(spark, monkeypatch):
    """Repetitive lines of very different lengths, lines of few characters and long ones with edits, in DataFrame functions only."""

    def refuse(*_):
        raise AssertionError("Python on the executors")

    monkeypatch.setattr("pyspark.sql.DataFrame.mapInArrow", refuse, raising=False)
    monkeypatch.setattr("pyspark.sql.classic.dataframe.DataFrame.mapInArrow", refuse, raising=False)
    rng = random.Random(8)
    long = ["".join(rng.choices("abcdefghij \U0001f600é", k=600)) for _ in range(6)]
    edited = [x[:300] + "ZZ" + x[302:] for x in long]
    docs = [(0, "-" * 40), (1, "-" * 5000), (2, "abc " * 12), (3, "abc " * 700), (4, "x"), (5, "x"), (6, "y"), *[(10 + i, x) for i, x in enumerate(long)], *[(20 + i, x) for i, x in enumerate(edited)]]
    got = line_dedup.without_repeated_lines(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in got if r["n_dropped"]} == {1, 3, 5, *range(20, 26)}


def test_native_sketches_keep_similar_texts(spark):
    """Pairs at the threshold pass, unlike ones don't; verification is exact."""
    rng = random.Random(9)
    rows = []
    for i in range(200):
        x = "".join(rng.choices("abcdefghijklmnop", k=400))
        near = list(x)
        for at in range(20, 380, 50):
            near[at] = "Z"
        rows += [(3 * i, x), (3 * i + 1, "".join(near)), (3 * i + 2, "".join(rng.choices("abcdefghijklmnop", k=400)))]
    texts = spark.createDataFrame(rows, "k long, text string")
    s = line_dedup._sketched_natively(texts)
    sides = [s.selectExpr(f"k AS {x}", f"sketch AS s{x}") for x in "ab"]
    for other, low, high in ((1, 199, 200), (2, 0, 0)):
        met = sides[0].where("a % 3 = 0").join(sides[1], sides[1]["b"] == sides[0]["a"] + other).where(line_dedup._agree_natively("sa", "sb"))
        assert low <= met.count() <= high
    pairs = texts.selectExpr("k AS ka", "text AS la").where("ka % 3 = 0").crossJoin(texts.selectExpr("k AS kb", "text AS lb")).where("kb > ka AND kb < ka + 3")
    sets = {k: {t[i : i + 5] for i in range(396)} for k, t in rows}
    want = {(a, b) for a in range(0, 600, 3) for b in (a + 1, a + 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in line_dedup._similar_natively(pairs, 0.8).collect()} == want and want
