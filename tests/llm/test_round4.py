"""Findings of round 3's check: memory of packing, line dedup without Python on the executors."""

import random

import public_tokenizers

from strataspan.llm import packing, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_counted_and_packed_in_one_worker(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gammadelta", "it's", "日本"]) for _ in range(rng.randint(0, 3000)))) for i in range(60)] + [(60, None), (61, ""), (None, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "text")
    one, two = packing.pack_texts(docs, PATH), packing.pack(token_counts.whole_counts(docs, PATH))
    assert plan(one).count("MapInArrow") == 1 and plan(two).count("MapInArrow") == 2
    assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, two.collect()), key=str)


def test_frequent_words_stay_remembered(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_WORDS", 40)
    counter, asked = token_counts.PrefixCounter(PATH), []
    encode = counter._encode
    counter._encode = lambda words: (asked.extend(words), encode(words))[1]
    for i in range(50):
        words = ["frequentword", *[f"word{i}x{j}" for j in range(10)]]
        assert counter.counts_of(words).tolist() == encode(words)
    assert asked.count("frequentword") == 1 and len(counter.words) + len(counter.before) < 80
    assert counter._within is None
