"""Pairs of near signatures by permuted tables, against all pairs."""

import random

import pytest

from strataspan.operators import simhash


@pytest.mark.parametrize("most", [1, 3, 5])
def test_pairs_are_all_within_the_bits(spark, most):
    rng = random.Random(most)
    sigs = {rng.getrandbits(64) for _ in range(150)}
    for s in list(sigs)[:100]:  # near copies, at up to two bits more than are asked for
        for b in rng.sample(range(64), rng.randint(1, most + 2)):
            s ^= 1 << b
        sigs.add(s)
    signed = sorted(s - (1 << 64) if s >> 63 else s for s in sigs)
    exp = sorted((a, b, n) for i, a in enumerate(signed) for b in signed[i + 1 :] if (n := ((a ^ b) & (2**64 - 1)).bit_count()) <= most)
    rows = spark.createDataFrame([(s, "complete") for s in signed + signed[:9]] + [(0, "empty")], "simhash long, status string")
    assert sorted(tuple(r) for r in simhash.similar_pairs(rows, most).collect()) == exp and len(exp) > 20
    assert all(bin(m).count("1") >= 3 * (64 // (most + 3)) - 3 for m in simhash.tables(most)) and (most != 3 or len(simhash.tables(3)) == 20)
    assert simhash.similar_pairs(rows.limit(0)).isEmpty()
