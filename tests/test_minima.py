"""MinHash decisions without all minima."""

import hashlib
import random

from evidara.functions.text import same_minima
from evidara.operators import dedup


def test_same_minima_against_all_minima():
    """As all 64 minima decide; sets that share nothing are not hashed, a changed copy takes less than half of the hashes."""
    made = 0

    def sha(x):
        nonlocal made
        made += 1
        return hashlib.sha256(x)

    def whole(a, b):
        low = lambda s, seed: min((hashlib.sha256(b"%d\0" % seed + x).hexdigest()[:16] for x in s), default="0" * 16)
        return sum(low(a, seed) == low(b, seed) for seed in range(64))

    rng = random.Random(7)
    words = [b"w%d" % i for i in range(60)]
    for _ in range(60):
        k, n = sorted(rng.sample(range(61), 2))
        a, b = set(words[:n]), set(words[k:])
        both, apart = sorted(a & b), sorted(a ^ b)
        agree = whole(a, b)
        assert [same_minima(both, apart, least, sha=sha) for least in (1, agree, agree + 1, 39)] == [agree >= 1, True, False, agree >= 39]
    assert same_minima([], [], 39) and not same_minima([], [b"x"], 39) and same_minima([b"x"], [], 39)
    made = 0
    assert not same_minima([], words, 39, sha=sha) and same_minima(words, [], 39, sha=sha) and made == 0
    assert same_minima(words[9:], words[:9], 39, sha=sha) and made < 64 * (len(words) - 9 + len(words)) / 2


def test_strategies_of_null_and_short_texts(spark):
    rows = [("a b c d", "a b c d", True), ("", "", True), (None, "x", True), ("a", "b", False), ("a b c", "A, b. c", True)]
    got = {r["strategy"]: (r["false_collapses"], r["missed"], r["pairs"]) for r in dedup.evaluate_strategies(spark.createDataFrame(rows, "a string, b string, same boolean")).collect()}
    assert got["minhash"] == (0, 1, 5) and got["exact"] == (0, 0, 5) and got["shingles"] == (0, 0, 5)
