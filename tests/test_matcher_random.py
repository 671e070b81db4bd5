"""Random parity over a tiny alphabet: overlaps, prefixes, duplicates."""

import random

from lexigate.operators import matching as M
from lexigate.sources import fixtures


def naive(patterns, texts):
    out = []
    for doc, text in enumerate(texts):
        for pid, pat, nocase in patterns:
            t, p = (text.upper(), pat.upper()) if nocase else (text, pat)
            start = t.find(p)
            while start >= 0:
                out.append((doc, pid, start, start + len(p)))
                start = t.find(p, start + 1)
    return sorted(out)


def test_matcher_equals_naive(spark):
    rng = random.Random(5)

    def word(least, most):
        return "".join(rng.choice("abAB") for _ in range(rng.randint(least, most)))

    for _ in range(3):
        patterns = [(i + 1, word(1, 10), rng.random() < 0.5) for i in range(12)]
        texts = [word(0, 40) for _ in range(200)]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        pats = spark.createDataFrame([(i, p, nc, 0, 0, "x") for i, p, nc in patterns], fixtures.PATTERN_SCHEMA)
        found = M.keyword_occurrences(docs, pats).select("doc_id", "pattern_id", "idx", "end_idx")
        assert sorted(map(tuple, found.collect())) == naive(patterns, texts)
