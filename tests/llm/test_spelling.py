"""Spelling variants against all pairs by left-out code points, and the gram bound."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from lexigate.llm import spelling
from lexigate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["word", "form", "root", "n", "n_near", "form_n"]


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def words_of(docs):
    count = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run if h % 97 else run[:at] + run[at + 1:]] += 1
    return {w: n for w, n in count.items() if n >= 3 and len(w) >= 5}


def variants(count):
    buckets = defaultdict(set)
    for w in count:
        for key in {w, *(w[:i] + w[i + 1:] for i in range(len(w)))}:
            buckets[key].add(w)
    near = defaultdict(set)
    for group in buckets.values():
        for a in group:
            near[a] |= {b for b in group if one_edit(a, b)}
    form = {}
    for w, n in count.items():
        best = min(near[w], key=lambda x: (-count[x], x), default=None)
        form[w] = best if best and count[best] >= 2 * n else None
    out = set()
    for w, n in count.items():
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), count[form[w]] if form[w] else None))
    return out


def found(df):
    rows = [tuple(r[c] for c in COLUMNS) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_on_the_table(spark, sf):
    path = f"/root/testdata/{sf}"
    docs = [tuple(r) for r in spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text").collect()]
    want = variants(words_of(docs))
    assert any(r[1] and r[1] != r[2] for r in want)  # a chain of forms
    assert found(QUERIES["op11_spelling_variants"][0](spark, path)) == want


def test_words_of_a_small_alphabet(spark):
    rng = random.Random(4)
    count = {"".join(rng.choice("abéÿ") for _ in range(rng.randint(5, 8))): rng.choice([3, 3, 4, 6, 12, 50])
             for _ in range(3000)}
    count |= {"x" * 300: 3, "x" * 301: 9, "x" * 150 + "y" + "x" * 150: 4}
    got = found(spelling.group_variants(spark.createDataFrame(list(count.items()), "word string, n long")))
    assert got == variants(count)


def test_words_without_useful_bounds(spark, monkeypatch):
    monkeypatch.setattr(spelling, "QMAX", 7)  # long grams: one edit can reach all of them
    monkeypatch.setattr(spelling, "PARTS", 10 ** 9)
    rng = random.Random(6)
    count = {"".join(rng.choice("ab") for _ in range(rng.randint(5, 7))): rng.randint(3, 90) for _ in range(150)}
    words = spark.createDataFrame(list(count.items()), "word string, n long")
    assert found(spelling.group_variants(words)) == variants(count)


def test_bound_on_affected_grams():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé") for _ in range(rng.randint(5, 10))) for _ in range(400)]
    count = Counter(f"<{w}>"[p:p + q] for w in words for q in range(2, 6) for p in range(len(w) + 3 - q))
    for limit in (2, 8, 40):
        dictionary = {g: n for g, n in count.items() if (n <= limit or len(g) == 5)
                      and (len(g) == 2 or count[g[:-1]] > limit)}
        index = spelling.Index(dictionary)
        for word in words:
            framed, grams, seen = index.grams(word)
            bound = index.affected(framed, grams, seen)
            for _ in range(20):
                at, c = rng.randrange(len(word) + 1), rng.choice("abcdéz")
                near = rng.choice([word[:at] + c + word[at:], word[:at] + c + word[at + 1:], word[:at] + word[at + 1:]])
                if near != word:
                    move = len(near) - len(word)
                    other = set(index.grams(near)[1])
                    kept = sum((p, g) in other or (p + move, g) in other for p, g in grams)
                    assert kept >= len(grams) - bound, (word, near)


def test_odd_documents(spark, odd_docs, no_docs):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = found(spelling.group_variants(spelling.noisy_words(odd_docs)))
    assert got == variants(words_of(docs))
    assert spelling.group_variants(spelling.noisy_words(no_docs)).collect() == []
