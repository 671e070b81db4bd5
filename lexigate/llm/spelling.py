"""Spelling variant grouping with an index of variable-length grams.

Words that differ by exactly one inserted, deleted or replaced code point are near.

*Gram dictionary.* Words are framed by ``<`` and ``>``. A gram of ``QMIN`` to ``QMAX``
code points is in the dictionary if it is found in at most one of ``PARTS`` of the words
(or has QMAX code points) and its shorter prefixes are in more than that: frequent grams
are pruned, what extends them stays. A kept gram's parent is frequent, so there are at
most PARTS * word length * alphabet * QMAX of them at any number of words, and the
dictionary is broadcast.

*Decomposition.* At each position a word has the longest dictionary gram that starts
there, or its next QMIN code points; grams within an earlier one are left out.

*Affected grams.* For each place of a single edit, the grams of the word that the edit can
change or swallow are counted; the largest count is the word's bound. A near word shares
at least (grams - bound) of them, so two near words share one of the ``bound + 1`` rarest
grams of either if both have that many. These grams are listed with position and length,
which may differ by one at most; lists are merged by joins on (gram, position, length) and
the pairs are verified. Where all grams of a word may be affected the bound says nothing:
pairs of two such words are found by the words with one code point left out (exact).

A word's form is its near word of largest count (ties: smallest in code-point order) if
that count is at least twice its own; roots follow forms, at most 62 times since counts
double, in six rounds of doubling joins.

Defined cases: null and empty texts have no words; a null doc_id reads as an empty id in
the hash; texts of any length are read whole; repeated rows count each; words under
``MIN_CHARS`` code points or ``MIN_COUNT`` occurrences are no words; words of any length
are compared; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm.common import ascii_lower, stored

RUN = "[A-Za-zÀ-ÿ]+"
MIN_CHARS, MIN_COUNT, DROP_ONE_OF = 5, 3, 97
QMIN, QMAX, PARTS = 2, 4, 2000


# --- words --------------------------------------------------------------------------

def noisy_words(docs: DataFrame) -> DataFrame:
    """(word, n) of documents (doc_id, text): runs of letters, A-Z lowered, one code
    point deleted where 97 divides the crc32 of ``doc_id:run``."""
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
                       F.explode(F.regexp_extract_all(text, F.lit(f"({RUN})"), 1)).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat_ws(":", "id", "run").cast("binary")).alias("h"))
    size, run = F.char_length("run"), F.col("run")
    at = (F.col("h") % size).cast("int")
    word = F.when(F.col("h") % DROP_ONE_OF == 0,
                  F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))).otherwise(run)
    return (hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .filter((F.col("n") >= MIN_COUNT) & (F.char_length("word") >= MIN_CHARS)))


def gram_counts(words: DataFrame) -> DataFrame:
    """(gram, n): in how many places of the framed words it stands."""
    framed = F.concat(F.lit("<"), F.col("word"), F.lit(">"))
    grams = F.flatten(F.transform(F.sequence(F.lit(QMIN), F.lit(QMAX)), lambda q: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(framed) - q + 1, F.lit(1))),
        lambda p: framed.substr(p, q))))
    return (words.select(F.explode(grams).alias("gram")).filter(F.char_length("gram") >= QMIN)
            .groupBy("gram").agg(F.count(F.lit(1)).alias("n")))


def gram_dictionary(words: DataFrame) -> dict[str, int]:
    """The frequency-pruned grams with their counts."""
    limit = -(-words.count() // PARTS)
    counts = stored(gram_counts(words), "spelling-grams")
    frequent = counts.filter(F.col("n") > limit).select(F.col("gram").alias("parent"))
    size = F.char_length("gram")
    kept = counts.filter((F.col("n") <= limit) | (size == QMAX))
    shortest = kept.filter(size == QMIN)
    longer = kept.filter(size > QMIN).join(
        frequent, F.col("gram").substr(F.lit(1), size - 1) == F.col("parent"), "left_semi")
    return {r["gram"]: r["n"] for r in shortest.unionByName(longer).collect()}


# --- decomposition ------------------------------------------------------------------

class Index:
    """Decomposes words by a dictionary."""

    def __init__(self, dictionary: dict[str, int]):
        self.count = dictionary
        self.inner = {g[:i] for g in dictionary for i in range(1, len(g))}  # proper prefixes
        self.tails = {g[i:] for g in dictionary for i in range(1, len(g))}  # proper suffixes

    def grams(self, word: str) -> tuple[str, list[tuple[int, str]], list[int]]:
        """(framed word, its grams by position, per position the last place looked at)."""
        framed, out, seen, end = f"<{word}>", [], [], 0
        last = len(framed)
        for p in range(last - QMIN + 1):
            stop, gram = p + 1, None
            while True:  # down the trie while the code points read go on
                part = framed[p:stop]
                if part in self.count:
                    gram = part
                if part not in self.inner or stop > last:
                    break
                stop += 1
            gram = gram or framed[p:p + QMIN]
            # The place after which nothing was read (the frame's end counts as a place).
            seen.append(max(min(stop, last + 1), p + QMIN) - 1)
            if p + len(gram) > end:
                out.append((p, gram))
                end = p + len(gram)
        return framed, out, seen

    def affected(self, framed: str, grams: list[tuple[int, str]], seen: list[int]) -> int:
        """The most grams that one edit can change, swallow or break."""
        last, most = len(framed), 0

        def lost(place: int, inserted: bool) -> int:
            # ``place``: code point edited, or (inserted) the one that moves right.
            reach = min((q for q in range(min(place, len(seen))) if seen[q] >= place), default=last)
            n = 0
            for p, gram in grams:
                end = p + len(gram)
                if (p < place if inserted else p <= place) and seen[p] >= place:
                    n += 1  # its reading went over the place
                elif end <= place:
                    n += reach < p  # an earlier gram may grow over it
                else:  # to the right: a gram from before the place may end over it
                    n += framed[place + (not inserted):end] in self.tails
            return n

        for place in range(1, last):
            most = max(most, lost(place, True))
            if place < last - 1:
                most = max(most, lost(place, False))
        return most

    def listed(self, word: str) -> tuple[list[tuple[int, str]], bool]:
        """(grams to list, whether the word's bound is useful)."""
        framed, grams, seen = self.grams(word)
        bound = self.affected(framed, grams, seen)
        if bound >= len(grams):
            return grams, False
        rare = sorted(grams, key=lambda g: (self.count.get(g[1], 0), g[1], g[0]))
        return rare[:bound + 1], True


def signatures(words: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """(word, size, pos, gram, useful): the grams under which each word is listed."""
    shared = words.sparkSession.sparkContext.broadcast(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for word in batch.column("word").to_pylist():
                grams, useful = index.listed(word)
                for pos, gram in grams:
                    for column, value in zip(out, (word, len(word), pos, gram, useful)):
                        column.append(value)
            types = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)],
                                             names=["word", "size", "pos", "gram", "useful"])

    return words.select("word").mapInArrow(run, "word string, size int, pos int, gram string, useful boolean")


# --- near words ---------------------------------------------------------------------

def _one_edit(a: str, b: str) -> Column:
    return F.levenshtein(F.col(a), F.col(b), 1) == 1


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b): every pair of near words once."""
    listed = stored(signatures(words, gram_dictionary(words)), "spelling-lists")
    key = ["gram", "size", "pos"]
    left = listed.select(F.col("word").alias("a"), "gram", "size", "pos")
    # The longer or equal word has the gram at the same place or one place on.
    moves = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(p).alias("p")) for s, p in ((0, 0), (1, 0), (1, 1))])
    probes = left.select("a", "gram", F.explode(moves).alias("m"), "size", "pos").select(
        "a", "gram", (F.col("size") + F.col("m.s")).alias("size"), (F.col("pos") + F.col("m.p")).alias("pos"),
        (F.col("m.s") == 0).alias("same"))
    merged = (probes.join(listed.select(F.col("word").alias("b"), *key), key)
              .filter((~F.col("same") | (F.col("a") < F.col("b"))) & _one_edit("a", "b")).select("a", "b"))
    return merged.unionByName(_left_out_pairs(listed)).distinct()


def _left_out_pairs(listed: DataFrame) -> DataFrame:
    """Pairs of words whose bounds say nothing, by the words with one code point left out."""
    plain = listed.filter(~F.col("useful")).select("word").distinct()
    word = F.col("word")
    keys = F.transform(F.sequence(F.lit(1), F.char_length(word)), lambda i: F.concat(
        word.substr(F.lit(1), i - 1), word.substr(i + 1, F.char_length(word))))
    short = plain.select("word", F.explode(F.array_distinct(F.concat(F.array(word), keys))).alias("key"))
    left, right = (short.select(F.col("word").alias(c), "key") for c in "ab")
    return (left.join(right, "key").filter((F.col("a") < F.col("b")) & _one_edit("a", "b")).select("a", "b")
            .select(*[F.when(F.char_length("a") <= F.char_length("b"), F.col(x)).otherwise(F.col(y)).alias(c)
                      for c, x, y in (("a", "a", "b"), ("b", "b", "a"))]))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), form null at a root: doubling joins until nothing
    moves. Counts at least double from word to form, so chains have at most 62 steps."""
    at = stored(forms.select("word", F.coalesce("form", "word").alias("root")), "spelling-roots")
    for _ in range(6):
        step = at.select(F.col("word").alias("r_word"), F.col("root").alias("r_root"))
        moved = stored(at.join(step.filter("r_word <> r_root"), F.col("root") == F.col("r_word"), "left")
                       .select("word", F.coalesce("r_root", "root").alias("root"),
                               F.col("r_root").isNotNull().alias("moved")), "spelling-roots")
        at = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return at


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of words (word, n)."""
    words = stored(words, "spelling-words")
    pairs = near_pairs(words)
    both = stored(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "spelling-pairs")
    other = words.select(F.col("word").alias("b"), F.col("n").alias("b_n"))
    best = both.join(other, "b").groupBy(F.col("a").alias("word")).agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("less"), F.col("b"))).alias("best"))
    found = words.join(best, "word", "left")
    takes = F.coalesce(-F.col("best.less") >= 2 * F.col("n"), F.lit(False))
    table = stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                F.when(takes, F.col("best.b")).alias("form"),
                                F.when(takes, -F.col("best.less")).alias("form_n")), "spelling-forms")
    return table.join(roots(table), "word").select("word", "form", "root", "n", "n_near", "form_n")
