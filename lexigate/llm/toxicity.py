"""Toxicity by maximum-scoring segments of token log-odds.

*Log-odds.* A token is a lower-cased run of letters and digits (a CJK character is one by
itself). Its features are the token and its first 3 to 6 code points, so that a stem
counts for the words built on it. A feature's log-odds between toxic and clean documents
takes the pooled shares as an informative Dirichlet prior (as strong as ``PRIOR``
tokens); tokens are counted once a text. It is used where it is ``MIN_ODDS`` or more, and
``MIN_Z`` standard deviations, from 0 and the feature makes up at least ``MIN_SHARE`` of
the tokens. A token has ``FEATURES`` features, so at most FEATURES / MIN_SHARE of them
are ever broadcast. A token weighs as its most decisive feature.

*Segments.* Every token costs the drift ``ln E[exp(weight)]`` of clean text, which makes
the score's extreme-value scale 1 (Karlin and Altschul). Clean text is that of the same
common words: a word that makes up ``COMMON`` of the tokens (at most 1 / COMMON do) has
the mean tilt ``exp(weight) - 1`` of the clean documents it is found in, and a text the
mean over its common words, so that a language where toxic stems are usual syllables
pays more. One linear scan over the tokens
(Ruzzo and Tompa) finds all maximal-scoring segments; the k-th occurrence of a token in a
text brings a k-th of its weight, so that one repeated phrase is not many findings.

*Calibration.* A segment's excess is ``S - ln(K n)`` for a text of n tokens, K from the
clean documents set aside; its chance in clean text is ``1 - exp(-exp(-excess))`` and
segments under ``SIGNIFICANT`` are passages. A text's value is the sum of its excesses
above 0, or its best one. Documents set aside from the counts turn values into
probabilities (isotonic fit over ``STEP`` wide bins, with a small strictly rising part).

Defined cases: null, empty and blank texts have no token, the least value and its score;
a text is read whole, whatever its length; texts without a label are not learned from,
equal texts are learned from once (toxic if most of their labels are), null doc_ids have
no label; without documents of both classes every score is 0; repeated rows are scored
each; columns other than ``doc_id`` and ``text`` pass through; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm.common import stored

STEMS = (3, 4, 5, 6)
FEATURES = len(STEMS) + 1
PRIOR = 10_000  # tokens
MIN_Z = 3.7
MIN_ODDS = 2.0
MIN_SHARE = 5e-6
LEARNED = 200_000  # labelled documents that a model is fitted to, at most
CALIBRATION_PART = 4  # one of so many labelled texts is set aside
SIGNIFICANT = 0.05
COMMON = 1e-4  # share of the tokens from which a word tells the drift
STEP, LEAST, MOST = 0.25, -25.0, 75.0  # bins and range of values
RISING = 0.01
HELD_WORDS = 200_000  # entries a task holds before it passes them on

_TOKEN = re.compile(r"[^\W_぀-鿿]+|[぀-鿿]")


def folded(text: str) -> str:
    """Lower case with every code point in its place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(folded(text)) if text else []


def features(token: str) -> list[str]:
    """The token and its stems (marked, so that a stem is not a word)."""
    return [token, *(token[:n] + "*" for n in STEMS if len(token) >= n)]


class Weights(dict):
    """Weight of a token, kept once computed."""

    def __init__(self, of_feature: dict[str, float]):
        super().__init__()
        self.of_feature = of_feature

    def __missing__(self, token: str) -> float:
        known = [self.of_feature[f] for f in features(token) if f in self.of_feature]
        self[token] = weight = max(known, key=abs) if known else 0.0
        return weight


def segments(weights: list[float], drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of ``weight - drift``, end
    exclusive, by start. One scan; a segment on the stack is merged at most once."""
    stack: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    total, last = 0.0, -1
    for i, weight in enumerate(weights):
        if not weight:
            continue
        total -= drift * (i - last - 1)  # tokens that only cost the drift
        last = i
        start, before = i, total
        total += weight - drift
        if weight <= drift:
            continue
        at = len(stack)
        while True:
            at -= 1
            while at >= 0 and stack[at][2] >= before:
                at -= 1
            if at < 0 or stack[at][3] >= total:
                break
            start, before = stack[at][0], stack[at][2]
            del stack[at:]
        stack.append((start, i + 1, before, total))
    return [(s, e, after - before) for s, e, before, after in stack]


def discounted(found: list[str], weights: Weights) -> list[float]:
    """Weights in order; a toxic token's k-th occurrence brings a k-th of it."""
    out, seen = [weights[t] for t in found], Counter()
    for i, weight in enumerate(out):
        if weight > 0:
            seen[found[i]] += 1
            out[i] = weight / seen[found[i]]
    return out


@dataclass
class Model:
    of_feature: dict[str, float] = field(default_factory=dict)
    tilt: float = 0.0  # of clean text as a whole
    tilts: dict[str, float] = field(default_factory=dict)  # of common words
    log_k: float = 0.0
    at: list[float] = field(default_factory=list)  # values and their probabilities
    probability: list[float] = field(default_factory=list)

    def drift(self, found: list[str]) -> float:
        known = [t for t in map(self.tilts.get, found) if t is not None]
        return math.log1p(max(sum(known) / len(known) if known else self.tilt, 1e-6))

    def value(self, weights: Weights, found: list[str]) -> tuple[float, list[tuple[int, int, float]]]:
        """A text's value and its segments (start, end, excess) of excess 0 or more."""
        cost = math.log(max(len(found), 1)) + self.log_k
        own = discounted(found, weights)
        scored = [(s, e, score - cost) for s, e, score in segments(own, self.drift(found))] if any(own) else []
        if not scored:
            return LEAST, []
        best = max(x for _, _, x in scored)
        above = [x for x in scored if x[2] >= 0]
        value = sum(x for _, _, x in above) if above else best
        return min(max(value, LEAST), MOST), above

    def score(self, values: list[float]) -> np.ndarray:
        at = np.array(values, dtype=float)
        if not self.at:
            return np.zeros(len(at))
        return (1 - RISING) * np.interp(at, self.at, self.probability) + RISING * (at - LEAST) / (MOST - LEAST)


def learnable(docs: DataFrame, labels: DataFrame, limit: int = LEARNED) -> DataFrame:
    """(text, toxic, aside) of the documents (doc_id, text) with a label (doc_id, toxic):
    one row per different text. At most ``limit`` labels are taken, by a hash of the id,
    so they are broadcast and only the texts learned from are shuffled."""
    label = (labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
             .groupBy(F.col("doc_id").alias("l_doc")).agg(F.avg(F.col("toxic").cast("double")).alias("label"))
             .orderBy(F.xxhash64("l_doc"), "l_doc").limit(limit))
    picked = F.broadcast(stored(label, "toxicity-labels"))
    kept = docs.filter(F.col("text").isNotNull()).select("doc_id", "text")
    return (kept.join(picked, F.col("doc_id") == F.col("l_doc")).groupBy(F.xxhash64("text").alias("h"))
            .agg(F.any_value("text").alias("text"), (F.avg("label") > 0.5).alias("toxic"))
            .select("text", "toxic", (F.pmod("h", F.lit(CALIBRATION_PART)) == 0).alias("aside")))


def word_counts(learned: DataFrame) -> DataFrame:
    """(token, toxic, clean): texts of each class that hold it; tasks add up before the
    shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())

        def passed() -> pa.RecordBatch:
            words = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(words, pa.string()), pa.array([held[1][w] for w in words], pa.int64()),
                 pa.array([held[0][w] for w in words], pa.int64())], names=["token", "toxic", "clean"])
            for h in held:
                h.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist()):
                held[bool(toxic)].update(set(tokens(text.as_py())))
                if len(held[0]) + len(held[1]) > HELD_WORDS:
                    yield passed()
        yield passed()

    return (learned.select("text", "toxic").mapInArrow(run, "token string, toxic long, clean long")
            .groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def tilt_sums(clean: DataFrame, of_feature: dict[str, float]) -> DataFrame:
    """(token, n, tilt): occurrences in clean texts, and the same times the text's mean tilt."""
    shared = clean.sparkSession.sparkContext.broadcast(of_feature)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, n, tilt = Weights(shared.value), Counter(), Counter()

        def passed() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays(
                [pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()),
                 pa.array([tilt[w] for w in n], pa.float64())], names=["token", "n", "tilt"])
            for held in (n, tilt, weights):
                held.clear()
            return out

        for batch in batches:
            for cell in batch.column("text"):
                found = tokens(cell.as_py())
                mean = sum(math.expm1(w) for w in discounted(found, weights) if w) / max(len(found), 1)
                own = Counter(found)
                n.update(own)
                if mean:
                    tilt.update({w: k * mean for w, k in own.items()})
                if len(n) > HELD_WORDS:
                    yield passed()
        yield passed()

    return (clean.select("text").mapInArrow(run, "token string, n long, tilt double")
            .groupBy("token").agg(F.sum("n").alias("n"), F.sum("tilt").alias("tilt")))


def log_odds(counts: DataFrame, n_toxic: int, n_clean: int) -> dict[str, float]:
    """Weight of every feature that passes ``MIN_Z`` and ``MIN_SHARE``; at most
    FEATURES / MIN_SHARE of them."""
    token = F.col("token")
    of_token = F.array(token, *[F.when(F.char_length(token) >= n, F.concat(F.substring(token, 1, n), F.lit("*")))
                                for n in STEMS])
    pooled = (counts.select(F.explode(F.array_compact(of_token)).alias("feature"), "toxic", "clean")
              .groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0")))
    size = PRIOR
    prior = (F.col("y1") + F.col("y0")) * (size / (n_toxic + n_clean))

    def odds(y: str, n: int):
        return F.log((F.col(y) + prior) / (n + size - F.col(y) - prior))

    spread = F.sqrt(1 / (F.col("y1") + prior) + 1 / (F.col("y0") + prior))
    scored = (pooled.filter(F.col("y1") + F.col("y0") >= MIN_SHARE * (n_toxic + n_clean))
              .select("feature", (odds("y1", n_toxic) - odds("y0", n_clean)).alias("weight"), spread.alias("sd"))
              .filter(F.abs("weight") >= F.greatest(F.lit(MIN_ODDS), MIN_Z * F.col("sd"))))
    return {r["feature"]: r["weight"] for r in scored.collect()}


def isotonic(bins: list[tuple[float, int, int]]) -> tuple[list[float], list[float]]:
    """Rising probabilities for bins (value, rows, toxic rows) by value: neighbours that
    fall are pooled."""
    blocks: list[list[float]] = []  # least value, largest value, rows, toxic
    for value, rows, toxic in bins:
        blocks.append([value, value, rows, toxic])
        while len(blocks) > 1 and blocks[-2][3] * blocks[-1][2] >= blocks[-1][3] * blocks[-2][2]:
            low, _, rows_low, toxic_low = blocks.pop(-2)
            blocks[-1] = [low, blocks[-1][1], rows_low + blocks[-1][2], toxic_low + blocks[-1][3]]
    at, probability = [], []
    for low, high, rows, toxic in blocks:
        for value in dict.fromkeys((low, high)):
            at.append(value)
            probability.append(toxic / rows)
    return at, probability


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of the documents (doc_id, text) that ``labels`` (doc_id, toxic) covers, at
    most ``LEARNED`` of them."""
    learned = stored(learnable(docs, labels), "toxicity-learned")
    counts = stored(word_counts(learned.filter(~F.col("aside"))), "toxicity-words")
    n = counts.agg(F.sum("toxic"), F.sum("clean")).first()
    n_toxic, n_clean = int(n[0] or 0), int(n[1] or 0)
    if not n_toxic or not n_clean:
        return Model()
    model = Model(log_odds(counts, n_toxic, n_clean))
    tilts = stored(tilt_sums(learned.filter("NOT aside AND NOT toxic"), model.of_feature), "toxicity-tilts")
    whole = tilts.agg(F.sum("tilt"), F.sum("n")).first()
    model.tilt = whole[0] / whole[1]
    model.tilts = {r["token"]: r["tilt"] / r["n"] for r in tilts.filter(F.col("n") >= COMMON * whole[1]).collect()}
    # In clean text, segments of excess u or more are K exp(-u) to a text (log_k is 0 so far).
    clean = score(learned.filter("aside AND NOT toxic"), model).agg(
        F.sum("n_above"), F.count(F.lit(1))).first()
    model.log_k = math.log(((clean[0] or 0) + 0.5) / (clean[1] + 1))
    # Values of the documents set aside in bins, so that what is collected has a fixed size.
    rows = score(learned.filter("aside"), model).groupBy(F.round(F.col("value") / STEP).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("toxic").cast("long")).alias("toxic")).orderBy("bin").collect()
    model.at, model.probability = isotonic([(r["bin"] * STEP, r["n"], r["toxic"]) for r in rows])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (text, more) with ``value``, ``score`` (probability of the toxic label),
    ``n_above`` (segments of excess 0 or more) and ``passages``: (start, end, excess) of
    the significant segments in code points of the text."""
    names = [c for c in docs.columns if c != "text"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())]))
    least = -math.log(-math.log1p(-SIGNIFICANT))

    def spans(text: str, found: list[tuple[int, int, float]]) -> list[dict]:
        if not found:
            return []
        places = [m.span() for m in _TOKEN.finditer(folded(text))]
        return [{"start": places[s][0], "end": places[e - 1][1], "excess": x} for s, e, x in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        weights = Weights(own.of_feature)
        for batch in batches:
            values, n_above, passages = [], [], []
            for cell in batch.column("text"):
                text = cell.as_py()
                value, above = own.value(weights, tokens(text))
                values.append(value)
                n_above.append(len(above))
                passages.append(spans(text, [x for x in above if x[2] >= least]))
                if len(weights) > HELD_WORDS:
                    weights.clear()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(values, pa.float64()), pa.array(own.score(values)),
                 pa.array(n_above, pa.int64()), pa.array(passages, passage)],
                names=[*names, "value", "score", "n_above", "passages"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.mapInArrow(run, f"{kept}value double, score double, n_above long, "
                                "passages array<struct<start:long,end:long,excess:double>>")
