"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams of all labelled texts (no sample): each task adds them up
by language and bucket and emits one row per non-empty cell, so a language with most
of the rows moves no more than the others. The log-probability matrix has one row per
language and a fixed number of buckets and is broadcast; scoring works on batches of
sparse counts in numpy.

Defined cases: null text, or text without a letter, is ``und`` with score 0 and is
not learned from; rows with a null label are not learned from; without any labelled
row everything is ``und``; equal scores go to the first language in order; repeated
rows count and are scored each; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
UNDETERMINED = "und"


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_buckets(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every character n-gram of the lower-cased text."""
    chars = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    out = []
    for n in ORDERS:
        if len(chars) < n:
            break
        h = np.full(len(chars) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = (h ^ chars[k:len(chars) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        out.append((h % np.uint64(buckets)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


@dataclass
class Model:
    languages: list[str]
    log_prior: np.ndarray  # (languages,)
    log_prob: np.ndarray  # (buckets, languages)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Posterior of each language (columns) for each text (rows)."""
        out = np.empty((len(texts), len(self.languages)))
        for i, text in enumerate(texts):
            counts = np.bincount(gram_buckets(text, len(self.log_prob)), minlength=len(self.log_prob))
            used = np.flatnonzero(counts)
            out[i] = self.log_prior + counts[used] @ self.log_prob[used]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        return out / out.sum(axis=1, keepdims=True)


def train(docs: DataFrame, buckets: int = BUCKETS) -> Model | None:
    """Model of all rows of ``docs`` (text, lang) with a label and a letter."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text"), batch.column("lang").to_pylist()):
                text = text.as_py()
                if lang is None or not has_letter(text):
                    continue
                if lang not in counts:
                    counts[lang] = np.zeros(buckets + 1, dtype=np.int64)
                counts[lang][:buckets] += np.bincount(gram_buckets(text, buckets), minlength=buckets)
                counts[lang][buckets] += 1  # documents
        for lang, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at])],
                names=["lang", "bucket", "n"])

    cells = (docs.select("text", "lang").mapInArrow(run, "lang string, bucket int, n long")
             .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
    table = cells.toArrow()  # at most (buckets + 1) cells per language
    languages = sorted(set(table.column("lang").to_pylist()))
    if not languages:
        return None
    counts = np.zeros((buckets + 1, len(languages)))
    column = {lang: i for i, lang in enumerate(languages)}
    counts[table.column("bucket").to_numpy(),
           [column[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    smooth = counts[:buckets] + SMOOTHING
    return Model(languages, np.log(counts[buckets] / counts[buckets].sum()), np.log(smooth / smooth.sum(axis=0)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, more) with ``lang_pred`` and ``score``; only ``text`` is used."""
    names = [c for c in docs.columns if c != "text"]
    parts = model and (model.languages, model.log_prior, model.log_prob)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value) if shared.value else None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if own and has_letter(t)]
            lang, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
            if known:
                posterior = own.scores([texts[i] for i in known])
                for i, best, p in zip(known, posterior.argmax(axis=1), posterior.max(axis=1)):
                    lang[i], score[i] = own.languages[best], p
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(lang, pa.string()), pa.array(score)],
                names=[*names, "lang_pred", "score"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.mapInArrow(run, f"{kept}{', ' if kept else ''}lang_pred string, score double")
