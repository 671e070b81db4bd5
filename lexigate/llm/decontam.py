"""Benchmark decontamination by pigeonhole edit matching.

Items and documents are sequences of lower-cased words (runs of letters, digits and
``_``). An item of n words may differ by k = n // 6 word edits (insert, delete,
replace). It is split into k + 1 pieces of five words or more; a passage within the
budget holds one piece unchanged, so exact piece hits (one automaton per block of
items) give every candidate. Each candidate's neighbourhood is verified with Myers'
bit-parallel distance, words as symbols.

The items are a query set against all documents: blocks of at most about
``BLOCK_CHARS`` characters go to the tasks one after another, so memory is bounded
for any number of items. Documents are only mapped over, never shuffled.

Defined cases: null or empty texts and items match nothing; items of fewer than
``MIN_WORDS`` words are no passage and match nothing; repeated rows are matched one
by one; empty tables give empty results.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS = 5
WORDS_PER_EDIT = 6
BLOCK_CHARS = 4_000_000

Match = tuple[object, int, int, int, int]  # item, its words, distance, start, end


def lowered(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    return low


def word_spans(low: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\w+", low)]


def budget(n: int) -> int:
    return n // WORDS_PER_EDIT


def pieces(words: list[str]) -> list[tuple[int, list[str]]]:
    """(place in the item, words) of budget + 1 pieces of nearly equal size."""
    parts = budget(len(words)) + 1
    cuts = [len(words) * i // parts for i in range(parts + 1)]
    return [(a, words[a:b]) for a, b in zip(cuts, cuts[1:])]


def symbol_masks(words: list[str]) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, w in enumerate(words):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def best_end(masks: dict[str, int], m: int, text: list[str]) -> tuple[int, int]:
    """(distance, end) of the stretch of ``text`` nearest to a pattern of ``m`` words;
    the first end at the least distance. Myers' recurrence on whole integers."""
    full, high = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for at, word in enumerate(text, 1):
        eq = masks.get(word, 0)
        vertical = eq | down
        diagonal = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(diagonal | up))
        minus = up & diagonal
        score += bool(plus & high) - bool(minus & high)
        plus, minus = plus << 1 & full, minus << 1 & full
        up = minus | (full & ~(vertical | plus))
        down = plus & vertical
        if score < best:
            best, end = score, at
    return best, end


class Items:
    """One block of items, ready to match; made once per task."""

    def __init__(self, items: list[tuple[object, str]]):
        import ahocorasick
        self.items, self.hits = [], ahocorasick.Automaton()
        wanted: dict[str, list[tuple[int, int]]] = {}
        for key, text in items:
            words = re.findall(r"\w+", lowered(text or ""))
            if len(words) < MIN_WORDS:
                continue
            for at, part in pieces(words):
                wanted.setdefault(f" {' '.join(part)} ", []).append((len(self.items), at))
            self.items.append((key, len(words), symbol_masks(words), symbol_masks(words[::-1])))
        for text, places in wanted.items():
            self.hits.add_word(text, (len(text), places))
        if wanted:
            self.hits.make_automaton()

    def matches(self, text: str | None) -> list[Match]:
        """The best match of every item that the text holds, spans in code points."""
        if not text or not self.items:
            return []
        low = lowered(text)
        words = re.findall(r"\w+", low)
        joined = f" {' '.join(words)} "
        found: dict[int, tuple[int, int, int]] = {}
        starts: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for last, (size, places) in self.hits.iter(joined):
            if not starts:
                at = 1
                for i, w in enumerate(words):
                    starts[at] = i
                    at += len(w) + 1
            first = starts[last - size + 2]
            for item, place in places:
                if (item, first - place) in tried:
                    continue
                tried.add((item, first - place))
                _, n, masks, _ = self.items[item]
                k = budget(n)
                a, b = max(0, first - place - k), first - place + n + k
                distance, end = best_end(masks, n, words[a:b])
                if distance <= k and (item not in found or distance < found[item][0]):
                    found[item] = (distance, a, a + end)
        if not found:
            return []
        spans, out = word_spans(low), []
        for item, (distance, a, end) in found.items():
            key, n, _, backward = self.items[item]
            _, length = best_end(backward, n, words[a:end][::-1])
            out.append((key, n, distance, spans[end - length][0], spans[end - 1][1]))
        return out


def _blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks by hash, each collected on its own."""
    keyed = items.select("item_id", "text").filter(F.length("text") > 0).distinct()
    total = keyed.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(total / block_chars))
    for b in range(blocks):
        mine = keyed.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b) if blocks > 1 else keyed
        yield [(r["item_id"], r["text"]) for r in mine.collect()]


def find_matches(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, item_words, distance, start, end): one row per document row
    and item it holds a passage of, with the nearest passage's span in code points."""
    id_kind = docs.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {id_kind}, item_id {item_kind}, item_words int, distance int, start long, end long"

    def task(block: list[tuple[object, str]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Items(block)
            for batch in batches:
                rows, found = [], []
                for i, text in enumerate(batch.column("text")):
                    for match in matcher.matches(text.as_py()):
                        rows.append(i)
                        found.append(match)
                if rows:
                    kinds = [names.field(c).type for c in ("item_id", "item_words", "distance", "start", "end")]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").take(pa.array(rows, pa.int64()))]
                        + [pa.array([m[c] for m in found], kind) for c, kind in enumerate(kinds)],
                        schema=names)
        return run

    from pyspark.sql.pandas.types import to_arrow_schema
    names = to_arrow_schema(docs.sparkSession.createDataFrame([], schema).schema)
    out = None
    for block in _blocks(items, block_chars):
        part = docs.select("doc_id", "text").mapInArrow(task(block), schema)
        out = part if out is None else out.unionByName(part)
    return out


def clean_documents(docs: DataFrame, items: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of ``docs`` that hold no passage of any item, unchanged."""
    def task(block: list[tuple[object, str]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = Items(block)
            for batch in batches:
                clean = [not matcher.matches(t.as_py()) for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))
        return run

    for block in _blocks(items, block_chars):
        docs = docs.mapInArrow(task(block), docs.schema)
    return docs
