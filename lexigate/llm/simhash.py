"""SimHash near-duplicates by a generalised pigeonhole.

A fingerprint has 64 bits, each the majority of that bit over the XXH64 values of
the text's word shingles. Equal fingerprints are collapsed first. Two fingerprints
differ in at most ``max_bits`` bits only if, for some group of bits i, they differ in
at most t_i bits there, whenever sum(t_i + 1) = max_bits + 1. Bits are grouped by
correlation (measured over all fingerprints) and the t_i, unequal and possibly "not
used", come from a dynamic program over estimated work: rows to probe and candidate
pairs, from the collisions counted in each group over all fingerprints. Each
fingerprint probes the values near its own in every used group; fingerprints that
meet under a key are verified by their full distance.

A key's fingerprints are searched breadth first and only a spanning forest of their
links is kept, so dense groups give no more rows than members. Keys with more than
``BLOCK`` members are dealt as pairs of blocks to different tasks. Components of the
links give ``component_id``, the smallest doc_id reachable.

Defined cases: null or blank text has no shingle and fingerprint zero, linked like
any other; fewer words than a shingle form one shingle; repeated rows share a
fingerprint; a null doc_id never names a component unless all ids in it are null;
an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm.common import packed, stored, unpacked
from lexigate.llm.components import components

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
BLOCK = 4096  # most members of a key compared in one unit
PROBE_COST = 100  # a probed row costs about as much as so many verified pairs
SMALL = 32  # keys up to this many members are compared all at once
NO_ID = -(1 << 63)  # stands for a null doc_id in a join
CHUNK = 1 << 17  # shingles whose bits are unpacked at once


def fingerprint(text: str | None, size: int = SHINGLE_WORDS) -> int:
    """Unsigned 64-bit SimHash of one whole text."""
    import xxhash
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = ends - np.fromiter(map(len, words), dtype=np.int64, count=len(words)) - 1
    n = max(1, len(words) - size + 1)
    begin, stop = starts[:n].tolist(), (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(begin[k:k + CHUNK], stop[k:k + CHUNK])],
                     dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE_WORDS) -> DataFrame:
    """The columns but ``text``, and fp: the fingerprint as a signed long."""
    names = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), size) for t in batch.column("text")], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(fps.view(np.int64))],
                                             names=[*names, "fp"])
    kinds = "".join(f"{c} {docs.schema[c].dataType.simpleString()}, " for c in names)
    return docs.mapInArrow(run, f"{kinds}fp long")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_statistics(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the 64 x 64 table of bits set together, over all."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64), dtype=np.int64)
        for batch in batches:
            b = _bits(batch.column("fp").to_numpy()).astype(np.float32)
            both += (b.T @ b).astype(np.int64)
        at = np.indices((64, 64)).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0], pa.int32()), pa.array(at[1], pa.int32()),
                                          pa.array(both.ravel())], names=["i", "j", "n"])
    rows = nodes.select("fp").mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    together = np.zeros((64, 64))
    for r in rows.collect():  # 4,096 rows, whatever the input
        together[r["i"], r["j"]] = r["n"]
    return nodes.count(), together


def bit_groups(n: int, together: np.ndarray, parts: int) -> list[list[int]]:
    """Groups of about equal size; each grows by the bit most correlated with it."""
    rate = np.diag(together) / max(n, 1)
    spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(rate, rate)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = list(range(64)), []
    for k in range(parts, 0, -1):
        size = math.ceil(len(left) / k)
        group = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            left.remove(best)
        groups.append(sorted(group))
    return groups


def _differing(rate: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in 0..most of some independent bits."""
    chance = np.zeros(most + 1)
    chance[0] = 1.0
    for p in 2 * rate * (1 - rate):
        chance[1:] = chance[1:] * (1 - p) + chance[:-1] * p
        chance[0] *= 1 - p
    return np.maximum(chance, 1e-300)


def _radius(t: int) -> int:
    """Bits each side flips so that values t bits apart meet."""
    return (t + 1) // 2


def _probes(bits: int, t: int) -> float:
    return 1 + bits / 2 if t == 1 else float(sum(math.comb(bits, k) for k in range(_radius(t) + 1)))


def allocate(cost: list[list[float]], max_bits: int) -> tuple[float, list[int]]:
    """Thresholds t_i >= -1 with sum(t_i + 1) = max_bits + 1 of least total cost;
    ``cost[i][t + 1]`` is that of group i at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in cost:
        after: dict[int, tuple[float, list[int]]] = {}
        for used, (total, chosen) in best.items():
            for step in range(max_bits + 2 - used):
                option = (total + row[step], [*chosen, step - 1])
                if used + step not in after or option < after[used + step]:
                    after[used + step] = option
        best = after
    return best[max_bits + 1]


def _costs(n: int, rate: np.ndarray, groups: list[list[int]], max_bits: int,
           equal_pairs: list[float] | None = None) -> list[list[float]]:
    out = []
    for i, g in enumerate(groups):
        chance = _differing(rate[g], 2 * max_bits)
        pairs = equal_pairs[i] if equal_pairs else n * n / 2 * chance[0]
        row = [0.0]
        for t in range(max_bits + 1):
            reach = 1 if t == 1 else 2 * _radius(t)
            row.append(PROBE_COST * n * _probes(len(g), t) + pairs * chance[:reach + 1].sum() / chance[0])
        out.append(row)
    return out


def _equal_pairs(nodes: DataFrame, groups: list[list[int]]) -> list[float]:
    """Pairs of fingerprints that agree on all bits of each group, counted over all."""
    keyed = probe_keys(nodes, groups, [0] * len(groups))
    counts = (keyed.groupBy("key").count()
              .select(F.shiftright("key", 56).alias("part"), F.col("count").cast("double").alias("c"))
              .groupBy("part").agg(F.sum(F.expr("c * (c - 1) / 2")).alias("pairs")))
    found = {r["part"]: r["pairs"] for r in counts.collect()}  # one row per group
    return [found.get(i, 0.0) for i in range(len(groups))]


def plan(nodes: DataFrame, max_bits: int = MAX_BITS) -> tuple[list[list[int]], list[int]]:
    """Groups of bits and their thresholds for these fingerprints."""
    n, together = bit_statistics(nodes)
    rate = np.diag(together) / max(n, 1)
    options = [bit_groups(n, together, m) for m in range(2, max_bits + 2)]
    groups = min(options, key=lambda g: allocate(_costs(n, rate, g, max_bits), max_bits)[0])
    return groups, allocate(_costs(n, rate, groups, max_bits, _equal_pairs(nodes, groups)), max_bits)[1]


def probe_keys(nodes: DataFrame, groups: list[list[int]], limits: list[int]) -> DataFrame:
    """(key, fp): the values of each used group within reach of the fingerprint's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            bits = _bits(fps).astype(np.int64)
            for part, (group, t) in enumerate(zip(groups, limits)):
                if t < 0:
                    continue
                value = bits[:, group] @ (1 << np.arange(len(group), dtype=np.int64))
                for k in range(_radius(t) + 1):
                    for flip in itertools.combinations(range(len(group)), k):
                        mask = sum(1 << b for b in flip)
                        near = value ^ mask
                        keep = near <= value if t == 1 else slice(None)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array((part << 56) + near[keep]), pa.array(fps[keep])], names=["key", "fp"])
    return nodes.select("fp").mapInArrow(run, "key long, fp long")


def _units(keyed: DataFrame, block: int) -> DataFrame:
    """(key, unit, fp): keys with more than ``block`` members become pairs of blocks."""
    large = (keyed.groupBy("key").count().filter(F.col("count") > block)
             .select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")))
    dealt = keyed.join(large, "key", "left").withColumn(
        "own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: x != F.col("own")),
                        lambda x: F.least(x, F.col("own")) * F.col("blocks") + F.greatest(x, F.col("own")))
    unit = F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(pairs)
    return dealt.select("key", F.explode(unit).alias("unit"), "fp")


def _forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of a spanning forest, breadth first: each found member leaves the rest."""
    out, rest = [], fps
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            node = queue.pop()
            near = np.bitwise_count(rest ^ node) <= max_bits
            if near.any():
                hits, rest = rest[near], rest[~near]
                out.append((np.full(len(hits), node), hits))
                queue.extend(hits)
    return out


def _small_links(fps: np.ndarray, sizes: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """All links within runs of ``fps`` of the given small sizes."""
    ends = np.cumsum(sizes)
    after = np.repeat(ends, sizes) - np.arange(len(fps)) - 1  # later members of the run
    left = np.repeat(np.arange(len(fps)), after)
    right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(after) - after, after)
    near = np.bitwise_count(fps[left] ^ fps[right]) <= max_bits
    return fps[left[near]], fps[right[near]]


def links(nodes: DataFrame, max_bits: int = MAX_BITS, block: int = BLOCK) -> DataFrame:
    """(u, v): pairs at most ``max_bits`` apart, enough to connect all such pairs."""
    groups, limits = plan(nodes, max_bits)
    dealt = (_units(probe_keys(nodes, groups, limits), block)
             .repartition("key", "unit").sortWithinPartitions("key", "unit", "fp"))

    def solve(fps: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        sizes = np.diff(np.append(starts, len(fps)))
        small = sizes <= SMALL
        found = [_small_links(fps[np.repeat(small, sizes)], sizes[small], max_bits)]
        for s, n in zip(starts[~small].tolist(), sizes[~small].tolist()):
            found += _forest(fps[s:s + n], max_bits)
        u, v = (np.concatenate([f[k] for f in found]).view(np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last unit may go on in the next batch
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ("key", "unit", "fp")]
            key, unit, fp = [np.concatenate(x) for x in zip(held, part)] if held else part
            starts = np.append(0, 1 + np.flatnonzero((key[1:] != key[:-1]) | (unit[1:] != unit[:-1])))
            cut = int(starts[-1])
            if cut:
                yield solve(fp[:cut].view(np.uint64), starts[:-1])
            held = [key[cut:], unit[cut:], fp[cut:]]
        if held and len(held[2]):
            yield solve(held[2].view(np.uint64), np.array([0]))

    return dealt.mapInArrow(run, "u long, v long")


def _rooted(prints: DataFrame, max_bits: int) -> DataFrame:
    """(fp, first_doc, root): the component's smallest fingerprint for each one."""
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "nodes")
    stars = components(links(nodes, max_bits))
    return nodes.join(stars.select(F.col("u").alias("fp"), F.col("v").alias("root")), "fp", "left").select(
        "fp", "first_doc", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = stored(fingerprints(docs.select("doc_id", "text"), size), "fingerprints")
    rooted = _rooted(prints, max_bits)
    least = rooted.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group, whole and unchanged: that of the smallest doc_id (null
    last), then of the smallest hash of the row. Groups are those of the texts, so each
    keeps its row even where its doc_id is null or is another group's too."""
    known = F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("__id")
    own = [F.col(f"`{c}`") for c in docs.columns]  # the hash skips nulls
    mark = F.xxhash64(*own, *[c.isNull() for c in own]).alias("__mark")

    prints = stored(fingerprints(docs.select("doc_id", "text", mark), size), "fingerprints")
    heads = (prints.join(_rooted(prints, max_bits).select("fp", "root"), "fp").groupBy("root")
             .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__mark")).alias("head"))
             .select("head.doc_id", "head.__mark").select(known, "__mark"))
    # joined and grouped by the same plain keys: one shuffle of the texts
    kept = docs.select(packed(docs), known, mark).join(heads, ["__id", "__mark"], "left_semi")
    single = kept.groupBy("__id", "__mark").agg(F.first("__row").alias("__row"))
    return unpacked(single, docs)
