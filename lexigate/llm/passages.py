"""Near-duplicate passages by compact windows.

A text is the sequence of its five-word shingles (A-Z lowered). For one hash
function, every subsequence of at least ``MIN_SHINGLES`` shingles has its least hash
at one place; all subsequences with the same place form one compact window (left,
place, right), a node of the Cartesian tree of the hashes. Only nodes that are the
minimum of some stretch of ``MIN_SHINGLES`` matter, and the tree's ancestors of such a
node are such nodes too, so a sliding minimum finds them all and a stack over them
alone gives their windows: about 2 n / MIN_SHINGLES per function.

Windows of different texts with the same least hash meet under that hash. Members are
linked along the sort order (hash, then a signature of the neighbourhood) and to the
first of their neighbourhood, never all with all; each task does so for its own
windows first and sends on only the first and last of a neighbourhood. Links of a pair of texts are joined
by diagonal; pairs with ``MIN_HASHES`` different functions on a diagonal become
candidates over the union of their window intervals, and are verified on the words:
passages of at least ``MIN_WORDS`` words whose shingle sets have a Jaccard similarity
of at least ``SIMILARITY``. These links leave out pairs of a hash that three or more
windows share, so rounds follow over composites: a hash together with the exact run of
``RUN`` shingles that begins or ends at its place. A stock phrase shorter than such a run
(``RUN`` + 4 words) joins nothing there, and a passage has such a run on one side of most of its
places: one of n shingles is left with a run of 2 ``RUN`` - 1 at least, since a changed
word costs at least four shingles of both texts and SIMILARITY allows n / 9. A text whose
window lies in no passage found so far, or in another class than most texts of its
composite, becomes a hub and is tested against every text that shares a composite with
it, until each such text was a hub. So every pair that meets in one composite (one function
is enough) is tested or in one class already. Texts that are equal word by word are one
node throughout; classes are the connected components of verified links.

Defined cases: null text is empty; texts under ``MIN_WORDS`` words have no passage and
are a class of their own; repeated rows and equal texts share a class and count the
whole text as a passage; a null doc_id never names a class unless all its ids are
null; repeats inside one text alone are not reported; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigate.llm import common
from lexigate.llm.components import components

SHINGLE = 5
MIN_WORDS = 50
MIN_SHINGLES = MIN_WORDS - SHINGLE + 1
SIMILARITY = 0.8
HASHES = 5
MIN_HASHES = 2
SHIFT = 12  # words by which a diagonal may move from one match to the next
NEAR = 8  # shingles on either side that sign a neighbourhood
RUN = 11  # shingles of an exact run that begins or ends at a place
ROUND = 32  # regions are cut out in multiples of so many words
CHUNK_WORDS = 1 << 18  # words whose windows are found at once
REACH = 0xFFFF  # a window's reach to either side as stored
BATCH_BYTES = 4 << 20  # regions that a task sends on at once
ROW_BYTES = 100  # counted for each besides its shingles

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``common.stored``; the write's shuffle files are deleted when it ends."""
    conf = df.sparkSession.conf
    before = conf.get(CLEANUP, "false")
    conf.set(CLEANUP, "true")
    try:
        return common.stored(df, name)
    finally:
        conf.set(CLEANUP, before)


def _mixed(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x ^ np.uint64(seed * 0x51_7CC1B7 + 0x2545F491)) * _M1
    x ^= x >> np.uint64(31)
    x *= _M2
    return x ^ (x >> np.uint64(29))


def split_words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    import xxhash
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), dtype=np.uint64, count=len(tokens))


def shingle_hashes(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SHINGLE + 1
    out = np.zeros(max(n, 0), dtype=np.uint64)
    for k in range(SHINGLE if n > 0 else 0):
        out = (out ^ hashes[k:k + n]) * _M1
        out ^= out >> np.uint64(29)
    return out


def run_hashes(s: np.ndarray) -> np.ndarray:
    """32-bit hash of the ``RUN`` shingles from each place on (past the end: of zeros)."""
    padded = np.append(s, np.zeros(RUN, dtype=np.uint64))
    out = np.zeros(len(s), dtype=np.uint64)
    for k in range(RUN):
        out = (out ^ padded[k:k + len(s)]) * _M1
        out ^= out >> np.uint64(29)
    return out >> np.uint64(32)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every stretch of ``width``: running minima of blocks from both ends."""
    n = len(x)
    blocks = np.append(x, np.full(-n % width, np.iinfo(np.uint64).max, dtype=np.uint64)).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def compact_windows(g: np.ndarray, begins: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, left, right) of every compact window of at least ``least``, for texts
    laid end to end that begin at ``begins`` (each at least ``least`` long)."""
    ends = np.append(begins[1:], len(g))
    low = sliding_min(g, least)
    for b in ends[:-1].tolist():
        low[b - least + 1:b] = 0  # stretches over the end of a text count for nothing
    edge = np.full(least - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    highest = ~sliding_min(np.concatenate([edge, ~low, edge]), least)  # over the stretches that hold a place
    places = np.flatnonzero(highest == g)
    text = np.searchsorted(begins, places, side="right") - 1
    left, right = begins[text].copy(), ends[text] - 1
    stack: list[int] = []
    value, owner, spot = g[places].tolist(), text.tolist(), places.tolist()
    for i, v in enumerate(value):
        while stack and owner[stack[-1]] == owner[i] and value[stack[-1]] > v:
            right[stack.pop()] = spot[i] - 1
        if stack and owner[stack[-1]] == owner[i]:
            left[i] = spot[stack[-1]] + 1
        else:
            stack.clear()
        stack.append(i)
    wide = right - left + 1 >= least  # of equal hashes the first counts as the least
    return places[wide], left[wide], right[wide]


def text_nodes(docs: DataFrame, carry: str = "doc_id") -> DataFrame:
    """(``carry``, node, n_words): node is a hash of the text's words in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            node, sizes = np.zeros(batch.num_rows, dtype=np.uint64), np.zeros(batch.num_rows, dtype=np.int64)
            for i, text in enumerate(batch.column("text")):  # the words of one text at a time
                tokens = split_words(text.as_py())
                node[i], sizes[i] = xxhash.xxh3_64_intdigest(b" ".join(tokens)), len(tokens)
            yield pa.RecordBatch.from_arrays(
                [batch.column(carry), pa.array(node.view(np.int64)), pa.array(sizes)], names=[carry, "node", "n_words"])
    return docs.select("doc_id", "text").mapInArrow(
        run, f"{carry} {docs.schema[carry].dataType.simpleString()}, node long, n_words long")


ROW = ["key", "near", "node", "spot", "other", "other_spot"]
LINK = -1  # ``near`` of a row that is a link already
SHARED, THINNED = -1, -2  # ``f`` of a row that names a key of two windows, of more
HUBS = 4  # texts of a key that become hubs in the first round, and growth a round


def _linked(key: np.ndarray, near: np.ndarray, node: np.ndarray, spot: np.ndarray, row: np.ndarray,
            partner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Links (a, b, f, a_spot, b_spot) between the rows at two index arrays, the smaller
    text first; none within a text."""
    real = node[row] != node[partner]
    u, v = row[real], partner[real]
    swap = node[u] > node[v]
    u, v = np.where(swap, v, u), np.where(swap, u, v)
    return node[u], node[v], key[u] & 15, spot[u], spot[v]


def _combined(key: np.ndarray, near: np.ndarray, node: np.ndarray, spot: np.ndarray) -> pa.RecordBatch:
    """What a task's windows send on: of each neighbourhood under a key the first and the
    last; the others are linked to the first and along the order here already. So a
    passage that very many texts hold reaches the shuffle as a few rows a task."""
    order = np.lexsort((spot, node, near, key))
    key, near, node, spot = key[order], near[order], node[order], spot[order]
    new = np.append(True, (key[1:] != key[:-1]) | (near[1:] != near[:-1]))
    row, start = np.arange(len(key)), np.flatnonzero(new)
    first = np.maximum.accumulate(np.where(new, row, 0))
    large = np.repeat(np.diff(np.append(start, len(key))) > 2, np.diff(np.append(start, len(key))))
    star, chain = row[large & ~new], row[large & ~new & (first != row - 1)]
    a, b, f, a_spot, b_spot = _linked(key, near, node, spot, np.append(star, chain),
                                      np.append(first[star], chain - 1))
    keep = ~large | new | np.append(new[1:], True)
    spread = ((a ^ (b << 7)) & ~np.int64(15)) | f  # any key: links only pass through
    cut = large[keep].astype(np.int64)  # others of this neighbourhood stay behind
    columns = [np.append(key[keep], spread), np.append(near[keep], np.full(len(a), LINK, np.int32)),
               np.append(node[keep], a), np.append(spot[keep], a_spot), np.append(cut, b),
               np.append(np.zeros_like(cut), b_spot)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=ROW)


def windows(docs: DataFrame, hashes: int = HASHES, combined: bool = True) -> DataFrame:
    """(key, near, node, spot) of every compact window: the least hash with its function
    in the low bits, the neighbourhood's signature, the text, and place and reach;
    if ``combined``, per task, so some rows are links (``other``, ``other_spot``). If not,
    ``other`` holds the runs that end and begin at the place, 32 bits each (0: the text
    ends before), and windows of one word or phrase said over and over are their first."""
    def found(nodes: list[int], parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        s = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        ends = np.cumsum(sizes)
        begins = ends - sizes
        width = 2 * NEAR + 1
        sign = sliding_min(_mixed(s, 99), width) >> np.uint64(33)
        ids = np.array(nodes, dtype=np.uint64).view(np.int64)
        runs = None if combined else run_hashes(s)
        rows = []
        for f in range(hashes):
            g = _mixed(s, f)
            at, left, right = compact_windows(g, begins, MIN_SHINGLES)
            text = np.searchsorted(begins, at, side="right") - 1
            key = (g[at] & ~np.uint64(15) | np.uint64(f)).view(np.int64)
            near = sign[np.clip(at - NEAR, begins[text], ends[text] - width)].astype(np.int32)
            spot = ((at - begins[text]) << 32) | (np.minimum(at - left, REACH) << 16) | np.minimum(right - at, REACH)
            if combined:
                rows.append((key, near, ids[text], spot))
                continue
            back, ahead = at - RUN + 1, at + RUN <= ends[text]
            run = (np.where(back >= begins[text], runs[np.maximum(back, 0)], 0) << np.uint64(32)
                   | np.where(ahead, runs[at], 0)).view(np.int64)
            order = np.lexsort((at, run, key, text))
            again = np.append(False, (np.diff(text[order]) == 0) & (np.diff(at[order]) <= MIN_SHINGLES)
                              & (key[order][1:] == key[order][:-1]) & (run[order][1:] == run[order][:-1]))
            keep = np.sort(order[~again])
            rows.append((key[keep], near[keep], ids[text[keep]], spot[keep], run[keep], np.zeros(len(keep), np.int64)))
        whole = [np.concatenate(c) for c in zip(*rows)]
        yield _combined(*whole) if combined else pa.RecordBatch.from_arrays([pa.array(c) for c in whole], names=ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            seen: set[int] = set()
            nodes, parts, held = [], [], 0
            for text in batch.column("text"):
                tokens = split_words(text.as_py())
                if len(tokens) < MIN_WORDS:
                    continue
                node = xxhash.xxh3_64_intdigest(b" ".join(tokens))
                if node in seen:
                    continue
                seen.add(node)
                nodes.append(node)
                parts.append(shingle_hashes(word_hashes(tokens)))
                held += len(tokens)
                if held >= CHUNK_WORDS:
                    yield from found(nodes, parts)
                    nodes, parts, held = [], [], 0
            if parts:
                yield from found(nodes, parts)

    return docs.select("text").mapInArrow(
        run, "key long, near int, node long, spot long, other long, other_spot long")


def window_links(placed: DataFrame) -> DataFrame:
    """(a, b, f, a_spot, b_spot): links between windows of different texts under one key,
    at most two for each window; and rows (key, key, ``SHARED`` or ``THINNED``, 0, 0)."""
    dealt = placed.repartition("key").sortWithinPartitions("key", "near", "node", "spot")

    def links(a, b, f, a_spot, b_spot) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(a), pa.array(b), pa.array(f.astype(np.int32)), pa.array(a_spot), pa.array(b_spot)],
            names=["a", "b", "f", "a_spot", "b_spot"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first of the open neighbourhood and the last row
        for batch in batches:
            part = [batch.column(c).to_numpy() for c in ROW]
            done = part[1] == LINK
            if done.any():
                key, _, node, spot, other, other_spot = (c[done] for c in part)
                yield links(node, other, key & 15, spot, other_spot)
            part = [c[~done] for c in part[:5]]
            if not len(part[0]):
                continue
            key, near, node, spot, cut = [np.concatenate(x) for x in zip(held, part)] if held else part
            same = np.append(False, (key[1:] == key[:-1]) & (node[1:] == node[:-1]) & (spot[1:] == spot[:-1]))
            if same.any():  # a copy's row takes its mark along
                cut = np.maximum.reduceat(cut, np.flatnonzero(~same))
            key, near, node, spot = key[~same], near[~same], node[~same], spot[~same]
            row = np.arange(len(key))
            new_key = np.append(True, key[1:] != key[:-1])
            at = np.flatnonzero(new_key)
            size = np.diff(np.append(at, len(key)))
            thinned = (size > 2) | (np.maximum.reduceat(cut, at) > 0)
            shared = thinned | (size == 2)
            named, none = key[at][shared], np.zeros(int(shared.sum()), dtype=np.int64)
            yield links(named, named, np.where(thinned[shared], THINNED, SHARED), none, none)
            new_near = new_key | np.append(True, near[1:] != near[:-1])
            first = np.maximum.accumulate(np.where(new_near, row, 0))
            star, chain = row[~new_near], row[~new_key & (new_near | (first != row - 1))]
            yield links(*_linked(key, near, node, spot, np.append(star, chain), np.append(first[star], chain - 1)))
            keep = [first[-1], len(key) - 1] if first[-1] < len(key) - 1 else [len(key) - 1]
            # rows of this key are left behind: one more makes it thinned
            held = [x[keep] for x in (key, near, node, spot)] + [np.full(len(keep), int(shared[-1]), dtype=np.int64)]

    return dealt.mapInArrow(run, "a long, b long, f int, a_spot long, b_spot long")


def candidates(linked: DataFrame, min_hashes: int = MIN_HASHES) -> DataFrame:
    """(a, b, a_lo, a_hi, b_lo, b_hi): regions in words of pairs of texts that meet on a
    diagonal under enough functions. The window intervals of a pair are swept in order
    of their diagonal; those that follow each other closely are one region."""
    places = linked.select(
        "a", "b", "f", F.shiftright("a_spot", 32).alias("ac"), F.shiftright("b_spot", 32).alias("bc"),
        *[F.least(*[F.shiftright(s, shift).bitwiseAND(REACH) for s in ("a_spot", "b_spot")]).alias(n)
          for n, shift in (("before", 16), ("after", 0))])
    dealt = places.withColumn("shift", F.col("bc") - F.col("ac")).repartition("a", "b").sortWithinPartitions(
        "a", "b", "shift", "ac")
    names = ["a", "b", "a_lo", "a_hi", "b_lo", "b_hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the open region, reduced to what it needs
        columns = ["a", "b", "shift", "f", "ac", "bc", "before", "after"]
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b, shift, f, ac, bc, before, after = (batch.column(c).to_numpy() for c in columns)
            new = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (shift[1:] - shift[:-1] > SHIFT))
            at = np.flatnonzero(new)
            rows = [list(r) for r in zip(
                a[at].tolist(), b[at].tolist(),
                np.minimum.reduceat(ac - before, at).tolist(), np.maximum.reduceat(ac + after, at).tolist(),
                np.minimum.reduceat(bc - before, at).tolist(), np.maximum.reduceat(bc + after, at).tolist(),
                np.bitwise_or.reduceat(1 << f.astype(np.int64), at).tolist())]
            if held is not None:
                old, last = held
                if old[0] == rows[0][0] and old[1] == rows[0][1] and shift[0] - last <= SHIFT:
                    rows[0][2], rows[0][4] = min(old[2], rows[0][2]), min(old[4], rows[0][4])
                    rows[0][3], rows[0][5] = max(old[3], rows[0][3]), max(old[5], rows[0][5])
                    rows[0][6] |= old[6]
                else:
                    rows.insert(0, old)
            held = (rows.pop(), shift[-1])
            yield emitted(rows)
        if held is not None:
            yield emitted([held[0]])

    def emitted(rows: list[list[int]]) -> pa.RecordBatch:
        rows = [r for r in rows if r[6].bit_count() >= min_hashes]
        cut = [[r[0] for r in rows], [r[1] for r in rows]]
        for lo, hi in ((2, 3), (4, 5)):
            cut.append([max(0, r[lo] - SHIFT) // ROUND * ROUND for r in rows])
            cut.append([-(-(r[hi] + SHINGLE + SHIFT) // ROUND) * ROUND for r in rows])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cut], names=names)

    return dealt.select("a", "b", "shift", "f", "ac", "bc", "before", "after").mapInArrow(
        run, ", ".join(f"{n} long" for n in names))


def shared_passages(sa: np.ndarray, sb: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(a_start, a_end, b_start, b_end) in words of the passages that two stretches,
    given as shingle hashes, share. A passage is a maximal stretch of ``sa`` in which
    every ``MIN_SHINGLES`` positions hold ``SIMILARITY`` of them that ``sb`` has too,
    together with the part of ``sb`` that its matches lie in around their usual
    diagonal; both of at least ``MIN_WORDS`` words, and the Jaccard similarity of the two
    shingle sets is at least ``SIMILARITY``. A stretch that is not similar enough is cut
    at its longest unmatched part."""
    if min(len(sa), len(sb)) < MIN_SHINGLES:
        return []
    order = np.argsort(sb, kind="stable")
    ranked = sb[order]
    place = np.minimum(np.searchsorted(ranked, sa), len(sb) - 1)
    matched = ranked[place] == sa
    upto = np.append(0, np.cumsum(matched))
    dense = np.flatnonzero(upto[MIN_SHINGLES:] - upto[:-MIN_SHINGLES] >= SIMILARITY * MIN_SHINGLES)
    if not len(dense):
        return []
    cuts = np.flatnonzero(np.diff(dense) > 1) + 1
    at, partner, out = np.flatnonzero(matched), order[place], []
    todo = [at[(at >= d[0]) & (at < d[-1] + MIN_SHINGLES)] for d in np.split(dense, cuts)]
    while todo:
        part = todo.pop()
        if not len(part) or part[-1] - part[0] + 1 < MIN_SHINGLES:
            continue
        lo, hi = int(part[0]), int(part[-1])
        found = partner[part]
        shift = found - part
        usual = np.sort(shift)[len(shift) // 2]  # one that occurs, not a mean of two
        found = found[np.abs(shift - usual) <= SHIFT + (hi - lo) // 4]
        first, last = int(found.min()), int(found.max())
        if last - first + 1 >= MIN_SHINGLES:
            left, right = np.unique(sa[lo:hi + 1]), np.unique(sb[first:last + 1])
            both = len(np.intersect1d(left, right, assume_unique=True))
            if both >= SIMILARITY * (len(left) + len(right) - both):
                out.append((lo, hi + SHINGLE, first, last + SHINGLE))
                continue
        gaps = np.diff(part)
        cut = int(gaps.argmax()) + 1 if gaps.max() > 1 else len(part) // 2
        todo += [part[:cut], part[cut:]]
    return sorted(out)


def region_shingles(regions: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, lo, hi, shingles): each wanted region of a text as 32-bit hashes of its
    shingles (two of a thousand shingles each meet by chance in one pair of 4,000, and
    then in one shingle). A text is joined and read once for all its regions (few: they are
    rounded); a row whose words are not the node's is another text under its doc_id."""
    wanted = regions.groupBy("node").agg(F.collect_set(F.struct("lo", "hi")).alias("regions"))

    def cut(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], t) for k, t in enumerate(
                (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["node", "lo", "hi", "shingles"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            rows, held = [], 0
            for node, text, wanted in zip(*(batch.column(c) for c in ("node", "text", "regions"))):
                tokens = split_words(text.as_py())
                if xxhash.xxh3_64_intdigest(b" ".join(tokens)) != node.as_py() % (1 << 64):
                    continue
                hashes = shingle_hashes(word_hashes(tokens)).astype(np.uint32)
                for r in wanted:
                    lo, hi = r["lo"].as_py(), r["hi"].as_py()
                    part = hashes[lo:max(lo, hi - SHINGLE + 1)]
                    rows.append((node.as_py(), lo, hi, part.tobytes()))
                    held += part.nbytes + ROW_BYTES
                    if held >= BATCH_BYTES:  # regions of a text overlap: all of a batch have no bound
                        yield cut(rows)
                        rows, held = [], 0
            yield cut(rows)

    return (wanted.join(texts, "node").select("node", "text", "regions")
            .mapInArrow(run, "node long, lo long, hi long, shingles binary"))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, a_start, a_end, b_start, b_end) of candidate ``pairs``; ``texts`` (node,
    text) has one row per text."""
    sides = [pairs.select(F.col(s).alias("node"), F.col(f"{s}_lo").alias("lo"), F.col(f"{s}_hi").alias("hi"))
             for s in ("a", "b")]
    cut = stored(region_shingles(sides[0].unionByName(sides[1]).distinct(), texts), "regions")

    def side(s: str) -> DataFrame:
        return cut.select(F.col("node").alias(s), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"),
                          F.col("shingles").alias(f"{s}_shingles"))

    both = (pairs.join(side("a"), ["a", "a_lo", "a_hi"]).join(side("b"), ["b", "b_lo", "b_hi"])
            .select("a", "b", "a_lo", "b_lo", "a_shingles", "b_shingles"))
    names = ["a", "b", "a_start", "a_end", "b_start", "b_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            keys = zip(*(batch.column(c).to_pylist() for c in ("a", "b", "a_lo", "b_lo")))
            for (a, b, a_lo, b_lo), x, y in zip(keys, batch.column("a_shingles"), batch.column("b_shingles")):
                sa, sb = (np.frombuffer(v.as_buffer(), dtype=np.uint32) for v in (x, y))
                for i, j, k, m in shared_passages(sa, sb):
                    rows.append((a, b, a_lo + i, a_lo + j, b_lo + k, b_lo + m))
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(6)],
                                             names=names)
    return both.mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _merged_spans(spans) -> F.Column:
    """Sorted (start, end) spans with those that touch made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(F.sort_array(spans), empty, lambda acc, x: F.when(
        (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(-1)) >= x["start"]),
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(
            F.get(acc, F.size(acc) - 1)["start"].alias("start"),
            F.greatest(F.get(acc, F.size(acc) - 1)["end"], x["end"]).alias("end")))))
        .otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))))


def _spans(found: DataFrame) -> DataFrame:
    """(node, other, start, end) of both sides of the passages found."""
    sides = [found.select(F.col(s).alias("node"), F.col(o).alias("other"), F.col(f"{s}_start").alias("start"),
                          F.col(f"{s}_end").alias("end")) for s, o in (("a", "b"), ("b", "a"))]
    return sides[0].unionByName(sides[1])


def _merged_of(found: DataFrame) -> DataFrame:
    """(node, spans): the merged spans of each text."""
    return (_spans(found).groupBy("node", "start").agg(F.max("end").alias("end")).groupBy("node")
            .agg(_merged_spans(F.collect_list(F.struct("start", "end"))).alias("spans")))


def _fetched(docs: DataFrame, texts: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, text) of the texts of ``pairs``, each from its first document; those that
    only documents without an id hold are found by their words."""
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    owners = texts.join(wanted, "node", "left_semi").select("node", F.col("first_doc").alias("doc_id"))
    nameless = (text_nodes(docs.filter(F.col("doc_id").isNull()), "text")
                .join(owners.filter(F.col("doc_id").isNull()).select("node"), "node", "left_semi")
                .groupBy("node").agg(F.first("text").alias("text")))
    return owners.join(docs.select("doc_id", "text"), "doc_id").select("node", "text").unionByName(nameless)


def composites(docs: DataFrame, keys: DataFrame, hashes: int) -> DataFrame:
    """(key, node, spot) of the windows under ``keys`` (key), once for each of the two runs
    at the place: key is a hash of the window's key, the side and the run. Of a text's places
    under such a key in one stretch of ``MIN_SHINGLES`` the first stands for all."""
    members = windows(docs, hashes, combined=False).select("key", "node", "spot", F.col("other").alias("runs")).join(
        keys, "key", "left_semi").distinct()
    sides = F.array(F.struct(F.lit(0).alias("side"), F.shiftrightunsigned("runs", 32).alias("run")),
                    F.struct(F.lit(1).alias("side"), F.col("runs").bitwiseAND(0xFFFFFFFF).alias("run")))
    return (members.select("key", "node", "spot", F.explode(F.filter(sides, lambda x: x["run"] != 0)).alias("x"))
            .groupBy(F.xxhash64("key", "x.side", "x.run").alias("key"), "node",
                     F.floor(F.shiftright("spot", 32) / MIN_SHINGLES)).agg(F.min("spot").alias("spot"))
            .select("key", "node", "spot"))


def _placed(members: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``members`` (key, node, spot) whose key is open, with ``root``, the text's
    class so far, and ``covered``, whether the place lies in a passage. A key of one class
    with all places in passages is closed for good: classes and passages only grow."""
    stars = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    place = F.shiftright("spot", 32)
    state = (members.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left")
             .join(_merged_of(found), "node", "left")
             .select("key", "node", "spot", F.coalesce("root", "node").alias("root"), F.coalesce(
                 F.exists("spans", lambda s: (s["start"] <= place) & (place < s["end"])), F.lit(False)).alias("covered")))
    is_open = state.groupBy("key").agg(
        F.min("node").alias("n0"), F.max("node").alias("n1"), F.min("root").alias("r0"), F.max("root").alias("r1"),
        F.min("covered").alias("covered")).filter((F.col("n0") < F.col("n1")) & ((F.col("r0") < F.col("r1")) | ~F.col("covered")))
    return stored(state.join(is_open.select("key"), "key", "left_semi"), "members-state")


def completed(docs: DataFrame, texts: DataFrame, linked: DataFrame, found: DataFrame, hashes: int) -> DataFrame:
    """``found`` with the passages of pairs that ``linked`` left out, by rounds of hubs in
    composites. A row of a pair in one class with both windows in passages already is not
    needed."""
    keys = stored(linked.filter(F.col("f") == THINNED).select(F.col("a").alias("key")).distinct(), "keys")
    if not keys.limit(1).count():
        return found
    state = _placed(stored(composites(docs, keys, hashes), "members"), found)
    done, most = None, HUBS
    while True:
        now = (state.join(done, "node", "left").withColumn("done", F.coalesce("done", F.lit(False)))
               if done is not None else state.withColumn("done", F.lit(False)))
        sizes = state.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        main = stored(sizes.groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main")), "main")
        # both windows in passages and texts in the main class of a key: never needed, so
        # such a row meets only the others of its key
        now = stored(now.join(main, "key").withColumn("out", (F.col("root") != F.col("main")) | ~F.col("covered"))
                     .drop("main"), "now")
        pending = stored(now.filter("out and not done").select("key", "node", F.xxhash64("node").alias("h")).distinct(),
                         "pending")
        rank = pending.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("h").alias("least"))
        hubs = stored(pending.join(rank, "key").filter(
            (F.col("h") == F.col("least")) | (F.pmod("h", F.col("c")) < most)).select("node").distinct(), "hubs")
        if not hubs.limit(1).count():
            return found
        now = now.join(hubs.withColumn("hub", F.lit(True)), "node", "left")
        left = now.filter("hub").select(
            "key", *[F.col(c).alias(f"h_{c}") for c in ("node", "spot", "root", "covered", "out")])
        both = left.filter("h_out").join(now, "key").unionByName(
            left.filter("not h_out").join(now.filter("out"), "key")).filter(
            ~F.col("done") & (F.col("h_node") != F.col("node"))
            & (F.col("hub").isNull() | (F.col("h_node") < F.col("node")))
            & ((F.col("h_root") != F.col("root")) | ~F.col("h_covered") | ~F.col("covered")))
        swap = F.col("h_node") > F.col("node")
        pairs = both.select(
            F.least("h_node", "node").alias("a"), F.greatest("h_node", "node").alias("b"), F.lit(0).alias("f"),
            F.when(swap, F.col("spot")).otherwise(F.col("h_spot")).alias("a_spot"),
            F.when(swap, F.col("h_spot")).otherwise(F.col("spot")).alias("b_spot"))
        pairs = stored(candidates(pairs, 1), "candidates")
        found = stored(found.unionByName(verified(pairs, _fetched(docs, texts, pairs))).distinct(), "passages")
        hubs = hubs.withColumn("done", F.lit(True))
        done, most = (stored(done.unionByName(hubs), "done") if done is not None else hubs), most * HUBS
        state = _placed(state.select("key", "node", "spot"), found)


def repeated_passages(docs: DataFrame, hashes: int = HASHES, min_hashes: int = MIN_HASHES) -> DataFrame:
    """(doc_id, class_id, n_links, passages) for every row of ``docs`` (doc_id, text):
    the smallest doc_id of its class, the other rows of its class, and the word spans
    that other texts or copies repeat."""
    nodes = stored(text_nodes(docs), "text-nodes")
    texts = nodes.groupBy("node").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("copies"),
                                      F.first("n_words").alias("n_words"))
    texts = stored(texts, "texts")
    linked = stored(window_links(windows(docs, hashes)), "links")
    pairs = stored(candidates(linked.filter(F.col("f") >= 0), min_hashes), "candidates")
    found = stored(verified(pairs, _fetched(docs, texts, pairs)), "passages")
    found = completed(docs, texts, linked, found, hashes)

    spans = _merged_of(found)
    stars = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")))
    named = texts.join(stars.select(F.col("u").alias("node"), F.col("v").alias("root")), "node", "left").withColumn(
        "root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("first_doc").alias("class_id"), F.sum("copies").alias("rows"))
    long_copy = (F.col("copies") > 1) & (F.col("n_words") >= MIN_WORDS)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    known = (named.join(least, "root").join(spans, "node", "left")
             .select("node", F.when(F.col("n_words") >= MIN_WORDS, F.col("class_id")).alias("class_id"),
                     F.when(F.col("n_words") >= MIN_WORDS, F.col("rows") - 1).otherwise(0).alias("n_links"),
                     F.when(long_copy, whole).when(F.col("spans").isNull(), F.array().cast(
                         "array<struct<start:bigint,end:bigint>>")).otherwise(F.col("spans"))
                     .alias("passages")))
    return nodes.join(known, "node").select(
        "doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.col("n_links").cast("long").alias("n_links"),
        "passages")
