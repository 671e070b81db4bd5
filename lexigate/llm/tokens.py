"""Token ids of whole texts, a batch at a time.

The vocabulary file is a byte-level BPE in ``tokenizers`` JSON form; its path is a
parameter. Ids equal ``Tokenizer.encode(text, add_special_tokens=False)`` (tests
compare them). The merges are in id order, so the same vocabulary runs as ranks in
the faster encoder. A white-space run always starts a pre-token, so a text may be
cut before each space that follows a non-space character and every distinct piece of
a batch is encoded once; ids are then gathered for all occurrences in numpy. Texts
with a space after other white space are encoded whole.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 16 << 20  # text encoded at once; bounds memory, changes no id
_TANGLED = r"[\s\x{85}\x{1c}-\x{1f}\p{Z}] "


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write bytes as printable characters: those that print
    stand for themselves, the others follow from code point 256 in byte order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    """Encoder for one vocabulary file; made once per task."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        to_byte = _byte_of_char()
        ranks = {bytes(to_byte[c] for c in token): i
                 for token, i in spec["model"]["vocab"].items() if token not in special}
        self.cut_id = max([*ranks.values(), *special.values()]) + 1
        self.cut, self.special = "<|piece cut|>", set(special)
        self.encoding = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN,
                                          mergeable_ranks=ranks, special_tokens=special | {self.cut: self.cut_id})

    def _each(self, texts: pa.Array, before: str = "") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each with ``before`` in front, and the number of
        each. One call encodes them all, joined by a special string of our own."""
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        clash = pc.match_substring(texts, self.cut)
        follow = self.cut + before
        ended = pc.binary_join_element_wise(pc.if_else(clash, "", texts).cast(pa.large_string()),
                                            *(pa.scalar(x, pa.large_string()) for x in ("", follow)))
        joined = before + ended.buffers()[2].to_pybytes().decode()[:-len(follow)]
        ids = np.asarray(self.encoding.encode_to_numpy(
            joined, allowed_special=self.special | {self.cut}, disallowed_special=()), dtype=np.uint32)
        ends = np.append(np.flatnonzero(ids == self.cut_id), len(ids))
        sizes = np.diff(ends, prepend=-1) - 1
        ids = ids[ids != self.cut_id]
        odd = np.flatnonzero(clash.to_numpy(zero_copy_only=False)).tolist()
        if odd:
            parts = np.split(ids, np.cumsum(sizes)[:-1])
            for i in odd:
                parts[i] = np.array(self.encoding.encode(
                    before + texts[i].as_py(), allowed_special=self.special, disallowed_special=()),
                    dtype=np.uint32)
            ids, sizes = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, sizes

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids per text); each text's ids are
        followed by ``end_id``. No text may be null."""
        texts = texts.cast(pa.large_string())
        if len(texts) == 0:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        tangled = pc.match_substring_regex(texts, _TANGLED)
        split = pc.split_pattern(pc.if_else(tangled, "", texts), " ")
        starts = split.offsets.to_numpy()
        starts, total = starts[:-1] - starts[0], int(starts[-1] - starts[0])
        flat = split.flatten()
        first = np.zeros(total, dtype=bool)
        first[starts] = True
        rest = flat.filter(pa.array(~first)).dictionary_encode()
        leads = pc.if_else(tangled, texts, flat.filter(pa.array(first)))
        inner, outer = self._each(rest.dictionary, " "), self._each(leads)
        ids, sizes = np.append(inner[0], outer[0]), np.append(inner[1], outer[1])
        codes = np.empty(total, dtype=np.int64)
        codes[~first] = rest.indices.to_numpy()
        codes[first] = len(rest.dictionary) + np.arange(len(texts))
        ids, sizes = np.append(ids, np.uint32(end_id)), np.append(sizes, 1)
        stops = np.append(starts[1:], total)
        codes = np.insert(codes, stops, len(sizes) - 1)
        begins = (np.cumsum(sizes) - sizes)[codes]
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        gathered = ids[np.repeat(begins - (ends - lengths), lengths) + np.arange(ends[-1])]
        last = ends[stops + np.arange(len(stops))]
        return gathered, np.diff(last, prepend=0)


def slices(texts: pa.Array, limit: int = SLICE_BYTES):
    """(from, to) ranges of about ``limit`` bytes of text; a longer text is alone."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, used = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and used + n > limit:
            yield start, i
            start, used = i, 0
        used += n
    if start < len(sizes):
        yield start, len(sizes)
