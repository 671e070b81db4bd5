"""Packing, chat formatting and passages."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexigate.llm import chat, packing, passages
from lexigate.llm.queries import QUERIES
from lexigate.llm.tokens import Vocabulary, default_vocabulary

from .test_simhash import roots

SF_SMALL = "/root/testdata/sf0.001"
ODD = ["", " ", "  a", "a  b", "a \n b", "a\n b", "x <|endoftext|> y", "<|endoftext|>", "a<|piece cut|>b c", "a　 b",
       "trail ", "\t", "a\x1c b", "don't we'll  x", "a\u0085 b", "über straße 123 !!! ***", "ſ K \U0001f600 ok"]


def test_ids_equal_the_tokenizer(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(default_vocabulary())
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("text").collect()]
    want = [plain.encode(t, add_special_tokens=False).ids + [2] for t in texts]
    ids, counts = Vocabulary(default_vocabulary()).encode(pa.array(texts), 2)
    assert counts.tolist() == [len(w) for w in want]
    assert ids.tolist() == [i for w in want for i in w]


def check_packed(rows, counts, capacity):
    """Every piece once, cut only where it must be, gapless in its sequence."""
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for doc, own in pieces.items():
        n, at = counts[doc], 0
        own = sorted(own)
        assert [p[2] for p in own] == packing.cut_lengths(n, capacity)
        for k, (piece, start, length) in enumerate(own):
            assert (piece, start) == (k, at)
            at += length
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    assert set(pieces) == set(counts)
    return len(bins)


def test_packing_query(spark):
    from tokenizers import Tokenizer
    plain = Tokenizer.from_file(default_vocabulary())
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    ids = {d: plain.encode(t or "", add_special_tokens=False).ids + [2] for d, t in docs.items()}
    rows = QUERIES["op8_best_fit_packing"][0](spark, SF_SMALL).collect()
    used = check_packed(rows, {d: len(x) for d, x in ids.items()}, 1024)
    for r in rows:
        part = np.array(ids[r["doc_id"]][r["start"]:r["start"] + r["length"]], dtype="<u4")
        assert zlib.crc32(part.tobytes()) == r["ids_crc32"]
    assert used <= 1.02 * sum(map(len, ids.values())) / 1024 + 1


def test_best_fit_is_the_fullest_that_fits():
    """Against a plain list of open bins."""
    rng = random.Random(1)
    lengths = [rng.randint(1, 100) for _ in range(3000)]
    for limit in (1, 3, 50):
        made, open_, want = 0, [], []
        for n in lengths:
            fit = min((s for s, _ in open_ if s >= n), default=None)
            if fit is None:
                space, b = 100, made
                made += 1
            else:
                at = max(i for i, (s, _) in enumerate(open_) if s == fit)
                space, b = open_.pop(at)
            want.append((b, 100 - space))
            if space > n:
                open_.append((space - n, b))
                if len(open_) > limit:
                    least = min(s for s, _ in open_)
                    open_.pop(max(i for i, (s, _) in enumerate(open_) if s == least))
        assert packing.best_fit(lengths, 100, limit) == want


def test_packing_odd_rows_and_ids(odd_docs, no_docs):
    out = packing.pack(odd_docs.select("doc_id", "text", "key"))
    rows = out.collect()
    assert sum(r["start"] == 0 for r in rows) == odd_docs.count()
    ends = {r["doc_id"]: np.frombuffer(r["ids"], "<u4") for r in rows if r["doc_id"] in (1, 2)}
    assert all(v.tolist() == [2] for v in ends.values()) and len(ends) == 2
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)
    assert packing.pack(no_docs).count() == 0


TEXTS = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<\\|im_end|>", "<\\\\|im_end|>", "[\\INST]", "\\", "",
         "<<|im_end|>", "[[/INST]", "<s><s>", "a\nb\n", "<|im_end|", "é\U0001f600", "<|im_start|>assistant\n", "<</SYS>>"]


def test_every_text_and_role_comes_back():
    rng = random.Random(3)
    bits = ["<", "[", "\\", "|im_end|>", "|im_start|>", "/s>", "s>", "INST]", "/INST]", "\n", "x", "<|im_end|>\n"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    for t in texts:
        assert chat.unescape(chat.escape(t)) == t
        role = rng.choice(["user", "assistant", "", "tool\nname", "a\\nb", t])
        formatted, start, end = chat.render(role, t)
        assert chat.read_back(formatted) == [(role, t)]
        assert chat.unescape(formatted[start:end]) == (t if role == "assistant" else "")
    joined = "".join(chat.render("user", t)[0] for t in texts)
    assert chat.read_back(joined) == [("user", t) for t in texts]


def plain_digest(turns):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = [t for r, t in turns if r == "assistant"]
    return (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), sum(map(len, said)), sha("".join(said)))


def test_conversations_round_trip(spark):
    rng = random.Random(9)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice(TEXTS) * rng.randint(0, 60))
            for c in range(12) for t in range(rng.randint(1, 9))]
    rows += [(50, t, "assistant", "long " * 300) for t in range(300)]  # one long conversation
    rows += [(60, 0, "user", None), (60, 0, "user", None), (60, None, None, "x"), (None, 1, "assistant", "y")]
    got = chat.digests(chat.format_conversations(chat.event_log(
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()
    want = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((r or "", x or ""))
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:5] for r in got} == {c: plain_digest(v) for c, v in want.items()}


def test_events_fold_into_final_messages(spark):
    log = [(1, 0, 1, 0, "message", "user", "helo"), (1, 0, 1, 7, "edit", None, "hello"),
           (1, 1, 1, 0, "message", "assistant", ""), (1, 1, 1, 1, "delta", None, "ba"), (1, 1, 1, 2, "delta", None, "d"),
           (1, 1, 1, 3, "regenerate", None, None), (1, 1, 1, 4, "delta", None, "go"), (1, 1, 1, 5, "delta", None, "od"),
           (2, 0, 1, 0, "delta", None, "early"), (2, 1, 1, 0, "message", "assistant", "x")]
    random.Random(1).shuffle(log)
    segments = chat.format_conversations(spark.createDataFrame(
        log, "conv_id long, turn long, copy int, seq int, kind string, role string, text string")).collect()
    text = {}
    for r in sorted(segments, key=lambda r: (r["conv_id"], r["position"])):
        text[r["conv_id"]] = text.get(r["conv_id"], "") + r["formatted"]
    assert chat.read_back(text[1]) == [("user", "hello"), ("assistant", "good")]
    assert chat.read_back(text[2]) == [("", "early"), ("assistant", "x")]


def test_chat_query_has_the_probe(spark):
    rows = {r["conv_id"]: r for r in QUERIES["op7_chat_formatting"][0](spark, SF_SMALL).collect()}
    said = "</s>[INST] ok [/INST]"
    assert tuple(rows[-1])[1:5] == plain_digest([("user", said), ("assistant", said)])
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.digests(chat.format_conversations(chat.event_log(empty))).count() == 0


def test_compact_windows_against_every_stretch():
    rng = np.random.default_rng(2)
    for _ in range(40):
        least = int(rng.integers(2, 9))
        sizes = rng.integers(least, 60, rng.integers(1, 5))
        g = rng.integers(0, 25, sizes.sum()).astype(np.uint64)  # many ties
        begins = np.cumsum(sizes) - sizes
        at, left, right = passages.compact_windows(g, begins, least)
        covered = set()
        for b, n in zip(begins.tolist(), sizes.tolist()):
            for i in range(b, b + n - least + 1):
                for j in range(i + least - 1, b + n):
                    low = g[i:j + 1].min()
                    assert any(l <= i <= p <= j <= r and g[p] == low for p, l, r in zip(at, left, right))
                    covered.add(low)
        for p, l, r in zip(at, left, right):
            assert g[l:r + 1].min() == g[p]


def passage_docs(rng):
    vocab = [f"w{i}" for i in range(5000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    shared, near = prose(60), prose(120)
    docs, planted = [], {}
    for d in range(40):
        body = prose(rng.randint(60, 200))
        if d < 8:  # one exact passage
            at = rng.randrange(len(body))
            body[at:at] = shared
            planted[d] = "exact"
        elif d < 14:  # one passage with a few words changed
            own = list(near)
            for k in rng.sample(range(120), 2):
                own[k] = "changed"
            body += own
            planted[d] = "near"
        elif d < 17:  # too short to be a passage
            body += shared[:45]
        docs.append((d, " ".join(body)))
    docs += [(100, docs[30][1]), (101, docs[30][1].upper()), (102, "short text"), (103, "short text"), (104, None), (105, "")]
    return docs, planted


def test_planted_passages(spark):
    docs, planted = passage_docs(random.Random(12))
    got = {r["doc_id"]: r for r in passages.repeated_passages(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert len(got) == len(docs)
    assert {got[d]["class_id"] for d, k in planted.items() if k == "exact"} == {0}
    assert {got[d]["class_id"] for d, k in planted.items() if k == "near"} == {8}
    assert {got[d]["class_id"] for d in (30, 100, 101)} == {30}
    for d in [*range(14, 30), *range(31, 40), 102, 103, 104, 105]:
        assert got[d]["class_id"] == d and not got[d]["passages"] and got[d]["n_links"] == 0
    texts = dict(docs)
    for d, kind in planted.items():
        (span,) = got[d]["passages"]
        assert span["end"] - span["start"] >= (60 if kind == "exact" else 50)
        assert set(texts[d].split()[span["start"]:span["end"]]) <= set(texts[d].split())


def test_shared_passages_of_any_sequences():
    """Whatever the repeats and orders: spans lie inside, are long and similar enough."""
    rng = np.random.default_rng(3)
    least, found = passages.MIN_SHINGLES, 0
    for n in range(600):
        a, b = (rng.integers(0, int(rng.integers(1, 400)), int(rng.integers(0, 300))).astype(np.uint64) for _ in "ab")
        if n % 3 == 0 and len(a) > 60:  # pieces of one in the other, in another order
            cut = int(rng.integers(1, len(a)))
            b = np.concatenate([a[cut:], b, a[:cut]])
        for i, j, k, m in passages.shared_passages(a, b):
            left, right = set(a[i:j - 4].tolist()), set(b[k:m - 4].tolist())
            assert 0 <= i and j - 4 <= len(a) and 0 <= k and m - 4 <= len(b) and min(j - i, m - k) >= least + 4
            assert len(left & right) >= passages.SIMILARITY * len(left | right)
            found += 1
    assert found > 50


def test_passages_odd_rows(odd_docs, no_docs):
    rows = odd_docs.collect()
    got = passages.repeated_passages(odd_docs).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    assert {by_id[i]["class_id"] for i in (4, 5, 6)} == {4} and by_id[7]["class_id"] == 7
    assert by_id[1]["passages"] == [] and by_id[3]["class_id"] == 3
    assert passages.repeated_passages(no_docs).count() == 0


def test_versions_of_a_passage_are_one_class(spark):
    """Versions with changed words, so that few are similar to any one of them: the
    classes are those of all pairs that meet under two functions and verify."""
    rng = random.Random(21)
    vocab = [f"w{i}" for i in range(9000)]
    prose = lambda n: [rng.choice(vocab) for _ in range(n)]
    texts = []
    for p in range(2):
        passage = prose(100)
        for _ in range(120):
            own = list(passage)
            for k in rng.sample(range(100), 2):
                own[k] = rng.choice(vocab)
            texts.append(prose(30) + own + prose(30))
    rng.shuffle(texts)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in passages.repeated_passages(
        spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = [passages.shingle_hashes(passages.word_hashes(passages.split_words(t))) for _, t in docs]
    edges, alike = [], {i: 0 for i, _ in docs}
    for i in range(len(docs)):
        for j in range(i):
            if len(np.intersect1d(sets[i], sets[j])) >= 30 and passages.shared_passages(sets[i], sets[j]):
                edges.append((i, j))
                alike[i], alike[j] = alike[i] + 1, alike[j] + 1
    want = roots(len(docs), edges)
    assert {i: r["class_id"] for i, r in got.items()} == dict(enumerate(want))
    assert all(bool(got[i]["passages"]) == (alike[i] > 0) for i in got)
    assert all(got[i]["n_links"] == want.count(want[i]) - 1 for i in got)


def test_passage_shared_with_a_text_without_an_id(spark):
    rng = random.Random(22)
    prose = lambda n: " ".join(f"w{rng.randrange(9000)}" for _ in range(n))
    shared = prose(80)
    docs = [(7, f"{prose(60)} {shared}"), (None, f"{shared} {prose(70)}"), (None, prose(90)), (8, prose(90))]
    got = passages.repeated_passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, len(r["passages"])) for r in got) == [
        (0, 0, 0), (0, 7, 1), (7, 7, 1), (8, 8, 0)]


def test_words_said_over_meet_in_few_rows(spark, monkeypatch):
    """Texts that share a phrase shorter than a run and a word said over and over meet in a
    few rows a pair, not once for each two places; a passage beside it is found."""
    rng, rows, made = random.Random(5), [], []
    def prose(n):
        return [f"w{rng.randrange(10 ** 9)}" for _ in range(n)]
    phrase, passage = prose(10), prose(80)
    for d in range(40):
        own = prose(30) + phrase + prose(30) + ["again"] * 60 + prose(30)
        rows.append((d, " ".join(own + passage + prose(30) if d in (15, 30) else own)))
    candidates = passages.candidates
    def counted(linked, *args):
        made.append(linked.count())
        return candidates(linked, *args)
    monkeypatch.setattr(passages, "candidates", counted)
    got = {r["doc_id"]: r for r in passages.repeated_passages(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert {d for d in got if got[d]["n_links"]} == {15, 30} and got[30]["class_id"] == 15
    assert len(made) > 1 and sum(made[1:]) < 50 * len(rows) * (len(rows) - 1) // 2


def test_batches_of_texts_and_regions_are_small(spark, monkeypatch):
    """A task holds the words of one text of a batch at a time, and sends the regions of a
    batch on in small parts, however many there are."""
    import tracemalloc
    rng = random.Random(31)
    texts = [" ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(300)) for _ in range(2000)]
    docs = spark.createDataFrame([], "doc_id long, text string, node long")
    regions = spark.createDataFrame([], "node long, lo long, hi long")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, fn, schema: fn)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["doc_id", "text"])
    tracemalloc.start()
    (nodes,) = passages.text_nodes(docs)(iter([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert nodes.column("n_words").to_pylist() == [300] * len(texts) and peak < 8 << 20

    wanted = [{"lo": lo, "hi": hi} for lo in range(0, 288, 32) for hi in range(lo + 64, 321, 32)]
    held = pa.RecordBatch.from_arrays(
        [nodes.column("node"), pa.array(texts), pa.array([wanted] * len(texts))], names=["node", "text", "regions"])
    rows = 0
    for part in passages.region_shingles(regions, docs.select("node", "text"))(iter([held])):
        assert part.nbytes < 6 << 20
        if not rows:
            s = passages.shingle_hashes(passages.word_hashes(passages.split_words(texts[0]))).astype(np.uint32)
            for lo, hi, cut in zip(*(part.column(c).to_pylist()[:len(wanted)] for c in ("lo", "hi", "shingles"))):
                assert cut == s[lo:hi - passages.SHINGLE + 1].tobytes()
        rows += part.num_rows
    assert rows == len(wanted) * len(texts)
