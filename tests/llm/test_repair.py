"""Conversation repair against a plain shortest-path search over (cost, audit)."""

import hashlib
import heapq
import random
import re
import zlib

from pyspark.sql import functions as F

from lexigate.llm import repair
from lexigate.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
FITS = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}


def cheapest(rows):
    """(cost, audit, messages) of rows (role, text, fault): uniform-cost search."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, out = heapq.heappop(heap)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, list(out)
        if (i, last) in done:
            continue
        done.add((i, last))
        turn = "a" if last == "u" else "u"
        named = {"u": "user", "a": "assistant"}[turn]
        heapq.heappush(heap, (cost + 5, audit + "I", i, turn, (*out, f"{named}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, last, out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if (role[:1], last) in FITS:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, FITS[role[:1], last], (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 1 + more, audit + "R", i + 1, turn, (*out, f"{named}:{text}")))


def expected(rows):
    """The contract of the query over (conv_id, turn, role, text)."""
    def key(v):
        return " " if v is None else v

    result = {}
    for conv in {r[0] for r in rows}:
        after = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{key(conv)}:{key(turn)}".encode()) % 20
            role, text = "user" if kind == 4 else key(role), key(text)
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            after += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        after.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        seen, faulty = set(), []
        for _, role, text in after:
            bare = text.strip(" \t\n\x0b\x0c\r")
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen
                     else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = {t for t, _, _ in after if t is not None}
        initials = [r[:1] for _, r, _ in after]
        cost, audit, out = cheapest(faulty)
        count = [sum(f == k for _, _, f in faulty) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        result[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *count, illegal, cost, audit,
                        hashlib.sha256("\n".join(out).encode()).hexdigest())
    return result


def found(df):
    return {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}


def run_on(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    return QUERIES["op12_conversation_repair"][0](spark, str(tmp_path))


def test_integers_against_search():
    rng = random.Random(3)
    kinds = ["", "blank", "duplicate", "truncated"]
    for _ in range(1500):
        rows = [(rng.choice("suax"), "", rng.choice([*kinds, "", ""])) for _ in range(rng.randint(0, 7))]
        codes = "".join(repair.CODES["suax".index(r) * 4 + kinds.index(f)] for r, _, f in rows)
        want = cheapest(rows)[:2]
        for size in {1, 2, max(len(codes), 1)}:  # blocks of every cut give the same
            fold = repair.Fold()
            for i in reversed(range(0, len(codes), size)):
                fold.put(codes[i:i + size])
            assert fold.result() == want


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"][0](spark, SF)) == expected(rows)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(8)
    texts = ["Yes.", "No", "", " \t\n", None, "Why? ", "x" * 300_000 + ".", "Ünïcödé 你好!", "a "]
    rows = [(c, rng.choice([None, *range(9), 40]), rng.choice(["system", "user", "assistant", None, "", "tool", "User"]),
             rng.choice(texts)) for c in range(60) for _ in range(rng.randint(1, 5))]
    rows = list({(r[0], r[1]): r for r in rows}.values())  # ties have a test of their own
    rows += [(None, 0, "user", "Hm."), (None, 1, "assistant", "Ha"), (99, None, None, None)]
    rows += [(c, 0, "user", "One row.") for c in range(100, 140)]  # some conversations lose all
    assert found(run_on(spark, rows, tmp_path)) == expected(rows)


def test_ties_and_repeated_rows(spark, tmp_path):
    rows = [(1, 0, "user", "Same."), (1, 0, "user", "Same."), (1, 0, "user", "Same."),
            (2, 3, "assistant", "B."), (2, 3, "user", "A."), (2, 3, "system", "C.")] * 2
    got = found(run_on(spark, rows, tmp_path))
    assert got == found(run_on(spark, rows[::-1], tmp_path / "again"))
    assert got[1] == expected(rows)[1]


def test_long_conversation_is_cut_into_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(repair, "BLOCK", 16)
    rng = random.Random(1)
    rows = [(5, t, rng.choice(["user", "assistant"]), rng.choice(["Same.", f"Row {t}.", "cut"])) for t in range(400)]
    blocks = repair.placed_rows(spark.createDataFrame(rows, SCHEMA))
    assert blocks.select(F.floor(F.col("place") / 16)).distinct().count() >= 25
    assert found(run_on(spark, rows, tmp_path)) == expected(rows)


def test_messages_and_extra_columns(spark):
    rows = spark.createDataFrame([(1, 0, "assistant", "Hello.", "x"), (1, 1, "user", "Hi", "y")],
                                 SCHEMA + ", copy string")
    table, messages = repair.repair(rows)
    got = [tuple(r)[2:] for r in messages.collect()]
    cost, audit, want = cheapest([("assistant", "Hello.", ""), ("user", "Hi", "truncated")])
    assert (cost, audit) == tuple(table.select("cost", "audit").first())
    assert [f"{role}:{text}" for _, role, text in got] == want


def test_empty_table(spark, tmp_path):
    assert run_on(spark, [], tmp_path).collect() == []
