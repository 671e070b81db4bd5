"""Conversation structure repair by an integer-minimum DAG dynamic programme.

The least costly edits (Keep 0, Rerole 1, Delete 2, Insert 5; a truncated row that stays
costs 5 more; blank and repeated rows must go) turn the role initials of a conversation
into ``(s?(ua)+)?``. Ties go to the audit (the edits' initials in order) that is least in
ASCII. One integer carries both: the high digits are the cost, the low ones the audit as
base-8 digits (D < I < K < R as 1 to 4) from the left of a fixed width, zeros at the end;
so the ordinary minimum of integers decides everything. Edits are put in front of what
follows them, which moves the audit one digit to the right: the programme runs backwards
over rows and four states (nothing yet, after system, after user, after assistant).

Long conversations are not one task's work: narrow rows (hashes, no texts) are range
partitioned in reading order and cut into blocks of ``BLOCK`` rows; a block becomes a
matrix of integers from entry to exit state, and a conversation's few matrices are folded
from the last to the first. At most two inserts stand before a row: three or more could
lose two and keep the state. Equal-cost ways through a block between the same states are
never a prefix of each other (a longer one has inserts more), so the fold's minimum is
that of whole audits. Texts move once, to be written in order next to the audit.

Defined cases: rows are read by turn, nulls first; rows of one turn by role and by a
hash of the text; null role or text is one space; a role counts by its first code point;
a null conv_id is a conversation of its own; a conversation without rows has cost 0, an
empty audit and no messages; texts of any length are hashed, never cut; repeated rows are
faults by the rule above; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexigate.llm.common import stored

BLOCK = 1 << 10
CODES = "abcdefghijklmnop"  # initial (s, u, a, other) times fault (none, blank, duplicate, truncated)
INITIALS = "sua"
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NEXT_TURN = (USER, USER, ASSISTANT, USER)  # state after a user or assistant turn that fits
FITS = {("s", EMPTY): SYSTEM, ("u", EMPTY): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
LETTERS = "DIKR"
DIGIT = 3  # bits
KEEP_COST, REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 1, 2, 5, 5
_NOT_SPACE = r"[^\x20\x09-\x0D]"


# --- integers -----------------------------------------------------------------------

def _edge(letter: str, cost: int, width: int) -> int:
    """What an edit in front adds to the weight of what follows, moved by one digit."""
    return (cost << DIGIT * width) + ((LETTERS.index(letter) + 1) << DIGIT * (width - 1))


def _least(values: list[int | None]) -> int | None:
    return min((v for v in values if v is not None), default=None)


@lru_cache(maxsize=1 << 15)
def block_weights(codes: str) -> tuple[tuple[int | None, ...], ...]:
    """[exit][entry]: least weight of taking a block's rows from entry to exit state, with
    an audit of width 3 * rows. None: no way."""
    width = 3 * len(codes)
    low = (1 << DIGIT * width) - 1
    insert, delete = _edge("I", INSERT_COST, width), _edge("D", DELETE_COST, width)
    stay = {f: (_edge("K", KEEP_COST + extra, width), _edge("R", REROLE_COST + extra, width))
            for f, extra in ((NONE, 0), (TRUNCATED, TRUNCATED_COST))}

    def front(edge: int, value: int | None) -> int | None:
        return None if value is None else value - (value & low) + ((value & low) >> DIGIT) + edge

    out = []
    for exit_ in range(4):
        after: list[int | None] = [0 if s == exit_ else None for s in range(4)]
        for code in reversed(codes):
            initial, fault = divmod(CODES.index(code), 4)
            before = []
            for state in range(4):
                ways = [front(delete, after[state])]
                if fault in stay:
                    keep, rerole = stay[fault]
                    to = FITS.get(("suax"[initial], state))
                    if to is not None:
                        ways.append(front(keep, after[to]))
                    ways.append(front(rerole, after[NEXT_TURN[state]]))
                before.append(_least(ways))
            once = [front(insert, before[NEXT_TURN[s]]) for s in range(4)]
            twice = [front(insert, once[NEXT_TURN[s]]) for s in range(4)]
            after = [_least([before[s], once[s], twice[s]]) for s in range(4)]
        out.append(tuple(after))
    return tuple(out)


class Fold:
    """Weights from each state to the end of a conversation; blocks are put in front."""

    def __init__(self) -> None:
        self.width = 2
        turn = _edge("I", INSERT_COST, 2)
        self.weights: list[int] = [0, turn + (turn >> DIGIT) % (1 << DIGIT * 2) + (INSERT_COST << DIGIT * 2), turn, 0]

    def put(self, codes: str) -> None:
        block, own = block_weights(codes), 3 * len(codes)
        low, low_block = (1 << DIGIT * self.width) - 1, (1 << DIGIT * own) - 1
        width = own + self.width

        def joined(head: int | None, tail: int) -> int | None:
            if head is None:
                return None
            letters = head & low_block
            padding = ((letters & -letters).bit_length() - 1) // DIGIT if letters else own
            cost = (head >> DIGIT * own) + (tail >> DIGIT * self.width)
            return (cost << DIGIT * width) + (letters << DIGIT * self.width) + ((tail & low) << DIGIT * padding)

        self.weights = [_least([joined(block[t][s], self.weights[t]) for t in range(4)]) for s in range(4)]
        self.width = width

    def result(self) -> tuple[int, str]:
        """(cost, audit) of the whole conversation."""
        value = self.weights[EMPTY]
        digits = oct((1 << DIGIT * self.width) + (value & (1 << DIGIT * self.width) - 1))[3:]
        return value >> DIGIT * self.width, digits.rstrip("0").translate(str.maketrans("1234", LETTERS))


# --- rows ---------------------------------------------------------------------------

def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) with planted faults, by the crc32 of
    ``conv_id:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes out its
    sentence ends, 3 repeats it, 4 makes it a user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), space))
    kind = F.crc32(key.cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                                F.coalesce("text", space).alias("text"), kind.alias("kind")).filter("kind <> 0")
    return rows.select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"),
    ).drop("copy")


def _narrow(rows: DataFrame) -> DataFrame:
    """Rows without their texts: two hashes, whether blank, whether it ends in the air."""
    space = F.lit(" ")
    text = F.coalesce("text", space)
    return rows.select(
        "conv_id", F.col("turn").isNotNull().alias("has_turn"), "turn", F.coalesce("role", space).alias("role"),
        F.xxhash64(text).alias("h1"), F.xxhash64(F.lit("repair"), text).alias("h2"),
        (~text.rlike(_NOT_SPACE)).alias("blank"),
        (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))


READING = ["has_turn", "turn", "role", "h1", "h2"]


def placed_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, place, code): every row with its place in reading order and its
    initial and first fault as a code. Equal rows are counted before they are compared
    with the first of their kind, so a hot conversation or text is spread over tasks."""
    counted = stored(_narrow(rows).groupBy("conv_id", *READING, "blank", "open")
                     .agg(F.count(F.lit(1)).alias("n")), "repair-rows")
    first = (counted.groupBy(F.col("conv_id").alias("f_conv"), F.col("role").alias("f_role"),
                             F.col("h1").alias("f1"), F.col("h2").alias("f2"))
             .agg(F.min(F.struct("has_turn", "turn")).alias("first")))
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role"))
                          & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2")))
    later = ~((F.col("has_turn") == F.col("first.has_turn")) & F.col("turn").eqNullSafe(F.col("first.turn")))
    copies = joined.select("*", later.alias("later"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("copy"))
    fault = (F.when(F.col("blank"), BLANK).when(F.col("later") | (F.col("copy") > 1), DUPLICATE)
             .when(F.col("open"), TRUNCATED).otherwise(NONE))
    initial = F.substring("role", 1, 1)
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    order = ["conv_id", *READING, "copy"]
    return stored(copies.select(*order, F.substring(F.lit(CODES), kind * 4 + fault + 1, F.lit(1)).alias("code"))
                  .repartitionByRange(*order).sortWithinPartitions(*order)
                  .select("conv_id", "turn", "code", F.monotonically_increasing_id().alias("place")), "repair-places")


def _type(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def plan(placed: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, illegal) of every conversation that has rows."""
    blocks = (placed.groupBy("conv_id", F.floor(F.col("place") / BLOCK).alias("block"))
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "code"))),
                                            lambda x: x["code"]), "").alias("codes")))
    dealt = blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv, illegal, head = None, None, 0, ""

        def closed() -> tuple:
            cost, audit = fold.result()
            return conv, cost, audit, illegal

        def sent(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                              names=["conv_id", "cost", "audit", "illegal"])

        kind = None
        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            for own, codes in zip(batch.column("conv_id").to_pylist(), batch.column("codes").to_pylist()):
                if fold is None or own != conv:
                    if fold is not None:
                        done.append(closed())
                    fold, conv, illegal, head = Fold(), own, 0, ""
                fold.put(codes)
                pairs = "".join("suax"[CODES.index(c) // 4] for c in codes) + head
                illegal += sum(pairs[i:i + 2] not in ("su", "ua", "au") for i in range(len(pairs) - 1))
                head = pairs[0]
            yield sent(done, kind)
        if fold is not None:
            yield sent([closed()], kind)

    return dealt.select("conv_id", "codes").mapInArrow(
        run, f"conv_id {_type(placed)}, cost long, audit string, illegal long")


def faults(placed: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation that has rows."""
    fault = (F.instr(F.lit(CODES), F.col("code")) - 1) % 4

    def count(kind: int, name: str) -> Column:
        return F.sum((fault == kind).cast("long")).alias(name)

    spread = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    return placed.groupBy("conv_id").agg(
        F.coalesce(spread, F.lit(0)).cast("long").alias("gaps"),
        count(BLANK, "blank"), count(DUPLICATE, "duplicate"), count(TRUNCATED, "truncated"))


def messages(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Repaired messages (conv_id, position, edit, role, text), in order and with a
    conversation's messages next to each other. Memory holds one audit and one row."""
    space = F.lit(" ")
    text, none = F.coalesce("text", space), F.lit(None)
    own = rows.select("conv_id", F.lit(1).alias("kind"), F.col("turn").isNotNull().alias("has_turn"), "turn",
                      F.coalesce("role", space).alias("role"), F.xxhash64(text).alias("h1"),
                      F.xxhash64(F.lit("repair"), text).alias("h2"), text.alias("text"))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), none.cast("boolean").alias("has_turn"),
                         none.cast(rows.schema["turn"].dataType).alias("turn"), none.cast("string").alias("role"),
                         none.cast("long").alias("h1"), none.cast("long").alias("h2"), F.col("audit").alias("text"))
    dealt = own.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *READING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, position, kind = None, "", 0, EMPTY, 0, None

        def inserted(out: list[tuple]) -> None:
            nonlocal at, state, position
            while at < len(audit) and audit[at] == "I":
                state = NEXT_TURN[state]
                out.append((conv, position, "I", "user" if state == USER else "assistant", ""))
                at, position = at + 1, position + 1

        def sent(rows_: list[tuple]) -> pa.RecordBatch:
            types = (kind, pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate(types)],
                                              names=["conv_id", "position", "edit", "role", "text"])

        for batch in batches:
            kind, out = batch.column("conv_id").type, []
            ids, kinds = batch.column("conv_id").to_pylist(), batch.column("kind").to_pylist()
            for own_conv, own_kind, role, cell in zip(ids, kinds, batch.column("role").to_pylist(), batch.column("text")):
                if own_kind == 0:
                    inserted(out)  # what is left of the conversation before
                    conv, audit, at, state, position = own_conv, cell.as_py(), 0, EMPTY, 0
                    continue
                inserted(out)
                edit, at = audit[at], at + 1
                if edit == "D":
                    continue
                if edit == "R":
                    state = NEXT_TURN[state]
                    role = "user" if state == USER else "assistant"
                else:
                    state = FITS[(role[0], state)]
                out.append((conv, position, edit, role, cell.as_py()))
                position += 1
            yield sent(out)
        out = []
        inserted(out)
        if out:
            yield sent(out)

    return dealt.select("conv_id", "kind", "role", "text").mapInArrow(
        run, f"conv_id {_type(rows)}, position long, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``messages``, which must not be shuffled in between;
    the hash runs along them. Conversations without a message have no row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed, kind = None, None, None

        def sent(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())],
                names=["conv_id", "repaired_sha256"])

        for batch in batches:
            kind, done = batch.column("conv_id").type, []
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "position", "role", "text")]
            for own, position, role, text in zip(*columns):
                if position == 0:
                    if hashed is not None:
                        done.append((conv, hashed.hexdigest()))
                    conv, hashed = own, hashlib.sha256()
                hashed.update(f"{chr(10) if position else ''}{role}:{text}".encode("utf-8", "surrogatepass"))
            yield sent(done)
        if hashed is not None:
            yield sent([(conv, hashed.hexdigest())])

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(
        run, f"conv_id {_type(repaired)}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per conversation (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit),
    and the repaired ``messages``."""
    placed = placed_rows(rows)
    plans = stored(plan(placed), "repair-plans")
    found = faults(placed)
    same = F.col("conv_id").eqNullSafe(F.col("f_conv"))
    table = plans.join(found.withColumnRenamed("conv_id", "f_conv"), same).drop("f_conv")
    return table, messages(rows, plans)
