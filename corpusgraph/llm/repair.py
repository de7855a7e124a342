r"""Conversation structure repair: the cheapest edits that give each conversation the turns `(s?(ua)+)?`, by parallel Viterbi.

Edits: Keep (0), Rerole to user or assistant (2), Delete (3), Insert an empty user or assistant turn (2); a truncated turn that stays
adds 1, blank and duplicate turns must go. A conversation's turns are stages, the roles seen so far have four states
(nothing, system, user, assistant), and backward[i][q] is the least cost of the rest from turn i in state q.

1. Order. Rows are sorted by ranges of (conversation, turn, ...) and numbered, so a conversation of any length lies over as
   many partitions as it needs; texts stay in that table, what follows moves a few bytes for each row.
2. Chunks of CHUNK rows run backward on their own from a speculative cost vector, that of a conversation's end. Costs matter only
   up to a constant, and then few vectors exist: what a stage does to one is worked out once a task and looked up.
3. Fix-up passes. A chunk whose vector isn't its right neighbour's runs again until both of its runs differ by a constant only;
   from there on nothing changes. Mostly one pass does. Each further pass runs groups of WIDER times as many chunks
   in sequence, so that rows that never forget their start (a run of one role) end after a logarithm of passes, too.
4. Stitched costs say at every turn which edit keeps the least cost from each state. The rows of a conversation then stream through one
   task in order (as their text, which is one result, must), and the state picks the edits: of equal costs always the
   smallest letter, which gives the ASCII-least audit, since every cheapest rest ends at cost 0.

A fault is the first of blank (no `[^\x20\x09-\x0D]`), duplicate (role and text stood earlier in the conversation), truncated (last such
character is not one of `.!?`). Repeats are found by the least row number of each (conversation, role, digest of text).

Defined cases: rows without a conversation id are one conversation; a null text, role, or (in the damage key) id or turn is
one space; turns sort nulls first, equal turns by role, then text; equal rows are spread over tasks by their place in
the input; very long texts stream one at a time; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, materialize, read, slices

SPACES = " \t\n\x0b\x0c\r"
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Rows of a chunk and chunks of a wider group, as powers of two; rows of a partition as monotonically_increasing_id numbers them.
CHUNK_BITS, WIDER_BITS, PARTITION_BITS = 6, 6, 33

# States of `(s?(ua)+)?`: nothing yet, after s, after u, after a
START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after the one role that can be inserted or given there, and whether that role is the user's.
FOLLOWS = (USER, USER, ASSISTANT, USER)
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Codes of a row: twice the place of its role's initial here (3: another), plus 1 if truncated; rows that must go.
INITIALS, BLANK, DUPLICATE = "sua", "8", "9"
LETTERS = "DKR"

Vector = tuple[int, int, int, int]
#: Costs at the end of a conversation: u lacks its a, s lacks both.
END: Vector = (0, 2 * INSERT, INSERT, 0)


def packed(v: Vector) -> int:
    return v[0] | v[1] << 8 | v[2] << 16 | v[3] << 24


def unpacked(x: int) -> Vector:
    return x & 255, x >> 8 & 255, x >> 16 & 255, x >> 24 & 255


@functools.cache
def stage(code: str, after: Vector) -> tuple[Vector, int]:
    """(the vector before a row, less its minimum; the row's moves as a number of 8 bits for each state) from the vector after it.

    A move has 2 bits for the number of inserts before the row, 2 for its letter and 2 for the state after it.
    """
    if code in (BLANK, DUPLICATE):
        return after, 0
    initial, truncated = "sua?"[int(code) // 2], int(code) % 2 * TRUNCATED
    options: list[list[tuple[int, int, int]]] = []  # by state: (cost of the rest, letter, next state), in order of letters
    for q in range(4):
        own = [(DELETE + after[q], 0, q)]
        if q in KEEPS.get(initial, {}):
            to = KEEPS[initial][q]
            own.append((truncated + after[to], 1, to))
        own.append((REROLE + truncated + after[FOLLOWS[q]], 2, FOLLOWS[q]))
        options.append(own)
    least = [min(o)[0] for o in options]
    for _ in range(2):
        least = [min(least[q], INSERT + least[FOLLOWS[q]]) for q in range(4)]
    moves = 0
    for q in range(4):
        at, inserts = q, 0
        while True:
            found = {letter: to for cost, letter, to in options[at] if cost == least[at]}
            if 0 not in found and least[at] == INSERT + least[FOLLOWS[at]]:
                at, inserts = FOLLOWS[at], inserts + 1
                continue
            letter = min(found)
            break
        moves |= (inserts | letter << 2 | found[letter] << 4) << 8 * q
    low = min(least)
    return (least[0] - low, least[1] - low, least[2] - low, least[3] - low), moves


def run_back(codes: str, right: Vector, before: Vector | None = None) -> Vector | None:
    """The vector at the left end of a chunk; None as soon as it differs from the run that began with `before` by a constant only."""
    for code in reversed(codes):
        if right == before:
            return None
        right = stage(code, right)[0]
        before = before and stage(code, before)[0]
    return None if right == before else right


# --- chunks ---------------------------------------------------------------------------------------

_STATE = "conv_id long, c long, next_c long, right long, left long"


def _speculated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    right = packed(END)
    for batch in batches:
        left = [packed(run_back(codes, END)) for codes in batch.column("codes").to_pylist()]
        yield pa.record_batch([batch.column("conv_id"), batch.column("c"), batch.column("next_c"), pa.array([right] * len(left), pa.int64()), pa.array(left, pa.int64())], ["conv_id", "c", "next_c", "right", "left"])


def _fixed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs groups of chunks again from right to left; the rightmost one takes what its neighbour said, `want`."""
    group, carried = None, 0
    for batch in batches:
        rights, lefts = [], []
        for conv, g, codes, right, left, want in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "g", "codes", "right", "left", "want"))):
            begin = carried if group == (conv, g) else want
            if begin != right:
                found = run_back(codes, unpacked(begin), unpacked(right))
                left = left if found is None else packed(found)
            group, carried = (conv, g), left
            rights.append(begin)
            lefts.append(left)
        yield pa.record_batch([batch.column("conv_id"), batch.column("c"), batch.column("next_c"), pa.array(rights, pa.int64()), pa.array(lefts, pa.int64())], ["conv_id", "c", "next_c", "right", "left"])


def _moves(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        convs, rows, all_codes, moves = [], [], [], []
        for conv, first, codes, right in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "codes", "right"))):
            v, own = unpacked(right), []
            for code in reversed(codes):
                v, move = stage(code, v)
                own.append(move)
            convs += [conv] * len(own)
            rows += range(first, first + len(own))
            all_codes += codes
            moves += reversed(own)
        yield pa.record_batch([pa.array(convs, pa.int64()), pa.array(rows, pa.int64()), pa.array(all_codes, pa.string()), pa.array(moves, pa.int64())], ["conv_id", "row", "code", "move"])


def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def stitched(chunks: DataFrame, wider_bits: int = WIDER_BITS) -> DataFrame:
    """(conv_id, c, right) of chunks (conv_id, c, next_c, codes): the cost vector at each chunk's right end.

    All tables have a row for each chunk; passes after the first take only groups that are not settled yet.
    """
    state, level = materialize(chunks.mapInArrow(_speculated, _STATE), "viterbi", few_files=True), 0
    while True:
        there = state.select(F.col("conv_id").alias("_conv"), F.col("c").alias("_c"), F.col("left").alias("_left"))
        seen = state.join(there, _same("conv_id", "_conv") & (F.col("next_c") == F.col("_c")), "left").withColumn("want", F.coalesce("_left", F.lit(packed(END)))).drop("_conv", "_c", "_left")
        seen = materialize(seen.withColumn("g", F.shiftright("c", level * wider_bits)), "viterbi", few_files=True)
        open_ = seen.filter("want <> right").select(F.col("conv_id").alias("_conv"), F.col("g").alias("_g")).distinct()
        if open_.isEmpty():
            discard(seen)
            return state.select("conv_id", "c", "right")
        mine = _same("conv_id", "_conv") & (F.col("g") == F.col("_g"))
        again = seen.join(open_, mine, "left_semi").join(chunks.select(F.col("conv_id").alias("_conv"), F.col("c").alias("_c"), "codes"), _same("conv_id", "_conv") & (F.col("c") == F.col("_c")))
        again = again.select("conv_id", "g", "c", "next_c", "codes", "right", "left", "want").repartition("conv_id", "g").sortWithinPartitions("conv_id", "g", F.desc("c"))
        settled = seen.join(open_, mine, "left_anti").select("conv_id", "c", "next_c", "right", "left")
        after = materialize(settled.union(again.mapInArrow(_fixed, _STATE)), "viterbi", few_files=True)
        discard(state)
        discard(seen)
        state, level = after, level + 1


# --- rows -----------------------------------------------------------------------------------------


def ordered(conversations: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) in order, numbered: row >> PARTITION_BITS is the partition."""
    own = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text")
    )
    # the last key deals out equal rows; the text's is short, because the keys of a sample go to the driver
    own = own.withColumn("_key", F.left("text", F.lit(64))).withColumn("_place", F.monotonically_increasing_id())
    out = own.repartitionByRange("conv_id", "turn", F.left("role", F.lit(64)), "_key", "_place").sortWithinPartitions("conv_id", "turn", "role", "text").drop("_key", "_place")
    return materialize(out.withColumn("row", F.monotonically_increasing_id()), "turns")


def coded(rows: DataFrame) -> DataFrame:
    """(conv_id, row, code): role and fault of each row in one letter."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    own = rows.select("conv_id", "row", "role", F.md5("text").alias("digest"), (F.length(trimmed) == 0).alias("blank"), (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).cast("int").alias("cut"))
    first = own.groupBy("conv_id", "role", "digest").agg(F.min("row").alias("_row")).select("_row")
    initial = F.instr(F.lit(INITIALS), F.left("role", F.lit(1)))
    place = F.when(F.col("role").eqNullSafe("") | (initial == 0), 3).otherwise(initial - 1)
    code = F.when(F.col("blank"), BLANK).when(F.col("_row").isNull(), DUPLICATE).otherwise((2 * place + F.col("cut")).cast("string"))
    return own.join(first, F.col("row") == F.col("_row"), "left").select("conv_id", "row", code.alias("code"))


def chunked(codes: DataFrame, chunk_bits: int = CHUNK_BITS) -> DataFrame:
    """(conv_id, c, next_c, first, codes): rows of one conversation whose numbers agree but for chunk_bits; next_c is where it would go on."""
    in_part = PARTITION_BITS - chunk_bits
    # a chunk has at most 2 ** chunk_bits rows
    chunks = codes.groupBy("conv_id", F.shiftright("row", chunk_bits).alias("c")).agg(F.min("row").alias("first"), F.expr("array_join(transform(array_sort(collect_list(struct(row, code))), x -> x.code), '')").alias("codes"))
    # a row for each partition: its last chunk and the first one of the next partition that has rows
    parts = codes.groupBy(F.shiftright("row", PARTITION_BITS).alias("part")).agg(F.shiftright(F.max("row"), chunk_bits).alias("last"))
    ends = parts.selectExpr("last", f"shiftleft(lead(part) over (order by part), {in_part}) as then")
    return materialize(chunks.join(ends, F.col("c") == F.col("last"), "left").select("conv_id", "c", F.when(F.col("last").isNull(), F.col("c") + 1).otherwise(F.col("then")).alias("next_c"), "first", "codes"), "chunks", few_files=True)


_OUT = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("old_role", pa.string()), ("role", pa.string()), ("text", pa.string()), ("fault", pa.string()), ("edit", pa.string())])
_FAULTS = {BLANK: "blank", DUPLICATE: "duplicate"}


def _edited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Follows the moves of each conversation; a row's move comes right before its text."""
    out: list[tuple] = []
    now, q, code, move, some = None, START, "", 0, False

    def inserted(q: int, n: int) -> int:
        for _ in range(n):
            out.append((now, None, None, "assistant" if q == USER else "user", "", None, "I"))
            q = FOLLOWS[q]
        return q

    def flushed() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _OUT)], schema=_OUT)
        out.clear()
        return batch

    for part in slices(batches, "text"):
        for conv, turn, role, text, c, m in zip(*(part.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "code", "move"))):
            if not some or conv != now:
                inserted(q, END[q] // INSERT)
                now, q, some = conv, START, True
            if c is not None:
                code, move = c, m
                continue
            if code in _FAULTS:
                out.append((conv, turn, role, None, text, _FAULTS[code], "D"))
                continue
            mine = move >> 8 * q & 255
            q = inserted(q, mine & 3)
            letter = LETTERS[mine >> 2 & 3]
            out.append((conv, turn, role, {"D": None, "K": role, "R": "assistant" if q == USER else "user"}[letter], text, "truncated" if int(code) % 2 else None, letter))
            q = mine >> 4 & 3
        if out:
            yield flushed()
    inserted(q, END[q] // INSERT)
    if out:
        yield flushed()


def repair(conversations: DataFrame, chunk_bits: int = CHUNK_BITS, wider_bits: int = WIDER_BITS) -> DataFrame:
    """The rows of each conversation with the cheapest edits, in order: conv_id, turn, old_role, role, text, fault, edit.

    edit is D, I, K or R; role is null for deleted rows, old_role and turn for inserted ones. A conversation's rows are in one
    partition and follow each other.
    """
    rows = ordered(conversations)
    chunks = chunked(coded(rows), chunk_bits)
    ends = stitched(chunks, wider_bits).select(F.col("conv_id").alias("_conv"), F.col("c").alias("_c"), "right")
    moves = chunks.join(ends, _same("conv_id", "_conv") & (F.col("c") == F.col("_c"))).select("conv_id", "first", "codes", "right").mapInArrow(_moves, "conv_id long, row long, code string, move long")
    both = rows.select("conv_id", "row", "turn", "role", "text", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("move"))
    both = both.unionByName(moves, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("code").desc_nulls_last()).mapInArrow(_edited, "conv_id long, turn long, old_role string, role string, text string, fault string, edit string")


# --- the query ------------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, chosen by crc32 of `conv_id:turn`."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), F.pmod(F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))), F.lit(20)).alias("_how"))
    own = own.filter("_how <> 0").withColumn("text", F.when(F.col("_how") == 1, "").when(F.col("_how") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")))
    own = own.withColumn("role", F.when(F.col("_how") == 4, "user").otherwise(F.col("role")))
    return own.withColumn("_copy", F.explode(F.when(F.col("_how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).select("conv_id", "turn", "role", "text")


_DIGEST = pa.schema([("_conv", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])


class _Digest:
    """Counts, audit and digest of one conversation, row by row."""

    def __init__(self) -> None:
        self.faults, self.cost, self.illegal, self.turns, self.audit, self.sha = {"blank": 0, "duplicate": 0, "truncated": 0}, 0, 0, 0, [], hashlib.sha256()
        self.low = self.turn = self.initial = None
        self.some = False

    def add(self, turn: int | None, old_role: str | None, role: str | None, text: str, fault: str | None, edit: str) -> None:
        self.audit.append(edit)
        self.cost += {"D": DELETE, "I": INSERT, "K": 0, "R": REROLE}[edit] + (fault == "truncated" and edit != "D") * TRUNCATED
        if role is not None:
            self.sha.update(f"{chr(10) if self.some else ''}{role}:{text}".encode())
            self.some = True
        if edit == "I":
            return
        if fault:
            self.faults[fault] += 1
        if self.initial is not None and self.initial + old_role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = old_role[:1]
        if turn is not None and turn != self.turn:
            self.low, self.turn, self.turns = turn if self.low is None else self.low, turn, self.turns + 1

    def row(self, conv: int | None) -> tuple:
        gaps = self.turn - self.low + 1 - self.turns if self.turns else 0
        return conv, gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest()


def _digested(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, state = None, None
    for part in slices(batches, "text"):
        rows = []
        for conv, *values in zip(*(part.column(c).to_pylist() for c in _OUT.names)):
            if state is None or conv != now:
                if state is not None:
                    rows.append(state.row(now))
                now, state = conv, _Digest()
            state.add(*values)
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), _DIGEST)], schema=_DIGEST)
    if state is not None:
        yield pa.record_batch([pa.array([c], f.type) for c, f in zip(state.row(now), _DIGEST)], schema=_DIGEST)


def digests(conversations: DataFrame) -> DataFrame:
    """The contract's columns for each conversation of the undamaged rows."""
    found = repair(damaged(conversations)).mapInArrow(_digested, "_conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(found, _same("conv_id", "_conv"), "left").select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(read(spark, sf_dir, "conversations"))
