"""Conversation repair against brute force: shortest paths by Dijkstra over whole audits, rows in plain loops."""

import collections
import hashlib
import heapq
import random
import zlib

import pytest

from corpusgraph.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, row int"
WS = " \t\n\x0b\x0c\r"


def plain_audit(rows):
    """(cost, audit, repaired) of rows (role, text, fault): the least (cost, audit) over states, by a heap."""
    follows, done = {0: 2, 1: 2, 2: 3, 3: 2}, set()
    heap = [(0, "", 0, 0, ())]
    while heap:
        cost, audit, i, q, out = heapq.heappop(heap)
        if (i, q) in done:
            continue
        if i == len(rows) and q in (0, 3):
            return cost, audit, "\n".join(out)
        done.add((i, q))
        new = "assistant" if q == 2 else "user"
        heapq.heappush(heap, (cost + 2, audit + "I", i, follows[q], (*out, f"{new}:")))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, q, out))
            if fault not in ("blank", "duplicate"):
                more, step = int(fault == "truncated"), (q, role[:1])
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}.get(step)
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, f"{role}:{text}")))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, follows[q], (*out, f"{new}:{text}")))
    raise AssertionError


def plain(rows, damage=True):
    one = lambda x: " " if x is None else str(x)
    out, by = {}, collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]  # noqa: B018
        how = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20 if damage else 9
        role, text = one(role), one(text)
        if how == 0:
            continue
        text = "" if how == 1 else text.translate({ord(c): None for c in ".!?"}) if how == 2 else text
        by[conv] += [(turn, "user" if how == 4 else role, text)] * (1 + (how == 3))
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, faulty, counts = set(), [], collections.Counter()
        for _, role, text in own:
            end = text.rstrip(WS)
            fault = "blank" if not end else "duplicate" if (role, text) in seen else None if end[-1] in ".!?" else "truncated"
            seen.add((role, text))
            counts[fault] += 1
            faulty.append((role, text, fault))
        turns = [t for t, *_ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, text = plain_audit(faulty)
        out[conv] = (gaps, counts["blank"], counts["duplicate"], counts["truncated"], illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def got(df):
    return {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")) for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)


def made(seed, convs, most):
    draw = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \t\n", "So it is. ", "dots... no", None, "中文。", "ok.\x0b"]
    roles = ["user", "assistant", "system", "tool", "", None, "ux", "User"]
    out = []
    for conv in range(convs):
        weights = [draw.random() ** 3 for _ in roles]
        for turn in range(draw.randrange(most)):
            out.append((None if conv == 3 else conv, draw.choice([turn, turn, turn, None, turn * 3]), draw.choices(roles, weights)[0], draw.choice(texts) if draw.random() < 0.4 else f"text {draw.random()}."))
    return out


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = repair.op13_repair(spark, sf)
    assert got(found) == plain(rows)
    assert found.count() == len({r[0] for r in rows})


def test_edge_cases(spark):
    rows = made(1, 60, 14) + [(100, 1, "user", "x" * 300_000 + "."), (100, 2, "assistant", "y " * 100_000), (101, None, None, None), (102, None, "user", "Same."), (102, None, "user", "Same.")]
    assert got(repair.digests(frame(spark, rows))) == plain(rows)
    assert repair.digests(frame(spark, [])).count() == 0
    assert repair.repair(frame(spark, [])).count() == 0


@pytest.mark.parametrize("chunk_bits, wider_bits", [(1, 1), (2, 1), (3, 6)])
def test_long_conversations(spark, chunk_bits, wider_bits):
    """Chunks of a few rows over several partitions: what a task speculates is put right by the passes, in runs of one role, too."""
    rows = made(2, 8, 60) + [(50, t, "user", f"Run {t}.") for t in range(90)] + [(51, t, "user", "") for t in range(70)] + [(51, 80, "assistant", "End.")]
    rows += [(52, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(40)] + [(53, 1, "user", "Equal.")] * 30
    found = collections.defaultdict(list)
    for r in repair.repair(frame(spark, rows).repartition(5), chunk_bits, wider_bits).collect():
        found[r.conv_id].append(r)
    want = plain(rows, damage=False)
    assert {c: "".join(r.edit for r in own) for c, own in found.items()} == {c: w[6] for c, w in want.items()}
    assert {c: hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in own if r.role is not None).encode()).hexdigest() for c, own in found.items()} == {c: w[7] for c, w in want.items()}


def test_passes_change_chunks(spark):
    """A run of one role gives a cost vector that depends on where it began, so speculated chunks of odd length are wrong at first."""
    codes = spark.createDataFrame([(1, r, "2") for r in range(33)], "conv_id long, row long, code string")
    chunks = repair.chunked(codes, 0)
    ends = {r.c: r.right for r in repair.stitched(chunks, 1).collect()}
    v, want = repair.END, {}
    for r in reversed(range(33)):
        want[r] = repair.packed(v)
        v = repair.stage("2", v)[0]
    assert ends == want and len(set(want.values())) > 1


def test_vectors_are_few():
    """The vectors that any rows can lead to, less a constant, are a handful, and fit the packing."""
    seen, new = set(), {repair.END}
    while new:
        seen |= new
        new = {repair.stage(str(c), v)[0] for v in new for c in range(8)} - seen
    assert len(seen) < 60 and max(max(v) for v in seen) < 16


def test_partition_ends(spark):
    """next_c leads to the next partition that has rows."""
    bits = repair.PARTITION_BITS
    codes = spark.createDataFrame([(1, 0, "2"), (1, 1, "4"), (1, 3 << bits, "2"), (2, (3 << bits) + 1, "2")], "conv_id long, row long, code string")
    found = {(r.conv_id, r.c): r.next_c for r in repair.chunked(codes, 1).select("conv_id", "c", "next_c").collect()}
    assert found == {(1, 0): 3 << bits - 1, (1, 3 << bits - 1): None, (2, 3 << bits - 1): None}
