"""Near-dedup of documents, lines and vectors against brute force, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from corpusgraph.llm import common, embedding_dedup, line_dedup, minhash
from corpusgraph.llm.common import connected_components, span_hashes

EDGE = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two"), (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "x " * 30_000), (9, "é " * 9)]


def components(ids, links):
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def near_texts(seed=1, groups=12):
    """Bases with edited copies around the threshold, one group large enough to hold several components at first."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    texts = []
    for g in range(groups):
        base = rng.choices(vocabulary, k=rng.randint(30, 120))
        for _ in range(60 if g == 0 else rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 20))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    return texts


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    df = spark.createDataFrame([(b, a) for a, b in links], "a long, b long")
    want = {i: c for i, c in components({x for e in links for x in e}, links).items() if any(i in e and e[0] != e[1] for e in links)}
    assert {r.id: r.component_id for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


def colliding_words(letters=1024):
    """A word and its complement whose hashes agree under every polynomial modulo 2**64."""
    word = "a"
    while len(word) < letters:
        word += word.translate({97: 98, 98: 97})
    return word, word.translate({97: 98, 98: 97})


def test_hashes_of_structured_words():
    for letters in (1024, 8192):
        a, b = colliding_words(letters)
        n = len(a)
        assert len(set(span_hashes(np.frombuffer((a + b + a).encode(), np.uint8), np.arange(3) * n, np.arange(1, 4) * n).tolist())) == 2


def test_hashes_against_plain_arithmetic(monkeypatch):
    data = np.frombuffer(random.Random(5).randbytes(5000), np.uint8)
    starts = np.array([0, 3, 100, 4999, 7, 20])
    ends = np.array([5000, 3, 4999, 5000, 8, 2020])
    prime = (1 << 61) - 1
    want = [int(common.mix(np.array([(sum((int(c) + 1) * pow(common._BASE, i, prime) for i, c in enumerate(data[a:b])) % prime + (b - a) * 0xD6E8FEB86659FD93) % (1 << 64)], np.uint64))[0]) for a, b in zip(starts.tolist(), ends.tolist())]
    assert span_hashes(data, starts, ends).tolist() == want
    monkeypatch.setattr(common, "_PART", 999)  # spans summed in parts
    assert span_hashes(data, starts, ends).tolist() == want


@pytest.mark.parametrize("block,rounds", [(minhash.BLOCK, minhash.SKETCH_ROUNDS), (8, minhash.SKETCH_ROUNDS), (minhash.BLOCK, 0), (8, 0)])
def test_minhash_brute_force(spark, monkeypatch, block, rounds):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SKETCH_ROUNDS", rounds)
    x, y = colliding_words()
    rows = [(i + 20, t) for i, t in enumerate(near_texts())] + EDGE + [(900, f"{x} b c d e f"), (901, f"{y} b c d e f"), (902, x), (903, y)]
    sets = {i: shingle_set(t) for i, t in rows if i is not None}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    df = spark.createDataFrame([(i, t, -1, "k") for i, t in rows], "doc_id long, text string, component_id long, kept string")
    got = minhash.near_duplicates(df).collect()
    assert len(got) == sum(i is not None for i, _ in rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), want[i], want[i] == i) for i in sets}
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_odd_sketch_never_rejects_links():
    rng = np.random.default_rng(2)
    for size in (5, 60, 400, 3000, 20000):
        for _ in range(20):
            n = int(size * rng.uniform(0.5, 1))
            base = rng.integers(0, 1 << 63, 2 * size, dtype=np.uint64)
            extra = int(n * 0.14)
            x, y = base[: n + extra], np.concatenate([base[:n], base[size + extra : size + 2 * extra]])
            if 100 * n < 75 * (len(x) + len(y) - n):
                continue
            rows = np.repeat([0, 1], [len(x), len(y)])
            bits, samples = minhash.odd_sketches(rows, np.concatenate([x, y]), 2)
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert minhash.may_link(np.array([apart]), np.array([samples.sum()]), np.array([len(x) + len(y)]))[0]


def line_brute_force(rows):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})

    held = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= 10:
                held.setdefault(key(line), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if i is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def test_lines_brute_force(spark):
    common, accents = "Licensed under the Apache License", "ÉÉÉÉÉÉÉÉÉ"
    rows = EDGE + [
        (20, f"{common}\nown line number one\n{common}"), (21, f"  {common.upper()}\t\r\nshort\nshort"), (22, f"{accents}x\n{accents}"), (23, f"{accents}x\n{accents}"),
        (24, "same doc twice\nsame doc twice"), (25, "\n\n"), (None, common), (26, "\u00a0padded by other space\u00a0"), (27, "\u00a0padded by other space"), (28, "x" * 200_000), (29, "x" * 200_000),
    ]
    df = spark.createDataFrame([(i, t, 7, 8) for i, t in rows], "doc_id long, text string, n_lines long, digest long")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == ["doc_id", "text", "n_lines", "digest", "_kept", "_lines", "_dropped"]
    assert sorted(((r.doc_id, r._lines, r._dropped, bytes(r._kept).decode()) for r in got.collect()), key=str) == line_brute_force(rows)
    assert line_dedup.drop_repeated_lines(df.limit(0)).count() == 0


def test_lines_with_a_small_filter(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "MIN_BITS", 64)
    monkeypatch.setattr(line_dedup, "MAX_BITS", 64)
    rows = [(i, "\n".join(f"line of text {j % 37}" for j in range(i, i + 9))) for i in range(60)]
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(((r.doc_id, r._lines, r._dropped, bytes(r._kept).decode()) for r in got.collect()), key=str) == line_brute_force(rows)


def vector_brute_force(rows):
    fine = {}
    for n, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            fine[n] = np.array(v, float) / np.linalg.norm(np.array(v, float))
    links = [(a, b) for a in fine for b in fine if a < b and len(fine[a]) == len(fine[b]) and fine[a] @ fine[b] >= 0.95]
    count = {n: 0 for n in range(len(rows))}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    ids = [i for i, _ in rows]
    part = components(set(i for i in ids if i is not None), [(min(ids[a], ids[b]), max(ids[a], ids[b])) for a, b in links])
    return sorted((i, count[n], part[i], part[i] == i) for n, (i, _) in enumerate(rows) if i is not None)


@pytest.mark.parametrize("cell, block, moved", [(embedding_dedup.CELL, embedding_dedup.BLOCK, embedding_dedup.MOVED), (20, 15, embedding_dedup.MOVED), (20, 15, 0), (1, 15, -1e6)])
def test_vectors_brute_force(spark, monkeypatch, cell, block, moved):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    monkeypatch.setattr(embedding_dedup, "MOVED", moved)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(150)]
    center = rng.normal(size=8)
    rows += [(200 + i, (center + rng.normal(size=8) * 0.12).tolist()) for i in range(80)]
    rows += [(300, None), (301, []), (302, [0.0] * 8), (303, [1.0, None] + [0.0] * 6), (304, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7), (306, [1.0, 2.0]), (307, [2.0, 4.0]), (None, [1.0, 2.0]), (308, [1e-300, 2e-300]), (309, rows[0][1]), (310, rows[0][1])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, n_links int")
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()) == vector_brute_force(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_pivots_follow_structure(spark):
    """Clusters get cells of their own; vectors without structure get one."""
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(16, 16))
    clustered = (centers[rng.integers(0, 16, 4000)] + rng.normal(size=(4000, 16)) * 0.01, 16)
    spread = (rng.normal(size=(4000, 64)), 64)
    for (x, d), most in ((clustered, 16), (spread, 1)):
        x = x / np.linalg.norm(x, axis=1)[:, None]
        units = spark.createDataFrame([(d, v.tobytes()) for v in x], "dim int, unit binary")
        found = embedding_dedup._pivots(units, 100_000, math.sqrt(2 - 2 * embedding_dedup.COSINE))[d]
        assert (len(found) == 1) if most == 1 else (8 <= len(found) <= most)


def test_line_columns_that_clash(spark):
    rows = [(1, "a line that repeats", 5, 6), (2, "a line that repeats\nown", 5, 6)]
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], "doc_id long, text string, _kept int, _gone int, _lines int, _id int")
    got = line_dedup.drop_repeated_lines(df)
    assert got.columns == [*df.columns, "__kept", "__lines", "_dropped"]
    assert sorted((r.doc_id, r._kept, bytes(r["__kept"])) for r in got.collect()) == [(1, 5, b"a line that repeats"), (2, 5, b"own")]


def test_line_digest_of_kept():
    assert line_dedup._key(b"  Tiny ") is None and line_dedup._key(b" ABCDEFGHIJ\r") == b"abcdefghij"
    assert len(line_dedup._digest(b"x")) == 16 and hashlib.sha256(b"").hexdigest()
