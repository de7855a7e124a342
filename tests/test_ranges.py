"""Ranged reading against a sequential version: borders, long units, characters of several bytes, empty files, tiny windows."""

import random

import pytest

from corpusgraph.sources import ranges


def sequential(data: bytes, window: int, cut: str) -> list[bytes]:
    """All cuts by a walk over every byte."""
    fits = {
        "line": lambda p: data[p - 1 : p] == b"\n",
        "sentence": lambda p: data[p - 1] in b".!?" and data[p : p + 1] in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"),
        "heading": lambda p: data[p - 1 : p] == b"\n" and any(data[p:].startswith(b"#" * n + b" ") for n in (1, 2, 3)),
    }[cut]
    cuts = [0]
    for line in range(window, len(data), window):
        p = next((p for p in range(line, line - window, -1) if fits(p)), None)
        if p is None:
            p = line
            while data[p] & 0xC0 == 0x80:
                p -= 1
        cuts.append(p)
    cuts.append(len(data))
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def made(seed: int, n: int) -> bytes:
    r = random.Random(seed)
    return "".join(r.choice(["word ", "é€😀", ". ", "!\n", "\n# Head\n", "\n### x ", "\r\n", "long" * r.randint(1, 30), "?"]) for _ in range(n)).encode()


@pytest.mark.parametrize("cut", ["line", "sentence", "heading"])
@pytest.mark.parametrize("window", [8, 37, 400])
def test_equals_sequential(spark, tmp_path, cut, window):
    folder = tmp_path / "in"
    (folder / "deep").mkdir(parents=True)
    texts = {"a.txt": made(1, 400), "deep/b.txt": made(2, 90), "empty.txt": b"", "_SUCCESS": b"no", "one.txt": b"x", "flat.txt": ("é" * 300).encode()}
    for name, data in texts.items():
        (folder / name).write_bytes(data)
    rows = ranges.read_ranges(spark, str(folder), cut, window, 5 * window).collect()
    assert {r.path.split("in/")[1] for r in rows} == {"a.txt", "deep/b.txt", "one.txt", "flat.txt"}
    for name in ("a.txt", "deep/b.txt", "one.txt", "flat.txt"):
        own = sorted((r for r in rows if r.path.endswith(name)), key=lambda r: r.window)
        assert [r.content.encode() for r in own] == sequential(texts[name], window, cut)
        assert [r.start_byte for r in own] == [0, *(r.end_byte for r in own[:-1])] and own[-1].end_byte == len(texts[name])


def test_one_file_by_many_tasks(spark, tmp_path):
    (tmp_path / "big.txt").write_bytes(made(3, 60_000))
    df = ranges.read_ranges(spark, f"file:{tmp_path}/big.txt", "sentence", 1000, 10_000)
    assert df.rdd.getNumPartitions() > 50
    assert "".join(r.content for r in df.orderBy("window").collect()).encode() == made(3, 60_000)


def test_options(spark, tmp_path):
    with pytest.raises(Exception, match="cut is one of"):
        ranges.read_ranges(spark, str(tmp_path), "page").collect()
    with pytest.raises(Exception, match="FileNotFound|absent"):
        ranges.read_ranges(spark, str(tmp_path / "absent")).collect()
