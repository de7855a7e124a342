"""Passages against a sequential version, with fences, long pieces and odd texts."""

import re

import pytest

from corpusgraph.operators import passages

TEXTS = [
    "Intro here. ```\nfoo. Bar\n``` And more. Then Ünder. Über",
    "no partner ``` here. But text. ",
    "````four. Marks```` and. After",
    "```a. B``````c. D``` end. E",
    "é" * 700 + ". Then " + "x" * 1023 + "é",
    "\n" + "line of words\n" * 300 + "```\n" + "code. Here\n" * 200 + "```",
    "\n" + "y" * 3000,
    "😀" * 1000 + "\n",
    "   ", "", None, "One. Two! Three?  Four", "```", "``````", "One. Two! Three?  Four",
]


def sequential(text, most=1024):
    data, out, at = text.encode(), [], 0
    parts = re.split(r"(```[\s\S]*?```)", text)
    seq = 0
    for i, segment in enumerate(parts):
        spans = [(segment, "")] if i % 2 else [(s, "") for s in re.split(r"(?<=[.!?])(?=\s+[A-Z])", segment, flags=re.ASCII)]
        for j, (piece, _) in enumerate(spans):
            content = piece if i % 2 or j == 0 else re.sub(r"^\s+", "", piece, flags=re.ASCII)
            start = at + len(piece.encode()) - len(content.encode())
            at += len(piece.encode())
            if re.search(r"\S", content, flags=re.ASCII):
                part = 0
                while content:
                    n = len(content)
                    if len(content.encode()) > most:
                        n = max(k for k in range(most // 4, most + 1) if len(content[:k].encode()) <= most)
                        newline = content.rfind("\n", 1, n)
                        n = newline + 1 if newline > 0 else n
                    size = len(content[:n].encode())
                    out.append((seq, part, content[:n], start, start + size, bool(i % 2)))
                    assert data[start : start + size].decode() == content[:n]
                    content, start, part = content[n:], start + size, part + 1
            seq += 1
    return out


@pytest.mark.parametrize("most", [1024, 64, 4])
def test_passages(spark, most):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, seq_ string, t int").repartition(3)
    found = passages.split_passages(df, keep=["seq_"], most_bytes=most)
    assert found.columns == ["doc_id", "seq_", "seq", "part", "content", "start_byte", "end_byte", "fenced"]
    rows = found.drop("seq_").collect()
    assert sorted(map(tuple, rows)) == sorted((i, *r) for i, t in enumerate(TEXTS) if t is not None for r in sequential(t, most))
    assert all(len(r.content.encode()) <= most for r in rows)
    if most == 1024:
        assert "```\nfoo. Bar\n```" in {r.content for r in rows if r.fenced}


def test_no_rows_and_bounds(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert passages.split_passages(df).count() == 0
    with pytest.raises(ValueError):
        passages.split_passages(df, most_bytes=3)
