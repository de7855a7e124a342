"""Text cut into passages of bounded size: sentences, with fenced code kept whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

FENCE = "```"


def pieces_within(piece: str, most_bytes: int) -> Iterator[str]:
    """Cuts a text to at most most_bytes UTF-8 bytes a piece: after the last newline that fits (not the first character), else at a character."""
    data, at = piece.encode(), 0
    while len(data) - at > most_bytes:
        end = at + most_bytes
        while data[end] & 0xC0 == 0x80:
            end -= 1
        newline = data.rfind(b"\n", at + 1, end)
        end = newline + 1 if newline > at else end
        yield data[at:end].decode()
        at = end
    yield data[at:].decode()


def split_passages(df: DataFrame, key: str = "doc_id", text: str = "text", keep: Iterable[str] = (), most_bytes: int = 1024) -> DataFrame:
    """(key, *keep, seq, part, content, start_byte, end_byte, fenced): sentences and whole code fences, at most most_bytes bytes each.

    Text from one ``` to the next is a fence and no border of sentences; a last ``` without a partner is plain text. Outside of
    fences a sentence ends at . ! or ? before white space and an upper-case ASCII letter. What is still over most_bytes (4 or
    more) is cut after its last newline that fits, else at a character: part counts these cuts from 0. Byte ranges are exact, and
    blank sentences are left out. Null and empty texts give no rows; equal rows give equal passages. Texts are cut inside their
    rows, without a shuffle; only what is too long goes to Python, in Arrow batches.
    """
    if most_bytes < 4:
        raise ValueError("most_bytes must be 4 or more, a character's greatest size")
    border = r"(?<=[.!?])(?=\s+[A-Z])"
    marks = df.select(key, *keep, F.split(text, FENCE, -1).alias("_m"))
    n = F.size("_m")
    last = F.concat(F.element_at("_m", -2), F.lit(FENCE), F.element_at("_m", -1))
    marks = marks.withColumn("_m", F.when(n % 2 == 0, F.concat(F.slice("_m", F.lit(1), n - 2), F.array(last))).otherwise(F.col("_m")))
    piece = lambda t, fenced, gap: F.struct(t.alias("t"), fenced.alias("fenced"), gap.alias("gap"))
    whole = lambda m: F.array(piece(F.concat(F.lit(FENCE), m, F.lit(FENCE)), F.lit(True), F.lit(False)))
    sentences = lambda m: F.transform(F.split(m, border, -1), lambda t, j: piece(t, F.lit(False), j > 0))
    cut = marks.select(key, *keep, F.flatten(F.transform("_m", lambda m, i: F.when(i % 2 == 1, whole(m)).otherwise(sentences(m)))).alias("_p"))
    cut = cut.withColumn("_e", T.running_sums(F.transform("_p", lambda p: F.octet_length(p["t"]).cast("long"))))
    rows = cut.select(key, *keep, F.posexplode(F.arrays_zip("_p", "_e")).alias("_s", "_x")).select(key, *keep, F.col("_s").cast("long").alias("seq"), "_x._p.*", F.col("_x._e").alias("_end"))
    rows = rows.withColumn("_c", F.when(F.col("gap"), F.regexp_replace("t", r"^\s+", "")).otherwise(F.col("t"))).filter(F.col("_c").rlike(r"\S"))

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else list(pieces_within(t, most_bytes)))

    size = F.octet_length("_c")
    rows = rows.withColumn("_long", F.pandas_udf(run, "array<string>")(F.when(size > most_bytes, F.col("_c"))))
    ends = F.when(F.col("_long").isNull(), F.array(size.cast("long"))).otherwise(T.running_sums(F.transform("_long", lambda t: F.octet_length(t).cast("long"))))
    parts = F.posexplode(F.arrays_zip(F.coalesce("_long", F.array("_c")).alias("t"), ends.alias("e"))).alias("_k", "_y")
    out = rows.select(key, *keep, "seq", "fenced", (F.col("_end") - size).alias("_start"), parts)
    end, content = F.col("_start") + F.col("_y.e"), F.col("_y.t")
    return out.select(key, *keep, "seq", F.col("_k").cast("long").alias("part"), content.alias("content"), (end - F.octet_length(content)).alias("start_byte"), end.alias("end_byte"), "fenced")
