"""Reading a corpus: files of a folder, chats as JSON lines, and the packing of large texts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File types that are read
FILE_TYPES = "*.{md,txt,yaml,yml,csv,json,jsonl,html,htm}"
CHUNK_BYTES, TARGET_BYTES = 10 << 20, 5 << 20

CHAT = T.StructType(
    [
        T.StructField("uuid", T.StringType()), T.StructField("timestamp", T.StringType()), T.StructField("type", T.StringType()), T.StructField("role", T.StringType()), T.StructField("content", T.StringType()),
        T.StructField("message", T.StructType([T.StructField("parts", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("thought", T.BooleanType())])))])),
        T.StructField("_bad", T.StringType()),
    ]
)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the text files below a folder, each whole; empty ones and the engine's own mirror go."""
    files = spark.read.format("text").option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", FILE_TYPES).load(path)
    files = files.select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    return files.filter(F.trim("text") != "").filter(~F.col("path").rlike("/mirror(ed)?[^/]*/"))


def with_source_metadata(df: DataFrame, path: str = "path") -> DataFrame:
    """Adds bucket (the folder below inbox, else the first one), kind (the extension) and provenance."""
    clean = F.regexp_replace(F.col(path), r"^[a-z]+:/+", "")
    inbox = F.regexp_extract(clean, "(?:^|/)(?:external-)?inbox/([^/]+)/", 1)
    first = F.element_at(F.split(clean, "/"), 1)
    kind = F.lower(F.regexp_extract(clean, r"\.([A-Za-z0-9]+)$", 1))
    provenance = F.when(clean.rlike("external-inbox|web_scrape"), "external").when(clean.contains("quarantine"), "quarantine").otherwise("internal")
    return df.withColumns({"bucket": F.when(inbox != "", inbox).otherwise(first), "kind": kind, "provenance": provenance})


def read_chat_jsonl(spark: SparkSession, path: str, least: int = 100) -> DataFrame:
    """(path, text): chats of JSON lines as `[User]: ...` lines; telemetry, thoughts, empty system turns and bad lines go."""
    lines = spark.read.schema(CHAT).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).withColumn("path", F.input_file_name()).withColumn("n", F.monotonically_increasing_id())
    role = F.lower(F.coalesce("role", "type"))
    said = F.coalesce(F.array_join(F.transform(F.filter("message.parts", lambda p: p["text"].isNotNull() & ~F.coalesce(p["thought"], F.lit(False))), lambda p: p["text"]), "\n"), F.col("content"))
    name = F.when(role == "user", "User").when(role.isin("assistant", "model"), "Assistant").when(role == "tool", "Tool").when(role == "system", "System")
    turns = lines.select("path", "n", name.alias("name"), said.alias("said"), "_bad").filter("_bad is null and name is not null and trim(said) <> ''")
    turns = turns.select("path", F.struct("n", F.format_string("[%s]: %s", "name", "said").alias("line")).alias("r"))
    joined = turns.groupBy("path").agg(F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n\n").alias("text"))
    return joined.filter(F.length("text") >= least)


def _packed(units: Iterator[str], target: int) -> Iterator[str]:
    held, size = [], 0
    for unit in units:
        n = len(unit.encode())
        if held and size + n > target:
            yield "".join(held)
            held, size = [], 0
        held.append(unit)
        size += n
    if held:
        yield "".join(held)


def _pack(df: DataFrame, cut, key: str, text: str, over: int, target: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch[key], batch[text]):
                t = t or ""
                parts = list(_packed(cut(t), target)) if len(t.encode()) > over else [t]
                yield pd.DataFrame({key: [k] * len(parts), "chunk": range(1, len(parts) + 1), "content": parts})

    out = df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, chunk long, content string")
    return out.withColumn("virtual_path", F.format_string("%s#chunk-%03d", F.col(key).cast("string"), "chunk"))


def pack_lines_into_chunks(df: DataFrame, key: str = "path", text: str = "text", over: int = CHUNK_BYTES, target: int = TARGET_BYTES, kind: str = "text") -> DataFrame:
    """(key, chunk, content, virtual_path): texts over `over` bytes in chunks of about `target`, cut at lines, headings (md) or documents (yaml)."""
    import re

    pattern = {"md": r"(?m)^(?=#{1,3} )", "yaml": r"(?m)^(?=---|[A-Za-z_][\w-]*:)"}.get(kind)
    return _pack(df, (lambda t: iter(re.split(pattern, t))) if pattern else (lambda t: iter(t.splitlines(keepends=True))), key, text, over, target)


def split_large_text(df: DataFrame, key: str = "path", text: str = "text", over: int = CHUNK_BYTES, target: int = 1 << 20) -> DataFrame:
    """The same, cut at sentence ends."""
    import re

    return _pack(df, lambda t: iter(re.split(r"(?<=[.!?])(?=\s)", t)), key, text, over, target)
