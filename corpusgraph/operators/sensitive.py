"""Sensitive-data scan: patterns, entropy and overlap rules as table jobs."""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Fixed values: (type, pattern, group, least entropy), in order of priority
PATTERNS = [
    ("EMAIL", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", 0, 2.5),
    ("PHONE", r"(?:\+?1?[-.\s]?)?\(?(?:[0-9]{3})\)?[-.\s]?(?:[0-9]{3})[-.\s]?(?:[0-9]{4})", 0, 0.0),
    ("CREDIT_CARD", r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b", 0, 0.0),
    ("API_KEY", r"""(?i)(?:api[_-]?key|apikey|api_secret|secret[_-]?key)[\s:=]+['"]?([a-zA-Z0-9_\-]{20,})['"]?""", 1, 3.5),
    ("PASSWORD", r"""(?i)(?:password|passwd|pwd|pass)[\s:=]+['"]?([^\s'"]{8,})['"]?""", 1, 3.0),
    ("AWS_KEY", r"\b(AKIA[0-9A-Z]{16})\b", 0, 0.0),
    ("GITHUB_TOKEN", r"\b(gh[pousr]_[A-Za-z0-9_]{36,})\b", 0, 0.0),
    ("SSN", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", 0, 0.0),
    ("IP_ADDRESS", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0, 0.0),
    ("PRIVATE_KEY", r"(?s)-----BEGIN (?:RSA |EC |DSA )?PRIVATE KEY-----.*?-----END (?:RSA |EC |DSA )?PRIVATE KEY-----", 0, 0.0),
    ("BEARER_TOKEN", r"(?i)bearer\s+[a-zA-Z0-9\-_\.]+", 0, 0.0),
    ("GENERIC_SECRET", r"""(?i)(?:secret|token|auth|credential)[_-]?(?:key|value)?[\s:=]+['"]?([a-zA-Z0-9\-_]{16,})['"]?""", 1, 4.0),
]


def shannon_entropy(text: Column) -> Column:
    """Bits for each character, over the characters of the text."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    return F.coalesce(F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))), F.lit(0.0))


#: For each kind what every text with a match holds: any of some strings in lower case, or a plainer pattern.
HINTS = {
    "EMAIL": ["@"], "PHONE": r"[0-9]{3}\)?[-.\s]?[0-9]{3}[-.\s]?[0-9]{4}", "CREDIT_CARD": "[0-9]{13}", "API_KEY": ["api", "secret"], "PASSWORD": ["pass", "pwd"], "AWS_KEY": ["akia"], "GITHUB_TOKEN": ["ghp_", "gho_", "ghu_", "ghs_", "ghr_"],
    "SSN": "[0-9]-[0-9]", "IP_ADDRESS": "[0-9][.][0-9]", "PRIVATE_KEY": ["-----begin"], "BEARER_TOKEN": ["bearer"], "GENERIC_SECRET": ["secret", "token", "auth", "credential"],
}

# Kinds whose pattern alone is worth .2 more
SURE = ("EMAIL", "SSN")

_EMPTY = "array<struct<type:string,priority:int,start:bigint,end:bigint,found:string,sure:boolean>>"


def _with_hits(df: DataFrame, patterns, key: str, text: str, low_entropy: bool) -> DataFrame:
    """(key, hits): the pattern hits of a text as an array of structs, by priority and place, in one pass over the table.

    The pieces between matches, by the same pattern, give the positions; sums over them are made in blocks.
    """
    rows = df.select(key, text, F.lower(text).alias("low"))

    def likely(kind: str, pattern: str) -> Column:
        hint = HINTS.get(kind) if any(kind == k and pattern == p for k, p, *_ in PATTERNS) else None
        if hint is None:
            return F.lit(True)
        return F.col(text).rlike(hint) if isinstance(hint, str) else reduce(Column.__or__, [F.col("low").contains(h) for h in hint])

    has = {i: likely(kind, pattern) & F.col(text).rlike(pattern) for i, (kind, pattern, *_) in enumerate(patterns)}
    columns = {}
    for i, (_, pattern, group, _) in enumerate(patterns):
        columns |= {f"p{i}": F.when(has[i], F.split(text, pattern, -1)), f"m{i}": F.when(has[i], F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))}
        if group:
            columns[f"g{i}"] = F.when(has[i], F.regexp_extract_all(text, F.lit(pattern), F.lit(group)))
    rows = rows.withColumns(columns).drop(text, "low")
    return rows.select(key, F.concat(*[_hits_of(i, kind, group, least, low_entropy) for i, (kind, _, group, least) in enumerate(patterns)]).alias("hits"))


def _hits_of(i: int, kind: str, group: int, least: float, low_entropy: bool) -> Column:
    whole, pieces, found = F.col(f"m{i}"), F.col(f"p{i}"), F.col(f"g{i}" if group else f"m{i}")
    steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(whole)), whole, lambda a, b: (F.length(a) + F.length(b)).cast("long"))
    placed = F.zip_with(T.running_sums(steps), F.arrays_zip(whole.alias("w"), found.alias("f")), lambda end, x: F.struct((end - F.length(x["w"])).alias("start"), x["w"].alias("w"), x["f"].alias("f")))

    def hit(x: Column) -> Column:
        start = x["start"] + (F.greatest(F.instr(x["w"], x["f"]) - 1, F.lit(0)) if group else F.lit(0))
        sure = shannon_entropy(x["f"]) >= least if least else F.lit(True)
        return F.struct(F.lit(kind).alias("type"), F.lit(i).alias("priority"), start.alias("start"), (start + F.length(x["f"])).alias("end"), x["f"].alias("found"), sure.alias("sure"))

    hits = F.transform(placed, hit)
    return F.coalesce(F.when(F.size(whole) > 0, hits if low_entropy or not least else F.filter(hits, lambda h: h["sure"])), F.array().cast(_EMPTY))


def matches(df: DataFrame, patterns=PATTERNS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, type, priority, start, end, found) of all pattern hits; positions in characters."""
    return _with_hits(df, patterns, key, text, False).select(key, F.explode("hits").alias("h")).select(key, "h.*").drop("sure")


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each row whether each of its hits, in their order, is clear of all hits taken before it."""
    for batch in batches:
        out = []
        for starts, ends in zip(batch.column("starts").to_pylist(), batch.column("ends").to_pylist()):
            taken, taken_ends, keep = [], [], []
            for a, b in zip(starts, ends):
                k = bisect.bisect_right(taken, a)
                free = (k == 0 or taken_ends[k - 1] <= a) and (k == len(taken) or taken[k] >= b)
                keep.append(free)
                if free:
                    taken.insert(k, a)
                    taken_ends.insert(k, b)
            out.append(keep)
        yield pa.RecordBatch.from_arrays([*[c for n, c in zip(batch.schema.names, batch.columns) if n not in ("starts", "ends")], pa.array(out, pa.list_(pa.bool_()))], names=[*[n for n in batch.schema.names if n not in ("starts", "ends")], "keep"])


def scan_sensitive(df: DataFrame, patterns=PATTERNS, key: str = "doc_id", text: str = "text", low_entropy: bool = False, least_confidence: float = 0.7) -> DataFrame:
    """(key, type, start, end, hash, confidence): hits in the order of the patterns, then of place, unless one taken before overlaps.

    Confidence is 1, halved below the least entropy (such hits only count with low_entropy), and .2 more for some kinds.
    Which hits are taken depends on those before, one after the other, so that step runs in Arrow batches over texts with hits.
    """
    rows = _with_hits(df, patterns, key, text, low_entropy).filter(F.size("hits") > 0)
    confidence = lambda h: F.least(F.lit(1.0), F.when(h["sure"], 1.0).otherwise(0.5) + F.when(h["type"].isin(*SURE), 0.2).otherwise(0.0))
    rows = rows.withColumn("hits", F.filter("hits", lambda h: (F.length(h["found"]) > 0) & (confidence(h) >= least_confidence)))
    rows = rows.withColumns({"starts": F.transform("hits", lambda h: h["start"]), "ends": F.transform("hits", lambda h: h["end"])})
    kept = rows.mapInArrow(_apart, f"`{key}` {dict(df.dtypes)[key]}, hits {dict(rows.dtypes)['hits']}, keep array<boolean>")
    found = kept.select(key, F.explode(F.arrays_zip("hits", "keep")).alias("x")).filter("x.keep").select(key, F.col("x.hits").alias("h"))
    return found.select(key, "h.type", "h.start", "h.end", F.substring(F.sha2("h.found", 256), 1, 16).alias("hash"), confidence(F.col("h")).alias("confidence"))


def sensitive_stats(found: DataFrame) -> DataFrame:
    """(type, n, chars, share): share of all hits in per cent."""
    by_type = found.groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("chars"))
    return by_type.withColumn("share", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1))), 2))  # one row for each type
