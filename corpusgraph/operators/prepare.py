"""Corpus preparation: clean, split, mine keywords, tag, and build the tag tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

# Named entities that are decoded
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&ndash;", "–"), ("&mdash;", "—"), ("&hellip;", "…"), ("&copy;", "©"), ("&amp;", "&")]

# Lines of terminal, installation and build logs
TRANSIENT = [
    r"(?i)Traceback \(most recent call last\)", "(?i)KeyError:", "(?i)TypeError:", "(?i)ValueError:", r"(?i)Error:.*at line \d+", "(?i)Exception in thread", "(?i)Fatal error:",
    "(?i)npm install", "(?i)pip install", "(?i)yarn add", "(?i)pnpm add", "(?i)Collecting [a-zA-Z0-9_-]+", "(?i)Downloading [a-zA-Z0-9_-]+", r"(?i)added \d+ package", "(?i)Successfully installed",
    "(?i)Build succeeded", "(?i)Build failed", r"(?i)Compiling\.\.\.", r"(?i)Linking\.\.\.", r"(?i)Generating\.\.\.",
    r"^\[\d{4}-\d{2}-\d{2}.*\]$", "^={50,}$", "^-{50,}$",
]

# File names of the engine's own output
SELF_OUTPUT = "(?i)(^|/)((master_)?distilled_|[^/]*_distilled_)[^/]*$"

EMAIL, IPV4, API_KEY = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "sk-[a-zA-Z0-9]{32,}"


def decode_entities(text: Column) -> Column:
    for name, char in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(char))
    return text


def composed(text: Column) -> Column:
    """Numeric entities and Unicode composition, which have no built-in function, on Arrow batches."""

    def run(texts: pd.Series) -> pd.Series:
        import html
        import unicodedata

        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", html.unescape(t) if "&#" in t else t))

    return F.pandas_udf(run, "string")(text)


def clean_text(text: Column, boilerplate: bool = True, unicode: bool = False) -> Column:
    """Text of a page: no scripts, styles, navigation or tags; entities decoded; blanks and empty lines collapsed."""
    out = F.regexp_replace(text, r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    if boilerplate:
        out = F.regexp_replace(out, r"(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>", "")
    out = decode_entities(F.regexp_replace(out, "<[^>]*>", " "))
    if unicode:
        out = composed(out)
    out = F.regexp_replace(out, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    out = F.regexp_replace(out, r"\r\n?", "\n")
    out = F.regexp_replace(F.regexp_replace(out, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.regexp_replace(out, r"^\s+|\s+$", "")


def clean_documents(df: DataFrame, text: str = "text", boilerplate: bool = True, unicode: bool = True) -> DataFrame:
    return df.withColumn(text, clean_text(F.col(text), boilerplate, unicode))


def redact(text: Column) -> Column:
    out = F.regexp_replace(text, EMAIL, "[EMAIL_REDACTED]")
    return F.regexp_replace(F.regexp_replace(out, IPV4, "[IP_REDACTED]"), API_KEY, "sk-[REDACTED]")


def sanitize(text: Column) -> Column:
    """Line ends, log noise, masks for personal data, speaker marks and the engine's own result fields."""
    out = F.replace(F.regexp_replace(text, "^﻿|[\u0000�]", ""), F.lit("\\r\\n"), F.lit("\n"))
    out = F.replace(out, F.lit("\r\n"), F.lit("\n"))
    for verb in ("Processing", "Loading", "Indexing", "Analyzing"):
        out = F.regexp_replace(out, rf"(?:^|\s|\.\.\.\s*){verb} '[^']+'\.\.\.", "\n")
    out = F.regexp_replace(out, r"(?m)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{3})?\s*(?:AM|PM)?\s*[-:>]", "")
    out = redact(F.regexp_replace(out, r"\[\d{4}-\d{2}-\d{2}.*?\]", ""))
    out = F.regexp_replace(out, r"<\|(?:user|assistant|system)\|>", "")
    out = F.regexp_replace(out, r"score:\s*\d+(?:\.\d+)?|(?:start|end)_byte:\s*\d+\s*,?|is_inflated:\s*(?:true|false)\s*,?|virtual_mem_[a-f0-9_]+", "")
    return F.regexp_replace(F.regexp_replace(out, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def sanitize_documents(df: DataFrame, text: str = "text") -> DataFrame:
    return df.withColumn(text, sanitize(F.col(text)))


def transient_ids(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Ids of texts of 5 lines or more in which pattern hits exceed half of the lines."""
    lines = F.split(text, "\n")
    hits = F.aggregate(lines, F.lit(0), lambda n, line: n + sum((F.coalesce(line.rlike(p), F.lit(False)).cast("int") for p in TRANSIENT), F.lit(0)))
    likely = df.filter(F.size(lines) >= 5).filter(F.col(text).rlike("|".join(f"(?m:{p})" if not p.startswith("(?i)") else f"(?i:{p[4:]})" for p in TRANSIENT)))
    return likely.filter(hits > 0.5 * F.size(lines)).select(key)


def drop_transient(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return df.join(transient_ids(df, key, text), key, "left_anti")


def drop_self_output(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(~F.col(path).rlike(SELF_OUTPUT))


def detect_type(text: Column, path: Column) -> Column:
    trimmed = F.regexp_replace(text, r"^\s+", "")
    return (
        F.when(path.rlike(r"\.(csv|json|ya?ml)$"), "data").when(path.rlike(r"\.(ts|js|py|rs|go|cpp|h|c)$"), "code").when(F.length(text) >= 1 << 20, "data")
        .when(trimmed.startswith("|"), "data").when(text.contains("```") | text.contains("function ") | text.contains("const ") | text.contains("import "), "code").otherwise("prose")
    )


def split_molecules(df: DataFrame, key: str = "doc_id", text: str = "text", kind: str = "prose", keep: Iterable[str] = ()) -> DataFrame:
    """(key, *keep, mol_id, seq, content, start_byte, end_byte): sentences of prose, or non-empty lines of data.

    A sentence ends at . ! or ? before white space and an upper-case ASCII letter. Byte ranges are exact:
    the slice of the UTF-8 text is the content. Texts are cut in place, without a shuffle.
    """
    border = r"(?<=[.!?])(?=\s+[A-Z])" if kind == "prose" else r"(?<!\n)(?=\n+[^\n])"
    rows = df.select(key, *keep, F.split(text, border, -1).alias("piece"))
    rows = rows.withColumn("end_byte", T.running_sums(F.transform("piece", lambda p: F.octet_length(p).cast("long"))))
    rows = rows.select(key, *keep, F.posexplode(F.arrays_zip("piece", "end_byte")).alias("seq", "x")).select(key, *keep, F.col("seq").cast("long").alias("seq"), "x.piece", "x.end_byte")
    stripped = F.regexp_replace("piece", r"^\s+" if kind == "prose" else "^\n+", "")
    content = F.when(F.col("seq") == 0, F.col("piece")).otherwise(stripped) if kind == "prose" else stripped
    out = rows.withColumn("content", content).filter(F.col("content").rlike(r"\S"))
    start = (F.col("end_byte") - F.octet_length("content")).cast("long").alias("start_byte")
    return out.select(key, *keep, F.concat_ws(":", F.col(key).cast("string"), F.col("seq").cast("string")).alias("mol_id"), "seq", "content", start, "end_byte")


def split_code(df: DataFrame, key: str = "doc_id", text: str = "text", most_bytes: int = 1024) -> DataFrame:
    """(key, seq, content, start_byte, end_byte) of code: blocks that end where braces are closed and a blank line follows.

    Blocks over most_bytes are cut again at line ends. One text at a time, in Arrow batches.
    """

    def pieces(source: str) -> Iterator[tuple[str, int, int]]:
        block, depth, start, at = [], 0, 0, 0
        for line in source.splitlines(keepends=True):
            size = len(line.encode())
            if block and (depth <= 0 and not line.strip() or at - start + size > most_bytes):
                yield "".join(block), start, at
                block, start = [], at
            block.append(line)
            depth += line.count("{") - line.count("}")
            at += size
        if block:
            yield "".join(block), start, at

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, *p) for k, t in zip(batch[key], batch[text]) for i, p in enumerate(p for p in pieces(t or "") if p[0].strip())]
            yield pd.DataFrame(rows, columns=[key, "seq", "content", "start_byte", "end_byte"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, seq long, content string, start_byte long, end_byte long")


def split_semantic(df: DataFrame, key: str = "doc_id", text: str = "text", most: int = 500, least: int = 10) -> DataFrame:
    """(key, seq, content, hash): paragraphs; those over `most` characters are packed greedily from sentences."""

    def packed(paragraph: str) -> Iterator[str]:
        if len(paragraph) <= most:
            yield paragraph
            return
        import re

        held = ""
        for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
            if held and len(held) + 1 + len(sentence) > most:
                yield held
                held = sentence
            else:
                held = f"{held} {sentence}" if held else sentence
        if held:
            yield held

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import re

        for batch in batches:
            rows = []
            for k, t in zip(batch[key], batch[text]):
                parts = [p.strip() for q in re.split(r"\n\s*\n", t or "") for p in packed(q.strip())]
                rows += [(k, i, p) for i, p in enumerate(p for p in parts if len(p) > least)]
            yield pd.DataFrame(rows, columns=[key, "seq", "content"])

    return df.select(key, text).mapInPandas(run, f"{key} {dict(df.dtypes)[key]}, seq long, content string").withColumn("hash", F.sha2("content", 256))


def mine_keywords(df: DataFrame, text: str = "text", least: int = 3, most: int = 200) -> DataFrame:
    """(keyword, n): the most frequent words of 3 letters or more and pairs of neighbours, of the whole corpus."""
    fit = lambda c: (F.length(c) >= 3) & ~c.isin(T.STOP_WORDS)
    rows = df.select(T.words(F.col(text)).alias("w")).select(F.explode(F.arrays_zip("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))).alias("after"))).alias("p")).select("p.*")
    alone = F.lit(None).cast("string")  # each word counts by itself and with the next: one shuffle of both kinds, counted by task
    rows = rows.filter(fit(F.col("w"))).select("w", F.explode(F.when(fit(F.col("after")), F.array(alone, "after")).otherwise(F.array(alone))).alias("after"))
    counted = rows.groupBy("w", "after").agg(F.count("*").alias("n")).filter(F.col("after").isNotNull() | ~F.col("w").rlike("^[0-9]+$"))
    counted = counted.select(F.concat_ws("-", "w", "after").alias("keyword"), "n")
    pair = F.contains(F.col("keyword"), F.lit("-"))
    ranked = counted.filter((F.col("n") >= least) | pair & (F.col("n") >= 2)).withColumn("pair", pair)
    ranked = ranked.withColumn("k", F.row_number().over(Window.partitionBy("pair").orderBy(F.col("n").desc(), "keyword")))
    return ranked.filter(F.col("k") <= most).filter(~F.col("pair") | (F.col("k") <= most // 2)).select("keyword", "n")


def tag_by_keywords(molecules: DataFrame, keywords: DataFrame, key: str = "mol_id", content: str = "content", keep: Iterable[str] = ()) -> DataFrame:
    """(key, *keep, tag): keywords by equality with words, or pairs `a-b` with neighbouring words; years 1900 to 2099; months.

    Rows come dealt by key, so what is made of a molecule's tags needs no other shuffle. Tables of few keywords should
    come with a broadcast; then only tags are shuffled, no words.
    """
    rows = molecules.select(key, *keep, content, T.words(F.col(content)).alias("w"))
    pairs = F.zip_with("w", F.slice("w", F.lit(2), F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit("-"), b))  # null behind the last
    years = F.regexp_extract_all(content, F.lit(r"\b((?:19|20)[0-9]{2})\b"), F.lit(1))
    months = F.transform(F.array_intersect("w", F.array(*[F.lit(m) for m in T.MONTHS])), lambda m: F.initcap(m))
    times = F.transform(F.concat(years, months), lambda x: F.concat(F.lit("\0"), x))  # marked: no word has such a character
    tokens = rows.select(key, *keep, F.explode(F.concat("w", pairs, times)).alias("_token"))
    known = tokens.join(keywords.select(F.col("keyword").alias("_token"), F.lit(True).alias("_known")), "_token", "left")
    found = known.filter(F.col("_known") | F.startswith("_token", F.lit("\0")))
    return found.select(key, *keep, F.concat(F.lit("#"), F.ltrim("_token", F.lit("\0"))).alias("tag")).repartition(key).distinct()


def scan_labels(molecules: DataFrame, key: str = "mol_id", content: str = "content") -> DataFrame:
    """(key, tag) of hash tags written in the text, without noise."""
    found = molecules.select(key, F.explode(F.array_distinct(F.regexp_extract_all(content, F.lit("#[A-Za-z][A-Za-z0-9_]{1,29}"), F.lit(0)))).alias("tag"))
    return found.filter(~T.is_noise_tag(F.col("tag")))


def build_tag_tables(molecules: DataFrame, tagged: DataFrame, bucket: str = "bucket") -> dict[str, DataFrame]:
    """labels, tags, edges and positions. molecules: mol_id, compound_id, bucket, start_byte, end_byte; tagged: mol_id, tag.

    If tagged has the columns of molecules too, they need not be joined again.
    """
    columns = ["compound_id", bucket, "start_byte", "end_byte"]
    joined = tagged if set(columns) <= set(tagged.columns) else tagged.join(molecules.select("mol_id", *columns), "mol_id")
    labels = tagged.select("tag").distinct().select(F.concat(F.lit("atom_"), T.short_hash(F.col("tag"))).alias("label_id"), "tag")
    tags = joined.select(F.col("mol_id").alias("node_id"), "tag", F.col(bucket).alias("bucket")).distinct()
    edges = joined.select(F.col("compound_id").alias("source_id"), F.concat(F.lit("atom_"), T.short_hash(F.col("tag"))).alias("target_id")).distinct().withColumns({"relation": F.lit("has_tag"), "weight": F.lit(1.0)})
    positions = joined.select("compound_id", F.col("tag").alias("label"), F.floor((F.col("start_byte") + F.col("end_byte")) / 2).cast("long").alias("byte_offset")).distinct()
    return {"labels": labels, "tags": tags, "edges": edges, "positions": positions}


def reindex_tags(nodes: DataFrame) -> DataFrame:
    """(node_id, tag, bucket) from arrays of tags and buckets."""
    return nodes.select("node_id", F.explode("tags").alias("tag"), "buckets").select("node_id", "tag", F.explode("buckets").alias("bucket")).distinct()


def chat_documents(rows: DataFrame, least: int = 100) -> DataFrame:
    """(conv_id, text): the turns of a conversation as `[User]: ...` lines; empty system turns go, short ones too."""
    name = F.initcap("role")
    said = rows.filter("text is not null and trim(text) <> ''").select("conv_id", "turn", F.concat(F.lit("["), name, F.lit("]: "), F.col("text")).alias("line"))
    joined = said.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n\n").alias("text"))
    return joined.filter(F.length("text") >= least)


def web_page_documents(pages: DataFrame) -> DataFrame:
    """(page_id, title, description, body, document) of raw pages."""
    html = F.col("html")
    title = decode_entities(F.trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1)))
    description = decode_entities(F.regexp_extract(html, """(?is)<meta[^>]+name=["']description["'][^>]*content=["'](.*?)["']""", 1))
    part = lambda tag: F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*)</{tag}>", 1), F.lit(""))
    body = clean_text(F.coalesce(part("main"), part("article"), part("body"), html))
    out = pages.select("page_id", "url", title.alias("title"), description.alias("description"), body.alias("body"))
    return out.withColumn("document", F.concat_ws("\n", F.concat(F.lit("# "), "title"), F.concat(F.lit("Source: "), "url"), F.lit(""), F.col("body")))


def commit_log_documents(commits: DataFrame) -> DataFrame:
    """(repo, document): commits of a repository, newest first, as Markdown. For repositories of bounded history."""
    line = F.format_string("## %s\n\n%s - %s\n\n%s", F.substring("sha", 1, 7), F.col("author"), F.date_format("ts", "yyyy-MM-dd"), F.col("message"))
    rows = commits.select("repo", F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("k"), "sha", line.alias("line")).alias("r"))
    return rows.groupBy("repo").agg(F.concat(F.lit("# "), F.first("repo"), F.lit("\n\n"), F.array_join(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["line"]), "\n\n")).alias("document"))


def entity_mentions(df: DataFrame, names: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, mentions) of listed one-word names."""
    tokens = df.select(key, F.explode(T.words(F.col(text))).alias("entity")).filter(F.col("entity").isin([n.lower() for n in names]))
    return tokens.groupBy(key, "entity").agg(F.count("*").alias("mentions"))


def entity_atoms(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, kind, tag): capitalised words by rules - all capitals or digits inside technical, years date, else concept."""
    found = df.select(key, F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)))).alias("entity"))
    found = found.filter(F.col("entity").rlike("^([A-Z][A-Za-z0-9]{3,}|(19|20)[0-9]{2})$"))
    kind = F.when(F.col("entity").rlike("^(19|20)[0-9]{2}$"), "date").when(F.col("entity").rlike("^[A-Z0-9]+$|[0-9]"), "technical").otherwise("concept")
    return found.withColumn("kind", kind).withColumn("tag", F.concat(F.lit("entity:"), F.lower("entity")))


def semantic_categories(df: DataFrame, rules: DataFrame, key: str = "doc_id", text: str = "text", least: int = 1) -> DataFrame:
    """(key, category, hits): categories with triggers in the text. rules: category, trigger (single words)."""
    tokens = df.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("trigger"))
    return tokens.join(rules.select("category", F.lower("trigger").alias("trigger")).distinct(), "trigger").groupBy(key, "category").agg(F.count("*").alias("hits")).filter(F.col("hits") >= least)


def by_category(df: DataFrame, category: str, tags: str = "tags") -> DataFrame:
    return df.filter(F.array_contains(tags, category))


def by_entities(df: DataFrame, entities: list[str], every: bool = False, tags: str = "tags") -> DataFrame:
    hits = [F.array_contains(tags, f"entity:{e.lower()}") for e in entities]
    out = hits[0]
    for h in hits[1:]:
        out = (out & h) if every else (out | h)
    return df.filter(out)


def relationship_molecules(df: DataFrame, entities: list[str], tags: str = "tags") -> DataFrame:
    return by_category(by_entities(df, entities, True, tags), "#Relationship", tags)
