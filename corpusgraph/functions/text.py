"""Column expressions over text, used by the table jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no content in lexical search
STOP_WORDS = """a an and are as at be been being but by can could did do does doing done each for from had has have having he her
him his how i if in is it its itself just me more my no not of off on or our out own same she should so some such than that the
their them then there these they this those to too very was we were what when where which while who whom why will with would you
your yours""".split()

# Phrases that open a question without saying anything
OPENING_PHRASES = [
    "show me", "what is", "what are", "can you find", "search for", "look for", "find", "display", "list", "tell me about", "give me",
    "bring up", "what do we know about", "what can we see from", "how about", "describe", "explain",
]

# Conversational questions and the group that holds their subject
REWRITES = [
    (r"(?i)what is the (latest|current|recent) (.+)", "$2"),
    (r"(?i)tell me about (.+)", "$1"),
    (r"(?i)how is (.+) doing", "$1"),
    (r"(?i)what's happening with (.+)", "$1"),
    (r"(?i)what do you know about (.+)", "$1"),
    (r"(?i)explain (.+)", "$1"),
    (r"(?i)describe (.+)", "$1"),
    (r"(?i)summarize (.+)", "$1"),
]

# Names of months
MONTHS = "january february march april may june july august september october november december".split()

# Signal words of each intent and their weight
INTENT_SIGNALS = {
    "emotional": (2, ["feel", "feeling", "tired", "frustrated", "happy", "sad", "angry", "anxious", "stressed", "burned", "burnout", "overwhelmed", "excited", "hopeful", "lost", "stuck"]),
    "temporal": (2, ["when", "recently", "lately", "last", "yesterday", "today", "this week", "this month", "ago", "since", "between", "before", "after"]),
    "relational": (1, ["and", "with", "told", "said", "met", "called", "texted", "about", "between"]),
    "creative": (2, ["idea", "brainstorm", "imagine", "what if", "could we", "design", "build", "create", "invent", "explore"]),
}


def words(text: Column) -> Column:
    """Lower-case runs of ASCII letters and digits."""
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def running_sums(sizes: Column, block: int = 256) -> Column:
    """Sums of an array up to and including each element: within blocks first, then over the blocks."""
    zero = F.lit(0).cast("long")
    last = lambda a: F.coalesce(F.get(a, F.size(a) - 1), zero)
    within = lambda part: F.aggregate(part, F.array().cast("array<bigint>"), lambda a, y: F.concat(a, F.array(last(a) + y)))
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int"))), lambda k: within(F.slice(sizes, k * block + 1, F.lit(block))))
    start = F.struct(zero.alias("at"), F.array().cast("array<array<bigint>>").alias("out"))
    step = lambda a, b: F.struct((a["at"] + last(b)).alias("at"), F.concat(a["out"], F.array(F.transform(b, lambda x: x + a["at"]))).alias("out"))
    return F.aggregate(blocks, start, step, lambda a: F.flatten(a["out"]))


def fts_tokens(text: Column) -> Column:
    """Lower-case words after everything but letters, digits and white space became blanks."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(text, r"[^a-zA-Z0-9\s]", " "), r"\s+", " "))
    return F.array_remove(F.split(F.lower(plain), " "), "")


def content_terms(tokens: Column) -> Column:
    """Tokens without stop words, or all of them if nothing else is left."""
    kept = F.array_except(tokens, F.array(*[F.lit(w) for w in STOP_WORDS]))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array_distinct(tokens))


def expand_camel(term: Column) -> Column:
    """The lower-case term and its camel-case and acronym parts of two letters or more."""
    apart = F.regexp_replace(F.regexp_replace(term, "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2")
    parts = F.filter(F.split(F.lower(apart), r"[ _-]+"), lambda p: F.length(p) > 1)
    return F.array_distinct(F.concat(F.array(F.lower(term)), parts))


def query_chunks(text: Column, size: int = 15) -> Column:
    """Sentences; for a single one its parts between commas, semicolons and colons; for a single part pieces of `size` words."""
    full = lambda parts: F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")
    sentences, parts = full(F.split(text, "[.!?]+")), full(F.split(text, "[,;:]+"))
    tokens = full(F.split(F.trim(text), r"\s+"))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size(tokens) / size).cast("int") - 1)), lambda i: F.array_join(F.slice(tokens, i * size + 1, size), " "))
    return F.when(F.size(sentences) > 1, sentences).when(F.size(parts) > 1, parts).otherwise(pieces)


def query_facets(text: Column) -> Column:
    """struct of phrases in quotes, @times, #buckets and the keywords that remain."""
    rest = F.regexp_replace(text, r'"[^"]*"|[@#][A-Za-z0-9_]+', " ")
    return F.struct(
        F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1)).alias("phrases"), F.regexp_extract_all(text, F.lit("@([A-Za-z0-9_]+)"), F.lit(1)).alias("times"),
        F.regexp_extract_all(text, F.lit("#([A-Za-z0-9_]+)"), F.lit(1)).alias("buckets"), words(rest).alias("keywords"),
    )


def key_terms(text: Column) -> Column:
    """Words that start upper case, years, and for short texts all content words; stands in for a part-of-speech model."""
    names = F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z][a-zA-Z0-9]{2,}\b"), F.lit(0)), lambda w: F.lower(w))
    years = F.regexp_extract_all(text, F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))
    content = F.filter(content_terms(words(text)), lambda w: F.length(w) > 2)
    return F.array_distinct(F.concat(F.array_except(names, F.array(*[F.lit(w) for w in STOP_WORDS])), years, F.when(F.size(words(text)) <= 10, content).otherwise(F.filter(content, lambda w: F.length(w) > 5))))


def strip_opening(text: Column) -> Column:
    """Removes opening phrases, longest first."""
    out = F.trim(text)
    for phrase in sorted(OPENING_PHRASES, key=lambda p: (-len(p), p)):
        out = F.regexp_replace(out, rf"(?i)^{phrase}\s+", "")
    return F.trim(out)


def conversational_rewrites(text: Column) -> Column:
    """Distinct rewritten forms of a conversational question."""
    forms = [F.when(text.rlike(p), F.trim(F.regexp_replace(text, p, to))) for p, to in REWRITES]
    return F.array_distinct(F.filter(F.array(*forms), lambda x: x.isNotNull() & (x != "")))


def strip_inline_tags(text: Column) -> Column:
    out = F.regexp_replace(text, '"#[A-Za-z0-9_:-]+"', "")
    out = F.regexp_replace(out, "##?[A-Za-z0-9_:-]+", "")
    out = F.regexp_replace(out, r"(?: - )+", " ")
    return F.trim(F.regexp_replace(out, " {2,}", " "))


def strip_tag_footer(text: Column) -> Column:
    """Removes the last lines if they hold nothing but ##Tokens."""
    return F.regexp_replace(text, r"(?:\n[ \t]*(?:##[A-Za-z0-9_]+[ \t]*)+)+\n*$", "")


def strip_artifacts(text: Column) -> Column:
    out = F.regexp_replace(text, "```[a-zA-Z]*", "")
    out = F.regexp_replace(out, r"(?m)^\s*//.*$", "")
    out = F.regexp_replace(out, r'\{[^{}]*"original"[^{}]*\}', "")
    out = F.regexp_replace(out, r"(?m)^\[[^\]]*\]\s*", "")
    out = F.trim(F.regexp_replace(out, r"token_count=\d+", ""))
    return F.when(out == "", F.lit("[REDACTED]")).otherwise(out)


def truncate_sentence(text: Column, n: int) -> Column:
    """At most n characters, cut at the last sentence end past the middle, else the last blank, with three dots."""
    part = F.substring(text, 1, n)
    sentence, word = F.regexp_extract(part, r"(?s)^(.*[.!?])", 1), F.regexp_extract(part, r"(?s)^(.*)\s", 1)
    cut = F.when(F.length(sentence) > n / 2, sentence).when(F.length(word) > 0, word).otherwise(part)
    return F.when(F.length(text) <= n, text).otherwise(F.concat(cut, F.lit("...")))


def normalize_line(line: Column, strict: bool = True) -> Column:
    """Trimmed; if strict also one blank for white space, lower case, without speaker and leading time."""
    out = F.regexp_replace(line, r"^\s+|\s+$", "")
    if strict:
        out = F.lower(F.regexp_replace(out, r"\s+", " "))
        for pattern in (r"^user:\s*", r"^assistant:\s*", r"^\[?\d{4}-\d{2}-\d{2}[\st]\d{2}:\d{2}:\d{2}\]?\s*", r"^\[?\d{2}:\d{2}:\d{2}\]?\s*"):
            out = F.regexp_replace(out, pattern, "")
    return out


def norm_alnum(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.replace(F.replace(text, F.lit("\\n"), F.lit(" ")), F.lit("\\t"), F.lit(" "))), "[^a-z0-9]", "")


def path_parts(path: Column) -> Column:
    """struct of directory, file name, extension and id of a path."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    name = F.element_at(F.split(clean, "/"), -1)
    return F.struct(
        F.regexp_extract(clean, "^(.*)/", 1).alias("directory"), name.alias("name"), F.lower(F.regexp_extract(name, r"(\.[A-Za-z0-9]+)$", 1)).alias("extension"), F.substring(F.sha2(clean, 256), 1, 16).alias("id")
    )


def short_hash(text: Column, n: int = 12) -> Column:
    return F.substring(F.sha2(text, 256), 1, n)


def hamming(a: Column, b: Column) -> Column:
    """Differing bits of two 64-bit fingerprints; 64 if one is missing."""
    return F.coalesce(F.bit_count(a.bitwiseXOR(b)), F.lit(64))


def temporal_weight(hours: Column, rate: float = 1e-5) -> Column:
    return F.exp(-rate * F.greatest(hours, F.lit(0.0)))


def result_relevance(tags: Column, chars: Column, age_days: Column) -> Column:
    recency = F.when(age_days < 30, 0.1).when(age_days < 365, 0.05).otherwise(0.0)
    size = F.when(chars > 100, 0.1).otherwise(0.0) + F.when(chars > 500, 0.1).otherwise(0.0)
    return F.least(F.lit(1.0), 0.5 + F.least(F.lit(0.2), 0.02 * tags) + size + recency)


def lightweight_score(base: Column, term_share: Column, phrase: Column, tag_hits: Column, age_days: Column) -> Column:
    recency = F.greatest(F.lit(0.0), 0.2 * (1 - age_days / 30))
    return F.least(F.lit(1.0), 0.3 * base + 0.5 * term_share + F.when(phrase, 0.3).otherwise(0.0) + 0.1 * tag_hits + recency)


def first_date(text: Column, scan: int | None = 5000) -> Column:
    """The first ISO, else US, else written date of the first `scan` characters of a text, or of all with None."""
    part = text if scan is None else F.substring(text, 1, scan)
    found = []
    for pattern, template in ((r"\b(\d{4})[-/](\d{1,2})[-/](\d{1,2})\b", (1, 2, 3)), (r"\b(\d{1,2})[-/](\d{1,2})[-/](\d{4})\b", (3, 1, 2))):
        y, m, d = (F.regexp_extract(part, pattern, i) for i in template)
        found.append(F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd"))
    written = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2})(?:st|nd|rd|th)?,\s+(\d{4})\b"
    m, d, y = (F.regexp_extract(part, written, i) for i in (1, 2, 3))
    found.append(F.try_to_date(F.concat_ws("-", y, F.initcap(m), F.lpad(d, 2, "0")), "yyyy-MMM-dd"))
    return F.coalesce(*found)


def earliest_timestamp(text: Column) -> Column:
    """The earliest ISO date-time, ISO date of 2020 to 2099 or US date of a text."""
    stamps = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2})"), F.lit(1)), lambda s: F.try_to_timestamp(F.replace(s, F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm:ss")))
    days = F.transform(F.regexp_extract_all(text, F.lit(r"\b(20[2-9]\d-\d{2}-\d{2})\b"), F.lit(1)), lambda s: F.try_to_timestamp(s, F.lit("yyyy-MM-dd")))
    american = F.transform(F.regexp_extract_all(text, F.lit(r"\b(\d{1,2}/\d{1,2}/\d{4})\b"), F.lit(1)), lambda s: F.try_to_timestamp(s, F.lit("M/d/yyyy")))
    return F.array_min(F.filter(F.concat(stamps, days, american), lambda x: x.isNotNull()))


def temporal_years(text: Column, now_year: Column) -> Column:
    """Years that a question speaks of: the last N years, from one year to another, and those named."""
    n = F.least(F.lit(100), F.coalesce(F.regexp_extract(text, r"(?i)last\s+(\d{1,6})\s+years?", 1).try_cast("int"), F.lit(-1)))
    last = F.when(n >= 0, F.sequence(now_year - F.greatest(n, F.lit(0)), now_year)).otherwise(F.array().cast("array<int>"))
    y = [F.regexp_extract(text, r"(?i)\b(from|between)\s+(\d{4})\s+(to|and)\s+(\d{4})\b", i).try_cast("int") for i in (2, 4)]
    span = F.when(y[0].isNotNull(), F.sequence(F.least(*y), F.greatest(*y))).otherwise(F.array().cast("array<int>"))
    named = F.transform(F.regexp_extract_all(text, F.lit(r"\b(202[0-9]|203[0-9])\b"), F.lit(1)), lambda v: v.cast("int"))
    return F.array_sort(F.array_distinct(F.concat(last, span, named)))


def time_drift_label(minutes: Column) -> Column:
    unit = lambda n, u: F.concat(F.floor(n).cast("string"), F.lit(f"{u} ago"))
    return F.when(minutes < 60, unit(minutes, "m")).when(minutes < 1440, unit(minutes / 60, "h")).when(minutes < 43200, unit(minutes / 1440, "d")).when(minutes < 525600, unit(minutes / 43200, "mo")).otherwise(unit(minutes / 525600, "y"))


def numeric_value(text: Column) -> Column:
    """struct(value, unit): the last number with a unit, else the first without; bare years 1900 to 2100 don't count."""
    pairs = F.transform(
        F.regexp_extract_all(text, F.lit(r"[0-9][0-9,]*(?:\.[0-9]+)?[ ]?[A-Za-z%]*"), F.lit(0)),
        lambda m: F.struct(F.replace(F.regexp_extract(m, r"^([0-9][0-9,]*(?:\.[0-9]+)?)", 1), F.lit(","), F.lit("")).try_cast("double").alias("value"), F.nullif(F.regexp_extract(m, "([A-Za-z%]+)$", 1), F.lit("")).alias("unit")),
    )
    pairs = F.filter(pairs, lambda p: p["value"].isNotNull() & (p["unit"].isNotNull() | ~((p["value"] >= 1900) & (p["value"] <= 2100) & (p["value"] == F.floor(p["value"])))))
    with_unit = F.filter(pairs, lambda p: p["unit"].isNotNull())
    return F.when(F.size(with_unit) > 0, F.element_at(with_unit, -1)).when(F.size(pairs) > 0, pairs[0])


def token_count(text: Column, method: str = "chars") -> Column:
    if method == "words":
        return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
    if method == "words_and_marks":
        return F.size(F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9_]+|[^A-Za-z0-9_\s]"), F.lit(0)))
    return F.ceil(F.length(text) / 4).cast("int")


def normalize_tag(tag: Column) -> Column:
    """With a leading #, capitalised if all lower case and at most 20 long; null unless 2 to 50 long."""
    name = F.regexp_replace(F.trim(tag), "^#+", "")
    shown = F.when((name == F.lower(name)) & (F.length(name) <= 20), F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 100))).otherwise(name)
    return F.when(F.length(name).between(2, 50), F.concat(F.lit("#"), shown))


# Shapes of tags that say nothing - colours, short numbers, markup, code words, scraping leftovers
NOISE_TAG = (
    r"^#([0-9a-fA-F]{3,8}|\d{1,3}|_\w*|(btn|class|div|id|span|href|src|fn|elif|else|endif|ifdef|ifndef|include|define|pragma|bib|ref)\b.*"
    r"|(cite_note|cite_ref|amp_tf|details_of_atom|entry_lin|entry_links|entry_metadata|feed_metadata|opensearch_extension|extension_elements"
    r"|simple_examples|query_interface|api_response|response_example|appendix).*|examples?|overview|preface|appendices)$"
)


def is_noise_tag(tag: Column) -> Column:
    """Listed shapes, over 30 characters, or more than 70 % digits."""
    digits = F.length(F.regexp_replace(tag, "[^0-9]", ""))
    return tag.rlike(NOISE_TAG) | (F.length(tag) > 30) | (digits > 0.7 * F.length(tag))


def filter_tags(tags: Column) -> Column:
    return F.filter(tags, lambda x: ~is_noise_tag(x))


def modulate_tags(tags: Column, level: int, least: int = 3, most: int = 20) -> Column:
    """Drops noise and short tags, keeps a share of `level` per cent of all-lower-case tags by hash, at most `most`."""
    kept = F.filter(tags, lambda x: ~is_noise_tag(x) & (F.length(x) > least) & ((x != F.lower(x)) | (F.pmod(F.xxhash64(x), F.lit(100)) < level)))
    return F.slice(kept, 1, most)


def display_tags(tags: Column) -> Column:
    return F.filter(tags, lambda x: ~x.rlike("^#?[0-9]{4}$"))


def system_tags(path: Column) -> Column:
    has = lambda p, tag: F.when(F.lower(path).rlike(p), F.lit(tag))
    project = F.nullif(F.regexp_extract(path, "(?i)projects?/([^/]+)/", 1), F.lit(""))
    found = [F.concat(F.lit("#project:"), project), has("(^|/)src/", "#src"), has("(^|/)docs?/", "#docs"), has("(^|/)tests?/", "#test"), has(r"\.(ts|js|py|rs|go|cpp|h|c)$", "#code"), has(r"\.(md|txt)$", "#doc"), has(r"\.(json|ya?ml|toml)$", "#config"), has("archive", "#Archive")]
    return F.array_compact(F.array(*found))


def query_intent(text: Column) -> Column:
    """The intent with the most signals; factual counts 1, ties go by the order of INTENT_SIGNALS."""
    low = F.lower(text)
    scores = {name: weight * sum((low.contains(w).cast("int") for w in signals), F.lit(0)) for name, (weight, signals) in INTENT_SIGNALS.items()}
    best = F.greatest(F.lit(1), *scores.values())
    out = F.lit("factual")
    for name in reversed(list(scores)):
        out = F.when(scores[name] == best, name).otherwise(out)
    return out
