"""Names in texts by kind, and categories of texts by rules over triggers and kinds.

Triggers, exclusions and time references are tested inside a row, so a text is never shuffled: what is joined are
flags of a document and the numbers of its names by kind.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# Words that are no names, even where they begin with a capital
COMMON = """the a an and or but in on at to for of with by is are was were be been being have has had do does did will would could should
may might must can shall this that these those""".split()

# Titles before persons, words of places
TITLES = ["Mr", "Mrs", "Ms", "Dr", "Prof"]
PLACE_WORDS = "city town state country street avenue road building boulevard lane drive court place".split()

# Technical terms
TECHNICAL = """typescript javascript api database function class method variable algorithm cozodb electron react vite graphql rest json xml
html css sql nosql mongodb postgresql mysql redis docker kubernetes aws azure gcp""".split()

# A capitalised run of words; one that stands inside a sentence, after a small letter, a digit or a comma, or after a title
RUN = r"\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*"
INSIDE = r"[\p{Ll}\p{N},;:)] (\p{Lu}\p{L}+(?: \p{Lu}\p{L}+)*)"
TITLED = rf"(?:{'|'.join(TITLES)})\. (\p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)*)"
YEAR = r"\b((?:19|20)[0-9]{2})\b"


@dataclass(frozen=True)
class Rule:
    """A category of texts that hold a trigger, a name of a required kind if any is asked for, and no exclusion."""

    category: str
    triggers: Sequence[str]
    required: Sequence[str] = ()
    exclusions: Sequence[str] = ()


# The rules
RULES = [
    Rule("#Relationship", ["and", "with", "met", "told", "said to", "spoke to", "visited", "called", "texted", "together", "relationship", "friend", "partner", "love", "missed", "cared about", "knows", "introduced to", "about"], ["person"]),
    Rule("#Narrative", ["when", "then", "later", "before", "after", "during", "while", "first", "next", "finally", "meanwhile", "eventually", "suddenly", "it was", "there was", "once upon", "story", "remember", "recall", "yesterday", "today", "tomorrow", "morning", "afternoon", "evening", "night"], ["person", "date"]),
    Rule("#Technical", ["function", "class", "method", "variable", "code", "algorithm", "api", "endpoint", "database", "server", "client", "library", "framework", "module", "component", "system", "architecture", "node.js", "typescript", "cozodb", "rag", "vector", "embedding"], ["technical"]),
    Rule("#Industry", ["market", "industry", "company", "business", "finance", "economy", "oil", "gas", "energy", "seismic", "co2", "sequestration", "production", "drilling", "reservoir", "pipeline", "refinery", "barrel", "bpd", "mboed", "upstream", "midstream", "downstream"], ["concept"]),
    Rule("#Location", ["in", "at", "near", "by", "around", "beside", "between", "within", "city", "town", "country", "state", "street", "building", "room", "address", "coordinates", "region", "area", "district", "zone", "albuquerque", "bernalillo", "sandia", "los alamos", "texas", "new mexico"], ["place"]),
    Rule("#Emotional", ["happy", "sad", "angry", "excited", "frustrated", "anxious", "joy", "fear", "love", "hate", "regret", "hope", "despair", "grateful", "felt", "emotions", "feelings", "heart", "soul", "spirit", "lonely", "connected", "isolated", "supported", "understood"]),
]

# References to time in a lower-case text, code, and turns of a conversation
TIME = r"\b[0-9]{4}\b|yesterday|today|tomorrow|morning|afternoon|evening|night|january|february|march|april|may|june|july|august|september|october|november|december|monday|tuesday|wednesday|thursday|friday|saturday|sunday"
CODE = r"(?s)```.*?```|`[^`]*`|function\s+[A-Za-z0-9_]+\s*\(|class\s+[A-Za-z0-9_]+|import\s+[A-Za-z0-9_]+|const\s+[A-Za-z0-9_]+\s*="
CHAT = r"(?i)(^|\n)(> )?(User|Human|Assistant|AI|System|Me|You):|(^|\n)\[[0-9]{2}:[0-9]{2}\]"


def any_of(words: Sequence[str]) -> str:
    """A pattern of a lower-case text that holds one of the words, wherever it stands."""
    import re

    return "|".join(re.sub(r"([^a-z0-9 ])", r"\\\1", w.lower()) for w in words)


def kind_of(name: Column, titled: Column) -> Column:
    """date, technical, person (titled), place, concept (all capitals) or person."""
    low = F.lower(name)
    return (
        F.when(low.isin(T.MONTHS) | name.rlike("^(19|20)[0-9]{2}$"), "date").when(low.isin(TECHNICAL), "technical").when(titled, "person")
        .when(F.arrays_overlap(F.split(low, " "), F.array(*[F.lit(w) for w in PLACE_WORDS])), "place").when(name == F.upper(name), "concept").otherwise("person")
    )


def named_entities(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = 2) -> DataFrame:
    """(key, entity, kind, tag) of the names of each text, years, and technical terms.

    A capitalised run is a name if `least` texts have it inside a sentence, where a capital isn't owed to the
    sentence's beginning, or if it follows a title; then its other places count too. A name that follows a title anywhere is a
    person everywhere. Names are found in one pass, counted by partial aggregates and joined with their occurrences by name.
    Null and empty texts have none.
    """
    listed = lambda pattern, group: F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group)))
    found = df.select(key, listed(RUN, 0).alias("runs"), listed(INSIDE, 1).alias("inside"), listed(TITLED, 1).alias("titled"), listed(YEAR, 1).alias("years"), F.array_intersect(T.words(F.col(text)), F.array(*[F.lit(w) for w in TECHNICAL])).alias("terms"))
    every = F.array_distinct(F.concat("runs", "titled"))
    runs = found.select(key, F.explode(F.transform(every, lambda r: F.struct(r.alias("entity"), F.array_contains("inside", r).alias("inside"), F.array_contains("titled", r).alias("titled")))).alias("r")).select(key, "r.*")
    runs = runs.filter(~F.lower("entity").isin(COMMON))
    known = runs.groupBy("entity").agg(F.sum(F.col("inside").cast("long")).alias("n"), F.max("titled").alias("titled")).filter((F.col("n") >= least) | F.col("titled"))
    names = runs.select(key, "entity").distinct().join(known.select("entity", "titled"), "entity").select(key, "entity", "titled")
    others = found.select(key, F.explode(F.concat("years", "terms")).alias("entity")).select(key, "entity", F.lit(False).alias("titled"))
    out = names.unionByName(others).select(key, "entity", kind_of(F.col("entity"), F.col("titled")).alias("kind")).distinct()
    return out.withColumn("tag", F.concat(F.lit("entity:"), F.lower("entity")))


KINDS = ["person", "place", "technical", "date", "concept"]


def derived_categories(df: DataFrame, entities: DataFrame, rules: Sequence[Rule] = RULES, key: str = "doc_id", text: str = "text", people: int = 2) -> DataFrame:
    """(key, category): the rules that a text meets, and what follows from its names.

    `people` persons or more make a relationship, a person and a reference to time a narrative, a technical term
    makes it technical, code marks it code, and turns of a conversation a narrative. entities: key, entity, kind. A null text has no category
    by rules, but its entities count. Keys are unique in df; rows of a null key have no entities.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    flags = [low.rlike(any_of(r.triggers)) & (~low.rlike(any_of(r.exclusions)) if r.exclusions else F.lit(True)) for r in rules]
    own = df.select(key, *[f.alias(f"rule{i}") for i, f in enumerate(flags)], low.rlike(TIME).alias("time"), F.coalesce(F.col(text).rlike(CODE), F.lit(False)).alias("code"), F.coalesce(F.col(text).rlike(CHAT), F.lit(False)).alias("chat"))
    counts = entities.select(key, "entity", "kind").distinct().groupBy(key).agg(*[F.count_if(F.col("kind") == k).alias(k) for k in KINDS])
    met = own.join(counts, key, "left").fillna(0, KINDS)
    some = lambda kinds: F.greatest(F.lit(0), F.lit(0), *[F.col(k) for k in kinds]) > 0
    named = [F.when(F.col(f"rule{i}") & (some(r.required) if r.required else F.lit(True)), r.category) for i, r in enumerate(rules)]
    follow = [F.when(F.col("person") >= people, "#Relationship"), F.when((F.col("person") > 0) & F.col("time") | F.col("chat"), "#Narrative"), F.when(F.col("technical") > 0, "#Technical"), F.when(F.col("code"), "#Code")]
    return met.select(key, F.explode(F.array_distinct(F.array_compact(F.array(*named, *follow)))).alias("category"))


def related_by_category(categories: DataFrame, entities: DataFrame, names: Sequence[str], category: str = "#Relationship", key: str = "doc_id") -> DataFrame:
    """(key) of texts of the category that hold every one of the names: a division of the entities by the list."""
    wanted = sorted({n.lower() for n in names})
    held = entities.filter(F.lower("entity").isin(wanted)).groupBy(key).agg(F.count_distinct(F.lower("entity")).alias("n")).filter(F.col("n") == len(wanted))
    return held.select(key).join(categories.filter(F.col("category") == category).select(key).distinct(), key, "left_semi")
