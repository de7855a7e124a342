"""Tag and synonym mining."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .dedup import near_duplicates
from .graph import tag_clusters, tag_cooccurrence
from .positions import stored
from .retrieve import BATCH_ROWS, to_tasks
from .tagstats import orphan_tags, tag_statistics
from .windows import top_k


def synonyms_by_tags(tags: DataFrame, least_nodes: int = 2, least: float = 0.5, most: int | None = 500) -> DataFrame:
    """(a, b, score): tags whose node sets have a Jaccard similarity of `least` or more."""
    own = tags.select("node_id", "tag").distinct()
    uses = own.groupBy("tag").agg(F.count("*").alias("n")).filter(F.col("n") >= least_nodes)
    if most:
        uses = uses.orderBy(F.col("n").desc(), "tag").limit(most)
    pairs = tag_cooccurrence(own.join(uses.select("tag"), "tag", "left_semi"), 1, None).withColumnRenamed("n", "both")
    scored = pairs.join(uses.select(F.col("tag").alias("a"), F.col("n").alias("x")), "a").join(uses.select(F.col("tag").alias("b"), F.col("n").alias("y")), "b")
    return scored.select("a", "b", F.round(F.col("both") / (F.col("x") + F.col("y") - F.col("both")), 6).alias("score")).filter(F.col("score") >= least)


def synonyms_by_simhash(prints: DataFrame, texts: DataFrame, distance: int = 8, k: int = 20, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n): terms that stand in one of two near texts each but not in both, the k most frequent of a term.

    n counts all pairs of texts. Texts of one fingerprint and the same terms are one row with their number; rows of
    two near fingerprints, or of one, are paired, and a pair counts as the product of the numbers.
    """
    pairs, members = near_duplicates(prints, distance, key)
    terms = texts.select(F.col(key), F.array_sort(F.filter(F.array_distinct(T.words(F.col(text))), lambda w: (F.length(w) >= 4) & ~w.isin(T.STOP_WORDS))).alias("w"))
    own = members.join(terms, key).groupBy("rep", "w").agg(F.count("*").alias("m"))
    left, right = own.select(F.col("rep").alias("a"), F.col("w").alias("x"), F.col("m").alias("mx")), own.select(F.col("rep").alias("b"), F.col("w").alias("y"), F.col("m").alias("my"))
    between = pairs.select("a", "b").join(left, "a").join(right, "b").select("x", "y", "mx", "my")
    within = left.join(right, F.col("a") == F.col("b")).filter("x < y").select("x", "y", "mx", "my")
    apart = between.unionByName(within).groupBy("x", "y").agg(F.sum(F.col("mx") * F.col("my")).alias("m"))
    apart = apart.select(F.array_except("x", "y").alias("x"), F.array_except("y", "x").alias("y"), "m")
    met = apart.select(F.explode("x").alias("p"), "y", "m").select("p", F.explode("y").alias("q"), "m")
    counted = met.groupBy(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).agg(F.sum("m").alias("n"))
    return top_k(counted, ["a"], [F.col("n").desc(), "b"], k)


def synonyms_by_cooccurrence(molecules: DataFrame, support: int = 5, least_chars: int = 5, content: str = "content", key: str = "mol_id", asked: DataFrame | None = None) -> DataFrame:
    """(a, b, n): words that stand together in `support` molecules or more; with `asked` (token) only pairs with one of these.

    Only words of `support` molecules or more can be in a pair. Up to BATCH_ROWS of them go to every task, and pairs are made
    inside a molecule, so that only their counts are shuffled; beyond, words meet by molecule.
    """
    fit = F.array_distinct(F.filter(T.words(F.col(content)), lambda w: (F.length(w) >= least_chars) & ~w.isin(T.STOP_WORDS)))
    words = molecules.select(key, F.explode(fit).alias("w"))
    frequent = words.groupBy("w").agg(F.count("*").alias("n")).filter(F.col("n") >= support).select("w")
    if asked is not None:
        frequent = frequent.join(asked.select(F.col("token").alias("w"), F.lit(True).alias("asked")).distinct(), "w", "left")
    else:
        frequent = frequent.withColumn("asked", F.lit(True))
    frequent = stored(frequent, "frequent")
    rows = frequent.count()
    to_a, to_b = (to_tasks(frequent.select(F.col("w").alias(x), F.col("asked").alias(f"{x}_asked")), rows) for x in ("a", "b"))
    if rows <= BATCH_ROWS:
        met = molecules.select(fit.alias("w")).select("w", F.explode("w").alias("a")).join(to_a, "a").select("a", "a_asked", F.explode("w").alias("b")).filter("a < b").join(to_b, "b")
    else:
        own = words.withColumnRenamed("w", "a").join(to_a, "a")
        met = own.join(own.toDF(*[c.replace("a", "b", 1) if c != key else key for c in own.columns]), key).filter("a < b")
    return met.filter("a_asked or b_asked").groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= support)


def synonym_rings(parts: dict[str, DataFrame], k: int = 10) -> DataFrame:
    """(term, synonym, strategy, score): all strategies both ways, the k best of a term. Each part has a, b and n or score."""
    every = None
    for order, (name, df) in enumerate(parts.items()):
        score = F.col("score" if "score" in df.columns else "n").cast("double")
        rows = df.select(F.col("a").alias("term"), F.col("b").alias("synonym"), F.lit(name).alias("strategy"), F.lit(order).alias("o"), score.alias("score"))
        rows = rows.unionByName(rows.select(F.col("synonym").alias("term"), F.col("term").alias("synonym"), "strategy", "o", "score"))
        every = rows if every is None else every.unionByName(rows)
    best = top_k(every, ["term", "synonym"], ["o", F.col("score").desc()], 1)
    return top_k(best, ["term"], ["o", F.col("score").desc(), "synonym"], k).drop("o")


def tag_audit(tags: DataFrame, support: int = 2) -> DataFrame:
    """(metric, value) of tag statistics, orphans and clusters."""
    s = tag_statistics(tags)
    numbers = s.select(F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in s.columns]), F.array(*[F.col(c).cast("double") for c in s.columns]))).alias("metric", "value"))
    orphans = orphan_tags(tags).agg(F.lit("orphans").alias("metric"), F.count("*").cast("double").alias("value"))
    clusters = tag_clusters(tags, support).agg(F.lit("clusters").alias("metric"), F.count("*").cast("double").alias("value"))
    return numbers.unionByName(orphans).unionByName(clusters)


def suggest_tags(nodes: DataFrame, tags: DataFrame, k: int = 5, terms: int = 20, contained: bool = False) -> DataFrame:
    """(node_id, tag, confidence): existing tags equal to one of the first content terms of a node that lacks them. nodes: node_id, content.

    With `contained` also tags that a term is part of, at .3 behind the equal ones: tags are looked up by all their parts of 4 to 29 letters.
    """
    fit = F.filter(F.array_distinct(T.words(F.col("content"))), lambda w: (F.length(w) >= 4) & (F.length(w) < 30) & ~w.isin(T.STOP_WORDS))
    words = nodes.select("node_id", F.posexplode(F.slice(fit, 1, terms)).alias("pos", "w"))
    known = tags.select("tag").distinct().withColumn("w", F.lower(F.regexp_replace("tag", "^#", "")))
    met = words.join(known, "w").withColumn("confidence", F.lit(0.8))
    if contained:
        size = F.length("w")
        starts = known.filter(size > 4).select("tag", "w", F.explode(F.sequence(F.lit(1), size - 3)).alias("a"))
        parts = starts.select("tag", F.col("w").alias("whole"), F.explode(F.transform(F.sequence(F.lit(4), F.least(F.lit(29), F.length("w") - F.col("a") + 1)), lambda n: F.substring(F.col("w"), F.col("a"), n))).alias("w"))
        met = met.unionByName(words.join(parts.filter("w <> whole").select("tag", "w").distinct(), "w").withColumn("confidence", F.lit(0.3)))
    found = met.join(tags.select("node_id", "tag").distinct(), ["node_id", "tag"], "left_anti")
    order = [F.col("confidence").desc(), "pos", "tag"]
    best = top_k(found, ["node_id", "tag"], order, 1) if contained else found
    return top_k(best, ["node_id"], order, k).select("node_id", "tag", "confidence")


def discover_tags(nodes: DataFrame, seeds: DataFrame, master: DataFrame, least: int = 2) -> DataFrame:
    """(tag, n): new capitalised words of the nodes that hold a seed word. seeds: word; master: tag; nodes: node_id, content."""
    holding = nodes.select("node_id", F.explode(F.array_distinct(T.words(F.col("content")))).alias("word")).join(seeds.select("word").distinct(), "word").select("node_id").distinct()
    found = nodes.join(holding, "node_id", "left_semi").select(F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("w")).filter(F.col("w").rlike("^[A-Z][a-z]{3,}$"))
    counted = found.groupBy(F.concat(F.lit("#"), F.lower("w")).alias("tag")).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return counted.join(master.select("tag").distinct(), "tag", "left_anti")


def cleanup_tags(tags: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept rows, removed tags with counts)."""
    noise = T.is_noise_tag(F.col("tag"))
    return tags.filter(~noise), tags.filter(noise).groupBy("tag").agg(F.count("*").alias("removed"))


def named_tags(queries: DataFrame, tags: DataFrame) -> DataFrame:
    """(query_id, tag): tags whose name is a word of the query."""
    words = queries.select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("token"))
    return words.join(tags.select("tag").distinct().withColumn("token", F.lower(F.regexp_replace("tag", "^#", ""))), "token").select("query_id", "tag").distinct()


def related_tags(tags: DataFrame, asked: DataFrame | None = None, support: int = 2, k: int = 5) -> DataFrame:
    """(tag, other, n, pmi): the k tags that stand with a tag most beyond chance, in `support` nodes or more.

    Only tags of `support` nodes or more can be in a pair, and only `asked` ones (tag) on its left, so both sides are cut before
    they meet by node. pmi is ln(n * nodes / (uses * other's uses)), above zero; ties go by name.
    """
    own = tags.select("node_id", "tag").distinct()
    uses = own.groupBy("tag").agg(F.count("*").alias("uses"))
    nodes = own.agg(F.count_distinct("node_id").alias("nodes"))
    fit = own.join(uses.filter(F.col("uses") >= support).select("tag"), "tag", "left_semi")
    left = fit.join(asked.select("tag").distinct(), "tag", "left_semi") if asked is not None else fit
    met = left.join(fit.withColumnRenamed("tag", "other"), "node_id").filter("tag <> other").groupBy("tag", "other").agg(F.count("*").alias("n")).filter(F.col("n") >= support)
    scored = met.join(uses.withColumnRenamed("uses", "x"), "tag").join(uses.select(F.col("tag").alias("other"), F.col("uses").alias("y")), "other").crossJoin(F.broadcast(nodes))  # one row
    lift = F.col("n").cast("double") * F.col("nodes") / (F.col("x").cast("double") * F.col("y"))
    best = top_k(scored.withColumn("lift", lift).filter("lift > 1"), ["tag"], [F.col("lift").desc(), "other"], k)
    return best.select("tag", "other", "n", F.round(F.log("lift"), 6).alias("pmi"))


def expand_related(asked: DataFrame, tags: DataFrame, support: int = 2, k: int = 5, points: int = 5) -> DataFrame:
    """(query_id, term, score): related tags of the tags that a query names, without those; the k furthest beyond chance. asked: query_id, tag."""
    related = related_tags(tags, asked, support, k)
    met = asked.join(related, "tag").select("query_id", F.col("other").alias("term"), "pmi")
    new = met.join(asked.withColumnRenamed("tag", "term"), ["query_id", "term"], "left_anti").groupBy("query_id", "term").agg(F.max("pmi").alias("pmi"))
    return top_k(new, ["query_id"], [F.col("pmi").desc(), "term"], k).select("query_id", "term", F.lit(points).alias("score"))
