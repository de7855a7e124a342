"""Retrieval over a table of queries: queries(query_id, query).

The lexical index is a table of (token, node_id, tf, size). All searches are joins on the token, so a
batch of queries is one plan; top rows are taken for each query with row_number.
Score of a hit: sum over terms of tf / size * ln(1 + nodes / nodes with the term), times 10.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from .windows import _islands, budget_prefix, rolling_context, round_robin, top_k


#: Rows up to which a batch's terms or results go to every task; about 100 bytes each.
BATCH_ROWS = 200_000
#: Partitions of an index of asked terms, as a multiple of the usual: a task's scores are many times its rows and should stay in memory.
FINER = 4


def to_tasks(df: DataFrame, rows: int | None = None, most: int = BATCH_ROWS) -> DataFrame:
    """df, for a join to send it to every task if it has at most `most` rows; it is counted if its `rows` aren't known."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def text_index(nodes: DataFrame, content: str = "content", terms: DataFrame | None = None) -> DataFrame:
    """(token, node_id, tf, size); with `terms` (token) of these tokens only, which go before anything is shuffled, dealt by node."""
    words = nodes.select("node_id", T.words(F.col(content)).alias("w")).withColumn("size", F.size("w").cast("long"))
    each = words.select("node_id", "size", F.explode("w").alias("token"))
    if terms is not None:
        parts = FINER * int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # as a number, so that they aren't put together again
        each = each.join(to_tasks(terms.select("token").distinct()), "token", "left_semi").repartition(parts, "node_id")
    return each.groupBy("token", "node_id").agg(F.count("*").alias("tf"), F.first("size").alias("size"))


def terms_of(queries: DataFrame) -> DataFrame:
    """(query_id, token): distinct content words of each query."""
    return queries.select("query_id", F.explode(F.array_distinct(T.content_terms(T.words(F.col("query"))))).alias("token"))


def _scored(terms: DataFrame, index: DataFrame, nodes: DataFrame, rows: int | None = None) -> DataFrame:
    """(query_id, node_id, hits, score). rows: of the terms at most, if that is known.

    Up to BATCH_ROWS the terms go to every task; over an index that is dealt by node, as that of asked terms, scores are
    then summed where their node is, and a top_k of them shuffles each task's best only.
    """
    rows = terms.count() if rows is None else rows
    wanted = index.join(to_tasks(terms.select("token").distinct(), rows), "token", "left_semi")
    df = F.count(F.when(F.col("size") > 0, 1)).alias("df")  # always true; the columns are those of the scores, so that one shuffle serves both
    frequency = wanted.groupBy("token").agg(df).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("n_nodes"))))  # one row of totals
    weights = frequency.select("token", F.log1p(F.col("n_nodes") / F.col("df")).alias("idf"))
    met = wanted.join(to_tasks(terms.join(weights, "token"), rows), "token")
    score = F.sum(F.col("tf") / F.col("size") * F.col("idf"))
    return met.groupBy("query_id", "node_id").agg(F.count("*").alias("hits"), F.round(10 * score, 6).alias("score"))


def lexical_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, k: int = 10, rows: int | None = None) -> DataFrame:
    """(query_id, node_id, hits, score): nodes with any term, best first. rows: see _scored."""
    return top_k(_scored(terms_of(queries), index, nodes, rows), ["query_id"], [F.col("score").desc(), "node_id"], k)


def traditional_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """Nodes with every term of the query."""
    terms = terms_of(queries)
    n = terms.groupBy("query_id").agg(F.count("*").alias("n_terms"))
    full = _scored(terms, index, nodes).join(n, "query_id").filter("hits = n_terms").drop("n_terms")
    return top_k(full, ["query_id"], [F.col("score").desc(), "node_id"], k)


def label_nodes(positions: DataFrame, labels: DataFrame, molecules: DataFrame, k: int) -> DataFrame:
    """(label, node_id): the first k molecules, by id, that hold the midpoint of each of the labels (label); what has all labels of a query has its first k, too."""
    asked = positions.join(to_tasks(labels.select("label").distinct()), "label", "left_semi").select("label", "compound_id", "byte_offset")
    places = molecules.select("compound_id", F.col("mol_id").alias("node_id"), "start_byte", "end_byte")
    held = asked.join(places, "compound_id").filter("byte_offset between start_byte and end_byte")
    return top_k(held.select("label", "node_id").distinct(), ["label"], ["node_id"], k)


def position_lookup(queries: DataFrame, positions: DataFrame, molecules: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, node_id): molecules that hold the midpoint of a label equal to a term. positions: compound_id, label, byte_offset."""
    terms = terms_of(queries).select("query_id", F.concat(F.lit("#"), "token").alias("label"))
    met = terms.join(label_nodes(positions, terms, molecules, k), "label")
    return top_k(met.select("query_id", "node_id").distinct(), ["query_id"], ["node_id"], k)


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets; cut characters at the ends go."""
    part = F.substring(F.encode(text, "UTF-8"), start.cast("int") + 1, (end - start).cast("int"))
    return F.replace(F.make_valid_utf8(part.cast("string")), F.lit("�"), F.lit(""))


def inflate_context(hits: DataFrame, documents: DataFrame, radius: int = 500) -> DataFrame:
    """hits (query_id, node_id, compound_id, start_byte, end_byte) with `context`: the text +-radius bytes, snapped to sentence ends."""
    rows = hits.join(documents.select(F.col("doc_id").alias("compound_id"), "text"), "compound_id")
    start, end = F.greatest(F.col("start_byte") - radius, F.lit(0)), F.least(F.col("end_byte") + radius, F.octet_length("text").cast("long"))
    rows = rows.withColumn("context", byte_slice(F.col("text"), start, end))
    head = F.when(start > 0, F.regexp_replace("context", r"(?s)^[^.!?]{0,200}[.!?]\s+", "")).otherwise(F.col("context"))
    rows = rows.withColumn("context", head)
    return rows.withColumn("context", F.regexp_replace("context", r"(?s)([.!?])\s+[^.!?]{0,200}$", "$1")).drop("text")


def neighbour_context(results: DataFrame, nodes: DataFrame, budget: int, k: int = 10, most: int = 5) -> DataFrame:
    """(query_id, node_id): newest other nodes that share a tag or bucket with the best results, where 1000 characters are left.

    results: query_id, node_id, score; nodes: node_id, content, tags, buckets, ts.
    """
    labels = lambda df, *keep: df.select(*keep, F.explode(F.array_union(F.coalesce("tags", F.array()), F.transform("buckets", lambda b: F.concat(F.lit("bucket:"), b)))).alias("label"))
    own = results.join(nodes, "node_id")
    room = own.groupBy("query_id").agg((F.lit(budget) - F.sum(F.length("content"))).alias("room")).filter("room >= 1000").select("query_id")
    best = top_k(own.join(room, "query_id"), ["query_id"], [F.col("score").desc(), "node_id"], most)
    met = labels(best, "query_id").distinct().join(labels(nodes, "node_id", "ts"), "label").select("query_id", "node_id", "ts").distinct()
    fresh = met.join(results.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    return top_k(fresh, ["query_id"], [F.col("ts").desc(), "node_id"], k).select("query_id", "node_id")


def tag_fallback(queries: DataFrame, found: DataFrame, tags: DataFrame, least: int = 5, k: int = 20) -> DataFrame:
    """(query_id, node_id, score): for queries with under `least` hits, nodes whose tag equals a word of over 3 letters."""
    few = queries.join(found.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least)
    words = few.select("query_id", F.explode(F.array_distinct(T.words(F.col("query")))).alias("w")).filter(F.length("w") > 3)
    hits = words.join(tags.select("node_id", "tag").distinct().withColumn("w", F.lower(F.regexp_replace("tag", "^#", ""))), "w")
    return top_k(hits.select("query_id", "w", "node_id"), ["query_id", "w"], ["node_id"], k).select("query_id", "node_id").distinct().withColumn("score", F.lit(0.8))


def create_engrams(rows: DataFrame) -> DataFrame:
    """(key, ids) of (name, node_id)."""
    return rows.groupBy(F.md5(F.lower(F.trim("name"))).alias("key")).agg(F.array_sort(F.collect_set("node_id")).alias("ids"))


def engram_lookup(queries: DataFrame, engrams: DataFrame) -> DataFrame:
    keyed = queries.select("query_id", F.md5(F.lower(F.trim("query"))).alias("key"))
    return keyed.join(engrams, "key").select("query_id", F.explode("ids").alias("node_id"), F.lit(1.0).alias("score"))


def anchor_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, positions: DataFrame, molecules: DataFrame, k: int = 10, tags: DataFrame | None = None) -> DataFrame:
    """(query_id, node_id, score, and tags if given): lexical and position hits together, rescored by share of terms and size of text.

    Of hits that overlap in a document or whose text another one holds the best stays; with `tags` a hit carries those
    of its whole document. The greedy steps see at most 2 * k hits of a query at a time.
    """
    from .dedup import dedup_containment, merge_anchors, simhash64

    lexical = lexical_search(queries, index, nodes, k)
    at = position_lookup(queries, positions, molecules, k)
    n = terms_of(queries).groupBy("query_id").agg(F.count("*").alias("n_terms"))
    both = lexical.select("query_id", "node_id", "hits").unionByName(at.select("query_id", "node_id", F.lit(1).cast("long").alias("hits"))).groupBy("query_id", "node_id").agg(F.max("hits").alias("hits"))
    scored = both.join(n, "query_id").withColumn("score", F.round(T.lightweight_score(F.lit(0.5), F.col("hits") / F.col("n_terms"), F.col("hits") == F.col("n_terms"), F.lit(0), F.lit(30.0)), 6))
    place = molecules.select(F.col("mol_id").alias("node_id"), "compound_id", "start_byte", "end_byte", "content")
    rows = merge_anchors(scored.select("query_id", "node_id", "score").join(place, "node_id"))
    rows = rows.join(simhash64(rows.select("node_id", "content").distinct(), "node_id", "content"), "node_id")
    best = top_k(dedup_containment(rows), ["query_id"], [F.col("score").desc(), "node_id"], k).select("query_id", "node_id", "score")
    if tags is None:
        return best
    return best.join(enrich_tags(best.select("query_id", "node_id"), place.select("node_id", "compound_id"), tags), ["query_id", "node_id"])


def star_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, tags: DataFrame, engrams: DataFrame | None = None, k: int = 10, profile: str = "standard", most_degree: int | None = None, budget: int = 4096, start_from: int | None = None) -> DataFrame:
    """(query_id, node_id, score, via): engrams and lexical anchors, then the walk over shared tags from them, best first.

    nodes: node_id, content, ts, simhash, compound_id, start_byte, end_byte. A query keeps max(200, budget / 200) rows.
    `start_from` walks from that many anchors only, taken in turns from the documents they lie in.
    """
    from .graph import _cut, gravity_walk

    anchors = lexical_search(queries, index, nodes, k).select("query_id", "node_id", "score", F.lit("anchor").alias("via"), F.lit(1).alias("o"))
    if engrams is not None:
        anchors = engram_lookup(queries, engrams).select("query_id", "node_id", "score", F.lit("engram").alias("via"), F.lit(0).alias("o")).unionByName(anchors)
    anchors = _cut(top_k(anchors, ["query_id", "node_id"], ["o"], 1))
    walked_from = anchors
    if start_from is not None:
        turns = round_robin(anchors.join(nodes.select("node_id", "compound_id"), "node_id"), ["query_id"], "compound_id", ["o", F.col("score").desc(), "node_id"])
        walked_from = turns.filter(F.col("place") <= start_from)
    walked = gravity_walk(walked_from.select("query_id", "node_id"), nodes, tags, profile, most_degree, k=k)
    walked = walked.join(anchors.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti").select("query_id", "node_id", "score", F.lit("walk").alias("via"), F.lit(2).alias("o"))
    return top_k(anchors.unionByName(walked), ["query_id"], [F.col("score").desc(), "o", "node_id"], max(200, -(-budget // 200))).drop("o")


def star_context(found: DataFrame, nodes: DataFrame, documents: DataFrame, now: Column, budget: int = 4096) -> DataFrame:
    """format_results of what star_search found: beyond 16,000 characters near hits of a document are shown as one.

    nodes: node_id, compound_id, start_byte, end_byte, content, source, ts.
    """
    rows = found.join(nodes.select("node_id", "compound_id", "start_byte", "end_byte", "content", "source", "ts"), "node_id")
    return format_results(rows, now, budget, documents, budget > 16_000, 800 if budget > 100_000 else 500)


def _regrouped(found: DataFrame, k: int) -> DataFrame:
    first = top_k(found, ["query_id", "node_id"], ["part", F.col("score").desc()], 1)
    return top_k(first, ["query_id"], ["part", F.col("score").desc(), "node_id"], k)


def molecule_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, k: int = 100, each: int = 10) -> DataFrame:
    """(query_id, node_id, part, score): each sentence or part of a query searched by itself; the first part to find a node wins."""
    parts = queries.select("query_id", F.posexplode(T.query_chunks(F.col("query"))).alias("part", "query"))
    keyed = parts.select(F.struct("query_id", "part").alias("query_id"), "query")
    found = lexical_search(keyed, index, nodes, each).select("query_id.query_id", "query_id.part", "node_id", "score")
    return _regrouped(found, k)


def iterative_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, node_id, attempt, score): the whole query needs every term; else its names and years; else any name."""
    names = F.filter(T.key_terms(F.col("query")), lambda w: F.length(w) > 4)
    tries = queries.select("query_id", F.posexplode(F.array(F.col("query"), F.array_join(names, " "), F.array_join(F.slice(names, 1, 3), " "))).alias("attempt", "query")).filter("query <> ''")
    keyed = tries.select(F.struct("query_id", "attempt").alias("query_id"), "query")
    strict = traditional_search(keyed.filter("query_id.attempt < 2"), index, nodes, k)
    loose = lexical_search(keyed.filter("query_id.attempt = 2"), index, nodes, k)
    found = strict.unionByName(loose).select("query_id.query_id", "query_id.attempt", "node_id", "score")
    lowest = found.groupBy("query_id").agg(F.min("attempt").alias("attempt"))
    return found.join(lowest, ["query_id", "attempt"])


def split_merge_search(queries: DataFrame, index: DataFrame, nodes: DataFrame, k: int = 10, few: int = 10) -> DataFrame:
    """(query_id, node_id, score, strategy): queries with under `few` hits are also searched by their first three key terms."""
    whole = traditional_search(queries, index, nodes, k).withColumn("part", F.lit(0)).withColumn("strategy", F.lit("whole"))
    n = whole.groupBy("query_id").agg(F.count("*").alias("n"))
    short = queries.join(n, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < few)
    parts = short.select("query_id", F.posexplode(F.slice(F.filter(T.key_terms(F.col("query")), lambda w: F.length(w) > 4), 1, 3)).alias("part", "query"))
    keyed = parts.select(F.struct("query_id", (F.col("part") + 1).alias("part")).alias("query_id"), "query")
    split = lexical_search(keyed, index, nodes, k, terms_of(queries).count()).select("query_id.query_id", "query_id.part", "node_id", "hits", "score", F.lit("split").alias("strategy"))
    return _regrouped(whole.select(*split.columns).unionByName(split), 2 * k).select("query_id", "node_id", "score", "strategy")


# Words that ask for a relation or a time
RELATION_WORDS = ["and", "with", "met", "told", "called", "friend", "partner", "together"]
TIME_WORDS = ["when", "before", "after", "during", "today", "yesterday", "year", "month"]


def semantic_search(queries: DataFrame, index: DataFrame, provenance: DataFrame | None = None, k: int = 10) -> DataFrame:
    """(query_id, node_id, terms, score): 10 for a term, 100 for a pair of terms, 5 for a relation word, 3 for a time word, 50 * terms**2.

    provenance: node_id, factor. Pairs of a node's matching terms are counted, not listed.
    """
    terms = terms_of(queries)
    hits = terms.join(index.select("token", "node_id"), "token").groupBy("query_id", "node_id").agg(F.count("*").alias("terms"))
    signals = index.filter(F.col("token").isin(RELATION_WORDS + TIME_WORDS)).groupBy("node_id").agg(F.sum(F.when(F.col("token").isin(RELATION_WORDS), 5).otherwise(3)).alias("signal"))
    pairs = F.col("terms") * (F.col("terms") - 1) / 2
    multi = F.when(F.col("terms") > 1, 50 * F.col("terms") * F.col("terms")).otherwise(0)
    scored = hits.join(signals, "node_id", "left").withColumn("score", (10 * F.col("terms") + 100 * pairs + F.coalesce("signal", F.lit(0)) + multi).cast("double"))
    if provenance is not None:
        scored = scored.join(provenance, "node_id", "left").withColumn("score", F.col("score") * F.coalesce("factor", F.lit(1.0)))
    return top_k(scored, ["query_id"], [F.col("score").desc(), "node_id"], k).select("query_id", "node_id", "terms", "score")


def distributed_search(queries: DataFrame, index: DataFrame, synonyms: DataFrame, budget: int = 10_000, most_terms: int = 5, k: int = 10) -> DataFrame:
    """(query_id, node_id, hits, score): 70 % of the budget goes to the first terms, 30 % to their synonyms; score is the best share + .2 of the rest.

    synonyms: term, synonym (at most 5 of a term are used).
    """
    content = queries.select("query_id", F.posexplode(F.slice(F.array_distinct(T.content_terms(T.words(F.col("query")))), 1, most_terms)).alias("pos", "token"))
    n = content.groupBy("query_id").agg(F.count("*").alias("n"))
    own = content.join(n, "query_id").select("query_id", "token", (0.7 * budget / F.col("n")).alias("share"))
    other = content.join(top_k(synonyms.select(F.col("term").alias("token"), "synonym").distinct(), ["token"], ["synonym"], 5), "token").select("query_id", F.col("synonym").alias("token")).distinct().join(content.select("query_id", "token"), ["query_id", "token"], "left_anti")
    m = other.groupBy("query_id").agg(F.count("*").alias("n"))
    other = other.join(m, "query_id").select("query_id", "token", (0.3 * budget / F.col("n")).alias("share"))
    met = own.unionByName(other).join(index.select("token", "node_id"), "token")
    scored = met.groupBy("query_id", "node_id").agg(F.count("*").alias("hits"), F.round((F.max("share") + 0.2 * (F.sum("share") - F.max("share"))) / budget, 6).alias("score"))
    return top_k(scored, ["query_id"], [F.col("score").desc(), "node_id"], k)


def expand_queries(queries: DataFrame, synonyms: DataFrame, tags: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, term, score, kind): tags that the query names (10), and synonyms of its terms (5)."""
    terms = terms_of(queries)
    named = terms.join(tags.select("tag").distinct().withColumn("token", F.lower(F.regexp_replace("tag", "^#", ""))), "token").select("query_id", F.col("tag").alias("term"), F.lit(10).alias("score"), F.lit("tag").alias("kind"))
    first = top_k(synonyms.select(F.col("term").alias("token"), "synonym").distinct(), ["token"], ["synonym"], k)  # all score alike, so the first by name are enough
    ring = terms.join(first, "token").select("query_id", F.col("synonym").alias("term"), F.lit(5).alias("score"), F.lit("synonym").alias("kind"))
    return top_k(named.unionByName(ring).distinct(), ["query_id"], [F.col("score").desc(), "term"], k)


def snippets(results: DataFrame, documents: DataFrame | None = None, threshold: int = 500, most: int = 50, most_tags: int = 15) -> DataFrame:
    """(query_id, compound_id, start_byte, end_byte, score, ts, source, tags, node_ids, n_atoms, content): near hits of a document as one.

    results: query_id, node_id, compound_id, start_byte, end_byte, source, content, ts, score, and tags if there are any. A hit
    joins those before it if it starts at most `threshold` bytes past their furthest end. A document gives at most
    max(3, min(8, most / 15)) snippets and a query `most`, best first. The content is the document's text between the
    ends, or the first hit's own where no documents are given. Merged lists are bounded by a query's hits.
    """
    rows = results if "tags" in results.columns else results.withColumn("tags", F.array().cast("array<string>"))
    keys, order = ["query_id", "compound_id"], ["start_byte", "end_byte", "node_id"]
    reached = F.max("end_byte").over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = _islands(rows.withColumn("_reached", reached), F.coalesce(F.col("start_byte") - F.col("_reached") > threshold, F.lit(True)), keys, order)
    merged = rows.groupBy(*keys, "island").agg(
        F.min("start_byte").alias("start_byte"), F.max("end_byte").alias("end_byte"), F.max("score").alias("score"), F.min("ts").alias("ts"), F.min("source").alias("source"),
        F.slice(F.array_distinct(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, "tags"))), lambda x: x["tags"]))), 1, most_tags).alias("tags"),
        F.transform(F.sort_array(F.collect_list(F.struct(*order))), lambda x: x["node_id"]).alias("node_ids"), F.count("*").alias("n_atoms"),
        F.min_by("content", F.struct(*order)).alias("content"),
    )
    best = top_k(merged, keys, [F.col("score").desc(), "start_byte"], max(3, min(8, -(-most // 15))))
    best = top_k(best, ["query_id"], [F.col("score").desc(), "compound_id", "start_byte"], most).drop("island")
    if documents is None:
        return best
    whole = best.join(documents.select(F.col("doc_id").alias("compound_id"), "text"), "compound_id", "left")
    cut = byte_slice(F.col("text"), F.col("start_byte"), F.least(F.col("end_byte"), F.octet_length("text").cast("long")))
    return whole.withColumn("content", F.coalesce(F.when(cut != "", cut), "content")).drop("text")


def format_results(results: DataFrame, now: Column, budget: int = 4096, documents: DataFrame | None = None, coalesce: bool = True, threshold: int = 500) -> DataFrame:
    """(query_id, place, compound_id, start_byte, end_byte, node_ids, n_atoms, weighted, chars, snippet), in time order.

    results as for snippets(). Scores fade with age, inline tags go, and a snippet goes that shares 60 % of its words with a
    better one of the query. A query shows at most max(50, budget / 500) coalesced snippets, or all its results.
    """
    from .dedup import dedup_word_overlap

    if coalesce:
        rows = snippets(results, documents, threshold, max(50, -(-budget // 500)))
    else:
        rows = results if "tags" in results.columns else results.withColumn("tags", F.array().cast("array<string>"))
        rows = rows.select("query_id", "compound_id", "start_byte", "end_byte", "score", "ts", "source", F.slice("tags", 1, 10).alias("tags"), F.array("node_id").alias("node_ids"), F.lit(1).cast("long").alias("n_atoms"), "content")
    hours = (F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3.6e9
    rows = rows.withColumn("score", F.round(F.col("score") * T.temporal_weight(hours), 3)).withColumn("content", T.strip_inline_tags(F.coalesce("content", F.lit("")))).withColumn("node_id", F.element_at("node_ids", 1))
    kept = dedup_word_overlap(rows)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("ts", "compound_id", "start_byte", "node_id")).cast("long")
    kept = kept.withColumn("place", place).withColumn("chars", F.length("content").cast("long"))
    time = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    # Fixed value: the form of a snippet
    form = '[GROUP:%d] [File:%s] [Range: 0x%04X-0x%04X] [Time: %s] [Atoms: %d] [Chars: %d]\n<atom id="%s" relevance="%.3f" timestamp="%s" persona="%s" source="%s">\n%s\n</atom>'
    ids = F.array_join(F.transform("node_ids", lambda x: F.substring(x.cast("string"), 1, 8)), ",")
    file = F.element_at(F.split(F.col("source"), "/"), -1)
    shown = F.format_string(form, "place", file, "start_byte", "end_byte", time, "n_atoms", "chars", ids, "score", time, F.coalesce(F.get("tags", F.lit(0)), F.lit("internal")), "source", "content")
    return kept.select("query_id", "place", "compound_id", "start_byte", "end_byte", "node_ids", "n_atoms", F.col("score").alias("weighted"), "chars", shown.alias("snippet"))


def budget_stats(formatted: DataFrame, budget: int = 4096) -> DataFrame:
    """(query_id, snippets, atoms, content_chars, overhead_chars, total_chars, used_percent) of each query's formatted results."""
    own = formatted.groupBy("query_id").agg(F.count("*").alias("snippets"), F.sum("n_atoms").alias("atoms"), F.sum("chars").alias("content_chars"), (F.sum(F.length("snippet")) + 2 * (F.count("*") - 1)).alias("total_chars"))
    return own.withColumn("overhead_chars", F.col("total_chars") - F.col("content_chars")).withColumn("used_percent", F.round(F.col("total_chars") * 100 / budget, 1))


def context_package(results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stats, hoisted): counts of each query's results; tags held by half of a source's nodes or more.

    results: query_id, node_id, source, score, shared, content, tags.
    """
    millionths = F.sum(F.round(F.col("score") * 1e6).cast("long"))  # whole numbers: the mean doesn't depend on the order of partial sums
    mean = (F.floor((2 * millionths + F.count("*")) / (2 * F.count("*"))) / 1e6).alias("avg_score")
    top = results.groupBy("query_id").agg(F.max("score").alias("best"), F.count("*").alias("nodes"), mean, F.sum((F.col("shared") >= 3).cast("long")).alias("recurring"), F.sum(T.token_count(F.col("content"))).cast("long").alias("tokens"))
    sizes = results.groupBy("query_id", "source").agg(F.count("*").alias("n"))
    uses = results.select("query_id", "source", F.explode("tags").alias("tag")).groupBy("query_id", "source", "tag").agg(F.count("*").alias("k"))
    return top, uses.join(sizes, ["query_id", "source"]).filter("k >= 0.5 * n").select("query_id", "source", "tag", "k", "n")


def package_text(results: DataFrame) -> DataFrame:
    """(query_id, text): one text for each query, results by source and rank. One query's results are bounded by its k."""
    part = F.struct("source", (-F.col("score")).alias("s"), "node_id", F.format_string("- (%.2f) %s", "score", "content").alias("line"))
    rows = results.groupBy("query_id").agg(F.sort_array(F.collect_list(part)).alias("r"))
    return rows.select("query_id", F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["source"], F.lit("] "), x["line"])), "\n").alias("text"))


def result_entities(results: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, entity, mentions, gap): the most mentioned capitalised words; under 3 mentions is a gap."""
    found = results.select("query_id", F.explode(F.regexp_extract_all("content", F.lit("[A-Za-z0-9]+"), F.lit(0))).alias("entity")).filter(F.col("entity").rlike("^[A-Z][a-z]{3,}$"))
    counted = found.groupBy("query_id", "entity").agg(F.count("*").alias("mentions"))
    return top_k(counted, ["query_id"], [F.col("mentions").desc(), "entity"], k).withColumn("gap", F.col("mentions") < 3)


def year_gaps(results: DataFrame) -> DataFrame:
    """(query_id, year): years between the first and the last result that have none."""
    years = results.select("query_id", F.year("ts").alias("year")).distinct()
    span = years.groupBy("query_id").agg(F.min("year").alias("a"), F.max("year").alias("b"))
    return span.select("query_id", F.explode(F.sequence("a", "b")).alias("year")).join(years, ["query_id", "year"], "left_anti")


def memory_node(results: DataFrame, tokens: int = 1000, k: int = 10) -> DataFrame:
    """(query_id, node_id, evidence, used): cleaned evidence within a token budget, k results at most."""
    rows = top_k(results, ["query_id"], [F.col("score").desc(), "node_id"], k).withColumn("evidence", T.strip_inline_tags(F.col("content")))
    return budget_prefix(rows, ["query_id"], [F.col("score").desc(), "node_id"], T.token_count(F.col("evidence")), tokens).select("query_id", "node_id", "evidence", F.col("used").cast("long").alias("used"))


def enrich_tags(anchors: DataFrame, nodes: DataFrame, tags: DataFrame) -> DataFrame:
    """anchors (query_id, node_id) with `tags`: the sorted tags of all nodes of the anchor's compound. nodes: node_id, compound_id."""
    wanted = anchors.join(nodes.select("node_id", "compound_id"), "node_id")
    own = tags.join(nodes.select("node_id", "compound_id"), "node_id").join(wanted.select("compound_id").distinct(), "compound_id", "left_semi")
    merged = own.groupBy("compound_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return wanted.join(merged, "compound_id", "left").select("query_id", "node_id", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


def clean_mode(results: DataFrame, least: int = 40) -> DataFrame:
    """Results without artifacts and short texts; a query that would lose all keeps the raw ones."""
    cleaned = results.withColumn("clean", T.strip_artifacts(F.col("content"))).withColumn("good", (F.length("clean") >= least) & (F.col("clean") != "[REDACTED]"))
    any_good = cleaned.groupBy("query_id").agg(F.max(F.col("good").cast("int")).alias("some"))
    return cleaned.join(any_good, "query_id").filter("good or some = 0").select("query_id", "node_id", F.when(F.col("some") == 1, F.col("clean")).otherwise(F.col("content")).alias("content"))


def context_window(results: DataFrame, now: Column, tokens: int) -> DataFrame:
    return rolling_context(results, ["query_id"], "content", "ts", "score", now, F.lit(False), tokens)
