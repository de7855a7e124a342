"""Tag statistics, graph walks and mining: over tags of documents, and over orders that share parts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, frame, graph, mining, prepare, retrieve, tagstats
from .corpus_queries import MOLECULES, TAGS, WORDS, molecules, tags
from .registry import Tables, query

# --- statistics of document tags --------------------------------------------------------------------


@query(f"WITH {TAGS}, top AS (SELECT tag, count(*) AS n, count(DISTINCT bucket) AS sources FROM tags GROUP BY tag ORDER BY n DESC, tag LIMIT 100) SELECT tag, n, sources, round(100 * n / (SELECT sum(n) FROM top), 2) AS pct FROM top")
def density_map(t: Tables) -> DataFrame:
    return tagstats.density_map(tags(t))


@query(f"WITH {TAGS} SELECT tag, bucket, count(*) AS n FROM tags GROUP BY ALL ORDER BY n DESC, tag, bucket LIMIT 50")
def density_by_bucket(t: Tables) -> DataFrame:
    return tagstats.density_by_bucket(tags(t))


_TERMS = ["the", "license", "heit", "zzz", "apache", "aeronautics"]


@query(f"""WITH {TAGS}, terms(term) AS (VALUES {', '.join(f"('{x}')" for x in _TERMS)}), hits AS (SELECT term, count(*) AS n FROM (SELECT DISTINCT mol_id, unnest({WORDS.format('content')}) AS term FROM molecules) GROUP BY term),
  uses AS (SELECT lower(regexp_replace(tag, '^#', '')) AS term, count(*) AS n FROM tags GROUP BY 1)
  SELECT term, coalesce(h.n, 0) AS molecules, coalesce(u.n, 0) AS tag_rows, CASE WHEN coalesce(h.n, 0) >= 50 THEN 'light' WHEN coalesce(h.n, 0) >= 5 THEN 'medium' ELSE 'heavy' END AS tier,
  CASE WHEN coalesce(h.n, 0) >= 50 THEN 10 WHEN coalesce(h.n, 0) >= 5 THEN 25 ELSE 0 END::INTEGER AS doc_limit FROM terms LEFT JOIN hits h USING (term) LEFT JOIN uses u USING (term)""")
def density_terms(t: Tables) -> DataFrame:
    terms = t.spark.createDataFrame([(x,) for x in _TERMS], "term string")
    mols = molecules(t)
    return tagstats.density_terms(terms, mols, tags(t))


@query("""WITH p AS (SELECT CASE WHEN toxic = 1 THEN 'quarantine' ELSE 'internal' END AS value FROM labels) SELECT value, count(*) AS n FROM p GROUP BY value UNION ALL SELECT 'total', count(*) FROM p""")
def provenance_counts(t: Tables) -> DataFrame:
    return tagstats.counts_with_total(t.labels.withColumn("provenance", F.when(F.col("toxic") == 1, "quarantine").otherwise("internal")), "provenance")


@query("SELECT event_type AS value, count(*) AS n FROM events GROUP BY 1 UNION ALL SELECT 'total', count(*) FROM events")
def type_counts(t: Tables) -> DataFrame:
    return tagstats.counts_with_total(t.events, "event_type")


@query(f"WITH {TAGS} SELECT 'molecules' AS metric, count(*) AS n FROM molecules UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'sources', count(DISTINCT source) FROM documents UNION ALL SELECT 'tags', count(DISTINCT tag) FROM tags")
def corpus_stats(t: Tables) -> DataFrame:
    return tagstats.corpus_stats(molecules(t), t.documents, tags(t))


@query("SELECT round(count(*) * avg(length(text)))::BIGINT AS chars FROM documents")
def corpus_char_estimate(t: Tables) -> DataFrame:
    return tagstats.corpus_chars(t.documents)


@query(f"""WITH {TAGS}, k AS (SELECT node_id, count(DISTINCT tag) AS k FROM tags GROUP BY 1), u AS (SELECT tag, count(*) AS n FROM tags GROUP BY 1)
  SELECT round(avg(k), 4) AS avg_tags, max(k) AS max_tags, median(k) AS median_tags, (SELECT count(*) FROM u) AS unique_tags, (SELECT count(*) FROM u WHERE n = 1) AS used_once FROM k""")
def tag_statistics(t: Tables) -> DataFrame:
    return tagstats.tag_statistics(tags(t))


#: Orders tagged by their parts: one node for each order, some tags used once
PART_TAGS = "part_tags AS (SELECT DISTINCT l_orderkey AS node_id, l_partkey AS tag, l_returnflag AS bucket FROM lineitem)"


def part_tags(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_orderkey").alias("node_id"), F.col("l_partkey").alias("tag"), F.col("l_returnflag").alias("bucket")).distinct()


@query(f"WITH {PART_TAGS} SELECT tag FROM (SELECT tag || ':' || (node_id % 7) AS tag FROM part_tags) GROUP BY tag HAVING count(*) = 1")
def orphan_tags(t: Tables) -> DataFrame:
    return tagstats.orphan_tags(part_tags(t).withColumn("tag", F.concat_ws(":", "tag", F.col("node_id") % 7)))


@query(f"WITH {TAGS} SELECT DISTINCT tag AS value FROM tags WHERE bucket = 'src1' ORDER BY value LIMIT 5000")
def list_tags(t: Tables) -> DataFrame:
    return tagstats.list_values(tags(t), "tag", bucket="src1")


@query(f"WITH {TAGS} SELECT DISTINCT tag FROM tags WHERE tag <> '' ORDER BY tag LIMIT 50")
def global_tags(t: Tables) -> DataFrame:
    return tagstats.global_tags(tags(t).groupBy("node_id").agg(F.collect_set("tag").alias("tags")))


@query("SELECT DISTINCT source AS value FROM documents ORDER BY value LIMIT 5000")
def list_buckets(t: Tables) -> DataFrame:
    return tagstats.list_values(t.documents, "source")


@query(f"WITH {TAGS} SELECT tag, count(DISTINCT node_id) AS degree FROM tags GROUP BY tag ORDER BY degree DESC, tag LIMIT 50")
def top_tags(t: Tables) -> DataFrame:
    return tagstats.top_tags(tags(t))


@query(f"WITH {TAGS} SELECT node_id, count(DISTINCT tag) AS degree FROM tags GROUP BY node_id ORDER BY degree DESC, node_id LIMIT 50")
def hub_atoms(t: Tables) -> DataFrame:
    return tagstats.hub_atoms(tags(t))


@query("SELECT source, count(*) AS n FROM documents GROUP BY source")
def source_counts(t: Tables) -> DataFrame:
    return tagstats.source_counts(t.documents)


@query("""SELECT entity, count(*) AS n, CASE WHEN lower(entity) IN ('ring') THEN 'thing' WHEN lower(entity) IN ('red', 'blue') THEN 'colour' ELSE 'concept' END AS category
  FROM (SELECT unnest(string_split(p_name, ' ')) AS entity FROM part) GROUP BY entity HAVING count(*) > 1 ORDER BY n DESC, entity LIMIT 50""")
def frequent_entities(t: Tables) -> DataFrame:
    return tagstats.frequent_entities(t.part.select(F.explode(F.split("p_name", " ")).alias("entity")), {"colour": ["red", "blue"], "thing": ["ring"]})


@query(f"""WITH {TAGS} (SELECT 'tags' AS section, row_number() OVER (ORDER BY d DESC, tag) AS rank, tag AS key, d AS value FROM (SELECT tag, count(DISTINCT node_id) AS d FROM tags GROUP BY tag) QUALIFY rank <= 50)
  UNION ALL (SELECT 'hubs', row_number() OVER (ORDER BY d DESC, node_id) AS rank, node_id, d FROM (SELECT node_id, count(DISTINCT tag) AS d FROM tags GROUP BY node_id) QUALIFY rank <= 50)
  UNION ALL (SELECT 'sources', row_number() OVER (ORDER BY d DESC, source) AS rank, source, d FROM (SELECT source, count(*) AS d FROM documents GROUP BY source) QUALIFY rank <= 50)""")
def graph_report(t: Tables) -> DataFrame:
    return tagstats.graph_report(tags(t), t.documents)


@query(f"""WITH {TAGS}, k AS (SELECT doc_id, count(DISTINCT tag) AS k FROM tags JOIN molecules ON mol_id = node_id WHERE tag LIKE '%a%e%' GROUP BY doc_id)
  SELECT doc_id FROM documents LEFT JOIN k USING (doc_id) WHERE length(text) > 500 AND coalesce(k, 0) < 2""")
def under_tagged(t: Tables) -> DataFrame:
    some = tags(t).filter("tag like '%a%e%'").join(molecules(t).select(F.col("mol_id").alias("node_id"), "doc_id"), "node_id")
    own = some.groupBy("doc_id").agg(F.collect_set("tag").alias("tags"))
    return frame.under_tagged(t.documents.join(own, "doc_id", "left"), "text").select("doc_id")


@query("""WITH e AS (SELECT p_partkey, list_transform(string_split(p_name, ' '), lambda x: 'entity:' || x) AS tags, p_type FROM part)
  SELECT p_partkey AS node_id, 'any' AS rule FROM e WHERE len(list_intersect(tags, ['entity:red', 'entity:ring'])) > 0 UNION ALL SELECT p_partkey, 'related' FROM e WHERE list_contains(tags, 'entity:red') AND list_contains(tags, 'entity:ring') AND p_type = 'ECONOMY'""")
def filter_by_entities(t: Tables) -> DataFrame:
    named = F.transform(F.split("p_name", " "), lambda x: F.concat(F.lit("entity:"), x))
    marked = F.when(F.col("p_type") == "ECONOMY", F.array(F.lit("#Relationship"))).otherwise(F.array().cast("array<string>"))
    rows = t.part.select(F.col("p_partkey").alias("node_id"), F.concat(named, marked).alias("tags"))
    some, related = prepare.by_entities(rows, ["red", "ring"]), prepare.relationship_molecules(rows, ["red", "ring"])
    return some.select("node_id", F.lit("any").alias("rule")).unionByName(related.select("node_id", F.lit("related").alias("rule")))


@query(f"""WITH {PART_TAGS}, anchors AS (SELECT o_orderkey // 100 AS query_id, o_orderkey AS node_id, o_custkey FROM orders WHERE o_orderkey % 50 = 0),
  m AS (SELECT o_custkey, string_agg(DISTINCT tag::VARCHAR, ',' ORDER BY tag::VARCHAR) AS tags FROM part_tags JOIN orders ON o_orderkey = node_id GROUP BY 1) SELECT query_id, node_id, coalesce(tags, '') AS tags FROM anchors LEFT JOIN m USING (o_custkey)""")
def enrich_tags(t: Tables) -> DataFrame:
    own = part_tags(t).withColumn("tag", F.col("tag").cast("string"))
    return retrieve.enrich_tags(anchors(t), order_nodes(t), own).withColumn("tags", F.array_join("tags", ","))


# --- walks ------------------------------------------------------------------------------------------

ORDER_EDGES = "edges AS (SELECT 'c' || o_custkey AS source_id, 'o' || o_orderkey AS target_id, 'placed' AS relation, o_totalprice AS weight FROM orders)"


def order_edges(t: Tables) -> DataFrame:
    return t.orders.select(F.concat(F.lit("c"), "o_custkey").alias("source_id"), F.concat(F.lit("o"), "o_orderkey").alias("target_id"), F.lit("placed").alias("relation"), F.col("o_totalprice").alias("weight"))


def seeds(t: Tables) -> DataFrame:
    """The query set: every order whose key is divisible by 50, dealt to four queries."""
    return t.orders.filter("o_orderkey % 50 = 0").select((F.floor(F.col("o_orderkey") / 50) % 4).alias("query_id"), F.col("o_orderkey").alias("node_id"))


SEEDS = "seeds AS (SELECT (o_orderkey // 50) % 4 AS query_id, o_orderkey AS node_id FROM orders WHERE o_orderkey % 50 = 0)"


@query(f"WITH {PART_TAGS} SELECT a.tag AS a, b.tag AS b, count(DISTINCT a.node_id) AS n FROM part_tags a JOIN part_tags b ON a.node_id = b.node_id AND a.tag < b.tag GROUP BY ALL HAVING count(DISTINCT a.node_id) >= 2 ORDER BY n DESC, a, b LIMIT 100")
def tag_cooccurrence(t: Tables) -> DataFrame:
    return graph.tag_cooccurrence(part_tags(t), 2, 100)


@query(f"""WITH {PART_TAGS}, p AS (SELECT a.tag AS tag, b.tag AS other FROM part_tags a JOIN part_tags b ON a.node_id = b.node_id AND a.tag <> b.tag GROUP BY ALL HAVING count(DISTINCT a.node_id) >= 2),
  u AS (SELECT tag, count(DISTINCT node_id) AS uses FROM part_tags GROUP BY tag)
  SELECT p.tag AS seed, string_agg(other::VARCHAR, ',' ORDER BY other) AS members, any_value(x.uses) AS support FROM p JOIN u x ON x.tag = p.tag JOIN u y ON y.tag = p.other
  GROUP BY p.tag HAVING NOT bool_or(y.uses > x.uses OR (y.uses = x.uses AND y.tag > x.tag))""")
def tag_clusters(t: Tables) -> DataFrame:
    return graph.tag_clusters(part_tags(t)).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


@query(f"""WITH RECURSIVE {PART_TAGS}, {SEEDS}, d AS (SELECT DISTINCT node_id, tag FROM part_tags), walk AS (
    SELECT query_id, node_id, 0 AS hop FROM seeds UNION SELECT w.query_id, y.node_id, w.hop + 1 FROM walk w JOIN d x ON x.node_id = w.node_id JOIN d y ON y.tag = x.tag WHERE w.hop < 2)
  SELECT query_id, node_id, min(hop)::INTEGER AS hop FROM walk GROUP BY ALL""")
def bfs_tags(t: Tables) -> DataFrame:
    return graph.bfs_tags(seeds(t), part_tags(t), 2)


_EDGE_WALK = f"""WITH RECURSIVE {ORDER_EDGES}, strong AS (SELECT * FROM edges WHERE weight >= 100000), steps AS (SELECT source_id AS a, target_id AS b FROM strong UNION ALL SELECT target_id, source_id FROM strong), walk AS (
    SELECT (o_orderkey // 50) % 4 AS query_id, 'o' || o_orderkey AS node_id, 0 AS hop FROM orders WHERE o_orderkey % 50 = 0
    UNION SELECT w.query_id, s.b, w.hop + 1 FROM walk w JOIN steps s ON s.a = w.node_id WHERE w.hop < 3),
  nodes AS (SELECT query_id, node_id, min(hop)::INTEGER AS hop FROM walk GROUP BY ALL)"""


def _edge_walk(t: Tables):
    starts = seeds(t).select("query_id", F.concat(F.lit("o"), "node_id").alias("node_id"))
    return graph.bfs_edges(starts, order_edges(t), 3, 100_000)


@query(f"{_EDGE_WALK} SELECT * FROM nodes")
def bfs_edges(t: Tables) -> DataFrame:
    return _edge_walk(t)[0]


@query(f"{_EDGE_WALK} SELECT a.query_id, source_id, target_id, weight FROM strong JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id AND a.query_id = b.query_id")
def induced_edges(t: Tables) -> DataFrame:
    return _edge_walk(t)[1].select("query_id", "source_id", "target_id", "weight")


@query(f"""{_EDGE_WALK}, inside AS (SELECT a.query_id, source_id, target_id, weight FROM strong JOIN nodes a ON a.node_id = source_id JOIN nodes b ON b.node_id = target_id AND a.query_id = b.query_id)
  SELECT query_id, node_id, round(sum(weight), 4) AS weight FROM (SELECT query_id, source_id AS node_id, weight FROM inside UNION ALL SELECT query_id, target_id, weight FROM inside) GROUP BY ALL""")
def subgraph_rank(t: Tables) -> DataFrame:
    nodes, _ = _edge_walk(t)
    return graph.subgraph_rank(nodes, order_edges(t).filter("weight >= 100000"))


@query(f"WITH {ORDER_EDGES} SELECT node_id, round(sum(weight), 4) AS weight FROM (SELECT source_id AS node_id, weight FROM edges UNION ALL SELECT target_id, weight FROM edges) GROUP BY 1 ORDER BY weight DESC, node_id LIMIT 100")
def weighted_degree(t: Tables) -> DataFrame:
    return graph.weighted_degree(order_edges(t), 100)


@query("SELECT greatest(coalesce(floor(sum(length(text)) / 1000), 0), 50000)::BIGINT AS budget FROM documents")
def auto_budget(t: Tables) -> DataFrame:
    return graph.auto_budget(t.documents)


@query(f"""WITH {TAGS}, deg AS (SELECT doc_id, count(DISTINCT tag) AS degree FROM tags JOIN molecules ON mol_id = node_id GROUP BY doc_id ORDER BY degree DESC, doc_id LIMIT 20),
  ranked AS (SELECT doc_id, row_number() OVER (ORDER BY degree DESC, doc_id) AS rank FROM deg),
  placed AS (SELECT mol_id AS node_id, content, row_number() OVER (ORDER BY rank, start_byte) AS place, round((20 - rank + 1) / 20.0, 4)::DOUBLE AS centrality, sum(length(content)) OVER (ORDER BY rank, start_byte ROWS UNBOUNDED PRECEDING) AS used FROM molecules JOIN ranked USING (doc_id))
  SELECT node_id, place, centrality, content FROM placed WHERE used <= 50000""")
def illuminate(t: Tables) -> DataFrame:
    return graph.illuminate(tags(t), molecules(t))


def order_nodes(t: Tables) -> DataFrame:
    start = F.col("o_orderkey") * 10
    return t.orders.select(F.col("o_orderkey").alias("node_id"), F.col("o_orderdate").alias("ts"), (F.col("o_orderkey") * 2654435761).alias("simhash"), F.col("o_custkey").alias("compound_id"), start.alias("start_byte"), (start + 5).alias("end_byte"))


def anchors(t: Tables) -> DataFrame:
    """The query set: orders whose key is divisible by 50, two anchors a query."""
    return t.orders.filter("o_orderkey % 50 = 0").select(F.floor(F.col("o_orderkey") / 100).alias("query_id"), F.col("o_orderkey").alias("node_id"))


_GRAVITY = f"""WITH {PART_TAGS}, d AS (SELECT DISTINCT node_id, tag FROM part_tags), anchors AS (SELECT o_orderkey // 100 AS query_id, o_orderkey AS anchor FROM orders WHERE o_orderkey % 50 = 0),
  nodes AS (SELECT o_orderkey AS node_id, o_orderdate AS ts, o_orderkey * 2654435761 AS bits, o_custkey AS c, o_orderkey * 10 AS a, o_orderkey * 10 + 5 AS b FROM orders),
  shared AS (SELECT query_id, anchor, y.node_id, count(*) AS shared FROM anchors JOIN d x ON x.node_id = anchor JOIN d y ON y.tag = x.tag GROUP BY ALL),
  near AS (SELECT query_id, anchor, n.node_id FROM anchors JOIN nodes m ON m.node_id = anchor JOIN nodes n ON n.c = m.c AND n.b >= m.a - 1000 AND n.a <= m.b + 1000),
  met AS (SELECT query_id, anchor, node_id, coalesce(s.shared, 0) AS shared, (n.node_id IS NOT NULL)::INT AS bonus FROM shared s FULL JOIN near n USING (query_id, anchor, node_id)),
  scored AS (SELECT query_id, met.node_id, anchor, met.shared, round(greatest(0, least(1, met.shared / 10 * 0.85 + 0.1 * bonus)) * exp(-1e-5 * least(abs(epoch(x.ts) - epoch(y.ts)) / 3600, 700000)) * (1 - bit_count(xor(x.bits, y.bits)) / 64), 6) AS score
    FROM met JOIN nodes x ON x.node_id = met.node_id JOIN nodes y ON y.node_id = anchor WHERE (query_id, met.node_id) NOT IN (SELECT (query_id, anchor) FROM anchors)),
  best AS (SELECT *, row_number() OVER (PARTITION BY query_id, node_id ORDER BY score DESC, anchor) AS j FROM scored WHERE score > 0.05 ),
  top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS k FROM best WHERE j = 1)"""


@query(f"{_GRAVITY} SELECT query_id, node_id, score, anchor AS best_anchor, 1::INTEGER AS hop, shared FROM top WHERE k <= 50")
def gravity_walk(t: Tables) -> DataFrame:
    return graph.gravity_walk(anchors(t), order_nodes(t), part_tags(t), threshold=0.05)


@query(f"{_GRAVITY} SELECT query_id, node_id, score, anchor AS best_anchor, 1::INTEGER AS hop, shared FROM top WHERE k <= 150")
def gravity_walk_high_budget(t: Tables) -> DataFrame:
    return graph.gravity_walk(anchors(t), order_nodes(t), part_tags(t), "high_budget")


@query(f"{_GRAVITY.replace('/ 10 * 0.85', '/ 10 * 1.0').replace('exp(-1e-5 *', 'exp(0 *').replace('score > 0.05', 'score > 0')} SELECT query_id, node_id, score, anchor AS best_anchor, 1::INTEGER AS hop, shared FROM top WHERE k <= 1000")
def gravity_walk_max_recall(t: Tables) -> DataFrame:
    return graph.gravity_walk(anchors(t), order_nodes(t), part_tags(t), "max_recall")


@query(f"{_GRAVITY} SELECT query_id, node_id, CASE WHEN score > 0.8 AND shared > 2 THEN 'strong bond' WHEN shared >= 3 THEN 'recurring' ELSE 'association' END AS label, shared || ' shared tags, 1 hops' AS reason FROM top WHERE k <= 50")
def link_labels(t: Tables) -> DataFrame:
    return graph.link_labels(graph.gravity_walk(anchors(t), order_nodes(t), part_tags(t), threshold=0.05)).select("query_id", "node_id", "label", "reason")


@query(f"""WITH {PART_TAGS}, d AS (SELECT DISTINCT node_id, tag FROM part_tags), anchors AS (SELECT o_orderkey // 100 AS query_id, o_orderkey AS anchor FROM orders WHERE o_orderkey % 50 = 0),
  w AS (SELECT DISTINCT query_id, tag FROM anchors JOIN d ON node_id = anchor), f AS (SELECT query_id, node_id, count(*) AS shared FROM w JOIN d USING (tag) WHERE (query_id, node_id) NOT IN (SELECT (query_id, anchor) FROM anchors) GROUP BY ALL)
  SELECT query_id, node_id, shared, round(0.1 * shared, 4)::DOUBLE AS score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY shared DESC, node_id) <= 50""")
def walk_from_tags(t: Tables) -> DataFrame:
    return graph.walk_from_tags(anchors(t), part_tags(t))


def _results(t: Tables) -> DataFrame:
    """Parts of a brand and a price step as the results of a query."""
    p = t.part
    return p.select(F.concat_ws(":", "p_brand", F.floor(F.col("p_retailprice") / 5).cast("string")).alias("query_id"), F.col("p_partkey").alias("node_id"), F.col("p_type").alias("source"), F.col("p_size").alias("seq"), F.split("p_name", " ").alias("tags"), F.array("p_type").alias("buckets"))


_RESULTS = "results AS (SELECT p_brand || ':' || floor(p_retailprice / 5)::BIGINT AS query_id, p_partkey AS node_id, p_type AS source, p_size AS seq, string_split(p_name, ' ') AS tags, [p_type] AS buckets FROM part)"


@query(f"""WITH {_RESULTS}, p AS (SELECT a.query_id, a.node_id AS a, b.node_id AS b, (2 * len(list_intersect(a.buckets, b.buckets)) + len(list_intersect(a.tags, b.tags)) + CASE WHEN a.source = b.source THEN 5 ELSE 0 END
    + CASE WHEN a.source = b.source AND abs(a.seq - b.seq) = 1 THEN 10 WHEN a.source = b.source AND abs(a.seq - b.seq) < 5 THEN 3 ELSE 0 END)::INTEGER AS strength FROM results a JOIN results b ON a.query_id = b.query_id AND a.node_id <> b.node_id)
  SELECT * FROM p WHERE strength > 0 QUALIFY row_number() OVER (PARTITION BY query_id, a ORDER BY strength DESC, b) <= 5""")
def bright_nodes(t: Tables) -> DataFrame:
    return graph.bright_nodes(_results(t))


@query(f"""WITH {_RESULTS}, r AS (SELECT DISTINCT query_id, node_id, unnest(tags) AS tag FROM results), p AS (SELECT a.query_id, a.node_id, b.node_id AS related, count(*) AS shared FROM r a JOIN r b ON a.query_id = b.query_id AND a.tag = b.tag AND a.node_id <> b.node_id GROUP BY ALL)
  SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id, node_id ORDER BY shared DESC, related) <= 3""")
def related_nodes(t: Tables) -> DataFrame:
    return graph.related_nodes(_results(t))


@query()
def themes(t: Tables) -> DataFrame:
    return graph.themes(_results(t))


@query(f"""WITH q AS (SELECT item_id AS query_id, {WORDS.format('text')}[1:3] AS terms FROM benchmark), m AS (SELECT query_id, len(list_distinct(terms)) AS n, unnest(list_distinct(terms)) AS term FROM q),
  w AS (SELECT DISTINCT doc_id AS node_id, unnest({WORDS.format('text')}) AS w FROM documents),
  hit AS (SELECT query_id, n, node_id, count(DISTINCT term) AS h FROM m JOIN w ON starts_with(w.w, m.term) AND length(m.term) >= 3 OR w.w = m.term OR (length(m.term) < 3 AND substr(w.w, 1, 3) = m.term) GROUP BY ALL)
  SELECT query_id, node_id FROM hit WHERE h = n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node_id) <= 20""")
def seed_nodes(t: Tables) -> DataFrame:
    queries = t.benchmark.select(F.col("item_id").alias("query_id"), F.slice(T.words(F.col("text")), 1, 3).alias("terms"))
    return graph.seed_nodes(queries, t.documents.select(F.col("doc_id").alias("node_id"), F.col("text").alias("content")))


# --- mining -----------------------------------------------------------------------------------------

_PARTS_BY_ORDERS = "WITH e AS (SELECT DISTINCT l_partkey AS node_id, l_suppkey || ':' || l_linenumber AS tag FROM lineitem)"


def _supplier_tags(t: Tables) -> DataFrame:
    return t.lineitem.select(F.col("l_partkey").alias("node_id"), F.concat_ws(":", "l_suppkey", "l_linenumber").alias("tag"), F.lit("b").alias("bucket")).distinct()


@query(f"""{_PARTS_BY_ORDERS}, u AS (SELECT tag, count(*) AS n FROM e GROUP BY tag HAVING count(*) >= 2 ORDER BY n DESC, tag LIMIT 500), o AS (SELECT e.* FROM e JOIN u USING (tag)),
  p AS (SELECT x.tag AS a, y.tag AS b, count(*) AS c FROM o x JOIN o y ON x.node_id = y.node_id AND x.tag < y.tag GROUP BY ALL)
  SELECT a, b, round(c / (x.n + y.n - c), 6) AS score FROM p JOIN u x ON x.tag = a JOIN u y ON y.tag = b WHERE round(c / (x.n + y.n - c), 6) >= 0.06""")
def synonyms_by_tags(t: Tables) -> DataFrame:
    return mining.synonyms_by_tags(_supplier_tags(t), least=0.06)


@query(f"""WITH {MOLECULES}, w AS (SELECT DISTINCT mol_id, w FROM (SELECT mol_id, unnest({WORDS.format('content')}) AS w FROM molecules) WHERE length(w) >= 5 AND w NOT IN ({', '.join(f"'{x}'" for x in T.STOP_WORDS)}))
  SELECT x.w AS a, y.w AS b, count(*) AS n FROM w x JOIN w y ON x.mol_id = y.mol_id AND x.w < y.w GROUP BY ALL HAVING count(*) >= 20""")
def synonyms_by_cooccurrence(t: Tables) -> DataFrame:
    return mining.synonyms_by_cooccurrence(molecules(t), 20)


@query()
def synonyms_by_simhash(t: Tables) -> DataFrame:
    return mining.synonyms_by_simhash(dedup.simhash64(t.documents), t.documents)


@query()
def synonym_rings(t: Tables) -> DataFrame:
    return mining.synonym_rings({"tags": mining.synonyms_by_tags(_supplier_tags(t), least=0.06), "together": mining.synonyms_by_cooccurrence(molecules(t), 20), "simhash": mining.synonyms_by_simhash(dedup.simhash64(t.documents), t.documents, k=5)})


@query(f"""WITH {PART_TAGS}, d AS (SELECT DISTINCT node_id, tag FROM part_tags), k AS (SELECT node_id, count(*) AS k FROM d GROUP BY 1), u AS (SELECT tag, count(*) AS n FROM part_tags GROUP BY 1), us AS (SELECT tag, count(*) AS uses FROM d GROUP BY 1),
  p AS (SELECT a.tag, b.tag AS other FROM d a JOIN d b ON a.node_id = b.node_id AND a.tag <> b.tag GROUP BY ALL HAVING count(*) >= 2),
  c AS (SELECT p.tag FROM p JOIN us x ON x.tag = p.tag JOIN us y ON y.tag = p.other GROUP BY p.tag HAVING NOT bool_or(y.uses > x.uses OR (y.uses = x.uses AND y.tag > x.tag)))
  SELECT 'avg_tags' AS metric, round(avg(k), 4) AS value FROM k UNION ALL SELECT 'max_tags', max(k)::DOUBLE FROM k UNION ALL SELECT 'median_tags', median(k)::DOUBLE FROM k UNION ALL SELECT 'unique_tags', count(*)::DOUBLE FROM u
  UNION ALL SELECT 'used_once', count(*)::DOUBLE FROM u WHERE n = 1 UNION ALL SELECT 'orphans', count(*)::DOUBLE FROM u WHERE n = 1 UNION ALL SELECT 'clusters', count(*)::DOUBLE FROM c""")
def tag_audit(t: Tables) -> DataFrame:
    return mining.tag_audit(part_tags(t))


@query(f"""WITH {TAGS}, f AS (SELECT mol_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT mol_id, list_filter({WORDS.format('content')}, lambda w: length(w) >= 4 AND length(w) < 30 AND NOT list_contains([{', '.join(f"'{x}'" for x in T.STOP_WORDS)}], w)) AS l FROM molecules)),
  g AS (SELECT mol_id, w, min(pos) AS pos FROM f GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY pos) AS r FROM g), own AS (SELECT DISTINCT node_id, tag FROM tags WHERE length(tag) % 2 = 0),
  k AS (SELECT DISTINCT tag, lower(regexp_replace(tag, '^#', '')) AS w FROM tags)
  SELECT mol_id AS node_id, tag, 0.8::DOUBLE AS confidence FROM h JOIN k USING (w) WHERE r <= 20 AND NOT EXISTS (SELECT 1 FROM own WHERE own.node_id = h.mol_id AND own.tag = k.tag) QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY r, tag) <= 5""")
def suggest_tags(t: Tables) -> DataFrame:
    every = tags(t)
    nodes = molecules(t).select(F.col("mol_id").alias("node_id"), "content")
    lacking = every.filter("length(tag) % 2 = 0").select("node_id", "tag").unionByName(every.select(F.lit("").alias("node_id"), "tag"))
    return mining.suggest_tags(nodes, lacking)


@query(f"""WITH {TAGS}, f AS (SELECT mol_id, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT mol_id, list_filter({WORDS.format('content')}, lambda w: length(w) >= 4 AND length(w) < 30 AND NOT list_contains([{', '.join(f"'{x}'" for x in T.STOP_WORDS)}], w)) AS l FROM molecules)),
  g AS (SELECT mol_id, w, min(pos) AS pos FROM f GROUP BY ALL), h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY mol_id ORDER BY pos) AS r FROM g) WHERE r <= 20), own AS (SELECT DISTINCT node_id, tag FROM tags WHERE length(tag) % 2 = 0),
  k AS (SELECT DISTINCT tag, lower(regexp_replace(tag, '^#', '')) AS w FROM tags), c AS (SELECT h.w, tag, CASE WHEN h.w = k.w THEN 0.8 ELSE 0.3 END::DOUBLE AS confidence FROM (SELECT DISTINCT w FROM h) h JOIN k ON contains(k.w, h.w)),
  m AS (SELECT mol_id, tag, confidence, r FROM h JOIN c USING (w) WHERE NOT EXISTS (SELECT 1 FROM own WHERE own.node_id = h.mol_id AND own.tag = c.tag) QUALIFY row_number() OVER (PARTITION BY mol_id, tag ORDER BY confidence DESC, r) = 1)
  SELECT mol_id AS node_id, tag, confidence FROM m QUALIFY row_number() OVER (PARTITION BY mol_id ORDER BY confidence DESC, r, tag) <= 5""")
def suggest_tags_contained(t: Tables) -> DataFrame:
    every = tags(t)
    nodes = molecules(t).select(F.col("mol_id").alias("node_id"), "content")
    lacking = every.filter("length(tag) % 2 = 0").select("node_id", "tag").unionByName(every.select(F.lit("").alias("node_id"), "tag"))
    return mining.suggest_tags(nodes, lacking, contained=True)


@query(f"""WITH held AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS w FROM documents) WHERE w IN ('license', 'apache')),
  f AS (SELECT '#' || lower(w) AS tag FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS w FROM documents JOIN held USING (doc_id)) WHERE regexp_matches(w, '^[A-Z][a-z]{{3,}}$'))
  SELECT tag, count(*) AS n FROM f WHERE tag NOT IN ('#license', '#apache') GROUP BY tag HAVING count(*) >= 2""")
def discover_tags(t: Tables) -> DataFrame:
    nodes = t.documents.select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"))
    words = t.spark.createDataFrame([("license",), ("apache",)], "word string")
    return mining.discover_tags(nodes, words, words.select(F.concat(F.lit("#"), "word").alias("tag")))


@query(f"""WITH {PART_TAGS}, n AS (SELECT node_id, '#' || tag AS tag FROM part_tags) SELECT 'kept' AS part, count(*) AS n FROM n WHERE NOT regexp_matches(tag, '^#([0-9a-fA-F]{{3,8}}|\\d{{1,3}})$') AND NOT length(regexp_replace(tag, '[^0-9]', '', 'g')) > 0.7 * length(tag)
  UNION ALL SELECT 'removed', count(*) FROM n WHERE regexp_matches(tag, '^#([0-9a-fA-F]{{3,8}}|\\d{{1,3}})$') OR length(regexp_replace(tag, '[^0-9]', '', 'g')) > 0.7 * length(tag)""")
def cleanup_tags(t: Tables) -> DataFrame:
    kept, removed = mining.cleanup_tags(part_tags(t).withColumn("tag", F.concat(F.lit("#"), F.col("tag").cast("string"))))
    zero = F.lit(0).cast("long")
    return kept.agg(F.lit("kept").alias("part"), F.count("*").alias("n")).unionByName(removed.agg(F.lit("removed").alias("part"), F.coalesce(F.sum("removed"), zero).alias("n")))
