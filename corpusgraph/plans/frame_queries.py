"""Frame verbs, joins, aggregates and windows over the order tables and events."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import frame, windows
from .registry import Tables, query


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_name LIKE '%ring%' AND p_size >= 20")
def builder_where_like(t: Tables) -> DataFrame:
    return frame.query(t.part).where("p_name", "CONTAINS", "ring").where("p_size", ">=", 20).select("p_partkey", "p_name", "p_size").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def builder_order_limit(t: Tables) -> DataFrame:
    q = frame.query(t.orders.orderBy("o_orderkey")).where("o_orderstatus", "=", "F").select("o_orderkey", "o_totalprice").to_df()
    return frame.head(q, 25, F.col("o_totalprice").desc_nulls_first(), "o_orderkey")


@query("SELECT o_orderkey, o_totalprice * 2 AS doubled, upper(o_orderpriority) AS priority FROM orders WHERE o_totalprice > 400000")
def frame_select_transform(t: Tables) -> DataFrame:
    rows = frame.filter_rows(t.orders, "o_totalprice > 400000")
    return frame.select_cols(frame.transform_cols(rows, {"doubled": F.col("o_totalprice") * 2}), {"o_orderkey": "o_orderkey", "doubled": "doubled", "priority": "upper(o_orderpriority)"})


@query("""SELECT o_orderkey, status, place FROM (SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status,
  row_number() OVER (ORDER BY nullif(o_orderstatus, 'P') DESC NULLS LAST, o_orderkey) AS place FROM orders) WHERE place <= 200""")
def frame_sort_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"))
    top = frame.sort_rows(rows, "status", "desc", "o_orderkey").limit(200)
    return windows.top_k(top.withColumn("_g", F.lit(0)), ["_g"], [F.col("status").desc_nulls_last(), "o_orderkey"], 200, "place").select("o_orderkey", "status", F.col("place").cast("long").alias("place"))


@query("""(SELECT 'head' AS part, c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10) UNION ALL
  (SELECT 'page', c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 100) UNION ALL
  (SELECT 'tail', c_custkey FROM customer ORDER BY c_custkey DESC LIMIT 10)""")
def frame_head_page_tail(t: Tables) -> DataFrame:
    c = t.customer
    parts = [("head", frame.head(c, 10, "c_acctbal", "c_custkey")), ("page", frame.list_rows(c, "c_acctbal", ("c_acctbal",), 50, 100, "c_custkey")), ("tail", frame.tail(c, 10, "c_custkey"))]
    first, *rest = [p.select(F.lit(n).alias("part"), "c_custkey") for n, p in parts]
    for p in rest:
        first = first.unionByName(p)
    return first


@query("SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL")
def value_counts(t: Tables) -> DataFrame:
    return frame.value_counts(t.customer, "c_mktsegment")


@query("SELECT DISTINCT p_brand AS value FROM part")
def unique_values(t: Tables) -> DataFrame:
    return frame.unique_values(t.part, "p_brand")


@query("""SELECT coalesce(n_regionkey::VARCHAR, 'null') AS key, count(*) AS n, string_agg(n_name, ',' ORDER BY n_name) AS names
  FROM (SELECT nullif(n_regionkey, 0) AS n_regionkey, n_name FROM nation) GROUP BY 1""")
def group_rows(t: Tables) -> DataFrame:
    rows = t.nation.select(F.nullif("n_regionkey", F.lit(0)).alias("n_regionkey"), "n_name")
    g = frame.group_rows(rows, "n_regionkey")
    return g.select("key", F.size("rows").cast("long").alias("n"), F.array_join(F.array_sort(F.transform("rows", lambda r: r["n_name"])), ",").alias("names"))


@query("""SELECT l_returnflag, count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_extendedprice), 2) AS revenue,
  min(l_quantity) AS least, max(l_quantity) AS most, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY l_returnflag HAVING count(*) > 10""")
def agg_all(t: Tables) -> DataFrame:
    aggregates = {"n": "count(*)", "parts": "count(distinct l_partkey)", "revenue": "round(sum(l_extendedprice), 2)", "least": "min(l_quantity)", "most": "max(l_quantity)", "discount": "round(avg(l_discount), 6)"}
    return frame.agg_all(t.lineitem, aggregates, ["l_returnflag"]).filter("n > 10")


@query("SELECT (row_number() OVER () - 1)::INTEGER AS position, column_name AS name, lower(replace(replace(column_type, 'VARCHAR', 'string'), 'INTEGER', 'int')) AS type FROM (DESCRIBE SELECT * FROM documents)")
def column_names(t: Tables) -> DataFrame:
    return frame.column_names(t.documents)


@query("SELECT count(*) AS n FROM lineitem")
def row_count(t: Tables) -> DataFrame:
    return frame.row_count(t.lineitem)


@query("""SELECT p_partkey FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR
  len(list_intersect(string_split(p_name, ' '), ['widget', 'bolt'])) > 0""")
def array_membership(t: Tables) -> DataFrame:
    words = F.split("p_name", " ")
    return t.part.filter(frame.has(words, "red") | frame.has_any(words, ["widget", "bolt"])).select("p_partkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RING%' OR p_type ILIKE 'econ%'")
def ilike_filter(t: Tables) -> DataFrame:
    return t.part.filter(frame.ilike_contains(F.col("p_name"), "RING") | frame.ilike_contains(F.col("p_type"), "econ", prefix=True)).select("p_partkey", "p_name")


@query("""SELECT p.doc_id FROM documents p LEFT JOIN labels l ON l.doc_id = p.doc_id
  WHERE CASE WHEN l.toxic = 1 THEN 'quarantine' ELSE 'internal' END <> 'quarantine'""")
def provenance_filter(t: Tables) -> DataFrame:
    marked = t.documents.join(t.labels, "doc_id", "left").withColumn("provenance", F.when(F.col("toxic") == 1, "quarantine").otherwise("internal"))
    return frame.by_provenance(marked, "all").select("doc_id")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 10 AND l_quantity <= 12 AND l_returnflag = 'R'")
def numeric_range(t: Tables) -> DataFrame:
    return t.lineitem.filter(frame.in_range(F.col("l_quantity"), 10, 12) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_quantity")


@query("""SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name""")
def join_inner(t: Tables) -> DataFrame:
    by_customer = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))  # sums first: the join moves one row a customer
    joined = by_customer.join(t.customer.select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.sum("n").alias("n"), F.round(F.sum("total"), 2).alias("total"))


@query("""SELECT c_custkey, count(o_orderkey) AS n, coalesce(round(sum(o_totalprice), 2), 0) AS total FROM customer
  LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY c_custkey""")
def join_left(t: Tables) -> DataFrame:
    open_ = t.orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total"))
    joined = t.customer.join(open_, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce(F.round("total", 2), F.lit(0.0)).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def join_semi(t: Tables) -> DataFrame:
    keys = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return frame.lookup(t.customer, keys, "c_custkey").select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def join_anti(t: Tables) -> DataFrame:
    large = t.orders.filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return t.customer.join(large, "c_custkey", "left_anti").select("c_custkey", "c_name")


_ORDER_TAGS = "WITH tags AS (SELECT DISTINCT l_orderkey AS node_id, p_brand AS tag FROM lineitem JOIN part ON l_partkey = p_partkey)"


@query(f"{_ORDER_TAGS} SELECT x.tag AS a, y.tag AS b, count(*) AS n FROM tags x JOIN tags y ON x.node_id = y.node_id AND x.tag < y.tag GROUP BY ALL")
def join_self_pairs(t: Tables) -> DataFrame:
    tags = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("node_id"), F.col("p_brand").alias("tag")).distinct()
    return frame.self_pairs(tags, "node_id", "tag").groupBy("a", "b").agg(F.count("*").alias("n"))


@query("""SELECT key, name, source FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY source) AS k FROM (
    SELECT c_nationkey AS key, min(c_name) AS name, 0 AS source FROM customer WHERE c_nationkey < 12 GROUP BY 1
    UNION ALL SELECT s_nationkey, min(s_name), 1 FROM supplier GROUP BY 1)) WHERE k = 1""")
def union_first_wins(t: Tables) -> DataFrame:
    own = t.customer.filter("c_nationkey < 12").groupBy(F.col("c_nationkey").alias("key")).agg(F.min("c_name").alias("name")).withColumn("source", F.lit(0))
    other = t.supplier.groupBy(F.col("s_nationkey").alias("key")).agg(F.min("s_name").alias("name")).withColumn("source", F.lit(1))
    return frame.union_first_wins([own, other], "key")


@query("""SELECT a.p_partkey AS a, b.p_partkey AS b, round(len(list_intersect(x, y))::DOUBLE / len(list_distinct(list_concat(x, y))), 6) AS jaccard,
    round(len(list_intersect(x, y))::DOUBLE / least(len(list_distinct(x)), len(list_distinct(y))), 6) AS share
  FROM (SELECT p_partkey, p_size, p_brand, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS x FROM part) a
  JOIN (SELECT p_partkey, p_size, p_brand, list_distinct(string_split(p_name || ' ' || p_type, ' ')) AS y FROM part) b
  ON a.p_size = b.p_size AND a.p_brand = b.p_brand AND a.p_partkey < b.p_partkey""")
def array_set_measures(t: Tables) -> DataFrame:
    words = F.array_distinct(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    a = t.part.select(F.col("p_partkey").alias("a"), "p_size", "p_brand", words.alias("x"))
    b = t.part.select(F.col("p_partkey").alias("b"), "p_size", "p_brand", words.alias("y"))
    pairs = a.join(b, ["p_size", "p_brand"]).filter("a < b")
    return pairs.select("a", "b", F.round(frame.jaccard(F.col("x"), F.col("y")), 6).alias("jaccard"), F.round(frame.overlap_share(F.col("x"), F.col("y")), 6).alias("share"))


@query("""SELECT e.event_id, get.k AS k, e.value FROM events e, LATERAL (SELECT (e.props->>'$.k')::INTEGER AS k) get WHERE get.k >= 90""")
def json_access(t: Tables) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return t.events.select("event_id", k.alias("k"), "value").filter("k >= 90")


# --- windows ----------------------------------------------------------------------------------------

_SESSIONS = """WITH gaps AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) > INTERVAL 1 HOUR AS far,
    lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL AS head FROM events),
  rows_ AS (SELECT *, sum((head OR far)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM gaps)"""


@query(f"""{_SESSIONS}, uses AS (SELECT user_id, island, event_type, count(*) AS u FROM rows_ GROUP BY ALL),
  best AS (SELECT *, row_number() OVER (PARTITION BY user_id, island ORDER BY u DESC, event_type) AS k FROM uses),
  topics AS (SELECT user_id, island, string_agg(event_type, ', ' ORDER BY k) AS topic FROM best WHERE k <= 3 GROUP BY ALL)
  SELECT 'cluster_' || user_id || '_' || strftime(min(ts), '%Y%m%d%H%M%S') AS cluster_id, user_id AS source, min(ts) AS started, max(ts) AS ended, count(*) AS n, any_value(topic) AS topic
  FROM rows_ JOIN topics USING (user_id, island) GROUP BY user_id, island""")
def session_clusters(t: Tables) -> DataFrame:
    return windows.session_clusters(t.events, "user_id", "ts", "event_type", "event_id")


_RANGES = """WITH ranges AS (SELECT l_suppkey AS compound_id, l_orderkey * 40 AS start_byte, l_orderkey * 40 + l_quantity::BIGINT * 4 AS end_byte, l_discount AS score, l_shipdate AS ts, l_linestatus AS tag, l_linenumber FROM lineitem)"""


def _ranges(t: Tables) -> DataFrame:
    start = F.col("l_orderkey") * 40
    return t.lineitem.select(F.col("l_suppkey").alias("compound_id"), start.alias("start_byte"), (start + F.col("l_quantity").cast("long") * 4).alias("end_byte"), F.col("l_discount").alias("score"), F.col("l_shipdate").alias("ts"), F.array("l_linestatus").alias("tags"))


@query(f"""{_RANGES}, reach AS (SELECT *, max(end_byte) OVER (PARTITION BY compound_id ORDER BY start_byte, end_byte ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ranges),
  islands AS (SELECT *, sum(coalesce((start_byte - reached > 500)::INT, 1)) OVER (PARTITION BY compound_id ORDER BY start_byte, end_byte ROWS UNBOUNDED PRECEDING) AS island FROM reach)
  SELECT compound_id, min(start_byte) AS start_byte, max(end_byte) AS end_byte, max(score) AS score, min(ts) AS ts, string_agg(DISTINCT tag, ',' ORDER BY tag) AS tags, count(*) AS n FROM islands GROUP BY compound_id, island""")
def coalesce_by_proximity(t: Tables) -> DataFrame:
    return windows.coalesce_by_proximity(_ranges(t)).withColumn("tags", F.array_join("tags", ","))


@query("""SELECT l_returnflag, l_orderkey, l_linenumber, place FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS place FROM
  (SELECT DISTINCT l_returnflag, l_linestatus, l_extendedprice, l_orderkey, l_linenumber FROM lineitem)) WHERE place <= 5""")
def top_k_per_group(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey", "l_linenumber").distinct()
    return windows.top_k(rows, ["l_returnflag", "l_linestatus"], [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], 5, "place").select("l_returnflag", "l_orderkey", "l_linenumber", F.col("place").cast("long").alias("place"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def distinct_on(t: Tables) -> DataFrame:
    return windows.distinct_on(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_custkey", "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN k <= greatest(1, floor(n * 0.1)) THEN 1000.0 WHEN k <= greatest(1, floor(n * 0.1)) + floor(n * 0.4) THEN 750.0 ELSE 500.0 END::DOUBLE AS radius
  FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def progressive_radius(t: Tables) -> DataFrame:
    return windows.progressive_radius(t.orders, ["o_custkey"], [F.col("o_totalprice").desc(), "o_orderkey"], 500).select("o_orderkey", "radius")


@query("""WITH a AS (SELECT o_orderkey, o_custkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS every,
    row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS turn FROM orders),
  b AS (SELECT *, min(every) OVER (PARTITION BY o_custkey, o_orderpriority) AS first FROM a)
  SELECT o_orderkey, turn, row_number() OVER (PARTITION BY o_custkey ORDER BY turn, first) AS place FROM b""")
def round_robin_by_group(t: Tables) -> DataFrame:
    out = windows.round_robin(t.orders, ["o_custkey"], "o_orderpriority", [F.col("o_totalprice").desc(), "o_orderkey"])
    return out.select("o_orderkey", F.col("turn").cast("long").alias("turn"), F.col("place").cast("long").alias("place"))


@query("""SELECT doc_id, used FROM (SELECT doc_id, sum(length(text)) OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM documents) WHERE used <= 50000""")
def budget_prefix(t: Tables) -> DataFrame:
    sizes = t.documents.select("doc_id", "source", "n_chars", F.length("text").cast("long").alias("size"))
    return windows.budget_prefix(sizes, ["source"], [F.col("n_chars").desc(), "doc_id"], F.col("size"), 50_000).select("doc_id", "used")


@query("""SELECT c_custkey, round((n - k)::DOUBLE / n, 4) AS centrality FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1 AS k,
  count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def centrality_score(t: Tables) -> DataFrame:
    return windows.centrality_score(t.customer, ["c_nationkey"], [F.col("c_acctbal").desc(), "c_custkey"]).select("c_custkey", "centrality")


@query("""SELECT o_orderkey, coalesce(last_value(CASE WHEN o_orderstatus = 'F' THEN o_orderdate END IGNORE NULLS) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), TIMESTAMP '1990-01-01') AS ts FROM orders""")
def carry_forward_time(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("ts"))
    default = F.lit("1990-01-01 00:00:00").cast(rows.schema["ts"].dataType)
    return windows.carry_forward(rows, ["o_custkey"], ["o_orderkey"], "ts", default).select("o_orderkey", "ts")


@query("""SELECT 'c' || a.conv_id || ':' || a.turn AS a, 'c' || b.conv_id || ':' || b.turn AS b, CASE WHEN b.turn - a.turn = 1 THEN 'next_chunk' ELSE 'near' END AS relation
  FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn > a.turn AND b.turn - a.turn < 5""")
def adjacent_chunks(t: Tables) -> DataFrame:
    rows = t.conversations.withColumn("node", F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn"))
    return windows.adjacent_chunks(rows, "conv_id", "turn", "node")


@query("""WITH e AS (SELECT user_id, ts, event_id, value / 100 AS relevance FROM events), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e WHERE relevance > 0.7)
  SELECT user_id, min(ts) AS earliest, max(ts) AS latest, ceil((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::BIGINT AS span_days,
  coalesce((SELECT string_agg(k.event_id::VARCHAR, ',' ORDER BY k.k) FROM k WHERE k.user_id = e.user_id AND k.k <= 5), '') AS moments FROM e GROUP BY user_id""")
def timeline(t: Tables) -> DataFrame:
    return windows.timeline(t.events.withColumn("relevance", F.col("value") / 100), ["user_id"], "ts", "relevance", "event_id")


@query("""WITH s AS (SELECT conv_id, turn, text, TIMESTAMP '2024-01-01' + to_days(turn::INTEGER * 3) AS ts, 1.0 / (1 + turn) AS relevance FROM conversations),
  r AS (SELECT *, round(0.7 * relevance + 0.3 * greatest(0, least(1, 1 - (21 - turn * 3) / 30.0)), 6) AS score FROM s),
  u AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY score DESC, ts, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM r),
  p AS (SELECT *, 1900 - used AS remains, substr(text, 1, (1900 - used)::BIGINT) AS part, regexp_extract(substr(text, 1, (1900 - used)::BIGINT), '(?s)^(.*[.!?])', 1) AS cut FROM u WHERE used < 1900),
  q AS (SELECT *, CASE WHEN length(text) <= remains THEN text WHEN remains > 200 THEN CASE WHEN length(cut) > remains / 2 THEN cut ELSE part END END AS piece FROM p)
  SELECT conv_id, turn, score::DOUBLE AS score, piece, row_number() OVER (PARTITION BY conv_id ORDER BY ts, text) AS place FROM q WHERE piece IS NOT NULL""")
def rolling_context(t: Tables) -> DataFrame:
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    rows = t.conversations.withColumn("ts", F.timestamp_add("DAY", (F.col("turn") * 3).cast("int"), start)).withColumn("relevance", 1.0 / (1 + F.col("turn")))
    now = F.lit("2024-01-22 00:00:00").cast("timestamp")
    out = windows.rolling_context(rows, ["conv_id"], "text", "ts", "relevance", now, F.lit(False), 500)
    return out.select("conv_id", "turn", "score", "piece", F.col("place").cast("long").alias("place"))
