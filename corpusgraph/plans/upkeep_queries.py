"""Sensitive data, lifecycle, sources, sinks and streams."""

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import buckets, lifecycle, sensitive
from ..sources import corpus, sinks
from ..streaming import jobs, stateful
from .corpus_queries import NORM, TAGS, molecules
from .registry import Tables, query

# --- sensitive data ---------------------------------------------------------------------------------

#: Kinds without an entropy rule that SQL can count with the same pattern
_PLAIN = [p for p in sensitive.PATTERNS if p[0] in ("SSN", "IP_ADDRESS", "AWS_KEY", "CREDIT_CARD")]


@query(" UNION ALL ".join(f"SELECT doc_id, '{k}' AS type, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}')) FROM documents) GROUP BY doc_id" for k, p, *_ in _PLAIN))
def sensitive_counts(t: Tables) -> DataFrame:
    return sensitive.matches(t.documents, _PLAIN).groupBy("doc_id", "type").agg(F.count("*").alias("n"))


def _kind_hits(i: int) -> str:
    """SQL for the hits of one kind with enough entropy: doc_id, type, s, e, found."""
    kind, pattern, group, least = sensitive.PATTERNS[i]
    pattern = pattern.replace("'", "''")
    inner = "greatest(strpos(m, found) - 1, 0)" if group else "0"
    enough = f"""WHERE list_sum(list_transform(list_distinct(string_split(found, '')), lambda c: -(list_count(list_filter(string_split(found, ''), lambda x: x = c)) / length(found)) * log2(list_count(list_filter(string_split(found, ''), lambda x: x = c)) / length(found)))) >= {least}""" if least else ""
    return f"""SELECT doc_id, '{kind}' AS type, place + {inner} AS s, place + {inner} + length(found) AS e, found FROM (
      SELECT doc_id, m, found, sum(length(piece) + length(m)) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING)::BIGINT - length(m) AS place FROM (
        SELECT doc_id, unnest(ms) AS m, unnest(fs) AS found, unnest(ps[1:len(ms)]) AS piece, generate_subscripts(ms, 1) AS k FROM (
          SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, regexp_extract_all(text, '{pattern}', {group}) AS fs, regexp_split_to_array(text, '{pattern}') AS ps FROM documents WHERE regexp_matches(text, '{pattern}')))) {enough}"""


_SENSITIVE = "t0 AS (" + _kind_hits(0) + ")" + "".join(f", t{i} AS (SELECT * FROM t{i - 1} UNION ALL SELECT * FROM ({_kind_hits(i)}) h WHERE NOT EXISTS (SELECT 1 FROM t{i - 1} t WHERE t.doc_id = h.doc_id AND t.s < h.e AND h.s < t.e))" for i in range(1, len(sensitive.PATTERNS)))
_LAST = f"t{len(sensitive.PATTERNS) - 1}"


@query(f"""WITH {_SENSITIVE} SELECT doc_id, type, s AS start, e AS "end", substr(sha256(found), 1, 16) AS hash, 1.0::DOUBLE AS confidence FROM {_LAST}""")
def scan_sensitive(t: Tables) -> DataFrame:
    return sensitive.scan_sensitive(t.documents)


@query(f"WITH {_SENSITIVE} SELECT type, count(*) AS n, sum(e - s)::BIGINT AS chars, round(100 * count(*) / (SELECT count(*) FROM {_LAST}), 2) AS share FROM {_LAST} GROUP BY type")
def sensitive_stats(t: Tables) -> DataFrame:
    return sensitive.sensitive_stats(sensitive.scan_sensitive(t.documents))


@query("""WITH c AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents), k AS (SELECT doc_id, c, count(*) AS k FROM c GROUP BY ALL), n AS (SELECT doc_id, sum(k) AS n FROM k GROUP BY 1)
  SELECT doc_id, round(-sum(k / n * log2(k / n)), 4) AS entropy FROM k JOIN n USING (doc_id) GROUP BY doc_id""")
def entropy(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.round(sensitive.shannon_entropy(F.col("text")), 4).alias("entropy"))


# --- lifecycle --------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0")
def upsert(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return lifecycle.upsert(rows, rows.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"])


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def insert_missing(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return lifecycle.upsert(rows.filter("o_orderkey % 2 = 0"), rows.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1), ["o_orderkey"], replace=False)


def _ledger(t: Tables) -> DataFrame:
    return t.documents.filter("doc_id % 4 = 0").select(F.col("doc_id").cast("string").alias("path"), F.sha2(F.when(F.col("doc_id") % 8 == 0, F.col("text")).otherwise(F.lower("text")), 256).alias("hash"))


_LEDGER = "ledger AS (SELECT doc_id::VARCHAR AS path, sha256(CASE WHEN doc_id % 8 = 0 THEN text ELSE lower(text) END) AS hash FROM documents WHERE doc_id % 4 = 0)"


@query(f"""WITH {_LEDGER}, h AS (SELECT *, sha256(text) AS hash, min(doc_id) OVER (PARTITION BY sha256(text)) AS first FROM documents)
  SELECT CASE WHEN trim(text) = '' THEN 'error' WHEN hash IN (SELECT hash FROM ledger) OR doc_id <> first THEN 'skipped' ELSE 'imported' END AS outcome, count(*) AS n FROM h GROUP BY 1""")
def ingest_records(t: Tables) -> DataFrame:
    return lifecycle.outcome_counts(lifecycle.ingest_outcomes(t.documents, _ledger(t)))


@query(f"""WITH {_LEDGER}, d AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS hash FROM documents WHERE doc_id % 16 <> 0)
  SELECT coalesce(d.path, l.path) AS path, coalesce(d.hash, l.hash) AS hash, CASE WHEN l.hash IS NULL THEN 'new' WHEN d.hash IS NULL THEN 'removed' WHEN d.hash = l.hash THEN 'unchanged' ELSE 'changed' END AS change FROM d FULL JOIN ledger l ON d.path = l.path""")
def source_changes(t: Tables) -> DataFrame:
    return lifecycle.changes(t.documents.filter("doc_id % 16 <> 0").withColumn("path", F.col("doc_id").cast("string")), _ledger(t))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND (doc_id % 8 = 0 OR text = lower(text)) THEN 'old' ELSE 'new' END AS version FROM documents")
def incremental_ingest(t: Tables) -> DataFrame:
    rows = t.documents.withColumn("path", F.col("doc_id").cast("string")).withColumn("version", F.lit("new"))
    stored = rows.filter("doc_id % 4 = 0").withColumn("version", F.lit("old"))
    return lifecycle.incremental_ingest(rows, stored, _ledger(t))[0].select("doc_id", "version")


def _stored(t: Tables) -> dict[str, DataFrame]:
    from ..operators import prepare
    from .corpus_queries import tagged

    mols = molecules(t)
    return {"molecules": mols} | prepare.build_tag_tables(mols, tagged(t, mols))


@query(f"""WITH {TAGS}, keep AS (SELECT * FROM molecules WHERE source <> 'src1') SELECT 'molecules' AS name, count(*) AS n FROM keep UNION ALL SELECT 'tags', count(*) FROM tags WHERE node_id IN (SELECT mol_id FROM keep)
  UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT doc_id, tag FROM tagged JOIN keep USING (mol_id))""")
def purge_source(t: Tables) -> DataFrame:
    left = lifecycle.purge_source(_stored(t), t.documents, "src1")
    first, *rest = [left[n].agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n in ("molecules", "tags", "edges")]
    for part in rest:
        first = first.unionByName(part)
    return first


@query("SELECT count(*) AS n FROM documents WHERE source NOT IN ('src1', 'src10', 'src11', 'src12', 'src13', 'src14', 'src15', 'src16', 'src17', 'src18', 'src19')")
def purge_directory(t: Tables) -> DataFrame:
    docs = t.documents.withColumn("path", F.concat(F.lit("inbox/"), F.substring("source", 1, 4), F.lit("/"), "doc_id"))
    tables = {"molecules": docs.select(F.col("doc_id").alias("mol_id"), F.col("doc_id").alias("compound_id")), "tags": docs.select(F.col("doc_id").alias("node_id")), "edges": docs.select(F.col("doc_id").alias("source_id"), F.col("doc_id").alias("target_id")), "positions": docs.select(F.col("doc_id").alias("compound_id"))}
    return lifecycle.purge_directory(tables, docs, "inbox/src1")["molecules"].agg(F.count("*").alias("n"))


def _nodes(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("node_id"), F.lit("internal").alias("provenance"), F.array(F.concat(F.lit("#"), "lang")).alias("tags"), "n_chars")


@query("""WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id AS node_id, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN 'quarantine' ELSE 'internal' END AS provenance,
  '#' || lang || CASE WHEN doc_id IN (SELECT doc_id FROM toxic) THEN ',#manually_quarantined' ELSE '' END AS tags FROM documents""")
def quarantine(t: Tables) -> DataFrame:
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("node_id"))
    return lifecycle.quarantine(_nodes(t), toxic).select("node_id", "provenance", F.array_join("tags", ",").alias("tags"))


@query("""WITH toxic AS (SELECT DISTINCT doc_id FROM labels WHERE toxic = 1) SELECT doc_id AS node_id, CASE WHEN doc_id IN (SELECT doc_id FROM toxic) AND doc_id % 2 = 1 THEN 'quarantine' ELSE 'internal' END AS provenance,
  '#' || lang || CASE WHEN doc_id IN (SELECT doc_id FROM toxic) AND doc_id % 2 = 1 THEN ',#manually_quarantined' ELSE '' END AS tags FROM documents""")
def restore_quarantined(t: Tables) -> DataFrame:
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("node_id"))
    held = lifecycle.quarantine(_nodes(t), toxic)
    return lifecycle.restore_quarantined(held, toxic.filter("node_id % 2 = 0")).select("node_id", "provenance", F.array_join("tags", ",").alias("tags"))


@query("SELECT doc_id AS node_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) ORDER BY n_chars DESC, doc_id LIMIT 100")
def list_quarantined(t: Tables) -> DataFrame:
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("node_id"))
    return lifecycle.list_quarantined(lifecycle.quarantine(_nodes(t), toxic), "n_chars").select("node_id")


@query("SELECT doc_id AS node_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id % 2 = 0)")
def delete_quarantined(t: Tables) -> DataFrame:
    toxic = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("node_id"))
    return lifecycle.delete_quarantined(lifecycle.quarantine(_nodes(t), toxic), _nodes(t).filter("node_id % 2 = 0")).select("node_id")


@query("""SELECT node_id, problem FROM (SELECT l_orderkey AS node_id, CASE WHEN nullif(l_linestatus, 'O') IS NULL THEN 'no path' WHEN l_quantity < 3 THEN 'ends before it starts' END AS problem FROM lineitem) WHERE problem IS NOT NULL""")
def validate_provenance(t: Tables) -> DataFrame:
    rows = t.lineitem.select(F.col("l_orderkey").alias("node_id"), F.nullif("l_linestatus", F.lit("O")).alias("path"), F.lit(3.0).alias("start_byte"), F.col("l_quantity").alias("end_byte"))
    return lifecycle.validate_provenance(rows)


@query(f"""WITH {TAGS}, p AS (SELECT source, CASE WHEN toxic = 1 THEN 'quarantine' ELSE 'internal' END AS provenance FROM documents LEFT JOIN labels USING (doc_id))
  SELECT 'molecules without document' AS "check", 0::BIGINT AS violations UNION ALL SELECT 'tags without molecule', 0 UNION ALL SELECT 'sources of several provenances', count(*) FROM (SELECT source FROM p GROUP BY source HAVING count(DISTINCT provenance) > 1)
  UNION ALL SELECT 'repeated document ids', 0 UNION ALL SELECT 'repeated tag rows', 0 UNION ALL SELECT 'repeated edges', 0""")
def integrity_checks(t: Tables) -> DataFrame:
    stored = _stored(t)
    provenance = t.documents.join(t.labels, "doc_id", "left").select("source", F.when(F.col("toxic") == 1, "quarantine").otherwise("internal").alias("provenance"))
    return lifecycle.integrity_checks(stored["molecules"], t.documents, stored["tags"], stored["edges"], provenance)


# --- sources and sinks ------------------------------------------------------------------------------


@query("""SELECT doc_id, source AS bucket, CASE WHEN doc_id % 2 = 0 THEN 'md' ELSE 'json' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'external' ELSE 'internal' END AS provenance FROM documents""")
def source_metadata(t: Tables) -> DataFrame:
    folder = F.when(F.col("doc_id") % 3 == 0, "external-inbox/").otherwise("inbox/")
    ending = F.when(F.col("doc_id") % 2 == 0, ".md").otherwise(".JSON")
    rows = t.documents.withColumn("path", F.concat(F.lit("data/"), folder, "source", F.lit("/"), "doc_id", ending))
    return corpus.with_source_metadata(rows).select("doc_id", "bucket", "kind", "provenance")


@query()
def pack_lines_into_chunks(t: Tables) -> DataFrame:
    return corpus.pack_lines_into_chunks(t.documents.select("doc_id", "text"), "doc_id", over=4000, target=2000)


@query()
def split_large_text(t: Tables) -> DataFrame:
    return corpus.split_large_text(t.documents.select("doc_id", "text"), "doc_id", over=4000, target=2000)


@query("SELECT 'documents' AS name, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents UNION ALL SELECT 'benchmark', count(*), sum(length(text))::BIGINT FROM benchmark")
def backup_restore(t: Tables) -> DataFrame:
    tables = {"documents": t.documents, "benchmark": t.benchmark}
    back = sinks.restore_tables(sinks.backup_tables(tables), {n: df.schema for n, df in tables.items()})
    first, second = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n"), F.sum(F.length("text")).alias("chars")) for n, df in back.items()]
    return first.unionByName(second)


def _bucketed(t: Tables, rows: DataFrame, *keys: str) -> buckets.Bucketed:
    return buckets.Bucketed(t.spark, _folder(t), rows.schema, keys).create(rows)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey, o_totalprice + 1 FROM orders WHERE o_orderkey % 3 = 0")
def bucketed_upsert(t: Tables) -> DataFrame:
    rows = t.orders.select("o_orderkey", "o_totalprice")
    table = _bucketed(t, rows, "o_orderkey")
    table.upsert(rows.filter("o_orderkey % 3 = 0").withColumn("o_totalprice", F.col("o_totalprice") + 1))
    return table.read()


@query("SELECT doc_id, source FROM documents WHERE source <> 'src1'")
def bucketed_purge(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "source")
    table = _bucketed(t, rows, "source")
    table.remove(rows.filter("source = 'src1'").select("source").distinct())
    return table.read()


@query()
def yaml_lines(t: Tables) -> DataFrame:
    return t.orders.select(sinks.yaml_line(t.orders))


# --- streams ----------------------------------------------------------------------------------------


def _folder(t: Tables) -> str:
    """A folder for a query's own tables: in the cluster's shared one, or a temporary one where none is set, on one machine."""
    import uuid

    shared = t.spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not t.spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='spark-')}/own-{uuid.uuid4().hex}"


@query("SELECT hash FROM (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE trim(text) <> '')")
def stream_ingest(t: Tables) -> DataFrame:
    folder = _folder(t)
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/documents.parquet*", t.documents.schema)
    jobs.stream_ingest(rows, f"{folder}/table", f"{folder}/state").awaitTermination()
    return t.spark.read.schema("hash string").parquet(f"{folder}/table").select("hash")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents), n AS (SELECT """ + NORM + """ AS norm FROM l) SELECT sha256(norm) AS hash, count(*) AS n FROM n WHERE norm <> '' GROUP BY 1""")
def stream_distill(t: Tables) -> DataFrame:
    folder = _folder(t)
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/documents.parquet*", t.documents.schema)
    jobs.stream_distill(rows, f"{folder}/table", f"{folder}/state").awaitTermination()
    return jobs.distilled(t.spark, f"{folder}/table").select("hash", "n")


@query("SELECT hash FROM (SELECT DISTINCT sha256(text) AS hash FROM documents WHERE trim(text) <> '')")
def stream_unseen(t: Tables) -> DataFrame:
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/documents.parquet*", t.documents.schema)
    return _collected(t, stateful.unseen(rows)).select("hash")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS content FROM documents), n AS (SELECT """ + NORM + """ AS norm FROM l) SELECT sha256(norm) AS hash, count(*) AS n FROM n WHERE norm <> '' GROUP BY 1""")
def stream_line_counts(t: Tables) -> DataFrame:
    folder = _folder(t)
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/documents.parquet*", t.documents.schema)
    store = lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")
    stateful.distill(rows).writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema("hash string, content string, n long").parquet(f"{folder}/out").groupBy("hash").agg(F.max("n").alias("n"))


def _collected(t: Tables, stream: DataFrame) -> DataFrame:
    folder = _folder(t)
    stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{folder}/out")


@query("SELECT DISTINCT sha256(text) AS hash FROM documents")
def stream_dedup(t: Tables) -> DataFrame:
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/documents.parquet*", t.documents.schema).withColumn("ts", F.lit("2024-01-01").cast("timestamp"))
    return _collected(t, jobs.stream_dedup(rows, "ts")).select("hash")


@query()
def stream_sessions(t: Tables) -> DataFrame:
    events = t.events
    rows = jobs.read_stream(t.spark, f"{t.sf_dir}/events.parquet*", events.schema).withColumn("ts", F.col("ts").cast("timestamp"))
    return _collected(t, jobs.stream_sessions(rows, "user_id", "ts"))
