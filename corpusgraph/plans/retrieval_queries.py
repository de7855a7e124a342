"""Searches with benchmark items as queries over documents and their sentences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, mining, prepare, retrieve
from .corpus_queries import KEYWORDS, MOLECULES, STOP, TAGS, WORDS, molecules, tagged, tags
from .registry import Tables, query

NOW = "2024-06-01 00:00:00"


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def nodes(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("node_id"), F.col("text").alias("content"), "source")


def _asked_index(t: Tables, n: DataFrame) -> DataFrame:
    """The index of the words that the items ask for."""
    return retrieve.text_index(n, terms=retrieve.terms_of(questions(t)))


INDEX = f"""index_ AS (SELECT token, node_id, count(*) AS tf, any_value(size) AS size FROM (SELECT doc_id AS node_id, unnest(w) AS token, len(w) AS size FROM (SELECT doc_id, {WORDS.format('text')} AS w FROM documents)) GROUP BY token, node_id),
  q0 AS (SELECT item_id AS query_id, {WORDS.format('text')} AS w FROM benchmark),
  terms AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(list_filter(w, lambda x: NOT list_contains({STOP}, x))) > 0 THEN list_filter(w, lambda x: NOT list_contains({STOP}, x)) ELSE w END) AS token FROM q0),
  idf AS (SELECT token, ln(1 + (SELECT count(*) FROM documents) / count(*)) AS idf FROM index_ WHERE token IN (SELECT token FROM terms) GROUP BY token),
  scored AS (SELECT query_id, node_id, count(*) AS hits, round(10 * sum(tf / size * idf), 6) AS score FROM terms JOIN idf USING (token) JOIN index_ USING (token) GROUP BY ALL)"""


#: tagged(mol_id, tag), given MOLECULES
KEYWORDED = TAGS[len(MOLECULES) + 2 : TAGS.index(", tags AS (")].replace("pairs_", "pairs__")
INLINE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '"#[A-Za-z0-9_:-]+"', '', 'g'), '##?[A-Za-z0-9_:-]+', '', 'g'), '(?: - )+', ' ', 'g'), ' {{2,}}', ' ', 'g'))"""
ARTIFACTS = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '```[a-zA-Z]*', '', 'g'), '(?m)^\s*//.*$', '', 'g'), '\{[^{}]*"original"[^{}]*\}', '', 'g'), '(?m)^\[[^\]]*\]\s*', '', 'g'), 'token_count=\d+', '', 'g'))"""

#: Sentences found for each item
HITS = f"""{MOLECULES}, {INDEX.replace('FROM (SELECT doc_id, ' + WORDS.format('text') + ' AS w FROM documents)', 'FROM (SELECT mol_id AS doc_id, ' + WORDS.format('content') + ' AS w FROM molecules)').replace('FROM documents) / count(*)', 'FROM molecules) / count(*)')},
  hits AS (SELECT query_id, node_id, hits, score, content, source, doc_id AS compound_id, seq, start_byte, end_byte
    FROM (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 20) JOIN molecules ON mol_id = node_id)"""


@query(f"SELECT token, count(*) AS n, sum(tf)::BIGINT AS uses FROM (WITH {INDEX} SELECT * FROM index_) GROUP BY token")
def text_index(t: Tables) -> DataFrame:
    return retrieve.text_index(nodes(t)).groupBy("token").agg(F.count("*").alias("n"), F.sum("tf").alias("uses"))


@query(f"WITH {INDEX} SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10")
def lexical_search(t: Tables) -> DataFrame:
    n = nodes(t)
    return retrieve.lexical_search(questions(t), _asked_index(t, n), n)


@query(f"WITH {INDEX} SELECT scored.* FROM scored JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id) WHERE hits = n QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10")
def traditional_search(t: Tables) -> DataFrame:
    n = nodes(t)
    return retrieve.traditional_search(questions(t), _asked_index(t, n), n).drop("n")


@query(f"""WITH {INDEX.replace('documents', 'documents')}, {TAGS.replace('pairs_', 'pairs__')}, positions AS (SELECT DISTINCT doc_id, tag, floor((start_byte + end_byte) / 2)::BIGINT AS x FROM tagged JOIN molecules USING (mol_id)),
  hit AS (SELECT DISTINCT query_id, mol_id AS node_id FROM terms JOIN positions p ON p.tag = '#' || token JOIN molecules m ON m.doc_id = p.doc_id AND p.x BETWEEN m.start_byte AND m.end_byte)
  SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY node_id) <= 20""")
def position_lookup(t: Tables) -> DataFrame:
    mols = molecules(t)
    return retrieve.position_lookup(questions(t), prepare.build_tag_tables(mols, tagged(t, mols))["positions"], mols)


def hits(t: Tables) -> DataFrame:
    """Sentences found for each item: query_id, node_id, content, source, compound_id, seq, byte range, score."""
    mols = molecules(t).withColumnRenamed("mol_id", "node_id")
    found = retrieve.lexical_search(questions(t), _asked_index(t, mols), mols, 20)
    return retrieve.to_tasks(found, 20 * questions(t).count()).join(mols.select("node_id", "content", F.col("bucket").alias("source"), "compound_id", "seq", "start_byte", "end_byte"), "node_id")


def dated_hits(t: Tables) -> DataFrame:
    """hits() with a time made of the document's number."""
    start = F.lit("2020-01-01 00:00:00").cast("timestamp")
    return hits(t).withColumn("ts", F.timestamp_add("DAY", (F.col("compound_id") % 1500).cast("int"), start))


@query()
def inflate_context(t: Tables) -> DataFrame:
    return retrieve.inflate_context(hits(t).select("query_id", "node_id", "compound_id", "start_byte", "end_byte"), t.documents)


@query(f"""WITH {HITS}, {KEYWORDED}, own AS (SELECT mol_id AS node_id, list_distinct(list(tag)) AS tags, any_value(source) AS bucket FROM tagged JOIN molecules USING (mol_id) GROUP BY 1),
  n AS (SELECT mol_id AS node_id, content, doc_id % 1500 AS day, list_append(tags, 'bucket:' || bucket) AS labels FROM molecules JOIN own ON own.node_id = mol_id), h AS (SELECT query_id, node_id, score, content, labels FROM (SELECT query_id, node_id, score FROM hits) JOIN n USING (node_id)),
  best AS (SELECT * FROM h WHERE query_id IN (SELECT query_id FROM h GROUP BY 1 HAVING 20000 - sum(length(content)) >= 1000) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 5),
  l AS (SELECT DISTINCT query_id, unnest(labels) AS label FROM best), m AS (SELECT DISTINCT query_id, node_id, day FROM l JOIN (SELECT node_id, day, unnest(labels) AS label FROM n) USING (label))
  SELECT query_id, node_id FROM m WHERE (query_id, node_id) NOT IN (SELECT (query_id, node_id) FROM hits) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY day DESC, node_id) <= 10""")
def neighbour_context(t: Tables) -> DataFrame:
    own = tags(t).groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"), F.collect_set("bucket").alias("buckets"))
    mols = molecules(t).select(F.col("mol_id").alias("node_id"), "content", F.timestamp_add("DAY", (F.col("doc_id") % 1500).cast("int"), F.lit("2020-01-01").cast("timestamp")).alias("ts")).join(own, "node_id")
    return retrieve.neighbour_context(hits(t).select("query_id", "node_id", "score"), mols, 20_000)


@query(f"""WITH {INDEX}, {TAGS.replace('pairs_', 'pairs__')}, few AS (SELECT query_id FROM scored s JOIN (SELECT query_id, count(*) AS n FROM terms GROUP BY 1) USING (query_id) GROUP BY query_id HAVING count(*) FILTER (WHERE hits = n) >= 5),
  w AS (SELECT DISTINCT query_id, unnest(w) AS w FROM q0 WHERE query_id NOT IN (SELECT query_id FROM few)), k AS (SELECT DISTINCT query_id, w, node_id FROM w JOIN (SELECT DISTINCT node_id, lower(regexp_replace(tag, '^#', '')) AS w FROM tags) USING (w) WHERE length(w) > 3),
  b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY query_id, w ORDER BY node_id) <= 20) SELECT DISTINCT query_id, node_id, 0.8::DOUBLE AS score FROM b""")
def tag_fallback(t: Tables) -> DataFrame:
    n = nodes(t)
    found = retrieve.traditional_search(questions(t), _asked_index(t, n), n, 1000)
    return retrieve.tag_fallback(questions(t), found, tags(t))


@query("""WITH e AS (SELECT DISTINCT md5(lower(trim(p_name))) AS key, p_partkey AS node_id FROM part), q AS (SELECT s_suppkey AS query_id, (SELECT p_name FROM part WHERE p_partkey = s_suppkey) AS query FROM supplier)
  SELECT query_id, node_id, 1.0::DOUBLE AS score FROM q JOIN e ON key = md5(lower(trim(query)))""")
def engram_lookup(t: Tables) -> DataFrame:
    engrams = retrieve.create_engrams(t.part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("node_id")))
    asked = t.supplier.join(t.part, F.col("s_suppkey") == F.col("p_partkey")).select(F.col("s_suppkey").alias("query_id"), F.upper("p_name").alias("query"))
    return retrieve.engram_lookup(asked, engrams)


@query()
def anchor_search(t: Tables) -> DataFrame:
    mols = molecules(t)
    n = mols.withColumnRenamed("mol_id", "node_id")
    found = retrieve.anchor_search(questions(t), _asked_index(t, n), n, prepare.build_tag_tables(mols, tagged(t, mols))["positions"], mols, tags=tags(t))
    return found.withColumn("tags", F.array_join("tags", ","))


def _star_nodes(t: Tables) -> DataFrame:
    mols = molecules(t).withColumnRenamed("mol_id", "node_id")
    prints = dedup.simhash64(mols, "node_id", "content")
    return mols.join(prints, "node_id").withColumn("ts", F.timestamp_add("DAY", (F.col("doc_id") % 1500).cast("int"), F.lit("2020-01-01").cast("timestamp")))


@query()
def star_search(t: Tables) -> DataFrame:
    mols = molecules(t).withColumnRenamed("mol_id", "node_id")
    return retrieve.star_search(questions(t), _asked_index(t, mols), _star_nodes(t), tags(t))


@query()
def star_context(t: Tables) -> DataFrame:
    shown = retrieve.star_context(star_search(t), _star_nodes(t).withColumn("source", F.col("bucket")), t.documents, F.lit(NOW).cast("timestamp"), 20_000)
    return shown.withColumn("node_ids", F.array_join("node_ids", ","))


@query()
def molecule_search(t: Tables) -> DataFrame:
    n = nodes(t)
    return retrieve.molecule_search(questions(t), retrieve.text_index(n), n)


@query()
def iterative_search(t: Tables) -> DataFrame:
    n = nodes(t)
    return retrieve.iterative_search(questions(t), retrieve.text_index(n), n)


@query()
def split_merge_search(t: Tables) -> DataFrame:
    n = nodes(t)
    return retrieve.split_merge_search(questions(t), retrieve.text_index(n), n)


_SIGNAL = "CASE WHEN token IN (" + ", ".join(f"'{w}'" for w in retrieve.RELATION_WORDS) + ") THEN 5 ELSE 3 END"
_SIGNALS = ", ".join(f"'{w}'" for w in retrieve.RELATION_WORDS + retrieve.TIME_WORDS)


@query(f"""WITH {INDEX}, h AS (SELECT query_id, node_id, count(*) AS terms FROM terms JOIN index_ USING (token) GROUP BY ALL), s AS (SELECT node_id, sum({_SIGNAL}) AS signal FROM index_ WHERE token IN ({_SIGNALS}) GROUP BY 1)
  SELECT query_id, node_id, terms, (10 * terms + 50 * terms * (terms - 1) + coalesce(signal, 0) + CASE WHEN terms > 1 THEN 50 * terms * terms ELSE 0 END)::DOUBLE AS score FROM h LEFT JOIN s USING (node_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10""")
def semantic_search(t: Tables) -> DataFrame:
    return retrieve.semantic_search(questions(t), retrieve.text_index(nodes(t)))


_RING = f"""{MOLECULES}, rw AS (SELECT DISTINCT mol_id, w FROM (SELECT mol_id, unnest({WORDS.format('content')}) AS w FROM molecules) WHERE length(w) >= 5 AND NOT list_contains({STOP}, w)),
  rp AS (SELECT a.w AS a, b.w AS b FROM rw a JOIN rw b ON a.mol_id = b.mol_id AND a.w < b.w GROUP BY ALL HAVING count(*) >= 20), ring AS (SELECT a AS term, b AS synonym FROM rp UNION ALL SELECT b, a FROM rp)"""


def _ring(t: Tables) -> DataFrame:
    """(term, synonym): words that stand together in 20 sentences or more, one of them a word of an item."""
    pairs = mining.synonyms_by_cooccurrence(molecules(t), 20, asked=retrieve.terms_of(questions(t)))
    return pairs.select(F.col("a").alias("term"), F.col("b").alias("synonym")).unionByName(pairs.select(F.col("b").alias("term"), F.col("a").alias("synonym")))


@query(f"""WITH {INDEX}, {_RING}, c AS (SELECT query_id, unnest(l) AS token, generate_subscripts(l, 1) AS pos FROM (SELECT query_id, CASE WHEN len(list_filter(w, lambda x: NOT list_contains({STOP}, x))) > 0 THEN list_filter(w, lambda x: NOT list_contains({STOP}, x)) ELSE w END AS l FROM q0)),
  f AS (SELECT query_id, token, min(pos) AS pos FROM c GROUP BY ALL), own AS (SELECT query_id, token, 7000.0::DOUBLE / count(*) OVER (PARTITION BY query_id) AS share FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 5)),
  other AS (SELECT DISTINCT query_id, synonym AS token FROM own JOIN (SELECT * FROM ring QUALIFY row_number() OVER (PARTITION BY term ORDER BY synonym) <= 5) ON term = token WHERE (query_id, synonym) NOT IN (SELECT (query_id, token) FROM own)),
  met AS (SELECT query_id, node_id, share FROM (SELECT * FROM own UNION ALL SELECT query_id, token, 3000.0::DOUBLE / count(*) OVER (PARTITION BY query_id) FROM other) JOIN index_ USING (token))
  SELECT * FROM (SELECT query_id, node_id, count(*) AS hits, round((max(share) + 0.2 * (sum(share) - max(share))) / 10000, 6)::DOUBLE AS score FROM met GROUP BY query_id, node_id) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10""")
def distributed_search(t: Tables) -> DataFrame:
    return retrieve.distributed_search(questions(t), retrieve.text_index(nodes(t)), _ring(t))


@query(f"""WITH {INDEX}, {_RING}, {KEYWORDED}, e AS (SELECT query_id, tag AS term, 10 AS score, 'tag' AS kind FROM terms JOIN (SELECT DISTINCT tag FROM tagged) ON lower(regexp_replace(tag, '^#', '')) = token
    UNION SELECT query_id, synonym, 5, 'synonym' FROM terms JOIN ring ON term = token)
  SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, term) <= 10""")
def expand_queries(t: Tables) -> DataFrame:
    return retrieve.expand_queries(questions(t), _ring(t), tags(t))


def synonym_table(t: Tables) -> DataFrame:
    """(term, synonym): the rings of the documents' own words and tags."""
    mols = molecules(t)
    named = tags(t).withColumn("tag", F.lower(F.regexp_replace("tag", "^#", "")))
    parts = {"tags": mining.synonyms_by_tags(named), "together": mining.synonyms_by_cooccurrence(mols), "simhash": mining.synonyms_by_simhash(dedup.simhash64(t.documents), t.documents, k=5)}
    return mining.synonym_rings(parts).select("term", "synonym")


@query()
def distributed_search_synonyms(t: Tables) -> DataFrame:
    return retrieve.distributed_search(questions(t), retrieve.text_index(nodes(t)), synonym_table(t))


@query()
def expand_queries_synonyms(t: Tables) -> DataFrame:
    return retrieve.expand_queries(questions(t), synonym_table(t), tags(t))


@query()
def format_results(t: Tables) -> DataFrame:
    return retrieve.format_results(dated_hits(t), F.lit(NOW).cast("timestamp"), documents=t.documents).withColumn("node_ids", F.array_join("node_ids", ","))


@query()
def budget_stats(t: Tables) -> DataFrame:
    return retrieve.budget_stats(retrieve.format_results(dated_hits(t), F.lit(NOW).cast("timestamp"), documents=t.documents))


def _package(t: Tables) -> DataFrame:
    own = tags(t).groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return hits(t).join(own, "node_id").withColumn("shared", F.col("hits"))


PACKAGE = f"""{HITS}, {KEYWORDED}, own AS (SELECT mol_id AS node_id, list_sort(list_distinct(list(tag))) AS tags FROM tagged GROUP BY 1), package AS (SELECT hits.*, tags FROM hits JOIN own USING (node_id))"""


@query(f"""WITH {PACKAGE} SELECT query_id, max(score) AS best, count(*) AS nodes, floor((2 * sum(round(score * 1e6)::BIGINT)::BIGINT + count(*)) / (2 * count(*))) / 1e6 AS avg_score, count(*) FILTER (WHERE hits >= 3) AS recurring, sum(ceil(length(content) / 4))::BIGINT AS tokens FROM package GROUP BY query_id""")
def context_package(t: Tables) -> DataFrame:
    return retrieve.context_package(_package(t))[0]


@query(f"""WITH {PACKAGE}, n AS (SELECT query_id, source, count(*) AS n FROM package GROUP BY ALL), k AS (SELECT query_id, source, tag, count(*) AS k FROM (SELECT query_id, source, unnest(tags) AS tag FROM package) GROUP BY ALL)
  SELECT query_id, source, tag, k, n FROM k JOIN n USING (query_id, source) WHERE k >= 0.5 * n""")
def hoisted_tags(t: Tables) -> DataFrame:
    return retrieve.context_package(_package(t))[1]


@query()
def package_text(t: Tables) -> DataFrame:
    return retrieve.package_text(hits(t))


@query(rf"""WITH {HITS}, e AS (SELECT query_id, unnest(regexp_extract_all(content, '[A-Za-z0-9]+')) AS entity FROM hits)
  SELECT query_id, entity, mentions, mentions < 3 AS gap FROM (SELECT query_id, entity, count(*) AS mentions FROM e WHERE regexp_matches(entity, '^[A-Z][a-z]{{3,}}$') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY mentions DESC, entity) <= 20""")
def result_entities(t: Tables) -> DataFrame:
    return retrieve.result_entities(hits(t))


@query("""WITH y AS (SELECT DISTINCT o_custkey AS query_id, year(o_orderdate) AS year FROM orders), s AS (SELECT query_id, min(year) AS a, max(year) AS b FROM y GROUP BY 1), e AS (SELECT query_id, unnest(range(a, b + 1)) AS year FROM s)
  SELECT query_id, year::INTEGER AS year FROM e WHERE (query_id, year) NOT IN (SELECT (query_id, year) FROM y)""")
def year_gaps(t: Tables) -> DataFrame:
    return retrieve.year_gaps(t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderdate").alias("ts")))


@query(f"""WITH {HITS}, e AS (SELECT *, {INLINE.format('content')} AS evidence FROM hits QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) <= 10),
  u AS (SELECT query_id, node_id, evidence, sum(ceil(length(evidence) / 4)) OVER (PARTITION BY query_id ORDER BY score DESC, node_id ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM e) SELECT * FROM u WHERE used <= 1000""")
def memory_node(t: Tables) -> DataFrame:
    return retrieve.memory_node(hits(t))


@query(f"""WITH {HITS}, c AS (SELECT query_id, node_id, content, CASE WHEN clean = '' THEN '[REDACTED]' ELSE clean END AS clean FROM (SELECT *, {ARTIFACTS} AS clean FROM hits)),
  g AS (SELECT *, length(clean) >= 40 AND clean <> '[REDACTED]' AS good FROM c), a AS (SELECT query_id, max(good::INT) AS n_good FROM g GROUP BY 1)
  SELECT query_id, node_id, CASE WHEN n_good = 1 THEN clean ELSE content END AS content FROM g JOIN a USING (query_id) WHERE good OR n_good = 0""")
def clean_mode(t: Tables) -> DataFrame:
    return retrieve.clean_mode(hits(t))


@query()
def context_window(t: Tables) -> DataFrame:
    return retrieve.context_window(dated_hits(t), F.lit(NOW).cast("timestamp"), 500).select("query_id", "node_id", "score", "piece", "place")


# --- expressions over whole tables ------------------------------------------------------------------


@query(r"""SELECT doc_id, len(w) AS n, sha256(array_to_string(w, ' ')) AS tokens FROM (SELECT doc_id, list_filter(string_split(lower(trim(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\s]', ' ', 'g'), '\s+', ' ', 'g'))), ' '), lambda w: w <> '') AS w FROM documents)""")
def fts_tokens(t: Tables) -> DataFrame:
    w = T.fts_tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(w).cast("long").alias("n"), F.sha2(F.array_join(w, " "), 256).alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) <= 300 THEN text ELSE CASE WHEN length(s) > 150 THEN s WHEN length(w) > 0 THEN w ELSE p END || '...' END AS short FROM (SELECT *, regexp_extract(p, '(?s)^(.*[.!?])', 1) AS s, regexp_extract(p, '(?s)^(.*)\\s', 1) AS w FROM (SELECT doc_id, text, substr(text, 1, 300) AS p FROM documents))")
def truncate_sentence(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", T.truncate_sentence(F.col("text"), 300).alias("short"))


@query()
def text_expressions(t: Tables) -> DataFrame:
    x = F.col("text")
    return t.documents.select(
        "doc_id", F.array_join(T.query_chunks(x), "|").alias("chunks"), F.array_join(T.key_terms(x), ",").alias("key_terms"), T.strip_opening(x).alias("opening"), F.array_join(T.conversational_rewrites(x), "|").alias("rewrites"),
        T.strip_tag_footer(x).alias("footer"), T.strip_artifacts(x).alias("artifacts"), T.query_intent(x).alias("intent"), T.first_date(x, None).alias("date"), T.earliest_timestamp(x).alias("earliest"), T.numeric_value(x)["value"].alias("number"),
        T.token_count(x, "words").cast("long").alias("words"), T.token_count(x, "words_and_marks").cast("long").alias("marks"), F.array_join(T.temporal_years(x, F.lit(2024)).cast("array<string>"), ",").alias("years"), F.array_join(T.system_tags(F.concat(F.lit("src/"), "source", F.lit(".py"))), ",").alias("system"),
    )


@query()
def tag_expressions(t: Tables) -> DataFrame:
    own = tags(t).groupBy("node_id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return own.select("node_id", F.array_join(T.filter_tags(F.col("tags")), ",").alias("kept"), F.array_join(T.modulate_tags(F.col("tags"), 50), ",").alias("modulated"), F.array_join(T.display_tags(F.col("tags")), ",").alias("shown"), F.array_join(F.transform("tags", T.normalize_tag), ",").alias("normal"))
