"""Preparation, distillation and deduplication over documents, conversations and pages."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import dedup, distill, frame, prepare
from ..operators.positions import stored
from .registry import Tables, query

STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^a-z0-9]+'), lambda w: w <> '')"

#: Sentences of documents as molecules
MOLECULES = r"""pieces AS (
  SELECT doc_id, source, unnest(string_split(m, chr(1))) AS piece, generate_subscripts(string_split(m, chr(1)), 1) - 1 AS seq
  FROM (SELECT doc_id, source, regexp_replace(text, '([.!?])(\s+)([A-Z])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g') AS m FROM documents)
), cuts AS (
  SELECT doc_id, source, seq, CASE WHEN seq = 0 THEN '' ELSE substr(piece, 1, strpos(piece, chr(2)) - 1) END AS gap, substr(piece, strpos(piece, chr(2)) + 1) AS content FROM pieces
), molecules AS (
  SELECT doc_id, source, doc_id || ':' || seq AS mol_id, seq::BIGINT AS seq, content, (e - octet_length(encode(content)))::BIGINT AS start_byte, e AS end_byte
  FROM (SELECT *, sum(octet_length(encode(gap)) + octet_length(encode(content))) OVER (PARTITION BY doc_id ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS e FROM cuts)
  WHERE regexp_matches(content, '\S')
)"""

KEYWORDS = f"""word_lists AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents),
singles AS (
  SELECT keyword, count(*) AS n FROM (SELECT unnest(w) AS keyword FROM word_lists)
  WHERE length(keyword) >= 3 AND NOT list_contains({STOP}, keyword) AND NOT regexp_matches(keyword, '^[0-9]+$') GROUP BY keyword HAVING count(*) >= 3 ORDER BY n DESC, keyword LIMIT 200
), pairs_ AS (
  SELECT a || '-' || b AS keyword, count(*) AS n FROM (SELECT unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM word_lists WHERE len(w) > 1)
  WHERE length(a) >= 3 AND length(b) >= 3 AND NOT list_contains({STOP}, a) AND NOT list_contains({STOP}, b) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, keyword LIMIT 100
), keywords AS (SELECT * FROM singles UNION ALL SELECT * FROM pairs_)"""

TAGGED = f"""{MOLECULES}, {KEYWORDS}, mol_lists AS (SELECT mol_id, {WORDS.format('content')} AS w FROM molecules), mol_words AS (SELECT DISTINCT mol_id, unnest(w) AS keyword FROM mol_lists),
mol_pairs AS (SELECT DISTINCT mol_id, a || '-' || b AS keyword FROM (SELECT mol_id, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:len(w)]) AS b FROM mol_lists WHERE len(w) > 1)),
tagged AS (
  SELECT mol_id, '#' || keyword AS tag FROM (SELECT * FROM mol_words UNION ALL SELECT * FROM mol_pairs) JOIN (SELECT DISTINCT keyword FROM keywords) USING (keyword)
  UNION ALL SELECT mol_id, '#' || upper(keyword[1]) || keyword[2:] FROM mol_words WHERE keyword IN ({', '.join(f"'{m}'" for m in T.MONTHS)})
  UNION ALL SELECT DISTINCT mol_id, '#' || unnest(regexp_extract_all(content, '\\b((?:19|20)[0-9]{{2}})\\b', 1)) FROM molecules
)""".replace("\\\\b", "\\b")

#: tags(node_id, tag, bucket)
TAGS = f"{TAGGED}, tags AS (SELECT DISTINCT mol_id AS node_id, tag, source AS bucket FROM tagged JOIN molecules USING (mol_id))"


def molecules(t: Tables) -> DataFrame:
    return prepare.split_molecules(t.documents, keep=["source"]).withColumnRenamed("source", "bucket").withColumn("compound_id", F.col("doc_id"))


def tagged(t: Tables, mols: DataFrame) -> DataFrame:
    keywords = F.broadcast(prepare.mine_keywords(t.documents))  # 300 rows at most
    return prepare.tag_by_keywords(mols, keywords, keep=["compound_id", "bucket", "start_byte", "end_byte"])


def tags(t: Tables) -> DataFrame:
    mols = molecules(t)
    return prepare.build_tag_tables(mols, tagged(t, mols))["tags"]


@query(f"WITH {MOLECULES} SELECT doc_id, seq, content, start_byte, end_byte FROM molecules")
def split_molecules_prose(t: Tables) -> DataFrame:
    return prepare.split_molecules(t.documents).drop("mol_id")


@query(r"""SELECT doc_id, count(*) AS n, sum(length(line))::BIGINT AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE regexp_matches(line, '\S') GROUP BY doc_id""")
def split_molecules_data(t: Tables) -> DataFrame:
    return prepare.split_molecules(t.documents, kind="data").groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("content")).alias("chars"))


@query()
def split_code(t: Tables) -> DataFrame:
    return prepare.split_code(t.pages.select("page_id", "html"), "page_id", "html")


@query()
def split_semantic(t: Tables) -> DataFrame:
    return prepare.split_semantic(t.documents)


@query(r"""WITH s AS (SELECT conv_id, string_agg('[' || upper(role[1]) || role[2:] || ']: ' || text, chr(10) || chr(10) ORDER BY turn) AS text FROM conversations WHERE text IS NOT NULL AND trim(text) <> '' GROUP BY conv_id)
  SELECT * FROM s WHERE length(text) >= 100""")
def chat_documents(t: Tables) -> DataFrame:
    return prepare.chat_documents(t.conversations)


def _decoded(x: str) -> str:
    for name, char in prepare.ENTITIES:
        x = f"replace({x}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return x


def _cleaned(x: str) -> str:
    x = rf"regexp_replace({x}, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g')"
    x = rf"regexp_replace({x}, '(?is)<nav\b.*?</nav>|<footer\b.*?</footer>|<header\b.*?</header>', '', 'g')"
    x = _decoded(f"regexp_replace({x}, '<[^>]*>', ' ', 'g')")
    x = rf"regexp_replace(regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'), '\r\n?', chr(10), 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g')"
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, {_cleaned('html')} AS text FROM pages")
def clean_pages(t: Tables) -> DataFrame:
    return prepare.clean_documents(t.pages.select("page_id", F.col("html").alias("text")), unicode=False)


@query(f"""SELECT 'pages' AS bucket, sum(length(html))::BIGINT AS before, sum(length(t))::BIGINT AS after, round(100 * (1 - sum(length(t)) / sum(length(html))), 2) AS removed
  FROM (SELECT html, {_cleaned('html')} AS t FROM pages)""")
def cleaning_stats(t: Tables) -> DataFrame:
    rows = t.pages.select(F.length("html").alias("x"), F.length(prepare.clean_text(F.col("html"))).alias("y"))
    return rows.agg(F.sum("x").alias("before"), F.sum("y").alias("after")).select(F.lit("pages").alias("bucket"), "before", "after", F.round(100 * (1 - F.col("after") / F.col("before")), 2).alias("removed"))


@query(rf"""SELECT page_id, {_decoded("trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))")} AS title,
  {_cleaned(r"coalesce(nullif(regexp_extract(html, '(?is)<main\b[^>]*>(.*)</main>', 1), ''), nullif(regexp_extract(html, '(?is)<article\b[^>]*>(.*)</article>', 1), ''), nullif(regexp_extract(html, '(?is)<body\b[^>]*>(.*)</body>', 1), ''), html)")} AS body FROM pages""")
def web_page_documents(t: Tables) -> DataFrame:
    return prepare.web_page_documents(t.pages).select("page_id", "title", "body")


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b', '[EMAIL_REDACTED]', 'g'),
  '\b(?:\d{1,3}\.){3}\d{1,3}\b', '[IP_REDACTED]', 'g'), 'sk-[a-zA-Z0-9]{32,}', 'sk-[REDACTED]', 'g') AS text FROM documents""")
def redact(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", prepare.redact(F.col("text")).alias("text"))


def _sanitized(x: str) -> str:
    """The fixed replacements, one after the other."""
    x = rf"replace(replace(regexp_replace({x}, '^\x{{FEFF}}|\x00|\x{{FFFD}}', '', 'g'), '\r\n', chr(10)), chr(13) || chr(10), chr(10))"
    for verb in ("Processing", "Loading", "Indexing", "Analyzing"):
        x = rf"regexp_replace({x}, '(?:^|\s|\.\.\.\s*){verb} ''[^'']+''\.\.\.', chr(10), 'g')"
    for pattern, to in [
        (r"(?m)^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d{3})?\s*(?:AM|PM)?\s*[-:>]", ""), (r"\[\d{4}-\d{2}-\d{2}.*?\]", ""), (prepare.EMAIL, "[EMAIL_REDACTED]"), (prepare.IPV4, "[IP_REDACTED]"), (prepare.API_KEY, "sk-[REDACTED]"),
        (r"<\|(?:user|assistant|system)\|>", ""), (r"score:\s*\d+(?:\.\d+)?|(?:start|end)_byte:\s*\d+\s*,?|is_inflated:\s*(?:true|false)\s*,?|virtual_mem_[a-f0-9_]+", ""),
    ]:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {_sanitized('text')} AS text FROM documents")
def sanitize_documents(t: Tables) -> DataFrame:
    return prepare.sanitize_documents(t.documents.select("doc_id", "text"))


_TRANSIENT_HITS = " + ".join(f"regexp_matches(line, '{p}')::INT" for p in prepare.TRANSIENT)


@query(rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
  SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM l GROUP BY doc_id HAVING count(*) >= 5 AND sum({_TRANSIENT_HITS}) > 0.5 * count(*))""")
def drop_transient(t: Tables) -> DataFrame:
    return prepare.drop_transient(t.documents).select("doc_id")


_PATHS = "source || '/' || doc_id || CASE doc_id % 5 WHEN 0 THEN '.json' WHEN 1 THEN '.py' ELSE '.md' END"


@query(rf"""SELECT doc_id, CASE WHEN regexp_matches(path, '\.(csv|json|ya?ml)$') THEN 'data' WHEN regexp_matches(path, '\.(ts|js|py|rs|go|cpp|h|c)$') THEN 'code' WHEN length(text) >= 1048576 THEN 'data' WHEN starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), '|') THEN 'data'
  WHEN contains(text, '```') OR contains(text, 'function ') OR contains(text, 'const ') OR contains(text, 'import ') THEN 'code' ELSE 'prose' END AS kind FROM (SELECT *, {_PATHS} AS path FROM documents)""")
def detect_type(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", prepare.detect_type(F.col("text"), F.expr(_PATHS)).alias("kind"))


@query(f"WITH {KEYWORDS} SELECT keyword, n FROM keywords")
def mine_keywords(t: Tables) -> DataFrame:
    return prepare.mine_keywords(t.documents)


@query(f"WITH {TAGGED} SELECT tag, count(*) AS n FROM tagged GROUP BY tag")
def tag_by_keywords(t: Tables) -> DataFrame:
    return tagged(t, molecules(t)).groupBy("tag").agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT doc_id, tag FROM (SELECT doc_id, unnest(regexp_extract_all(text || ' #' || lang || '_text #' || source || ' #abc123 #_x', '#[A-Za-z][A-Za-z0-9_]{1,29}')) AS tag FROM documents)
  WHERE NOT (regexp_matches(tag, '^#[0-9a-fA-F]{3,8}$') OR length(tag) > 30)""")
def scan_labels(t: Tables) -> DataFrame:
    labelled = F.concat("text", F.lit(" #"), "lang", F.lit("_text #"), "source", F.lit(" #abc123 #_x"))  # the texts have none of their own
    return prepare.scan_labels(t.documents.withColumn("text", labelled), "doc_id", "text")


@query(f"WITH {TAGS} SELECT node_id, tag, bucket FROM tags")
def build_tags(t: Tables) -> DataFrame:
    return tags(t)


@query(f"""WITH {TAGGED} SELECT 'atom_' || substr(sha256(tag), 1, 12) AS target_id, count(DISTINCT doc_id) AS n, sum(x)::BIGINT AS midpoints FROM
  (SELECT DISTINCT doc_id, tag, floor((start_byte + end_byte) / 2)::BIGINT AS x FROM tagged JOIN molecules USING (mol_id)) GROUP BY 1""")
def build_edges_positions(t: Tables) -> DataFrame:
    mols = molecules(t)
    made = prepare.build_tag_tables(mols, tagged(t, mols))
    edges = made["edges"].groupBy("target_id").agg(F.count("*").alias("n"))
    offsets = made["positions"].groupBy(F.concat(F.lit("atom_"), T.short_hash(F.col("label"))).alias("target_id")).agg(F.sum("byte_offset").alias("midpoints"))
    return edges.join(offsets, "target_id")


@query("""SELECT DISTINCT p_partkey AS node_id, tag, bucket FROM (SELECT p_partkey, bucket, unnest(string_split(p_name, ' ')) AS tag FROM (SELECT p_partkey, p_name, unnest([p_brand, p_type]) AS bucket FROM part))""")
def reindex_tags(t: Tables) -> DataFrame:
    return prepare.reindex_tags(t.part.select(F.col("p_partkey").alias("node_id"), F.split("p_name", " ").alias("tags"), F.array("p_brand", "p_type").alias("buckets")))


_NAMES = ["the", "thing", "license", "apache"]


@query(f"SELECT doc_id, entity, count(*) AS mentions FROM (SELECT doc_id, unnest({WORDS.format('text')}) AS entity FROM documents) WHERE entity IN ('the', 'thing', 'license', 'apache') GROUP BY ALL")
def entity_mentions(t: Tables) -> DataFrame:
    return prepare.entity_mentions(t.documents, _NAMES)


@query(r"""SELECT DISTINCT doc_id, entity, CASE WHEN regexp_matches(entity, '^(19|20)[0-9]{2}$') THEN 'date' WHEN regexp_matches(entity, '^[A-Z0-9]+$|[0-9]') THEN 'technical' ELSE 'concept' END AS kind, 'entity:' || lower(entity) AS tag
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z0-9]+')) AS entity FROM documents) WHERE regexp_matches(entity, '^([A-Z][A-Za-z0-9]{3,}|(19|20)[0-9]{2})$')""")
def entity_atoms(t: Tables) -> DataFrame:
    return prepare.entity_atoms(t.documents)


@query(f"""WITH rules(category, trigger) AS (VALUES ('Relationship', 'with'), ('Relationship', 'and'), ('Narrative', 'then'), ('Narrative', 'for'), ('Location', 'in'), ('Location', 'at'))
  SELECT doc_id, category, count(*) AS hits FROM (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS trigger FROM documents) JOIN rules USING (trigger) GROUP BY ALL HAVING count(*) >= 2""")
def semantic_categories(t: Tables) -> DataFrame:
    rules = t.spark.createDataFrame([("Relationship", "with"), ("Relationship", "and"), ("Narrative", "then"), ("Narrative", "for"), ("Location", "in"), ("Location", "at")], "category string, trigger string")
    return prepare.semantic_categories(t.documents, rules, least=2)


# --- distillation -----------------------------------------------------------------------------------

NORM = r"lower(regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))"
for _p in (r"^user:\s*", r"^assistant:\s*", r"^\[?\d{4}-\d{2}-\d{2}[\st]\d{2}:\d{2}:\d{2}\]?\s*", r"^\[?\d{2}:\d{2}:\d{2}\]?\s*"):
    NORM = f"regexp_replace({NORM}, '{_p}', '')"
LINES = f"""blocks AS (SELECT * FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) = 1),
raw_lines AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM blocks),
lines AS (SELECT *, sha256(norm) AS hash FROM (SELECT *, {NORM} AS norm FROM raw_lines) WHERE norm <> '')"""


@query(f"""WITH {LINES} SELECT hash, arg_min(content, (doc_id, line_no)) AS content, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(*) AS n, min(doc_id) AS first_doc FROM lines GROUP BY hash""")
def distill_lines(t: Tables) -> DataFrame:
    return distill.distill_lines(t.documents).withColumn("sources", F.array_join("sources", ",")).drop("first_line")


@query(f"""WITH {LINES} SELECT count(*) AS total, count(DISTINCT hash) AS unique_lines, count(*) - count(DISTINCT hash) AS duplicate_lines, printf('%.2f', count(*) / count(DISTINCT hash)) || ':1' AS ratio FROM lines""")
def distill_stats(t: Tables) -> DataFrame:
    return distill.distill_stats(t.documents)


@query(f"""WITH {LINES.replace('FROM documents', 'FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)')} SELECT hash, count(*) AS n FROM lines GROUP BY hash""")
def distill_incremental(t: Tables) -> DataFrame:
    return distill.distill_incremental(t.documents, t.labels).select("hash", "n")


@query(f"WITH {LINES} SELECT lang AS tag, count(*) AS total, count(DISTINCT hash) AS unique_lines FROM lines JOIN (SELECT DISTINCT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang")
def distill_by_tag(t: Tables) -> DataFrame:
    return distill.distill_by_tag(t.documents, t.documents.select("doc_id", F.col("lang").alias("tag")))


@query(f"""WITH {LINES}, d AS (SELECT hash, arg_min(content, (doc_id, line_no)) AS content, min((doc_id, line_no)) AS k FROM lines GROUP BY hash), p AS (SELECT content, row_number() OVER (ORDER BY k) - 1 AS place FROM d)
  SELECT floor(place / 1000)::BIGINT AS chunk, place, content FROM p""")
def reassemble(t: Tables) -> DataFrame:
    return distill.reassemble(distill.distill_lines(t.documents))


def _shortened(x: str, n: int) -> str:
    p, cut = f"substr({x}, 1, {n})", rf"regexp_extract(substr({x}, 1, {n}), '(?s)^(.*[.!?])', 1)"
    word = rf"regexp_extract({p}, '(?s)^(.*)\s', 1)"
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE CASE WHEN length({cut}) > {n / 2} THEN {cut} WHEN length({word}) > 0 THEN {word} ELSE {p} END || '...' END"


_INLINE = r"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '"#[A-Za-z0-9_:-]+"', '', 'g'), '##?[A-Za-z0-9_:-]+', '', 'g'), '(?: - )+', ' ', 'g'), ' {{2,}}', ' ', 'g'))"""
_HEAD = rf"""trim(regexp_replace({_INLINE.format("string_split(clean, chr(10))[1]")}, '^[#*\-\s]+', ''))"""


@query(rf"""WITH {LINES}, d AS (SELECT hash, arg_min(content, (doc_id, line_no)) AS content FROM lines GROUP BY hash), c AS (SELECT hash, content, {_INLINE.format('content')} AS clean FROM d)
  SELECT hash, {_shortened('head', 80)} AS title, {_shortened('clean', 200)} AS summary, clean AS content, array_to_string(list_sort(list_distinct(regexp_extract_all(content, '#[A-Za-z][A-Za-z0-9_]+'))), ',') AS tags
  FROM (SELECT *, {_HEAD} AS head FROM c) WHERE length(clean) >= 10""")
def decision_records(t: Tables) -> DataFrame:
    return distill.decision_records(distill.distill_lines(t.documents)).withColumn("tags", F.array_join("tags", ","))


@query(f"""SELECT doc_id FROM documents WHERE source IN ('src1', 'src2') OR list_contains({WORDS.format('text')}, 'license')""")
def collect_for_distill(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.col("doc_id").alias("compound_id"), F.col("source").alias("bucket"), F.col("text").alias("content"))
    return distill.collect_for_distill(rows, buckets=["src1", "src2"], terms=["license"]).select("doc_id")


@query(f"WITH {LINES} SELECT 's1' AS session, count(*) AS total, count(DISTINCT hash) AS unique_lines FROM lines")
def distill_runs(t: Tables) -> DataFrame:
    stats = distill.distill_stats(t.documents)
    ledger = distill.record_run(stats, "s1", ["src1"], {"mode": "strict"}, "2024-01-01").unionByName(distill.record_run(stats, "s2", ["src2"], {"mode": "lenient"}, "2024-01-02"))
    return distill.runs(ledger, "s1", "src1", ("mode", "strict")).select("session", "total", "unique_lines")


# --- deduplication ----------------------------------------------------------------------------------


@query("SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_exact_documents(t: Tables) -> DataFrame:
    return dedup.dedup_exact(t.documents)


@query(r"""SELECT doc_id FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY source, md5(substr(regexp_replace(lower(replace(replace(text, '\n', ' '), '\t', ' ')), '[^a-z0-9]', '', 'g'), 1, 500)) ORDER BY n_chars DESC, doc_id) AS k FROM documents WHERE length(text) >= 20)
  WHERE k = 1 UNION ALL SELECT doc_id FROM documents WHERE length(text) < 20""")
def dedup_fingerprint(t: Tables) -> DataFrame:
    return dedup.dedup_fingerprint(t.documents, ["source"], "text", "n_chars", "doc_id").select("doc_id")


@query("SELECT sha256(event_type || user_id) AS hash, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS occurrence_count FROM events GROUP BY 1")
def duplicate_state(t: Tables) -> DataFrame:
    return dedup.duplicate_state(t.events.withColumn("c", F.concat("event_type", F.col("user_id").cast("string"))), "c", "ts")


_BITS = ", ".join(f"sum(CASE WHEN (h >> {b}) & 1 = 1 THEN 1 ELSE -1 END) AS s{b}" for b in range(64))
_PACK = " + ".join(f"(CASE WHEN s{b} > 0 THEN {1 << b}::HUGEINT ELSE 0 END)" for b in range(64))
PRINTS = f"""hashed AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 16))::UBIGINT AS h FROM (SELECT DISTINCT doc_id, unnest({WORDS.format('text')}) AS w FROM documents)),
sums AS (SELECT doc_id, {_BITS} FROM hashed GROUP BY doc_id),
prints AS (SELECT doc_id, (CASE WHEN p >= 9223372036854775808 THEN p - 18446744073709551616 ELSE p END)::BIGINT AS simhash FROM (SELECT doc_id, {_PACK} AS p FROM sums))"""


@query(f"WITH {PRINTS} SELECT doc_id, simhash FROM prints")
def simhash64(t: Tables) -> DataFrame:
    return dedup.simhash64(t.documents)


@query(f"""WITH {PRINTS}, reps AS (SELECT simhash, min(doc_id) AS rep FROM prints GROUP BY simhash)
  SELECT a.rep AS a, b.rep AS b, bit_count(xor(a.simhash, b.simhash))::INTEGER AS distance FROM reps a JOIN reps b ON a.rep < b.rep AND bit_count(xor(a.simhash, b.simhash)) <= 3""")
def near_duplicates(t: Tables) -> DataFrame:
    return dedup.near_duplicates(dedup.simhash64(t.documents), 3)[0]


@query(f"WITH {PRINTS} SELECT doc_id, min(doc_id) OVER (PARTITION BY simhash) AS rep FROM prints")
def near_duplicate_members(t: Tables) -> DataFrame:
    return dedup.near_duplicates(dedup.simhash64(t.documents), 3)[1]


def _hits(t: Tables) -> DataFrame:
    """Sentences that share a rare word with a benchmark item, as hits of a query."""
    from .retrieval_queries import hits

    return hits(t)


@query()
def dedup_geometric(t: Tables) -> DataFrame:
    return dedup.dedup_geometric(_hits(t).select("query_id", "compound_id", "node_id", "start_byte", "end_byte", "score"))


@query()
def dedup_containment(t: Tables) -> DataFrame:
    found = stored(_hits(t).select("query_id", "node_id", "content", "score"), "hits")  # prints of what was found only
    prints = dedup.simhash64(found.select("node_id", "content").distinct(), "node_id", "content")
    return dedup.dedup_containment(found.join(prints, "node_id").select("query_id", "node_id", "content", "score", "simhash"))


@query()
def dedup_word_overlap(t: Tables) -> DataFrame:
    return dedup.dedup_word_overlap(_hits(t).select("query_id", "node_id", "content", "score"))


@query()
def merge_anchors(t: Tables) -> DataFrame:
    return dedup.merge_anchors(_hits(t).select("query_id", "compound_id", "node_id", "start_byte", "end_byte", "score"))


@query()
def merge_windows(t: Tables) -> DataFrame:
    mols = molecules(t)
    positions = prepare.build_tag_tables(mols, tagged(t, mols))["positions"]
    return dedup.merge_windows(positions.select("compound_id", "byte_offset").distinct(), 500)


@query(f"""WITH {MOLECULES} SELECT DISTINCT a.mol_id AS anchor_id, b.mol_id AS node_id FROM molecules a JOIN molecules b ON a.doc_id = b.doc_id AND b.end_byte >= a.start_byte - 500 AND b.start_byte <= a.end_byte + 500 WHERE a.seq % 50 = 0""")
def byte_range_join(t: Tables) -> DataFrame:
    rows = molecules(t).withColumnRenamed("mol_id", "node_id")
    anchors = rows.filter("seq % 50 = 0").withColumnRenamed("node_id", "anchor_id")
    return frame.byte_range_join(rows, anchors).select("anchor_id", "node_id")
