"""Passages of bounded size, of documents and of conversations written with fences."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import passages
from .registry import Tables, query


def passage_sql(source: str, key: str) -> str:
    """source: SQL that gives (key, text)."""
    sentences = r"string_split(regexp_replace(s, '([.!?])(\s+)([A-Z])', '\1' || chr(1) || '\2' || chr(2) || '\3', 'g'), chr(1))"
    return rf"""WITH RECURSIVE marks AS (SELECT {key}, string_split(text, '```') AS p FROM ({source}) WHERE text IS NOT NULL),
segments AS (SELECT {key}, unnest(q) AS s, generate_subscripts(q, 1) AS i FROM (SELECT {key}, CASE WHEN len(p) % 2 = 1 THEN p ELSE list_concat(p[1:len(p) - 2], [p[len(p) - 1] || '```' || p[len(p)]]) END AS q FROM marks)),
lists AS (SELECT {key}, i, i % 2 = 0 AS fenced, CASE WHEN i % 2 = 0 THEN ['```' || s || '```'] ELSE {sentences} END AS x FROM segments),
pieces AS (SELECT {key}, i, fenced, unnest(x) AS piece, generate_subscripts(x, 1) AS j FROM lists),
cuts AS (SELECT {key}, i, j, fenced, CASE WHEN fenced OR j = 1 THEN '' ELSE substr(piece, 1, strpos(piece, chr(2)) - 1) END AS gap, CASE WHEN fenced OR j = 1 THEN piece ELSE substr(piece, strpos(piece, chr(2)) + 1) END AS content FROM pieces),
placed AS (SELECT {key}, fenced, content, row_number() OVER w - 1 AS seq, sum(strlen(gap) + strlen(content)) OVER w - strlen(content) AS start_byte FROM cuts WINDOW w AS (PARTITION BY {key} ORDER BY i, j ROWS UNBOUNDED PRECEDING)),
walk AS (
  SELECT {key}, seq, fenced, -1 AS part, '' AS content, content AS rest, start_byte::BIGINT AS start_byte, start_byte::BIGINT AS end_byte FROM placed WHERE regexp_matches(content, '\S')
  UNION ALL
  SELECT {key}, seq, fenced, part + 1, substr(rest, 1, k), substr(rest, k + 1), end_byte, end_byte + strlen(substr(rest, 1, k)) FROM (
    SELECT *, CASE WHEN strlen(rest) <= 1024 THEN length(rest) WHEN regexp_matches(substr(rest, 1, fit), '(?s)^.+\n') THEN length(regexp_extract(substr(rest, 1, fit), '(?s)^.+\n')) ELSE fit END AS k FROM (
      SELECT *, CASE WHEN strlen(rest) <= 1024 THEN 0 ELSE list_max(list_filter(range(256, 1025), lambda c: strlen(substr(rest, 1, c)) <= 1024)) END AS fit FROM walk WHERE rest <> ''))
) SELECT {key}, seq::BIGINT AS seq, part::BIGINT AS part, content, start_byte::BIGINT AS start_byte, end_byte::BIGINT AS end_byte, fenced FROM walk WHERE part >= 0"""


_FENCED = """SELECT conv_id, string_agg(CASE WHEN role = 'assistant' THEN '```' || chr(10) || text || chr(10) || '```' ELSE text END, chr(10) ORDER BY turn, role, text) AS text FROM conversations
  WHERE turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id"""


@query(passage_sql("SELECT doc_id, text FROM documents", "doc_id"))
def split_passages(t: Tables) -> DataFrame:
    return passages.split_passages(t.documents)


@query(passage_sql(_FENCED, "conv_id"))
def split_passages_fenced(t: Tables) -> DataFrame:
    """Conversations as one text each, with what the assistant says in fences."""
    rows = t.conversations.filter("turn is not null and role is not null and text is not null")
    said = F.when(F.col("role") == "assistant", F.concat(F.lit("```\n"), "text", F.lit("\n```"))).otherwise(F.col("text"))
    turns = F.sort_array(F.collect_list(F.struct("turn", "role", "text", said.alias("said"))))
    return passages.split_passages(rows.groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x["said"]), "\n").alias("text")), "conv_id")
