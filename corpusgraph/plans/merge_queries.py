"""Merges of byte ranges by table functions, with their SQL as a fold over sorted lists."""

from pyspark.sql import DataFrame

from ..operators import merging, prepare
from .corpus_queries import TAGGED, _hits, molecules, tagged
from .registry import Tables, query

_OFFSETS = f"""WITH {TAGGED}, offsets AS (SELECT DISTINCT doc_id AS compound_id, floor((start_byte + end_byte) / 2)::BIGINT AS byte_offset FROM tagged JOIN molecules USING (mol_id)),
folded AS (SELECT compound_id, list_reduce(list([[greatest(0, byte_offset - 500), byte_offset + 500]] ORDER BY byte_offset), lambda m, x:
  CASE WHEN x[1][1] - m[len(m)][2] < 500 AND x[1][2] - m[len(m)][1] <= 4000 THEN list_concat(m[1:len(m) - 1], [[m[len(m)][1], x[1][2]]]) ELSE list_concat(m, x) END) AS w FROM offsets GROUP BY compound_id)
SELECT compound_id, x[1] AS start_byte, x[2] AS end_byte FROM (SELECT compound_id, unnest(w) AS x FROM folded)"""


@query(_OFFSETS)
def merge_byte_windows(t: Tables) -> DataFrame:
    mols = molecules(t)
    positions = prepare.build_tag_tables(mols, tagged(t, mols))["positions"]
    return merging.merge_byte_windows(positions.select("compound_id", "byte_offset").distinct(), 500)


@query()
def merge_near_anchors(t: Tables) -> DataFrame:
    return merging.merge_near_anchors(_hits(t).select("query_id", "compound_id", "node_id", "start_byte", "end_byte", "score"))
