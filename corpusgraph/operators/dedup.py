"""Deduplication jobs of the corpus."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .windows import top_k


def dedup_exact(docs: DataFrame, known: DataFrame | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, hash): the smallest id of each distinct text that isn't in `known` (hash)."""
    hashed = docs.select(key, F.sha2(text, 256).alias("hash")).groupBy("hash").agg(F.min(key).alias(key))
    return hashed.join(known.select("hash").distinct(), "hash", "left_anti") if known is not None else hashed


def fingerprint(text: Column, chars: int = 500) -> Column:
    return F.md5(F.substring(T.norm_alnum(text), 1, chars))


def dedup_fingerprint(rows: DataFrame, by: list[str], text: str, score: str, tie: str, least: int = 20) -> DataFrame:
    """Of rows with the same first 500 letters and digits the best stays; texts under `least` characters all stay."""
    short = F.length(text) < least
    kept = top_k(rows.filter(~short).withColumn("_f", fingerprint(F.col(text))), [*by, "_f"], [F.col(score).desc(), tie], 1).drop("_f")
    return kept.unionByName(rows.filter(short))


def duplicate_state(rows: DataFrame, text: str, ts: str) -> DataFrame:
    """(hash, first_seen, last_seen, occurrence_count) of equal contents."""
    return rows.groupBy(F.sha2(text, 256).alias("hash")).agg(F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("occurrence_count"))


def simhash64(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, simhash): sign of 64 sums over the distinct words of a text, packed into a long."""
    tokens = docs.select(key, F.explode(F.array_distinct(T.words(F.col(text)))).alias("w"))
    hashed = tokens.select(key, F.conv(F.substring(F.md5("w"), 1, 16), 16, -10).cast("long").alias("h"))
    sums = hashed.groupBy(key).agg(*[F.sum(F.when(F.shiftright("h", b).bitwiseAND(F.lit(1)) == 1, 1).otherwise(-1)).alias(f"s{b}") for b in range(64)])
    packed = F.lit(0).cast("long")
    for b in range(64):
        packed = packed.bitwiseOR(F.when(F.col(f"s{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return sums.select(key, packed.alias("simhash"))


def hamming_blocks(distance: int) -> tuple[int, int]:
    """(blocks, radius): of so many blocks of a 64-bit print one differs in `radius` bits at most, if the prints differ in `distance`."""
    blocks = max(2, -(-(distance + 1) // 3)) if distance else 1
    return blocks, distance // blocks


def _blocks_of_bits(blocks: int) -> list[tuple[range, Column]]:
    """The bits of each block of a 64-bit print, and their mask."""
    ends = [64 * i // blocks for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(ends, ends[1:])]
    return [(range(lo, hi), F.lit(m - (1 << 64) if m >> 63 else m).cast("long")) for lo, hi, m in zip(ends, ends[1:], masks)]


def hamming_keys(prints: DataFrame, blocks: int, flip: bool, bit: str) -> DataFrame:
    """prints with block, key and `bit`: the print's own bits of each block (bit -1) and, with `flip`, those with one bit flipped."""
    def block(i: int, bits: range, mask: Column) -> list[Column]:
        own = F.col("simhash").bitwiseAND(mask)
        row = lambda key, at: F.struct(F.lit(i).alias("block"), key.alias("key"), at.alias(bit))
        flipped = F.transform(F.sequence(F.lit(bits[0]), F.lit(bits[-1])), lambda b: row(own.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), b)), b))
        return [F.array(row(own, F.lit(-1))), flipped][: 1 + flip]

    options = [x for i, (bits, mask) in enumerate(_blocks_of_bits(blocks)) for x in block(i, bits, mask)]
    return prints.select("*", F.explode(F.concat(*options)).alias("k")).select(*prints.columns, "k.*")


def near_duplicates(prints: DataFrame, distance: int = 3, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs of distinct fingerprints within the distance (0 to 8), by their smallest ids, and who has each.

    Prints are cut into blocks, one of which differs in two bits at most: two blocks of 32 bits up to a distance of 5, three of 21 or 22
    bits beyond. Each side flips at most one bit of a block, so prints meet by equality of wide keys, and a print has at most 67
    of them. A pair counts in its first near block, where the left side flips the one bit or the lower of two that differ,
    so it comes once. Equal fingerprints are one class, so a group of copies gives no pairs.
    """
    if not 0 <= distance <= 8:
        raise ValueError("distance is 0 to 8")
    classes = prints.groupBy("simhash").agg(F.min(key).alias("rep"))
    members = prints.join(classes, "simhash").select(key, "rep")
    blocks, radius = hamming_blocks(distance)
    left = hamming_keys(classes.withColumnRenamed("rep", "a"), blocks, radius >= 1, "bit").withColumnRenamed("simhash", "x")
    right = hamming_keys(classes.withColumnRenamed("rep", "b"), blocks, radius >= 2, "other").withColumnRenamed("simhash", "y")
    differ = F.col("x").bitwiseXOR(F.col("y"))
    apart = [F.bit_count(differ.bitwiseAND(mask)) for _, mask in _blocks_of_bits(blocks)]
    nearer = F.element_at(F.array(*apart), F.col("block") + 1) == (F.col("bit") >= 0).cast("int") + (F.col("other") >= 0).cast("int")
    once = (F.col("other") < 0) | (F.col("bit") >= 0) & (F.col("bit") < F.col("other"))
    for i, n in enumerate(apart[:-1]):
        once = once & ((F.col("block") <= i) | (n > radius))
    met = left.join(right, ["block", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(differ) <= distance) & nearer & once)
    return met.select("a", "b", T.hamming(F.col("x"), F.col("y")).alias("distance")), members


def dedup_geometric(rows: DataFrame, share: float = 0.5, adjacency: int = 500) -> DataFrame:
    """Greedy by score within each (query_id, compound_id): drops ranges that overlap a kept one or lie too near it.

    rows: query_id, compound_id, node_id, start_byte, end_byte, score. Groups are one query's hits in one document.
    """

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "node_id"], ascending=[False, True])
        taken: list[tuple[int, int]] = []
        keep = []
        for a, b in zip(group["start_byte"], group["end_byte"]):
            ok = True
            for x, y in taken:
                small = max(1, min(b - a, y - x))
                over = min(b, y) - max(a, x)
                if over >= share * small or (over <= 0 and -over < max(adjacency, 0.2 * small)):
                    ok = False
                    break
            keep.append(ok)
            if ok:
                taken.append((a, b))
        return group[keep]

    return rows.groupBy("query_id", "compound_id").applyInPandas(kept, rows.schema)


def dedup_containment(rows: DataFrame, prefix: int = 100, near: int = 5) -> DataFrame:
    """Drops rows whose text a better row of the query contains, starts like, or nearly equals.

    rows: query_id, node_id, content, score, simhash. Groups are the hits of one query.
    """

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["score", "node_id"], ascending=[False, True])
        taken: list[tuple[str, int]] = []
        keep = []
        for text, print_ in zip(group["content"], group["simhash"]):
            same = lambda other, bits: text in other or other in text or (min(len(text), len(other)) > 50 and text[:prefix] == other[:prefix]) or bin((print_ ^ bits) & (2**64 - 1)).count("1") < near
            ok = not any(same(*t) for t in taken)
            keep.append(ok)
            if ok:
                taken.append((text, print_))
        return group[keep]

    return rows.groupBy("query_id").applyInPandas(kept, rows.schema)


def dedup_word_overlap(rows: DataFrame, share: float = 0.6) -> DataFrame:
    """Greedy by score within a query: drops rows that share `share` of the smaller set of words of 5 letters or more with a kept one."""

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        import re

        group = group.sort_values(["score", "node_id"], ascending=[False, True])
        taken: list[set] = []
        keep = []
        for text in group["content"]:
            own = {w for w in re.findall(r"\b[a-z]{5,}\b", text.lower()) if w not in T.STOP_WORDS}
            ok = not any(own and t and len(own & t) / min(len(own), len(t)) >= share for t in taken)
            keep.append(ok)
            if ok:
                taken.append(own)
        return group[keep]

    return rows.groupBy("query_id").applyInPandas(kept, rows.schema)


def merge_anchors(rows: DataFrame, near: int = 50) -> DataFrame:
    """Within (query_id, compound_id), in byte order: of ranges that nearly equal, contain or overlap by half, the best stays."""

    def kept(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["start_byte", "end_byte", "node_id"])
        out: list = []
        for row in group.itertuples(index=False):
            last = out[-1] if out else None
            if last is not None and row.start_byte <= last.end_byte + near:
                over = min(row.end_byte, last.end_byte) - max(row.start_byte, last.start_byte)
                small = max(1, min(row.end_byte - row.start_byte, last.end_byte - last.start_byte))
                alike = abs(row.start_byte - last.start_byte) < 5 and abs(row.end_byte - last.end_byte) < 5
                if alike or over >= small or over > 0.5 * small:
                    if row.score > last.score:
                        out[-1] = row
                    continue
            out.append(row)
        return pd.DataFrame(out, columns=group.columns)

    return rows.groupBy("query_id", "compound_id").applyInPandas(kept, rows.schema)


def merge_windows(rows: DataFrame, radius: int, gap: int = 500, most: int = 4000) -> DataFrame:
    """(compound_id, start_byte, end_byte): windows of +-radius around offsets, merged if near and not longer than `most`."""

    def merged(group: pd.DataFrame) -> pd.DataFrame:
        out: list[list[int]] = []
        for at in sorted(group["byte_offset"]):
            a, b = max(0, at - radius), at + radius
            if out and a - out[-1][1] < gap and b - out[-1][0] <= most:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return pd.DataFrame([(group["compound_id"].iloc[0], a, b) for a, b in out], columns=["compound_id", "start_byte", "end_byte"])

    kind = dict(rows.dtypes)["compound_id"]
    return rows.groupBy("compound_id").applyInPandas(merged, f"compound_id {kind}, start_byte long, end_byte long")


def near_blocks(docs: DataFrame, distance: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, root): the smallest key reachable over fingerprints within the distance; itself for texts without words."""
    pairs, members = near_duplicates(simhash64(docs, key, text), distance, key)
    roots = components(pairs)
    named = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select(key, F.coalesce("root", "rep").alias("root"))
    return docs.select(key).distinct().join(named, key, "left").select(key, F.coalesce("root", key).alias("root"))


def components(pairs: DataFrame, rounds: int = 100) -> DataFrame:
    """(node, root): the smallest node reachable over pairs (a, b), for the nodes of pairs.

    Each round every node steps to the first of itself and its neighbours in an order by hash that changes with the round, and
    once more from there; then steps are contracted, so what is left shrinks by a constant share whatever the shape (an ordered
    chain, too). Hubs are minima by partial aggregates; rounds are cut by checkpoint(), and only whether pairs are left
    reaches the driver. A graph that isn't done after `rounds` raises.
    """
    from .graph import _cut

    left = _cut(pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    names = _cut(left.select("a").union(left.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("at")))
    for i in range(rounds):
        if left.isEmpty():
            roots = names.groupBy("at").agg(F.min("node").alias("root"))
            return names.join(roots, "at").select("node", "root")
        both = left.union(left.select("b", "a")).union(left.select("a", "a")).union(left.select("b", "b")).toDF("x", "y")
        step = both.groupBy("x").agg(F.min(F.struct(F.xxhash64(F.lit(i), "y").alias("h"), "y"))["y"].alias("y"))
        further = step.select(F.col("x").alias("y"), F.col("y").alias("z"))
        step = _cut(step.join(further, "y").select("x", "z"))
        names = _cut(names.join(step.withColumnRenamed("x", "at"), "at", "left").select("node", F.coalesce("z", "at").alias("at")))
        moved = left.join(step.toDF("a", "to_a"), "a").join(step.toDF("b", "to_b"), "b").filter("to_a <> to_b")
        left = _cut(moved.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct())
    raise RuntimeError("components did not settle; allow more rounds")
