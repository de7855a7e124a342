"""Byte-level BPE by a global shuffle of distinct words; decoding joins the token-byte table.

1. Texts are cut into pre-tokens with their positions, a block of documents at a time, by array
   operations that reproduce the pattern of the rank file.
2. Each block gives its distinct words; (word, block) rows are shuffled by word and sorted, so each
   distinct word of the corpus is encoded once, by whichever task holds it.
3. The ids go back to the blocks that asked, are joined to the pre-tokens and put together by position.
A word has at most one row for each block, so no word is hot. What moves is the compressed text and
each block's distinct words, never one row for each occurrence. Blocks name words by 64-bit hashes; the
tokens of every word are compared with its own bytes after decoding, and a slice of texts in which two
words share a hash is encoded in place.

Defined cases: null and empty texts have no tokens; repeated rows and null ids are kept as they are;
an empty table gives an empty result; columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import group_bounds, read, slices, span_hashes, text_bytes

RANKS = "byte_bpe_multi_50k.tiktoken"
BLOCK_BYTES = 32 << 20
SPACE, LETTER, NUMBER, OTHER = range(4)


def ranks_path(path: str | None = None) -> str:
    import public_tokenizers

    return path or public_tokenizers.path(RANKS)


@lru_cache(1)
def _encoder(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(1)
def _token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The token-byte table: (all bytes, offsets by id)."""
    encoder = _encoder(path)
    parts = [encoder.decode_single_token_bytes(i) for i in range(encoder.n_vocab)]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of each code point: white space, letter, number or other."""
    import regex

    points = np.setdiff1d(np.arange(0x110000, dtype=np.uint32), np.arange(0xD800, 0xE000, dtype=np.uint32))
    text = points.tobytes().decode("utf-32-le")
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[[ord(c) for c in regex.findall(pattern, text)]] = kind
    return out


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(byte starts of all pre-tokens and the end, first pre-token of each row and the end)."""
    if not len(data):
        return np.zeros(1, np.int64), np.zeros(len(offsets), np.int64)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    n = len(points)
    place = np.concatenate([[0], np.cumsum(1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000))])
    edge = np.zeros(n + 1, bool)
    edge[np.searchsorted(place, offsets)] = True
    kind = _classes()[points]
    run = np.ones(n + 1, bool)
    run[1:n] = (kind[1:] != kind[:-1]) | edge[1:n]
    start = run.copy()
    # the last white space before a word stands apart, or belongs to the word if it is a blank
    b = np.flatnonzero(run[1:n] & ~edge[1:n] & (kind[:-1] == SPACE)) + 1
    start[b - 1] = True
    start[b[points[b - 1] == 0x20]] = False
    # contractions: a lone apostrophe that starts a token
    p = np.flatnonzero((points[: n - 1] == 0x27) & start[: n - 1] & run[1:n] & ~edge[1:n])
    one = points[p + 1]
    two = np.where((p + 2 < n) & ~edge[np.minimum(p + 2, n)], points[np.minimum(p + 2, n - 1)], 0)
    size = np.where(np.isin(one, [115, 116, 109, 100]), 1, 0)
    size[((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))] = 2
    p, size = p[size > 0], size[size > 0]
    start[p + 1] = False
    start[(p + 2)[size == 2]] = False
    start[p + 1 + size] = True
    at = place[np.flatnonzero(start[:n])]
    return np.append(at, len(data)), np.searchsorted(at, offsets)


def _blocks(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[tuple[int, pa.Table]]:
    """Numbered blocks of about `most` bytes of text; a second scan that numbers them otherwise only costs time."""
    number, held, size = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24, [], 0
    for part in slices(batches, "text"):
        held.append(part)
        size += part.nbytes
        if size >= most:
            yield number, pa.Table.from_batches(held)
            number, held, size = number + 1, [], 0
    if held:
        yield number, pa.Table.from_batches(held)


def _parts(table: pa.Table) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for part in slices(table.to_batches(), "text"):
        data, offsets = text_bytes(part.column("text"))
        at, first = pre_tokens(data, offsets)
        yield part, data, at, first, span_hashes(data, at[:-1], at[1:])


def _distinct_words(most: int = BLOCK_BYTES):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _blocks(batches, most):
            known = np.zeros(0, np.uint64)
            for _, data, at, _, hashes in _parts(table):
                hashes, index = np.unique(hashes, return_index=True)
                fresh = ~np.isin(hashes, known, assume_unique=True)
                index = index[fresh]
                known = np.concatenate([known, hashes[fresh]])
                size = at[index + 1] - at[index]
                ends = np.cumsum(size)
                picked = data[np.repeat(at[index] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
                words = pa.Array.from_buffers(pa.binary(), len(index), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32)), pa.py_buffer(picked)])
                yield pa.record_batch([words, pa.array(np.full(len(index), block))], ["word", "block"])

    return run


def _encode_words(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)._encode_single_piece
        word, ids, size = None, b"", 0
        for batch in batches:  # sorted by word
            data, offsets = _bytes(batch.column("word"))
            hashes = span_hashes(data, offsets[:-1], offsets[1:])
            raw, out, sizes = data.tobytes(), [], np.zeros(batch.num_rows, np.uint8)
            wide = {}
            for i in range(batch.num_rows):
                w = raw[offsets[i] : offsets[i + 1]]
                if w != word:
                    word, found = w, np.array(encode(w), np.uint16)
                    ids, size = found.tobytes(), len(found)
                if size < 255:
                    sizes[i] = size
                else:
                    sizes[i], wide[i] = 255, size
                out.append(ids)
            blocks = batch.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            bounds = group_bounds(blocks[order])
            rows = []
            for a, b in zip(bounds[:-1], bounds[1:]):
                own = order[a:b]
                sized = np.array([wide.get(i, sizes[i]) for i in own], np.uint32) if wide else sizes[own].astype(np.uint32)
                rows.append((int(blocks[own[0]]), hashes[own].tobytes(), sized.astype(np.uint8).tobytes() if sized.max() < 256 else b"", sized.tobytes() if sized.max() >= 256 else b"", b"".join([out[i] for i in own])))
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()))], ["block", "hashes", "sizes", "wide", "ids"])

    return run


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _packed(most: int = BLOCK_BYTES):
    """Each block of documents as one compressed value."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, table in _blocks(batches, most):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=6))) as w:
                w.write_table(table.combine_chunks())
            yield pa.record_batch([pa.array([block], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "docs"])

    return run


OUT = "doc_id long, ids binary, decoded binary"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])


def _looked_up(hashes: np.ndarray, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, number of ids of each word) of words by hash; an unknown word has none."""
    if not len(hashes) or not len(own):
        return np.zeros(0, np.uint32), np.zeros(len(own), np.int64)
    i = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
    size = np.where(hashes[i] == own, sizes[i], 0)
    to = np.cumsum(size)
    return ids[np.repeat(begins[i] - (to - size), size) + np.arange(to[-1])].astype(np.uint32), size


def _decoded(vocabulary: np.ndarray, place: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, width of each token, ends of the tokens) from the token-byte table."""
    width = place[flat + 1] - place[flat]
    ends = np.concatenate([[0], np.cumsum(width)])
    return vocabulary[np.repeat(place[flat] - ends[:-1], width) + np.arange(ends[-1])], width, ends


def _same_words(data: np.ndarray, at: np.ndarray, size: np.ndarray, width: np.ndarray, decoded: np.ndarray) -> bool:
    """Whether the tokens of every word decode to that word's own bytes."""
    widths = np.bincount(np.repeat(np.arange(len(size)), size), weights=width, minlength=len(size))
    return bool((widths == np.diff(at)).all()) and np.array_equal(decoded, data)


def _encoded_here(path: str, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    encode, raw, known = _encoder(path)._encode_single_piece, data.tobytes(), {}
    got = []
    for a, b in zip(at[:-1], at[1:]):
        word = raw[a:b]
        if word not in known:
            known[word] = encode(word)
        got.append(known[word])
    return np.array([x for g in got for x in g], np.uint32), np.array([len(g) for g in got], np.int64)


def _reassemble(path: str):
    def run(docs: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        """Joins the ids to the pre-tokens of a block and decodes them again."""
        hashes = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in words.column("hashes")] or [np.zeros(0, np.uint64)])
        sizes = np.concatenate([np.frombuffer(a.as_py(), np.uint8).astype(np.int64) if len(a.as_py()) else np.frombuffer(b.as_py(), np.uint32).astype(np.int64) for a, b in zip(words.column("sizes"), words.column("wide"))] or [np.zeros(0, np.int64)])
        ids = np.concatenate([np.frombuffer(x.as_py(), np.uint16) for x in words.column("ids")] or [np.zeros(0, np.uint16)])
        ends = np.cumsum(sizes)
        order = np.argsort(hashes)
        hashes, begins, sizes = hashes[order], (ends - sizes)[order], sizes[order]
        vocabulary, place = _token_bytes(path)
        for packed in docs.column("docs"):
            table = pa.ipc.open_stream(packed.as_py()).read_all()
            for part, data, at, first, own in _parts(table):
                flat, size = _looked_up(hashes, begins, sizes, ids, own)
                decoded, width, ends_b = _decoded(vocabulary, place, flat)
                if not _same_words(data, at, size, width, decoded):  # two words with one hash, or another numbering of blocks
                    flat, size = _encoded_here(path, data, at)
                    decoded, width, ends_b = _decoded(vocabulary, place, flat)
                to = np.concatenate([[0], np.cumsum(size)])[first]
                raw_ids, raw_text = flat.astype("<u4").tobytes(), decoded.tobytes()
                back = ends_b[to]
                yield pa.record_batch(
                    [part.column("doc_id").cast(pa.int64()), pa.array([raw_ids[4 * a : 4 * b] for a, b in zip(to[:-1], to[1:])], pa.binary()), pa.array([raw_text[a:b] for a, b in zip(back[:-1], back[1:])], pa.binary())],
                    schema=SCHEMA,
                )

    return run


def _digests(run):
    def reduced(docs: pa.Table, words: pa.Table) -> Iterator[pa.RecordBatch]:
        for batch in run(docs, words):
            ids, decoded = batch.column("ids").to_pylist(), batch.column("decoded").to_pylist()
            yield pa.record_batch(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return reduced


def encode_decode(docs: DataFrame, ranks: str | None = None, digests: bool = False, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, ids, decoded): ids as little-endian 32-bit integers and the bytes they decode to; or their digests."""
    path = ranks_path(ranks)
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    words = docs.mapInArrow(_distinct_words(block_bytes), "word binary, block long")
    encoded = words.repartition("word").sortWithinPartitions("word").mapInArrow(_encode_words(path), "block long, hashes binary, sizes binary, wide binary, ids binary")
    packed = docs.mapInArrow(_packed(block_bytes), "block long, docs binary")
    run = _reassemble(path)

    both = packed.groupBy("block").cogroup(encoded.groupBy("block"))
    if digests:
        out = _digests(run)

        def whole(left: pa.Table, right: pa.Table) -> pa.Table:
            return pa.Table.from_batches(list(out(left, right)), schema=pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

        return both.applyInArrow(whole, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(run(left, right)), schema=SCHEMA)

    return both.applyInArrow(whole, OUT)


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(read(spark, sf_dir, "documents"), digests=True)
