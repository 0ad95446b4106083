"""Binary token output: canonical length-limited Huffman coding with table-driven decoding.

1. Texts are encoded once into a written table of packed ids.
2. Global id counts are summed map-side, and the driver makes code lengths by package-merge, of at most 16 bits or, above 65,536 used ids, one
   more than these need: one number for each vocabulary entry.  The codes are canonical, so the lengths are the whole codebook.
3. Documents are range-partitioned by doc_id, and each partition writes blocks of whole documents.  A block is
   self-contained: header, document table, the bit offset of every ``CHECKPOINT``-th id, and the bit stream.
4. A reader decodes any block alone: all its checkpoints are lanes that step together through a table with an entry for each bit pattern of the longest code, 16 bits at least.

Folder: ``codebook`` (one row: lengths) and ``blocks`` (part, block, start, n_tokens, payload), written by
Spark's committed writer, with files in ascending doc_id order.  ``start`` counts ids from the part's start; ``part`` totals give the rest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronofold.llm.common import bounded_batches, discard, materialise, scratch
from chronofold.llm.tokenizing import WORD_BPE, cached_tokenizer

MAX_BITS, CHECKPOINT, BLOCK_TOKENS, PART_TOKENS, END_ID = 16, 128, 1 << 19, 1 << 23, 2
#: Parts of a store at most; beyond, a part holds more ids.  One number a part reaches the driver.
MAX_PARTS = 1 << 16
MAGIC = b"HTB1"
NO_ID = -(1 << 63)


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits (package-merge); 0 for ids that never occur.

    Without ``limit`` it is MAX_BITS, or one bit more than codes of one length for all used ids have, if that is greater.
    """
    used = np.flatnonzero(counts)
    if limit is None:
        limit = max(MAX_BITS, (max(len(used), 2) - 1).bit_length() + 1)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of the asked length")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    leaf, packages = [], np.zeros(0, np.int64)
    for _ in range(limit):
        both = np.concatenate([weights, packages])
        at = np.argsort(both, kind="stable")
        leaf.append(at < len(weights))
        merged = both[at]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(1)
    lengths, n = np.zeros(len(order), np.int64), 2 * len(order) - 2
    for is_leaf in reversed(leaf):
        own = int(is_leaf[:n].sum())
        lengths[:own] += 1
        n = 2 * (n - own)
    out[order] = lengths
    return out


def table_bits(lengths: np.ndarray) -> int:
    return max(MAX_BITS, int(lengths.max(initial=0)))


def _window_bytes(bits: int) -> int:
    """Bytes that a code of ``bits`` bits may touch, wherever in the first it starts."""
    return (bits + 14) // 8


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes, code, last = np.zeros(len(lengths), np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for each window of as many bits as the longest code has, MAX_BITS at least."""
    width = table_bits(lengths)
    codes = canonical_codes(lengths)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    span = 1 << (width - lengths[order].astype(np.int64))
    ids, bits = np.zeros(1 << width, np.uint32), np.ones(1 << width, np.uint8)
    n = int(span.sum())
    assert not len(order) or int(codes[order[0]]) == 0
    ids[:n], bits[:n] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, bits


def encode_block(doc_ids: list[int], sizes: list[int], ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> bytes:
    """header | doc_ids | sizes | checkpoints | bits; little-endian, the bit stream most significant bit first."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    touched = _window_bytes(table_bits(lengths))
    word = np.uint32 if touched <= 4 else np.uint64
    window = codes[ids].astype(word) << (8 * touched - size - (at & 7)).astype(word)
    total = int(ends[-1]) if len(ends) else 0
    n_bytes = (total + 7) // 8 + touched
    stream = np.zeros(n_bytes, np.float64)
    for k in range(touched):
        stream += np.bincount((at >> 3) + k, weights=(window >> word(8 * (touched - 1 - k))) & word(255), minlength=n_bytes)
    head = struct.pack("<4sIQQ", MAGIC, len(doc_ids), len(ids), total)
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), np.array(sizes, "<u8").tobytes(), at[::CHECKPOINT].astype("<u8").tobytes(), stream.astype(np.uint8).tobytes()])


def decode_block(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, sizes, ids) of one block."""
    magic, n_docs, n, total = struct.unpack_from("<4sIQQ", block)
    if magic != MAGIC:
        raise ValueError("not a token block")
    at = struct.calcsize("<4sIQQ")
    doc_ids = np.frombuffer(block, "<i8", n_docs, at)
    sizes = np.frombuffer(block, "<u8", n_docs, at + 8 * n_docs).astype(np.int64)
    at += 16 * n_docs
    lanes = -(-n // CHECKPOINT)
    bit = np.frombuffer(block, "<u8", lanes, at).astype(np.int64)
    symbol, length = table
    width = (len(symbol) - 1).bit_length()
    touched = _window_bytes(width)
    word = np.uint32 if touched <= 4 else np.uint64
    raw = np.frombuffer(block, np.uint8, -1, at + 8 * lanes).astype(word)
    window = np.zeros(len(raw), word)
    for k in range(touched):
        window[: len(raw) - touched + 1] |= raw[k : len(raw) - touched + 1 + k] << word(8 * (touched - 1 - k))
    out = np.zeros((CHECKPOINT, lanes), np.uint32)
    for k in range(CHECKPOINT):
        live = lanes if k < (n - 1) % CHECKPOINT + 1 else lanes - 1  # the last lane may be shorter
        if live <= 0:
            break
        here = bit[:live]
        code = (window[here >> 3] >> (8 * touched - width - (here & 7)).astype(word)) & word((1 << width) - 1)
        out[k, :live] = symbol[code]
        bit[:live] += length[code]
    return doc_ids, sizes, out.T.reshape(-1)[:n]


def _encode_texts(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = cached_tokenizer(path)
        end, width = np.array([end_id], tokenizer.dtype).tobytes(), tokenizer.dtype.itemsize
        for batch in batches:
            packed = [tokenizer.packed(t or "") + end for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(p) // width for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return run


def _count_ids(dtype: np.dtype, vocab: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocab, np.int64)
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts += np.bincount(np.frombuffer(packed, dtype), minlength=vocab)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    return run


def _write_blocks(dtype: np.dtype, sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = np.frombuffer(sent.value, np.uint8)
        codes, part = canonical_codes(lengths), TaskContext.get().partitionId()
        block, start, held, n = 0, 0, [], 0

        def close() -> pa.RecordBatch:
            nonlocal block, start, held, n
            ids = np.frombuffer(b"".join(p for _, p in held), dtype)
            payload = encode_block([d for d, _ in held], [len(p) // dtype.itemsize for _, p in held], ids, codes, lengths)
            out = pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (part, block, start, n)] + [pa.array([payload], pa.binary())], names=["part", "block", "start", "n_tokens", "payload"])
            block, start, held, n = block + 1, start + n, [], 0
            return out

        for batch in batches:
            for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                size = len(packed) // dtype.itemsize
                if held and n + size > BLOCK_TOKENS:
                    yield close()
                held.append((NO_ID if doc_id is None else doc_id, packed))
                n += size
        if held:
            yield close()

    return run


BLOCKS = "part long, block long, start long, n_tokens long, payload binary"


def write_tokens(docs: DataFrame, folder: str, path: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", part_tokens: int = PART_TOKENS) -> None:
    """Encode every whole text, append ``end_id``, and write ``folder`` in ascending doc_id order (null first).

    Null or empty text is ``end_id`` alone.  Rows that repeat a doc_id are written next to each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    tokenizer = cached_tokenizer(path)
    dtype, vocab = tokenizer.dtype, tokenizer.library.get_vocab_size()
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    tokens = materialise(source.mapInArrow(_encode_texts(path, end_id), "doc_id long, n_tokens long, ids binary"), "token-ids")
    counts = np.zeros(vocab, np.int64)
    for r in tokens.select("ids").mapInArrow(_count_ids(dtype, vocab), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["id"]] = r["n"]  # at most one row for each vocabulary entry
    lengths = code_lengths(counts)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{folder}/codebook")
    sent = spark.sparkContext.broadcast(lengths.tobytes())
    parts = min(MAX_PARTS, max(1, -(-int(counts.sum()) // part_tokens)))
    ordered = tokens.select("doc_id", "ids").repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    ordered.mapInArrow(_write_blocks(dtype, sent), BLOCKS).write.parquet(f"{folder}/blocks")
    discard(tokens)


def _read(spark: SparkSession, folder: str, names: list[str], types: list[pa.DataType], schema: str, each) -> DataFrame:
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    lengths = spark.read.schema("lengths binary").parquet(f"{folder}/codebook").first()["lengths"]
    # one number for each part, of which there are at most MAX_PARTS
    totals = sorted((r["part"], r["n"]) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).toLocalIterator())
    before, total = {}, 0
    for part, n in totals:
        before[part], total = total, total + n
    sent = spark.sparkContext.broadcast((bytes(lengths), before))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, before = sent.value
        table = decode_table(np.frombuffer(lengths, np.uint8))
        for batch in batches:
            for part, start, payload in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                doc_ids, sizes, ids = decode_block(payload, table)
                ends = np.cumsum(sizes)
                first = before[part] + start + ends - sizes
                own = pa.array(doc_ids, mask=doc_ids == NO_ID)
                rest = [pa.array(x, t) for x, t in zip(each(ids, ends - sizes, ends), types, strict=True)]
                yield pa.RecordBatch.from_arrays([own, pa.array(first), pa.array(sizes), *rest], names=["doc_id", "start", "n_tokens", *names])

    return blocks.select("part", "start", "payload").mapInArrow(run, f"doc_id long, start long, n_tokens long, {schema}")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids, decoded from the files of ``folder``."""
    def each(ids, starts, ends):
        return [[ids[a:b].astype(np.int32) for a, b in zip(starts, ends, strict=True)]]

    return _read(spark, folder, ["ids"], [pa.list_(pa.int32())], "ids array<int>", each)


def read_digests(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of little-endian unsigned 32-bit ids), decoded from the files of ``folder``."""
    def each(ids, starts, ends):
        return [[zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(starts, ends, strict=True)]]

    return _read(spark, folder, ["ids_crc32"], [pa.int64()], "ids_crc32 long", each)


def token_round_trip(docs: DataFrame, path: str = WORD_BPE, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the token files to the shared folder and read them back: doc_id, start, n_tokens, ids_crc32.

    Null or empty text is ``end_id`` alone; a null doc_id comes first; rows that repeat a doc_id follow each other in any order, each with its own ids.  An
    empty table gives an empty result.  Other columns are not read.
    """
    folder = f"{scratch(docs.sparkSession)}/token-store-{uuid.uuid4().hex}"
    write_tokens(docs, folder, path, end_id, id_col, text_col)
    return read_digests(docs.sparkSession, folder)
