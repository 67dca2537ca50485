"""Operator 8: token ids of a corpus in compressed files, in ascending order of documents.

Method: canonical Huffman codes of limited length from the global counts of ids; each block decodes by itself, from a
table and from bit offsets at checkpoints, so that many places of a block are decoded side by side.

The format is a folder with two Parquet tables: `code` (id, length: the canonical code) and `blocks` (part, block,
first: ids of this part before the block, doc_ids, lengths, n_ids, checkpoints: bit offset of every EVERY-th id,
payload: the bits, the highest first). Parts hold ascending ranges of doc_id, blocks of a part ascend as well.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm import common, wordbpe

#: Ids between checkpoints, and ids from which a block is closed (a document never spans two blocks).
EVERY, BLOCK = 256, 1 << 18
#: Bits of the longest code, unless the vocabulary needs more.
LONGEST = 18


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Lengths of an optimal prefix code of at most longest bits for counts; 0 for ids that don't occur. Package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    m = len(used)
    if m <= 1:
        out[used] = 1
        return out
    longest = max(longest, int(np.ceil(np.log2(m))) + 1)
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(longest):
        both = np.concatenate([weights, packages])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < m)
        merged = both[rank]
        even = len(merged) // 2 * 2
        packages = merged[0:even:2] + merged[1:even:2]
    take = 2 * (m - 1)
    lengths = np.zeros(m, np.int64)
    for single in reversed(levels):
        n = int(single[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in the order of (length, id)."""
    ids = np.flatnonzero(lengths)
    ids = ids[np.argsort(lengths[ids], kind="stable")]
    codes, code, last = np.zeros(len(lengths), np.uint64), 0, 0
    for i in ids.tolist():
        n = int(lengths[i])
        code <<= n - last
        codes[i], code, last = code, code + 1, n
    return codes


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of ids, and the bit offset of every EVERY-th of them."""
    n = lengths[ids].astype(np.int64)
    end = np.cumsum(n)
    start = end - n
    word, free = start >> 5, (64 - (start & 31) - n).astype(np.uint64)
    v = codes[ids] << free
    size = int(end[-1] + 31 >> 5) + 1 if len(ids) else 0
    # Bits don't overlap, so sums are unions, and below 2**32 doubles are exact.
    bits = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), size) + np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), size)[:size] if size else np.zeros(0)
    return bits.astype(">u4").tobytes(), start[::EVERY]


class Table:
    """Decodes blocks: ids and lengths by the next bits."""

    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        self.ids, self.lengths = np.zeros(1 << self.bits, np.uint32), np.zeros(1 << self.bits, np.int64)
        codes = canonical(lengths)
        for i in np.flatnonzero(lengths).tolist():
            n = int(lengths[i])
            at = int(codes[i]) << self.bits - n
            self.ids[at : at + (1 << self.bits - n)], self.lengths[at : at + (1 << self.bits - n)] = i, n

    def unpack(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
        window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # 32 bits from each byte on
        at, out = checkpoints.astype(np.int64), np.zeros((len(checkpoints), EVERY), np.uint32)
        tail = n - (len(checkpoints) - 1) * EVERY
        mask = (1 << self.bits) - 1
        for k in range(EVERY if len(checkpoints) > 1 else tail):
            if k == tail:
                at = at[:-1]
            key = window[at >> 3] >> (32 - self.bits - (at & 7)).astype(np.uint32) & mask
            out[: len(at), k] = self.ids[key]
            at = at + self.lengths[key]
        return out.reshape(-1)[:n]


def _tokenised(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = wordbpe.load(path, wordbpe.LibraryWords)
        end, squeeze = np.array([end_id], words.dtype).tobytes(), zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in common.slices(batch, 1):
                ids = words.encode_all([text or "" for text in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([squeeze.compress(x.tobytes() + end) for x in ids], pa.binary())], names=["doc_id", "ids"])

    return docs.mapInArrow(run, "doc_id long, ids binary")


def _dtype(path: str) -> np.dtype:
    return wordbpe.load(path, wordbpe.LibraryWords).dtype


def _counts(tokens: DataFrame, dtype: np.dtype, size: int) -> np.ndarray:
    """How often each id occurs. At most one row for each id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, read = np.zeros(size, np.int64), zstandard.ZstdDecompressor()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                got = np.bincount(np.frombuffer(read.decompress(x), dtype))
                total[: len(got)] += got
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen])], names=["id", "n"])

    out = np.zeros(size, np.int64)
    for row in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


BLOCKS = "part int, block int, first long, doc_ids array<long>, lengths array<int>, n_ids long, checkpoints array<int>, payload binary"
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.list_(pa.int32()), pa.binary()]


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text of docs, ends each with end_id, and writes the format above to folder.

    A null text is empty (its only id is end_id). Null ids come first, equal ids stand side by side in the order of
    their contents; repeated rows are all written. An empty table gives an empty folder of both tables. Other columns
    of docs aren't read.
    """
    spark = docs.sparkSession
    dtype = _dtype(path)
    size = max(wordbpe.load(path, wordbpe.LibraryWords).size, end_id + 1)
    tokens = common.written(_tokenised(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)), path, end_id), f"{folder}/tokens", compression="none")
    lengths = code_lengths(_counts(tokens, dtype, size))
    spark.createDataFrame(list(enumerate(lengths.tolist())), "id int, length int").coalesce(1).write.parquet(f"{folder}/code")
    shared = spark.sparkContext.broadcast(lengths)  # one byte for each id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, read = canonical(shared.value), zstandard.ZstdDecompressor()
        held: list[tuple] = []
        n = block = first = part = 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate([x for _, x in held])
            payload, at = pack(ids, shared.value, codes)
            row = [part, block, first, [d for d, _ in held], [len(x) for _, x in held], len(ids), at.tolist(), payload]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, x, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part = p
                held.append((doc, np.frombuffer(read.decompress(x), dtype)))
                n += len(held[-1][1])
                if n >= BLOCK:
                    yield close()
                    held, first, block, n = [], first + n, block + 1, 0
        if held:
            yield close()

    ordered = tokens.repartitionByRange(common.partitions(spark), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    ordered.withColumn("part", F.spark_partition_id()).mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")
    common.remove(spark, f"{folder}/tokens")


def read_token_files(spark: SparkSession, folder: str, keep_ids: bool = True) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids."""
    rows = spark.read.parquet(f"{folder}/code").collect()  # one row for each id of the vocabulary
    lengths = np.zeros(len(rows), np.uint8)
    for row in rows:
        lengths[row.id] = row.length
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    # One row for each part: as many as the writer had partitions, whatever the corpus's size.
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0).cast("long")).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Table(shared.value)
        for batch in batches:
            for start, docs, counts, n, at, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = code.unpack(payload, np.array(at), n)
                ends = np.cumsum(counts)
                each = np.split(ids, ends[:-1])
                columns = [pa.array(docs, pa.int64()), pa.array(start + ends - counts), pa.array(counts, pa.int64()), pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in each], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns + ([pa.array([x.astype(np.int32) for x in each], pa.list_(pa.int32()))] if keep_ids else []), names=["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * keep_ids)

    placed = blocks.join(F.broadcast(parts), "part").select((F.col("before") + F.col("first")).alias("start"), "doc_ids", "lengths", "n_ids", "checkpoints", "payload")
    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * keep_ids)
