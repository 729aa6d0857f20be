"""Token-ID / binary output (6): canonical length-limited Huffman coding of ids.

Files: a code book (each id's code length, from global counts, at most
``MAX_BITS``) and blocks. A block holds whole documents in ascending id order
and can be decoded by itself. Its bytes, little-endian:

    4s magic, u4 documents, u8 ids, u8 ids before it in its part, u4 step, u4 payload bytes
    u1[documents] id is null, i8[documents] doc_id, u8[documents] number of ids
    u8[ceil(ids / step)] bit offset of every step-th id
    payload: canonical codes, most significant bit first

The decoder reads from all checkpoints of a block at once, one table lookup for
each id. Spark's Parquet writer carries the blocks, one in a row, so that files
appear whole or not at all and in any store.

Scale: texts are encoded once; only the ids move, to be range-partitioned by
document id. Counts are summed per task first; the vocabulary bounds what
reaches the driver. First ids of parts are sums over one row per part.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import scratch
from .bytewise import chunks, lean, raw_bytes
from .common import settle
from .tokens import TEXT_BYTES, default_path, encoder

MAX_BITS, STEP, BLOCK_IDS = 20, 128, 1 << 17
#: The most ids that a part has on average.
PART_IDS = 1 << 25
HEAD = struct.Struct("<4sIQQII")
MAGIC = b"SWH1"


def code_lengths(counts: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``most`` bits (package-merge); 0 for ids that don't occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} ids don't fit {most} bits")
    used = used[np.lexsort((used, counts[used]))]
    weights = counts[used].astype(np.float64)
    level, leaves = weights, []
    for _ in range(most - 1):
        leaves.append(None if level is weights else leaf)
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        order = np.argsort(both, kind="stable")
        level, leaf = both[order], order < len(weights)
    leaves.append(leaf if most > 1 else None)
    take, length = 2 * (len(used) - 1), np.zeros(len(used), np.int64)
    for leaf in reversed(leaves):
        own = take if leaf is None else int(leaf[:take].sum())
        length[:own] += 1
        take = 2 * (take - own)
    out[used] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by (length, id)."""
    codes, code, before = np.zeros(len(lengths), np.uint64), 0, 0
    for bits in range(1, int(lengths.max(initial=0)) + 1):
        code <<= bits - before
        before = bits
        ids = np.flatnonzero(lengths == bits)
        codes[ids] = np.arange(code, code + len(ids), dtype=np.uint64)
        code += len(ids)
    return codes


def write_block(keys: list[int | None], sizes: np.ndarray, ids: np.ndarray, before: int, lengths: np.ndarray, codes: np.ndarray, step: int = STEP) -> bytes:
    bits = lengths[ids].astype(np.int64)
    end = np.cumsum(bits)
    at = end - bits
    total = int(end[-1]) if len(ids) else 0
    words = np.zeros(total // 64 + 2, np.uint64)
    if len(ids):
        code, word, room = codes[ids], at >> 6, 64 - (at & 63) - bits
        high = np.where(room >= 0, code << np.maximum(room, 0).astype(np.uint64), code >> np.maximum(-room, 0).astype(np.uint64))
        first = np.flatnonzero(np.diff(word, prepend=-1))
        words[word[first]] = np.bitwise_or.reduceat(high, first)
        over = np.flatnonzero(room < 0)
        words[word[over] + 1] |= code[over] << (64 + room[over]).astype(np.uint64)
    payload = words.astype(">u8").tobytes()[: (total + 7) // 8]
    null = np.array([k is None for k in keys], np.uint8)
    known = np.array([k or 0 for k in keys], "<i8")
    return b"".join([HEAD.pack(MAGIC, len(keys), len(ids), before, step, len(payload)), null.tobytes(), known.tobytes(), np.asarray(sizes, "<u8").tobytes(), at[::step].astype("<u8").tobytes(), payload])


class Decoder:
    def __init__(self, lengths: np.ndarray):
        self.bits = max(1, int(lengths.max(initial=0)))
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        # Canonical codes ascend, so the table is each id repeated over the codes that begin with its own.
        span = np.left_shift(1, self.bits - lengths[used].astype(np.int64))
        entry = (used.astype(np.uint32) << np.uint32(5)) | lengths[used].astype(np.uint32)
        self.table = np.zeros(1 << self.bits, np.uint32)
        filled = np.repeat(entry, span)
        self.table[: len(filled)] = filled

    def read(self, block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
        """Document ids, their numbers of ids, all ids, the number of ids before the block in its part."""
        magic, docs, n, before, step, size = HEAD.unpack_from(block)
        if magic != MAGIC:
            raise ValueError("not a block")
        at = HEAD.size
        null = np.frombuffer(block, np.uint8, docs, at)
        keys = np.frombuffer(block, "<i8", docs, at + docs)
        sizes = np.frombuffer(block, "<u8", docs, at + 9 * docs).astype(np.int64)
        lanes = -(-n // step)
        where = np.frombuffer(block, "<u8", lanes, at + 17 * docs).astype(np.int64)
        data = np.zeros(size + 8, np.uint32)
        data[:size] = np.frombuffer(block, np.uint8, size, at + 17 * docs + 8 * lanes)
        window = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
        ids = np.empty((step, lanes), np.uint32)
        down, last = np.uint32(32 - self.bits), len(window) - 1
        for k in range(step):
            entry = self.table[(window[np.minimum(where >> 3, last)] << (where & 7).astype(np.uint32)) >> down]
            ids[k] = entry >> np.uint32(5)
            where = where + (entry & np.uint32(31))
        return [None if x else k for x, k in zip(null.tolist(), keys.tolist(), strict=True)], sizes, ids.T.reshape(-1)[:n], before


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian, of 2 or 4 bytes as the vocabulary needs): one row for each row of ``docs``."""
    kind = encoder(path).kind
    width = int(kind[-1])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in chunks(batch.column(1), TEXT_BYTES):
                ids, offsets = encoder(path).encode(text)
                raw = pa.BinaryArray.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer((offsets * width).astype(np.int32)), pa.py_buffer(ids.astype(kind))])
                yield pa.record_batch([batch.column(0)[lo:hi], raw], ["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(encode), "doc_id long, ids binary")


def _counted(kind: str):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            # No id is split between rows, so all rows are one run of ids.
            data, offsets = raw_bytes(batch.column(0))
            ids = np.frombuffer(data[offsets[0] : offsets[-1]], kind)
            for lo in range(0, len(ids), 1 << 20):
                got = np.bincount(ids[lo : lo + (1 << 20)])
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[: len(got)] += got
        used = np.flatnonzero(total)
        yield pa.record_batch([pa.array(used), pa.array(total[used])], ["id", "n"])

    return counted


def write(docs: DataFrame, folder: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> None:
    """Write ``folder``/book (id, bits) and ``folder``/blocks (part, seq, block) of all rows of ``docs``."""
    spark = docs.sparkSession
    path = path or default_path()
    kind = encoder(path).kind
    ids = settle(encoded(docs, path, id_col, text_col), "ids")
    counts = ids.select("ids").mapInArrow(lean(_counted(kind)), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    count = np.zeros(max((r["id"] for r in counts), default=0) + 1, np.int64)
    for r in counts:
        count[r["id"]] = r["n"]
    lengths = code_lengths(count)
    codes = canonical(lengths)
    book = [(int(i), int(lengths[i])) for i in np.flatnonzero(lengths)]
    spark.createDataFrame(book, "id long, bits int").coalesce(1).write.parquet(f"{folder}/book")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            block = write_block(keys, np.array([len(h) for h in held]), np.concatenate(held), before, lengths, codes)
            return pa.record_batch([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([block], pa.binary())], ["part", "seq", "block"])

        for batch in batches:
            for key, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                got = np.frombuffer(row.as_buffer(), kind)
                if held and size + len(got) > BLOCK_IDS:
                    yield flush()
                    seq, before, keys, held, size = seq + 1, before + size, [], [], 0
                keys.append(key)
                held.append(got)
                size += len(got)
        if held:
            yield flush()

    # Rows that share an id, null included, may be many: their ids tell them apart.
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(count.sum()) // PART_IDS))
    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"))
    ordered = ids.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ordered.mapInArrow(lean(blocks), "part int, seq int, block binary").write.option("compression", "none").parquet(f"{folder}/blocks")


def read(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the files."""
    book = spark.read.schema("id long, bits int").parquet(f"{folder}/book").collect()
    lengths = np.zeros(max((r["id"] for r in book), default=0) + 1, np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for part, block in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                keys, sizes, ids, before = decoder.read(block.as_buffer().to_pybytes())
                start = np.cumsum(sizes) - sizes
                view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                raw = [view[4 * a : 4 * (a + n)] for a, n in zip(start.tolist(), sizes.tolist(), strict=True)]
                columns = [pa.array([part] * len(keys), pa.int32()), pa.array(keys, pa.int64()), pa.array(start + before), pa.array(sizes), pa.array([zlib.crc32(x) for x in raw], pa.int64())]
                names = ["part", "doc_id", "at", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns, names = [*columns, pa.array([bytes(x) for x in raw], pa.binary())], [*names, "ids"]
                yield pa.record_batch(columns, names)

    form = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    blocks = spark.read.schema("part int, seq int, block binary").parquet(f"{folder}/blocks").select("part", "block")
    rows = settle(blocks.mapInArrow(lean(decode), form), "decoded")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    out = rows.join(parts, "part")
    return out.select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def round_trip(docs: DataFrame, path: str | None = None, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back: doc_id, start, n_tokens, ids_crc32.

    One row for each row of ``docs``; a null or empty text has the end id only;
    null ids come first; rows that repeat an id stand side by side. Other
    columns are not looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "huffman")
    write(docs, folder, path)
    return read(spark, folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
