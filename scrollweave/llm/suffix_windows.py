"""Suffix-array dedup (1): depth-limited radix sort of suffixes.

A byte string of ``depth`` bytes that occurs in two documents is a group of
suffixes that are equal through their first ``depth`` bytes. The sort goes by
most significant digits and never further than ``depth``; a group that has one
document only is dropped as soon as a digit shows it. The digits of a suffix:

1. its anchor, the gram with the least hash within its first ``depth`` bytes,
   and the anchor's place. Equal suffixes have equal anchors, and successive
   suffixes share theirs, so this digit is sorted once for a dozen suffixes.
   Only here do all documents meet, as 4 bytes per anchor.
2. the bytes, eight at a time, of the stretch of text that the suffixes with one
   anchor cover: equal stretches are groups of equal suffixes at once;
3. where an anchor has different stretches, the bytes of the suffixes
   themselves, eight at a time, up to ``depth``.

Hashes choose anchors and drop groups (a collision keeps a group for nothing);
digits alone say what is equal.

Scale: documents are packed into batches, which meet by range of the first
digit. A batch sends each anchor once, with its least document, so a passage
that a third of all documents share is one entry per batch. Answers are bits:
for each anchor, whether others have it, then for each stretch, which of its
suffixes a smaller document has. Buckets follow the input, so that each holds
``BUCKET`` bytes of it, whatever its size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import BASE, U, Text, column_bytes, lean, mix, words_at
from .common import settle

DEPTH = 50
BATCH, PIECE, BUCKET = 4 << 20, 1 << 20, 32 << 20
#: Stands for a null id, which is larger than any other.
NULL = np.iinfo(np.int64).max
SORT_AT_ONCE = 25_000


class Stretches:
    """All suffixes of a batch that reach ``depth`` within their document, by anchor: start, last (suffix starts), key (hash of the anchor), doc."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, depth: int):
        self.data, self.offsets, self.depth = data, offsets, depth
        self.gram = max(8, depth - 26)
        parts = [self._piece(p) for p in range(0, max(0, len(data) - depth + 1), PIECE)]
        self.start, self.last, self.key = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, U)))
        self.doc = np.searchsorted(offsets, self.start, "right") - 1

    def _piece(self, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        depth, gram = self.depth, self.gram
        data = self.data[first : first + PIECE + depth - 1]
        n, grams, choice = len(data) - depth + 1, len(data) - gram + 1, depth - gram + 1
        at = words_at(data).copy()
        h = np.zeros(grams, U)
        for k in sorted({*range(0, gram - 7, 8), gram - 8}):
            h += at[k : k + grams]
            h *= BASE
            h ^= h >> U(29)
        key = mix(h)
        least = (key & U(0xFFFFFFFF00000000)) | np.arange(grams, dtype=U)
        width = 1
        while width * 2 <= choice:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if choice > width:
            least = np.minimum(least[: len(least) - (choice - width)], least[choice - width :])
        anchor = (least[:n] & U(0xFFFFFFFF)).astype(np.int64)
        reach = np.zeros(n, bool)
        lo, hi = np.clip(self.offsets[:-1] - first, 0, n), np.clip(self.offsets[1:] - first - depth + 1, 0, n)
        mark = np.zeros(n + 1, np.int64)
        some = hi > lo
        np.add.at(mark, lo[some], 1)
        np.add.at(mark, hi[some], -1)
        reach = np.cumsum(mark[:n]) > 0
        new = np.ones(n, bool)
        new[1:] = (anchor[1:] != anchor[:-1]) | (reach[1:] != reach[:-1])
        edge = np.flatnonzero(new)
        last = np.append(edge[1:], n) - 1
        use = reach[edge]
        edge, last = edge[use], last[use]
        return edge + first, last + first, key[anchor[edge]]


def buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The range of keys that each belongs to: ascending with the key."""
    return ((keys >> U(40)) * U(buckets) >> U(24)).astype(np.int64)


def short(keys: np.ndarray) -> np.ndarray:
    return ((keys >> U(8)) & U(0xFFFFFFFF)).astype(np.uint32)


class Batch:
    """A batch's stretches with its distinct anchors, and, once it knows which are shared, its distinct shared stretches."""

    def __init__(self, ids: bytes, sizes: bytes, text: bytes, depth: int):
        self.ids = np.frombuffer(ids, "<i8")
        self.offsets = np.concatenate([[0], np.cumsum(np.frombuffer(sizes, "<i8"))])
        self.data = np.frombuffer(zstandard.decompress(text, max_output_size=int(self.offsets[-1])) if self.offsets[-1] else b"", np.uint8)
        self.depth = depth
        self.all = Stretches(self.data, self.offsets, depth)
        self.keys, self.of = np.unique(self.all.key, return_inverse=True)

    def several(self) -> np.ndarray:
        """For each distinct anchor, whether it has several ids here."""
        own = self.ids[self.all.doc]
        order = np.argsort(self.of, kind="stable")
        if not len(order):
            return np.zeros(0, bool)
        first = np.searchsorted(self.of[order], np.arange(len(self.keys)))
        return np.minimum.reduceat(own[order], first) != np.maximum.reduceat(own[order], first)

    def share(self, shared: np.ndarray) -> None:
        """Sets, for stretches with a shared anchor: start, last, id, and content: the number of the distinct stretch. The distinct ones have first (where), least (id) and key, by ascending key."""
        use = np.flatnonzero(shared[self.of])
        use = use[np.argsort(self.of[use], kind="stable")]
        self.start, self.last, key = self.all.start[use], self.all.last[use], self.all.key[use]
        self.id = self.ids[self.all.doc[use]]
        end = self.last + self.depth
        at = words_at(self.data)
        codes = sorted_ranges(at, self.start, end - self.start, key)
        _, first, self.content = np.unique(codes, return_index=True, return_inverse=True)
        # Numbered in the order of keys, as the stretches are.
        rank = np.argsort(np.argsort(first))
        self.content = rank[self.content]
        self.first = np.sort(first)
        self.key = key[self.first]
        self.least = np.full(len(self.first), NULL)
        np.minimum.at(self.least, self.content, self.id)


def sorted_ranges(at: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Codes of byte ranges of eight bytes or more, equal where key, size and bytes are, by most significant digits.

    The digits are key and size, then the bytes, eight at a time (the last
    eight again, instead of fewer). What is alone in its group is done.
    """
    out = np.full(len(start), -1, np.int64)
    live, made = np.arange(len(start)), 0
    group = pd.factorize(pd.factorize(key)[0].astype(np.int64) * (int(size.max(initial=0)) + 1) + size)[0]
    for k in range(0, int(size.max(initial=0)) + 8, 8):
        stay = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        live, group = live[stay], group[stay]
        ended = size[live] <= k
        if ended.any():
            number, groups = pd.factorize(group[ended])
            out[live[ended]], made = made + number, made + len(groups)
            live, group = live[~ended], group[~ended]
        if not len(live):
            break
        digit = at[start[live] + np.minimum(k, size[live] - 8)]
        order = np.lexsort((digit, group))
        new = np.ones(len(live), bool)
        new[1:] = (group[order][1:] != group[order][:-1]) | (digit[order][1:] != digit[order][:-1])
        group = np.empty(len(live), np.int64)
        group[order] = np.cumsum(new) - 1
    alone = out < 0
    out[alone] = made + np.arange(int(alone.sum()))
    return out


def radix(at: np.ndarray, place: np.ndarray, group: np.ndarray, depth: int) -> np.ndarray:
    """Sort suffixes (their ``place`` in the words ``at``) within ``group`` by most significant digits; the number of the equal group of each, -1 where it is alone."""
    out = np.full(len(place), -1, np.int64)
    live = np.arange(len(place))
    _, group = np.unique(group, return_inverse=True)
    digits = sorted({*range(0, depth - 7, 8), depth - 8})
    for d in [None, *digits]:
        if d is not None:
            digit = at[place[live] + d]
            order = np.lexsort((digit, group))
            new = np.ones(len(live), bool)
            new[1:] = (group[order][1:] != group[order][:-1]) | (digit[order][1:] != digit[order][:-1])
            group = np.empty(len(live), np.int64)
            group[order] = np.cumsum(new) - 1
        stay = np.bincount(group)[group] > 1 if len(group) else np.zeros(0, bool)
        live, group = live[stay], group[stay]
        if not len(live):
            return out
    out[live] = group
    return out


def _packed(batch_bytes: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        texts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            raw = np.concatenate(texts)
            cells = [np.concatenate(ids).astype("<i8").tobytes(), np.concatenate(sizes).astype("<i8").tobytes(), zstandard.ZstdCompressor(1).compress(raw)]
            return pa.record_batch([pa.array([(part << 32) | seq]), *(pa.array([c], pa.binary()) for c in cells), pa.array([len(raw)], pa.int64())], ["batch", "ids", "sizes", "text", "n"])

        for batch in batches:
            keys = batch.column(0).fill_null(NULL).to_numpy(zero_copy_only=False)
            data, offsets = column_bytes(batch.column(1))
            lo = 0
            while lo < len(keys):
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + batch_bytes - held, "right")) - 1)
                ids.append(keys[lo:hi])
                sizes.append(np.diff(offsets[lo : hi + 1]))
                texts.append(data[offsets[lo] : offsets[hi]].copy())
                held += int(offsets[hi] - offsets[lo])
                lo = hi
                if held >= batch_bytes * 3 // 4:
                    yield flush()
                    ids, sizes, texts, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield flush()

    return pack


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _joined(answers: list[dict] | None) -> bytes:
    """The answers of all buckets, in their order."""
    return b"".join(x["answer"] for x in sorted(answers or [], key=lambda x: x["bucket"]))


def _anchors(depth: int, buckets: int):
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _rows(rows):
                b = Batch(row["ids"], row["sizes"], row["text"], depth)
                several, keys = b.several(), short(b.keys).astype("<u4")
                edge = np.searchsorted(buckets_of(b.keys, buckets), np.arange(buckets + 1))
                some = np.flatnonzero(np.diff(edge))
                cells = [[keys[edge[i] : edge[i + 1]].tobytes() for i in some], [np.packbits(several[edge[i] : edge[i + 1]]).tobytes() for i in some]]
                yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([row["batch"]] * len(some), pa.int64()), *(pa.array(c, pa.binary()) for c in cells)], ["bucket", "batch", "keys", "several"])

    return anchors


def _shared(table: pa.Table) -> pa.Table:
    """One bucket: for each batch, a bit for each of its anchors: has it several documents, here or elsewhere."""
    keys = [np.frombuffer(k, "<u4") for k in table["keys"].to_pylist()]
    several = [np.unpackbits(np.frombuffer(s, np.uint8), count=len(k)).astype(bool) for s, k in zip(table["several"].to_pylist(), keys, strict=True)]
    hit = pd.Series(np.concatenate(keys)).duplicated(keep=False).to_numpy() | np.concatenate(several)
    answers = [hit[e - len(k) : e].astype(np.uint8).tobytes() for k, e in zip(keys, np.cumsum([len(k) for k in keys]).tolist(), strict=True)]
    return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array([zlib.compress(a, 1) for a in answers], pa.binary())})


def _answered(row: dict, depth: int) -> Batch:
    b = Batch(row["ids"], row["sizes"], row["text"], depth)
    bits = b"".join(zlib.decompress(x["answer"]) for x in sorted(row["shared"] or [], key=lambda x: x["bucket"]))
    b.share(np.frombuffer(bits, np.uint8).astype(bool))
    return b


def _stretches(depth: int, buckets: int):
    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _rows(rows):
                b = _answered(row, depth)
                edge = np.searchsorted(buckets_of(b.key, buckets), np.arange(buckets + 1))
                start, size = b.start[b.first], (b.last - b.start)[b.first] + depth
                some, cells = np.flatnonzero(np.diff(edge)), []
                for i in some:
                    own = slice(edge[i], edge[i + 1])
                    n = size[own]
                    where = np.repeat(start[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    raw = b"".join([short(b.key[own]).astype("<u4").tobytes(), b.least[own].astype("<i8").tobytes(), n.astype("<u4").tobytes(), b.data[where].tobytes()])
                    cells.append(zstandard.ZstdCompressor(1).compress(raw))
                count = np.diff(edge)[some]
                yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([row["batch"]] * len(some), pa.int64()), pa.array(count), pa.array(cells, pa.binary())], ["bucket", "batch", "count", "cell"])

    return stretches


def _smaller(depth: int):
    def smaller(table: pa.Table) -> pa.Table:
        """One bucket: for each batch and stretch, a bit for each suffix: has a document with a smaller id than the batch's least the same."""
        counts = table["count"].to_pylist()
        raw = [zstandard.decompress(c.as_buffer()) for c in table["cell"].combine_chunks()] if counts else []
        take = lambda kind, skip, width: np.concatenate([np.frombuffer(r, kind, n, skip * n) for r, n in zip(raw, counts, strict=True)])  # noqa: E731, ARG005
        key, least, size = take("<u4", 0, 4), take("<i8", 4, 8), take("<u4", 12, 4).astype(np.int64)
        data = np.concatenate([np.frombuffer(r, np.uint8, offset=16 * n) for r, n in zip(raw, counts, strict=True)])
        del raw
        mask = np.zeros(len(key), "<u4")
        order = np.argsort(key, kind="stable")
        start = np.cumsum(size) - size
        # Some keys at a time, all stretches of a key together.
        lo = 0
        while lo < len(order):
            hi = min(len(order), lo + SORT_AT_ONCE)
            if hi < len(order):
                hi = int(np.searchsorted(key[order], key[order[hi - 1]], "right"))
            own = order[lo:hi]
            mask[own] = smaller_suffixes(data, start[own], size[own], key[own], least[own], depth)
            lo = hi
        answers = [mask[e - n : e].tobytes() for n, e in zip(counts, np.cumsum(counts).tolist(), strict=True)]
        return pa.table({"batch": table["batch"], "bucket": table["bucket"], "answer": pa.array(answers, pa.binary())})

    return smaller


def smaller_suffixes(data: np.ndarray, start: np.ndarray, size: np.ndarray, key: np.ndarray, least: np.ndarray, depth: int) -> np.ndarray:
    """Bits of each stretch (start, size, anchor key, least id): suffix k also occurs with a smaller id."""
    own = np.cumsum(size) - size
    data = data[np.repeat(start - own, size) + np.arange(int(size.sum()))]
    start = own
    # Second digit: equal stretches.
    at = words_at(data)
    codes = sorted_ranges(at, start, size, key)
    _, first, code = np.unique(codes, return_index=True, return_inverse=True)
    low = np.full(len(first), NULL)
    np.minimum.at(low, code, least)
    many = size - depth + 1
    mask = np.where(low[code] < least, (U(1) << many.astype(U)) - U(1), U(0))
    # Third: the bytes of suffixes, where an anchor has several distinct stretches.
    _, of = np.unique(key[first], return_inverse=True)
    mixed = np.flatnonzero(np.bincount(of)[of] > 1)
    if len(mixed):
        n = many[first[mixed]]
        owner = np.repeat(np.arange(len(mixed)), n)
        k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        place = start[first[mixed]][owner] + k
        group = radix(at, place, of[mixed][owner], depth)
        same = np.flatnonzero(group >= 0)
        if len(same):
            smallest = np.full(int(group.max()) + 1, NULL)
            np.minimum.at(smallest, group[same], low[mixed][owner[same]])
            least_of = np.full((len(first), int(many.max())), NULL)
            least_of[mixed[owner[same]], k[same]] = smallest[group[same]]
            for j in range(least_of.shape[1]):
                mask |= np.where(least_of[code, j] < least, U(1) << U(j), U(0))
    return mask.astype(np.uint32)


SPANS = "array<struct<start:long,end:long>>"


def _removed(depth: int):
    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for row in _rows(rows):
                b = _answered(row, depth)
                mask = np.frombuffer(_joined(row["smaller"]), "<u4").astype(U)[b.content]
                # A document that isn't the batch's least with a stretch has all of its suffixes from that one.
                mask[b.id > b.least[b.content]] = U(0xFFFFFFFF)
                many = b.last - b.start + 1
                use = np.flatnonzero(mask)
                owner = np.repeat(use, many[use])
                k = np.arange(len(owner)) - np.repeat(np.cumsum(many[use]) - many[use], many[use])
                place = (b.start[owner] + k)[(mask[owner] >> k.astype(U)) & U(1) > 0]
                cover = np.zeros(len(b.data) + 1, np.int32)
                np.add.at(cover, place, 1)
                np.add.at(cover, place + depth, -1)
                gone = np.cumsum(cover[:-1]) > 0
                text = Text(b.data, b.offsets)
                start, end = text.runs(gone)
                doc = text.doc_of(start)
                per = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=text.n))]).astype(np.int32)
                spans = pa.StructArray.from_arrays([pa.array(start - b.offsets[doc]), pa.array(end - b.offsets[doc])], ["start", "end"])
                kept = b.data[~gone]
                edge = np.concatenate([[0], np.cumsum(text.per_doc(~gone))])
                for lo in range(0, text.n, 2000):
                    hi = min(text.n, lo + 2000)
                    raw = [kept[x:y].tobytes() for x, y in zip(edge[lo:hi].tolist(), edge[lo + 1 : hi + 1].tolist(), strict=True)]
                    ids = pa.array(b.ids[lo:hi], mask=b.ids[lo:hi] == NULL)
                    lists = pa.ListArray.from_arrays(pa.array(per[lo : hi + 1]), spans)
                    yield pa.record_batch([ids, pa.array(np.diff(b.offsets[lo : hi + 1])), lists, pa.array(raw, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"])

    return removed


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH, batch_bytes: int = BATCH) -> DataFrame:
    """doc_id, n_bytes, spans, kept: one row for each row of ``docs``.

    spans are the maximal runs of bytes, from the text's first, that a string of
    ``depth`` bytes covers which also starts in a document with a smaller id;
    kept is what is left, which need not be UTF-8. A null text is empty and a
    null id larger than any other; rows with one id are not each other's
    copies. Strings are judged on the input and never cross documents. Other
    columns are not looked at; an empty table gives an empty result. ``depth``
    is at least 16.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    form = "batch long, ids binary, sizes binary, text binary, n long"
    batches = settle(texts.mapInArrow(lean(_packed(batch_bytes)), form), "batches", few=False)
    total = batches.agg(F.sum("n")).first()[0] or 0
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET))
    answer = "batch long, bucket int, answer binary"
    gather = lambda df, name: df.groupBy("batch").agg(F.collect_list(F.struct("bucket", "answer")).alias(name))
    anchors = batches.mapInArrow(lean(_anchors(depth, buckets)), "bucket int, batch long, keys binary, several binary")
    shared = settle(gather(anchors.groupBy("bucket").applyInArrow(_shared, answer), "shared"), "shared")
    known = batches.join(shared, "batch", "left").select("batch", "ids", "sizes", "text", "shared")
    cells = known.mapInArrow(lean(_stretches(depth, buckets)), "bucket int, batch long, count long, cell binary")
    smaller = settle(gather(cells.groupBy("bucket").applyInArrow(_smaller(depth), answer), "smaller"), "smaller")
    known = known.join(smaller, "batch", "left").select("batch", "ids", "sizes", "text", "shared", "smaller")
    return known.mapInArrow(lean(_removed(depth)), f"doc_id long, n_bytes long, spans {SPANS}, kept binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All windows of 50 bytes, as hex digits, grouped as they are.
ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
low AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT DISTINCT w.doc_id, w.i FROM w JOIN low USING (s) WHERE least < w.doc_id),
grp AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS new FROM hit)),
runs AS (SELECT doc_id, g, min(i) AS a, max(i) + 50 AS b FROM grp GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM runs),
kept AS (SELECT c.doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM cut c JOIN t USING (doc_id) GROUP BY c.doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""
