"""MinHash near-dedup (10): DartMinHash.

Each shingle of a text is a column of a plane, as wide as its weight; darts,
the same for every text that has the shingle, lie in its unit cells as often
and where the hash of (shingle, cell) says. A text has the darts that fall
within its weights and below a rank; each dart belongs to one coordinate, and
the earliest dart of each coordinate is the signature. Two texts agree in a
coordinate with the probability of their weighted Jaccard similarity. A text
costs as many darts as it has weight (or, if short, as its signature needs),
not shingles times coordinates.

Signatures are joined by bands. Distinct shingle sets are classes first, so
copies are one row from there on. Each member of shared buckets meets one other
(exact similarity, from the sets): of those that lead its buckets, the one that
shares buckets with most. These links are trees. A bucket whose members are in
one tree is settled. Of the members of the others, all pairs of different trees
that can be similar enough are found by their prefixes: rarest shingles first,
two sets that share enough have one in common among the first few. So no link
within buckets is lost, and groups of near copies don't form all pairs.

Scale: sets are read again only for members of shared buckets. Buckets, leads
and prefixes are joins and aggregations by key with partial sums; a hot bucket
is rows, not a list. Trees are followed by pointers that double their reach,
components found by alternating large and small stars: rounds that grow with
the logarithm of a component's width. Tables of rounds go when the next is
written.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytewise import BASE, U, Text, chunks, doc_key, lean, mix, windows
from .common import drop_settled, settle

WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 32, 6
#: Sizes of sets fall into classes whose edges grow by this factor; cells that a worker takes at once.
CLASS, CELLS = 1.05, 1_000_000
#: Distribution function of the number of darts in a cell (Poisson with mean 1).
DARTS = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def shingles(text: Text, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document of each run of ``words`` words; a text with fewer words, but some, has one of all its words."""
    starts, ends = text.words()
    docs, word = text.docs_of(starts), text.hashes(starts, ends)
    keys, at = windows(word, docs, words)
    found = [(keys, docs[at])]
    have = np.bincount(docs, minlength=text.n)
    for k in range(1, words):
        few = have[docs] == k
        if few.any():
            keys, at = windows(word[few], docs[few], k)
            found.append((mix(keys + U(k)), docs[few][at]))
    return np.concatenate([k for k, _ in found]), np.concatenate([d for _, d in found])


def weighted(keys: np.ndarray, docs: np.ndarray, weight: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each document with their weights: 1 (``set``) or how often they occur (``count``)."""
    pair = keys + doc_key(docs)
    if weight == "set":
        first = ~pd.Series(pair).duplicated().to_numpy()
        return keys[first], docs[first], np.ones(int(first.sum()))
    codes, unique = pd.factorize(pair)
    first = np.zeros(len(unique), np.int64)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return keys[first], docs[first], np.bincount(codes, minlength=len(unique)).astype(float)


def signatures(keys: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int, size: int) -> np.ndarray:
    """n rows of ``size`` dart names; rows of documents without weight are 0."""
    out = np.zeros((n, size), U)
    total = np.bincount(docs, weights, n)
    limit = np.divide(size * (math.log(size) + 3), total, out=np.zeros(n), where=total > 0)
    todo = total > 0
    rank, name = np.full((n, size), np.inf), np.zeros((n, size), U)
    while todo.any():
        mine = np.flatnonzero(todo[docs])
        cells = (np.ceil(weights[mine]) * np.maximum(1, np.ceil(limit[docs[mine]]))).sum()
        for part in np.array_split(mine, max(1, int(cells // CELLS))):
            _throw(keys[part], docs[part], weights[part], limit, rank, name)
        empty = todo & (rank == np.inf).any(1)
        out[todo & ~empty] = name[todo & ~empty]
        rank[empty] = np.inf
        limit[empty] *= 2
        todo = empty
    return out


def _throw(keys: np.ndarray, docs: np.ndarray, weights: np.ndarray, limit: np.ndarray, rank_of: np.ndarray, name_of: np.ndarray) -> None:
    """Throw the darts of some shingles: keeps the earliest of each document and coordinate."""
    size = rank_of.shape[1]
    wide, high = np.ceil(weights).astype(np.int64), np.maximum(1, np.ceil(limit[docs])).astype(np.int64)
    cells = wide * high
    own = np.repeat(np.arange(len(keys)), cells)
    cell = np.arange(len(own)) - np.repeat(np.cumsum(cells) - cells, cells)
    column, row = cell // high[own], cell % high[own]
    h = mix(keys[own] + mix(column.astype(U) + U(1)) + (row.astype(U) + U(1)) * BASE)
    count = np.searchsorted(DARTS, (h >> U(11)) * 2.0**-53)
    at = np.repeat(np.arange(len(own)), count)
    dart = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    name = mix(h[at] + (dart.astype(U) + U(1)) * BASE)
    rank = row[at] + (name >> U(11)) * 2.0**-53
    low = rank < limit[docs[own[at]]]
    if (wide != weights).any():
        low &= column[at] + (mix(name + U(7)) >> U(11)) * 2.0**-53 < weights[own[at]]
    at, name, rank = at[low], name[low], rank[low]
    slot = docs[own[at]] * size + (mix(name + BASE) % U(size)).astype(np.int64)
    flat, names = rank_of.reshape(-1), name_of.reshape(-1)
    np.minimum.at(flat, slot, rank)
    first = flat[slot] == rank
    names[slot[first]] = name[first]


def _digests(keys: np.ndarray, docs: np.ndarray, weights: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two words for each document that are the same for the same weighted shingles."""
    out = []
    for salt in (U(11), U(13)):
        term = mix(keys + salt) * (weights.astype(U) * U(2) - U(1))
        order = np.argsort(docs, kind="stable")
        total = np.concatenate([np.zeros(1, U), np.cumsum(term[order])])
        edge = np.searchsorted(docs[order], np.arange(n + 1))
        out.append(mix(total[edge[1:]] - total[edge[:-1]]))
    return out[0], out[1]


def _sketched(bands: int, rows: int, words: int, weight: str):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in chunks(batch.column(1)):
                keys, docs, weights = weighted(*shingles(text, words), weight)
                n = hi - lo
                sign = signatures(keys, docs, weights, n, bands * rows).reshape(n, bands, rows)
                band = np.repeat(np.arange(bands, dtype=U)[None], n, 0) * BASE
                for k in range(rows):
                    band = mix(band + sign[:, :, k])
                one, two = _digests(keys, docs, weights, n)
                count = np.bincount(docs, minlength=n)
                raw, edge = memoryview(text.data), text.offsets.tolist()
                sha = [hashlib.sha256(raw[a:b]).digest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                flat = pa.array(band.reshape(-1).view(np.int64))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, n * bands + 1, bands, dtype=np.int32)), flat)
                none = pa.array(count == 0)
                null = lambda x: pa.compute.if_else(none, pa.scalar(None, pa.int64()), pa.array(x.view(np.int64)))  # noqa: E731, B023
                yield pa.record_batch([batch.column(0)[lo:hi], pa.array(sha, pa.binary()), null(one), null(two), pa.array(count.astype(np.int64)), lists], ["doc_id", "sha", "d1", "d2", "n_shingles", "bands"])

    return sketch


def _sets(words: int, weight: str):
    """Each distinct shingle set of a task once, as sorted 8-byte hashes; with ``count``, a shingle has one for each time it occurs."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, text in chunks(batch.column(0)):
                keys, docs, weights = weighted(*shingles(text, words), weight)
                n = hi - lo
                one, two = _digests(keys, docs, weights, n)
                if weight != "set":
                    times = weights.astype(np.int64)
                    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    keys, docs = np.repeat(keys, times) + nth.astype(U) * BASE, np.repeat(docs, times)
                items = mix(keys).view(np.int64)
                order = np.lexsort((items, docs))
                edge = np.searchsorted(docs[order], np.arange(n + 1))
                fresh = (edge[1:] > edge[:-1]) & ~pd.Series(one).duplicated().to_numpy()
                use, size = np.repeat(fresh, np.diff(edge)), np.diff(edge)[fresh]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(items[order][use]))
                yield pa.record_batch([pa.array(one.view(np.int64)[fresh]), pa.array(two.view(np.int64)[fresh]), lists], ["d1", "d2", "items"])

    return sets


def components(links: DataFrame) -> DataFrame:
    """v, label for each end of ``links`` (a, b): label is the smallest end of its component."""
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    mark = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    last = mark(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(small, "u")
        after = settle(met.select("u", F.col("m").alias("v")).unionByName(met.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct(), "edges")
        drop_settled(edges)
        edges = after
        if (now := mark(edges)) == last:
            break
        last = now
    return edges.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("label"))


def _alike(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """The ``pairs`` (a, b, and what else they have) whose sets have similarity ``similar`` or more."""
    one = sets.select(F.col("rid").alias("a"), F.col("items").alias("ia"))
    two = sets.select(F.col("rid").alias("b"), F.col("items").alias("ib"))
    both = F.size(F.array_intersect("ia", "ib"))
    met = pairs.join(one, "a").join(two, "b").withColumn("both", both)
    return met.filter(F.col("both") >= (similar - 1e-9) * (F.size("ia") + F.size("ib") - F.col("both"))).select(*pairs.columns)


def _led(members: DataFrame) -> DataFrame:
    """a, b: for each member, the one that shares buckets with most of those that lead its buckets.

    The text that a group's copies come from is closer to them than they are to
    one another, and shares most. ``b`` always shares more (or as much, with a
    larger rid), so that the pairs form trees.
    """
    shares = members.groupBy("rid").agg(F.sum("size").alias("shares"))
    rows = members.join(shares, "rid").select("bucket", F.struct("shares", "rid").alias("own"))
    lead = settle(rows.groupBy("bucket").agg(F.max("own").alias("lead")), "leads")
    best = rows.join(lead, "bucket").filter("own < lead").groupBy("own.rid").agg(F.max("lead").alias("lead"))
    return best.select(F.col("rid").alias("a"), F.col("lead.rid").alias("b"))


def _roots(parents: DataFrame) -> DataFrame:
    """v, label: the root of each node of the trees ``parents`` (a, b), by pointers that double their reach."""
    up = settle(parents.select(F.col("a").alias("v"), F.col("b").alias("label")), "roots")
    while True:
        next_ = up.select(F.col("v").alias("w"), F.col("label").alias("top"))
        higher = up.join(next_, up.label == F.col("w"), "left")
        now = settle(higher.select("v", F.coalesce("top", "label").alias("label"), F.col("top").isNotNull().alias("moved")), "roots")
        drop_settled(up)
        up = now
        if not up.filter("moved").limit(1).count():
            return up.select("v", "label")


def _prefixes(sets: DataFrame, similar: float) -> DataFrame:
    """rid, label, item, class, probe, at, n: the prefixes of ``sets`` (rid, label, items) by which pairs can be found.

    Items are ordered from the rarest. Two sets of n and m items that share o
    have one of these among the first n - o + 1 of one and m - o + 1 of the
    other. Sizes are cut into classes. A set stands as ``index`` in its own,
    for sets as large or larger, and asks as ``probe`` in all classes of sets
    that are as large or smaller, each with the o that this needs. Items of one
    set only aren't kept, but have their places.
    """
    share = similar / (1 + similar)
    each = sets.select("rid", "label", F.size("items").alias("n"), F.explode("items").alias("item"))
    common = each.groupBy("item").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    kept = each.join(settle(common, "common"), "item").groupBy("rid", "label", "n").agg(F.sort_array(F.collect_list(F.struct("times", "item"))).alias("order"))
    size_class = lambda n: F.floor(F.log(n) / math.log(CLASS)).cast("int")
    need = lambda n, m: F.ceil(share * (n + m) - 1e-6)
    n = F.col("n")
    own = F.struct(size_class(n).alias("class"), F.lit(False).alias("probe"), (n - need(n, n) + 1).alias("first"))
    least = lambda c: F.greatest(F.ceil(F.pow(F.lit(CLASS), c) - 1e-6), F.ceil(similar * n - 1e-6))
    asked = F.transform(F.sequence(size_class(F.greatest(F.lit(1), F.ceil(similar * n - 1e-6))), size_class(n)), lambda c: F.struct(c.alias("class"), F.lit(True).alias("probe"), (n - need(n, least(c)) + 1).alias("first")))
    rows = kept.withColumn("part", F.explode(F.concat(F.array(own), asked)))
    lone = n - F.size("order")
    rows = rows.select("rid", "label", "n", "part.class", "part.probe", lone.alias("lone"), F.posexplode(F.slice("order", 1, F.greatest(F.lit(0), F.col("part.first") - lone).cast("int"))).alias("pos", "x"))
    return rows.select("rid", "label", "n", "class", "probe", (F.col("lone") + F.col("pos")).alias("at"), "x.item")


def _candidates(sets: DataFrame, similar: float) -> DataFrame:
    """a, b: all pairs of ``sets`` with different labels that can have similarity ``similar``, and few others."""
    prefixes = settle(_prefixes(sets, similar), "prefixes")
    per = prefixes.groupBy("item", "class", "label").agg(F.count(F.lit(1)).alias("n"))
    per = per.groupBy("item", "class").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("labels")).filter("labels > 1")
    per = settle(per.select("item", "class", F.col("most.label").alias("most")), "most")
    rows = settle(prefixes.join(per, ["item", "class"]), "met")
    drop_settled(prefixes)
    # Of a pair with two labels, one isn't the most frequent: those that have it never meet one another.
    few = rows.filter("label <> most").select("item", "class", *(F.col(c).alias(f"{c}_") for c in ("rid", "label", "n", "probe", "at")))
    share = similar / (1 + similar)
    # Rows of the first item that both have leave room for all they must share.
    room = F.least(F.col("n") - F.col("at"), F.col("n_") - F.col("at_"))
    fits = (F.col("label") != F.col("label_")) & (F.col("probe") != F.col("probe_")) & (room >= F.ceil(share * (F.col("n") + F.col("n_")) - 1e-6))
    hit = rows.join(few, ["item", "class"]).filter(fits)
    pairs = hit.select(F.least("rid", "rid_").alias("a"), F.greatest("rid", "rid_").alias("b"), F.least("label", "label_").alias("la"), F.greatest("label", "label_").alias("lb"))
    pairs = settle(pairs.distinct(), "pairs")
    drop_settled(rows)
    return pairs


def linked(members: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """v, label: components of the links of similarity ``similar`` or more within buckets; members without links may be absent.

    ``members`` has bucket, rid and the bucket's size; ``sets`` has rid, items.
    """
    trees = settle(_alike(_led(members), sets, similar), "trees")
    roots = _roots(trees)
    labelled = members.join(roots, members.rid == roots.v, "left").select("bucket", "rid", F.coalesce("label", "rid").alias("label"))
    mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi")
    open_ = labelled.join(settle(mixed.select("bucket"), "mixed"), "bucket").select("rid", "label").distinct()
    pairs = _candidates(sets.join(open_, "rid"), similar)
    links = _alike(pairs, sets, similar).select(F.col("la").alias("a"), F.col("lb").alias("b"))
    joined = components(links).withColumnsRenamed({"v": "w", "label": "top"})
    every = roots.unionByName(roots.select(F.col("label").alias("v"), "label")).unionByName(joined.select(F.col("w").alias("v"), F.col("w").alias("label"))).distinct()
    return every.join(joined, every.label == joined.w, "left").select("v", F.coalesce("top", "label").alias("label"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, words: int = WORDS, bands: int = BANDS, rows: int = ROWS, weight: str = "set") -> DataFrame:
    """doc_id, sha, class_id, class_size, n_shingles, kept, label: one row for each row of ``docs``.

    class_id is the smallest id of a class: documents joined by links of
    similarity ``similar`` or more (of shingle sets; ``weight="count"``: of
    their counts). Equal shingle sets are one class, whose number is label. Rows
    with the smallest id are kept; if all ids of a class are null, all rows are.
    Texts without words (and null) are classes of their own and kept. With 32 bands of 6, a
    pair at 0.8 shares a bucket with probability 0.99994. Other columns are not
    looked at; an empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = texts.mapInArrow(lean(_sketched(bands, rows, words, weight)), "doc_id long, sha binary, d1 long, d2 long, n_shingles long, bands array<long>")
    sketch = settle(sketch, "sketches")
    reps = sketch.filter("d1 is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"), F.first("bands").alias("bands"))
    reps = settle(reps.withColumn("rid", F.monotonically_increasing_id()), "sets")
    band = reps.select("rid", F.explode("bands").alias("bucket"))
    shared = band.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # What is joined by bucket is written first, so that a hot bucket can be split.
    members = settle(band.join(settle(shared, "shared"), "bucket"), "buckets")
    wanted = reps.join(members.select("rid").distinct(), "rid").select("d1", "d2", "rid")
    items = texts.select("text").mapInArrow(lean(_sets(words, weight)), "d1 long, d2 long, items array<long>")
    items = settle(items.join(wanted, ["d1", "d2"]).dropDuplicates(["rid"]).select("rid", "items"), "items")
    labels = linked(members, items, similar).withColumnRenamed("v", "rid")
    labelled = settle(reps.join(labels, "rid", "left").select("d1", "d2", "least", "n", F.coalesce("label", "rid").alias("label")), "labelled")
    whole = labelled.groupBy("label").agg(F.min("least").alias("class_id"), F.sum("n").alias("class_size"))
    known = labelled.join(whole, "label").select("d1", "d2", "class_id", "class_size", "label")
    out = sketch.select("doc_id", "sha", "d1", "d2", "n_shingles").join(known, ["d1", "d2"], "left")
    lone = F.col("d1").isNull()
    out = out.withColumns({"class_id": F.when(lone, F.col("doc_id")).otherwise(F.col("class_id")), "class_size": F.when(lone, F.lit(1)).otherwise(F.col("class_size")).cast("long")})
    return out.select("doc_id", "sha", "class_id", "class_size", "n_shingles", (lone | F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("kept"), "label")


def drop_near_copies(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one row of each class of :func:`classes`, all columns.

    Columns may have any names. Of rows that repeat an id and a text, one stays.
    """
    kept = classes(docs, similar=similar).filter("kept")
    empty = kept.filter("n_shingles = 0").select(F.col("doc_id").alias("kid"), F.col("sha").alias("ksha"))
    # A class whose smallest id repeats with different texts keeps the one whose digest is smallest.
    some = kept.filter("n_shingles > 0").groupBy("label").agg(F.min("class_id").alias("kid"), F.min("sha").alias("ksha")).select("kid", "ksha")
    kept = some.unionByName(empty.distinct())
    sha = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    own = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), sha.alias("sha"))
    own = own.join(kept, own.id.eqNullSafe(kept.kid) & (own.sha == kept.ksha), "left_semi")
    return own.dropDuplicates(["id", "sha"]).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "class_size", "n_shingles", "kept")


#: All pairs of texts that share a shingle, compared exactly; components by following links.
ORACLE_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, w[i : i + 4] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, w FROM w WHERE len(w) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 5 * c >= 4 * (x.n + y.n - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS to_ FROM n UNION SELECT r.doc_id, b.b FROM reach r JOIN ends b ON b.a = r.to_),
class AS (SELECT doc_id, min(to_) AS class_id, count(*) AS class_size FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(class_size, 1)::BIGINT AS class_size, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(class_id, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN class USING (doc_id)
"""
