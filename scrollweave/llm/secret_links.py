"""Secret scans (7), native: multipart credential linking.

Three kinds of spans are certain by their form (assign, access, hex). Weak
candidates are not: a bare token (``part``) or an address (``endpoint``) is
harmless alone. They are reported only when complementary parts co-occur within
a scope of ``scope`` code points: a bare token beside an access identifier, an
address beside both an access identifier and a secret.

Scale: the patterns run in the scan; only the spans of documents that have some
leave it. Access identifiers whose scopes meet are one group: its scope is one
interval, so the intervals of a document are disjoint and a candidate meets few.
Candidates and intervals are joined by document and cell of ``CELL`` code
points, then by overlap: no pairs of spans are formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import settle

#: The kinds, as listed, with their patterns.
ASSIGN = r"""(?i:(?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: A whole run of token characters with one that isn't punctuation: not the host or path of an address, nor a name that a value is assigned to. After a dot (the later parts of a JWT) only base64url; or the user of an address.
_NAME = r"""[A-Za-z0-9_]++(?:=["']?|\x20+=\x20*["']?)[A-Za-z0-9+/_-]"""
PART = (
    rf"(?:(?<![A-Za-z0-9+/_.-])(?!(?<=:)//)(?!{_NAME})(?=[+/_-]*[A-Za-z0-9])[A-Za-z0-9+/_-]{{32,}}+"
    r"|(?<=\.)(?=[_-]*[A-Za-z0-9])[A-Za-z0-9_-]{32,}+(?![+/])"
    r"|(?<=://)[A-Za-z0-9_-]{32,}+(?=@|:[^@/\s]*@))={0,2}"
)
#: Any scheme; the bound keeps long runs of letters from being tried from each of their characters.
ENDPOINT = r"[A-Za-z][A-Za-z0-9+.-]{0,63}://[^\s\"'<>]+"
KINDS = ("assign", "access", "hex", "part", "endpoint")
SCOPE, CELL = 256, 4096


def _matches(text: Column, pattern: str, group: int | None = None) -> Column:
    """array of (gap, length, inner): characters since the match before, of the match, of its group.

    ``split`` and ``regexp_extract_all`` find the same leftmost matches that
    don't overlap, so that the lengths of what lies between give positions.
    """
    lengths = lambda c: F.transform(c, lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = whole if group is None else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.arrays_zip(lengths(F.slice(F.split(text, pattern, -1), 1, F.size(whole))).alias("gap"), lengths(whole).alias("length"), lengths(inner).alias("inner"))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, sha, kind (its number in KINDS), start, end, group, reported: one row for each span, code points, end exclusive.

    A span is in the scope of another if at most ``scope`` code points lie
    between them, whichever comes first. group numbers a document's groups of
    access identifiers whose scopes meet; a part or an endpoint that is reported
    has the one that it is linked to (of several, the first).

    Documents with the same id and text have their spans once. Null and empty
    texts have none. Also has weak candidates that aren't reported, in
    documents with an access identifier.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    none = F.lit(None).cast("array<struct<gap:int,length:int,inner:int>>")
    some = lambda k, pattern, guard, group=None: F.when(guard, F.transform(_matches(F.col("text"), pattern, group), lambda x: F.struct(x["gap"].alias("gap"), x["length"].alias("length"), x["inner"].alias("inner")))).otherwise(none).alias(f"k{k}")
    access = F.col("text").contains("AKIA") & F.col("text").rlike(ACCESS)
    flags = rows.select("doc_id", "text", F.col("text").rlike(ASSIGN).alias("a"), access.alias("b"), F.col("text").rlike("[0-9a-f]{24}").alias("c")).filter("a or b or c")
    found = flags.select(
        "doc_id",
        F.sha2(F.col("text").cast("binary"), 256).alias("sha"),
        some(0, ASSIGN, F.col("a"), 1),
        some(1, ACCESS, F.col("b")),
        some(2, HEX, F.col("c")),
        some(3, PART, F.col("b") & F.col("text").rlike("[A-Za-z0-9+/_-]{32}")),
        some(4, ENDPOINT, F.col("b") & F.col("text").contains("://")),
    ).dropDuplicates(["doc_id", "sha"])
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"k{k}").alias("found")) for k in range(len(KINDS))))
    each = found.select("doc_id", "sha", F.explode(kinds).alias("k")).select("doc_id", "sha", "k.kind", F.posexplode("k.found").alias("i", "m"))
    so_far = Window.partitionBy("doc_id", "sha", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.length")).over(so_far)).withColumn("start", F.col("end") - F.col("m.length"))
    each = each.filter("kind > 0 or m.inner >= 6").select("doc_id", "sha", "kind", "start", "end")
    each = settle(each, "spans")
    # A weak candidate that overlaps a certain span is that span.
    base = F.col("kind") < 3
    doc = Window.partitionBy("doc_id", "sha")
    left, right = doc.orderBy("start").rangeBetween(Window.unboundedPreceding, 0), doc.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, 0)
    inside = (F.max(F.when(base, F.col("end"))).over(left) > F.col("start")) | (F.min(F.when(base, F.col("start"))).over(right) < F.col("end"))
    certain, weak = each.filter(base), each.withColumn("inside", F.coalesce(inside, F.lit(False))).filter(~base & ~F.col("inside")).drop("inside")
    ids = _scopes(certain.filter("kind = 1"), scope)
    weak = settle(_within(weak, ids), "weak")
    parts = weak.filter("kind = 3")
    ends = _within(weak.filter("kind = 4"), _scopes(certain.filter("kind <> 1").unionByName(parts.filter("group is not null").drop("group")), scope), "beside")
    ends = ends.withColumn("group", F.when(F.col("beside").isNotNull(), F.col("group"))).drop("beside")
    own = _within(certain.filter("kind = 1"), ids)
    sure = certain.filter("kind <> 1").withColumn("group", F.lit(None).cast("long")).unionByName(own)
    return sure.withColumn("reported", F.lit(True)).unionByName(parts.unionByName(ends).withColumn("reported", F.col("group").isNotNull()))


def _scopes(spans: DataFrame, scope: int) -> DataFrame:
    """d, s, group, lo, hi: the disjoint intervals that ``spans``, each with ``scope`` code points around it, cover; group is the number in the document."""
    each = spans.select(F.col("doc_id").alias("d"), F.col("sha").alias("s"), (F.col("start") - scope).alias("lo"), (F.col("end") + scope).alias("hi"))
    order = Window.partitionBy("d", "s").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    each = each.withColumn("new", F.coalesce((F.col("lo") > before), F.lit(True)).cast("long"))
    each = each.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return each.groupBy("d", "s", "group").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _within(spans: DataFrame, scopes: DataFrame, name: str = "group") -> DataFrame:
    """Add ``name``: the group of the first of ``scopes`` that each span touches, or null. An interval join by cells."""
    cells = lambda lo, hi: F.explode(F.expr(f"sequence(greatest({lo}, 0) div {CELL}, greatest({hi}, 0) div {CELL})")).alias("cell")
    one = spans.select("doc_id", "sha", "kind", "start", "end", cells("start", "end"))
    two = scopes.select("d", "s", F.col("group").alias("g"), "lo", "hi", cells("lo", "hi").alias("c"))
    met = one.join(two, one.doc_id.eqNullSafe(two.d) & (one.sha == two.s) & (one.cell == two.c) & (one.start <= two.hi) & (one.end >= two.lo))
    met = met.groupBy(*(F.col(c).alias(f"_{c}") for c in ("doc_id", "sha", "kind", "start", "end"))).agg(F.min("g").alias(name))
    same = spans.doc_id.eqNullSafe(met._doc_id) & (spans.sha == met._sha) & (spans.kind == met._kind) & (spans.start == met._start) & (spans.end == met._end)
    return spans.join(met, same, "left").drop(*(f"_{c}" for c in ("doc_id", "sha", "kind", "start", "end")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_weak, links: one row for each row of ``docs``.

    Spans are ``kind:start:end`` by start and then kind as listed. A text
    without spans (or null) has the digest of the empty string. links has
    ``group:kind:start:end`` of access identifiers and what is linked to them.
    Ids may be null or repeat; other columns are not looked at; an empty table
    gives an empty result.
    """
    each = spans(docs, id_col, text_col, scope).filter("reported")
    name = F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1)
    each = each.withColumn("span", F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("said"), "group"))
    said = lambda cond, say=lambda x: x["said"]: F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.when(cond, F.col("span")))), say))
    count = lambda k: F.count(F.when(F.col("kind") == k, 1))
    got = each.groupBy(F.col("doc_id").alias("_id"), F.col("sha").alias("_sha")).agg(count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.count(F.when(F.col("kind") > 2, 1)).alias("n_weak"), said(F.col("kind") < 3).alias("base"), said(F.lit(True)).alias("spans"), said(F.col("group").isNotNull(), lambda x: F.concat_ws(":", x["group"], x["said"])).alias("links"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text.cast("binary"), 256).alias("sha"))
    out = rows.join(got, rows.doc_id.eqNullSafe(got._id) & (rows.sha == got._sha), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", zero("n_assign"), zero("n_access"), zero("n_hex"), F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), zero("n_weak"), F.coalesce("links", F.lit("")).alias("links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
