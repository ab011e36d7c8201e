"""Secret scans with corpus-wide ownership frequency, in DataFrame operations only.

Candidates are found by pattern, their values hashed, and each hash counted by distinct repositories (doc_id)
and owners (source).  A value that many owners hold is a copied example; one that stays with few owners looks
live.  Base kinds are always reported; tokens of known services are added where their value looks live.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, table

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# A run that is too short holds no long one, so the least length can stand in the pattern for these two.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
SERVICE = (
    r"(?:gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}|[sr]k_live_[A-Za-z0-9]{16,}"
    r"|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
)
#: kind, pattern, group that holds the value, least length of the value, is it of the base
KINDS = (("assign", ASSIGN, 2, 6, True), ("access", ACCESS, 0, 20, True), ("hex", HEX, 0, 24, True), ("service", SERVICE, 0, 15, False))
#: A value that this many owners hold is a copied example.
EXAMPLE_OWNERS = 3


def _label(x: Column) -> Column:
    return F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))


def candidates(scanned: DataFrame) -> DataFrame:
    """(uid, doc_id, owner, kind, nr, start, end, value, base, fits): a row for each match of a pattern.

    Matches of a pattern and the pieces between them alternate, so running sums of their lengths give places in
    code points.
    """
    parts = None
    for nr, (kind, _, _, least, base) in enumerate(KINDS):
        one = scanned.where(F.size(kind) > 0).select("uid", "doc_id", "owner", F.lit(kind).alias("kind"), F.lit(nr).alias("nr"), F.posexplode(F.arrays_zip(F.col(kind).alias("m"), F.col(f"{kind}_value").alias("value"), F.col(f"{kind}_gap").alias("gap"))).alias("i", "x"))
        one = one.select("uid", "doc_id", "owner", "kind", "nr", "i", F.col("x.gap").cast("long").alias("gap"), F.col("x.m").cast("long").alias("m"), F.col("x.value").alias("value"), F.lit(base).alias("base"), (F.length("x.value") >= least).alias("fits"))
        parts = one if parts is None else parts.unionByName(one)
    upto = F.sum(F.col("gap") + F.col("m")).over(Window.partitionBy("uid", "nr").orderBy("i"))
    return parts.withColumn("end", upto).withColumn("start", F.col("end") - F.col("m")).drop("gap", "m", "i")


def ownership(found: DataFrame, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(hash, owners, repositories, example) for each distinct candidate value; found: (hash, owner, doc_id)."""
    one = found.select("hash", "owner", "doc_id").distinct()
    per = one.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
    per = per.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
    return per.withColumn("example", F.col("owners") >= example_owners)


def scan_secrets(docs: DataFrame, owner: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """(doc_id, spans, base_spans, n_assign, n_access, n_hex, n_live, n_example), one row for each row of docs.

    spans: array of (start, nr, kind, end, owners, repositories, example), by start, then kind.  Null texts count
    as empty; null owners are one owner, null ids one repository; repeated rows are each scanned and count as one
    repository.  Texts of any length are scanned whole; an empty table gives no rows.  Other columns of docs are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cols = [F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias(kind) for kind, pattern, *_ in KINDS]
    rows = docs.select("doc_id", F.col(owner).alias("owner"), text.alias("_text"), *cols)
    for kind, pattern, group, *_ in KINDS:
        some = F.size(kind) > 0
        value = F.when(some, F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))) if group else F.col(kind)
        rows = rows.withColumn(f"{kind}_value", value).withColumn(f"{kind}_gap", F.when(some, F.transform(F.split("_text", pattern, -1), F.length)))
    rows = rows.select("doc_id", "owner", F.monotonically_increasing_id().alias("uid"), *[c for kind, *_ in KINDS for c in (F.transform(kind, F.length).alias(kind), f"{kind}_value", F.slice(f"{kind}_gap", F.lit(1), F.size(kind)).alias(f"{kind}_gap"))])
    scanned = staged(rows, "secrets")

    found = candidates(scanned).withColumn("hash", F.struct(F.xxhash64("value").alias("a"), F.xxhash64(F.lit(1), "value").alias("b")))
    found = found.drop("value")
    classes = staged(ownership(found.where("fits"), example_owners), "secret-classes")  # written, so that the join splits widely copied values
    found = found.join(classes, "hash", "left")
    span = F.struct("start", "nr", "kind", "end", "base", "owners", "repositories", "example")
    keep = F.col("fits") & (F.col("base") | ~F.col("example"))
    found = found.groupBy("uid", "doc_id").agg(F.array_sort(F.collect_list(F.when(keep, span))).alias("spans"))
    none = scanned.where(" AND ".join(f"size({kind}) = 0" for kind, *_ in KINDS)).select("uid", "doc_id")
    none = none.withColumn("spans", F.array().cast(found.schema["spans"].dataType))
    both = found.unionByName(none)
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    live, example = F.size(F.filter("spans", lambda x: ~x["example"])).cast("long"), F.size(F.filter("spans", lambda x: x["example"])).cast("long")
    return both.select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base_spans"), of("assign"), of("access"), of("hex"), live.alias("n_live"), example.alias("n_example"))


def op7_secret_scan(spark, sf_dir):
    out = scan_secrets(table(spark, sf_dir, "documents"))
    joined = lambda c: F.array_join(F.transform(c, _label), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"), "n_live", "n_example")
