"""Exact deduplication: 128-bit content hashes find the groups, a comparison of bytes confirms them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, texts

#: Values of the hash bucket: the most rows that are ever broadcast.
BUCKETS = 1 << 20


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", content_hash: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Rows with byte-identical text form a group; the row with the smallest (``keep="min"``) or largest
    (``"max"``) id stays. Hashes alone never join two rows: in each group of equal hashes all texts are
    compared with one of them, and rows that differ are grouped by their bytes.

    Most texts are unique, so whole texts should not be shuffled for them. A first pass over hashes finds
    the hash buckets that hold any repeated hash, at most BUCKETS rows, which are broadcast; rows in other
    buckets are single and done. Only the rest moves, pre-aggregated to one text a hash and task.

    Null text counts as empty; a null id sorts below all others and is an id like any other. Rows repeated with the
    same id and text count in group_size, and kept is true for each of them. An empty table gives no rows.
    """
    if keep not in ("min", "max"):
        raise ValueError(f"keep must be min or max, not {keep!r}")
    pick = F.min if keep == "min" else F.max
    text = F.col("text")
    base = texts(docs, id_col, text_col).withColumn("h", content_hash(text)).withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(BUCKETS)))
    sha = F.sha2(text.cast("binary"), 256).alias("text_sha256")
    repeated = base.groupBy("h", "bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket").distinct()

    single = base.join(F.broadcast(repeated), "bucket", "left_anti").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)

    rows = base.join(F.broadcast(repeated), "bucket", "left_semi").select("doc_id", "h", "text", sha)
    # a table of its own, so that the joins that follow can split a hot hash
    one = stored(rows.groupBy("h").agg(F.max("text").alias("first_text")), "exact")
    checked = stored(rows.join(one, "h").select("doc_id", "h", "text_sha256", F.when(text != F.col("first_text"), text).alias("other")), "exact")
    groups = checked.groupBy("h", "other").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = stored(groups.withColumnsRenamed({"h": "gh", "other": "gother"}), "exact")
    several = checked.join(groups, (F.col("h") == F.col("gh")) & F.col("other").eqNullSafe(F.col("gother"))).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    return single.unionByName(several)
