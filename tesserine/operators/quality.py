"""Samples, checks and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(seed: int, key: str) -> Column:
    """The order of a seeded draw: by the MD5 of seed and key, so that other engines can follow it."""
    return F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary"))


def stratified(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each stratum in the order of a seeded draw, and a place in the mixed list."""
    from .rank import global_rank

    picked = rows.withColumn("__r", F.row_number().over(Window.partitionBy(by).orderBy(shuffled(seed, key), key))).where(F.col("__r") <= n).drop("__r")
    return global_rank(picked.withColumn("__o", shuffled(seed + 1, key)), [F.asc("__o"), F.asc(key)], "place").drop("__o")


def near_threshold(rows: DataFrame, eligible: Column, done: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    return rows.where(eligible).join(done, key, "left_anti").orderBy(shuffled(seed, key), key).limit(n)


def fuzzy_candidates(queries: DataFrame, targets: DataFrame, text: str, top: int = 3, least: int = 4) -> DataFrame:
    """query, target, score: shared words of ``least`` letters or more over one more than the query's words; the best ``top``.

    An inverted index as a join on words. Common words are kept: a word's targets meet a word's queries in tasks that Spark can split.
    """
    words = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^a-z0-9]+"), lambda w: F.length(w) >= least))).alias("w"))
    q, t = words(queries, "query"), words(targets, "target")
    sizes = q.groupBy("query").agg(F.count(F.lit(1)).alias("n"))
    shared = q.join(t, "w").groupBy("query", "target").agg(F.count(F.lit(1)).alias("k"))
    scored = shared.join(sizes, "query").select("query", "target", F.round(F.col("k") / (F.col("n") + 1), 6).alias("score"))
    return scored.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "target"))).where(F.col("r") <= top).drop("r")


def count_assertions(rows: DataFrame, by: str, present: Column, expected: DataFrame, min_share: float = 0.99) -> DataFrame:
    """expected: by, min_rows. Per expectation: rows, share of rows with the field, and whether both suffice; a group that is missing has none."""
    own = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg(present.cast("double")).alias("share"))
    got = expected.join(own, by, "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("share", F.round(F.coalesce("share", F.lit(0.0)), 6))
    return got.withColumn("ok", (F.col("n") >= F.col("min_rows")) & (F.col("share") >= min_share))


def drift(local: DataFrame, live: DataFrame, by: str) -> DataFrame:
    """Groups whose counts differ, on either side."""
    got = local.withColumnRenamed("n", "local").join(live.withColumnRenamed("n", "live"), by, "full_outer")
    return got.where(~F.col("local").eqNullSafe(F.col("live")))


def carried_date(now: DataFrame, before: DataFrame, key: str, today: str) -> DataFrame:
    """now: key, hash; before: key, hash, updated. The old date where the hash is the same, else today."""
    old = before.select(key, F.col("hash").alias("__h"), F.col("updated").alias("__d"))
    got = now.join(old, key, "left")
    return got.withColumn("updated", F.when(F.col("hash") == F.col("__h"), F.col("__d")).otherwise(F.lit(today))).drop("__h", "__d")


def missing_work(rows: DataFrame, missing: Column, key: str, *by: str) -> DataFrame:
    """What is still to fetch: the keys of each group, sorted."""
    return rows.where(missing).groupBy(*by).agg(F.array_sort(F.collect_set(key)).alias("keys"))


def fetch_order(cites: str, title: str) -> list[Column]:
    return [F.desc_nulls_last(cites), F.asc(title)]
