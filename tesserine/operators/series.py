"""Yearly series on dense axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import client_round, growth_rate


def dense_years(counts: DataFrame, by: list[str], year: str = "year", value: str = "n") -> DataFrame:
    """Every year from a group's first to its last, 0 where it has none."""
    span = counts.groupBy(*by).agg(F.min(year).alias("a"), F.max(year).alias("b")).select(*by, F.explode(F.sequence("a", "b")).alias(year))
    return span.join(counts, [*by, year], "left").withColumn(value, F.coalesce(value, F.lit(0)))


def yearly(papers: DataFrame, values: Column, partial_year: int, groups: list[str] | None = None, normalise: bool = False, skip_zeros: bool = False) -> DataFrame:
    """value, year, n: distinct values of papers before the partial year, on the axis of all complete years. ``normalise``: percent of the
    papers that have any value that year. ``skip_zeros``: null instead of 0."""
    many = papers.where(F.col("year") < partial_year).select("paper", "year", F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != ""))).alias("v"))
    one = many.select("year", F.explode("v").alias("value"))
    if groups:
        one = one.where(F.col("value").isin(groups))
    counts = one.groupBy("year", "value").agg(F.count(F.lit(1)).alias("k"))
    years = many.groupBy("year").agg(F.count_if(F.size("v") > 0).alias("with_value"))
    axis = counts.select("value").distinct().crossJoin(F.broadcast(years))
    n = F.coalesce(F.col("k"), F.lit(0)).cast("double")
    if normalise:
        n = F.coalesce(F.round(100 * n / F.nullif(F.col("with_value"), F.lit(0)), 6), F.lit(0.0))
    got = axis.join(counts, ["year", "value"], "left").select("value", "year", n.alias("n"))
    return got.withColumn("n", F.when(F.col("n") != 0, F.col("n"))) if skip_zeros else got


def category_shares(papers: DataFrame, partial_year: int, left_out: str) -> DataFrame:
    """Percent of *all* papers of the year in each category; one category isn't shown, but counts in the whole."""
    complete = papers.where(F.col("year") < partial_year)
    whole = complete.groupBy("year").agg(F.count(F.lit(1)).alias("whole"))
    own = complete.where(F.col("category") != left_out).groupBy("year", "category").agg(F.count(F.lit(1)).alias("n"))
    return own.join(whole, "year").select("year", "category", "n", F.round(100.0 * F.col("n") / F.col("whole"), 6).alias("percent"))


def yearly_average(papers: DataFrame) -> DataFrame:
    """Papers, citations and the average over papers with a number, by year."""
    got = papers.groupBy("year").agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations"), F.count("citations").alias("known"))
    return got.select("year", "papers", "citations", client_round(F.col("citations") / F.nullif(F.col("known"), F.lit(0))).cast("long").alias("average"))


def growth(counts: DataFrame, partial_year: int, window: int = 11) -> DataFrame:
    """One row: the compound growth over the last ``window`` complete years. counts: year, n."""
    last = counts.where(F.col("year") < partial_year).orderBy(F.desc("year")).limit(window)
    ends = last.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.min_by("n", "year").alias("a"), F.max_by("n", "year").alias("b"), F.count(F.lit(1)).alias("k"))
    return ends.select("first_year", "last_year", growth_rate(F.col("a"), F.col("b"), F.col("k") - 1).alias("growth"))


def active_years(papers: DataFrame, by: str) -> DataFrame:
    """Per group its first and last year, and the first year of the whole corpus."""
    start = papers.agg(F.min("year").alias("corpus_start"))
    return papers.groupBy(by).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")).crossJoin(F.broadcast(start))


def missing_steps(papers: DataFrame, by: str, step: int, until: int) -> DataFrame:
    """Years of a group's rhythm, every ``step`` from its first, in which it has nothing."""
    due = papers.groupBy(by).agg(F.min("year").alias("a")).where(F.col("a") <= until).select(by, F.explode(F.sequence("a", F.lit(until), F.lit(step))).alias("year"))
    return due.join(papers.select(by, "year").distinct(), [by, "year"], "left_anti")
