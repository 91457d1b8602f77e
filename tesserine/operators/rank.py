"""Ranks, top lists and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import significant_words
from ..scratch import stored


def tied_rank(rows: DataFrame, score: str, by: list[str]) -> DataFrame:
    """Competition rank within ``by``, and rank_to, the last rank of those tied, null without a tie. Nulls have no rank.

    Ranks need only the counts of equal scores, so the window runs over distinct scores, however many rows a group has.
    """
    counts = rows.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.count(F.lit(1)).alias("same"))
    if by:
        above = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("above", F.coalesce(F.sum("same").over(above), F.lit(0)))
    else:
        counts = running_total(counts, [F.desc(score)], "same", "above")
    ranks = counts.select(*by, score, (F.col("above") + 1).alias("rank"), F.when(F.col("same") > 1, F.col("above") + F.col("same")).alias("rank_to"))
    return rows.join(ranks, [*by, score])


def running_total(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over all rows before in a total order, without gathering all rows in one task.

    Rows are partitioned by ranges of the order and stored, as a second partitioning might fall differently; each partition's sum (a row
    each) is added up, then each partition runs on its own.
    """
    ranged = stored(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    sums = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))
    base = sums.select("__part", F.coalesce(F.sum("__s").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("__in", inside).join(F.broadcast(base), "__part").withColumn(name, F.col("__base") + F.col("__in")).drop("__part", "__base", "__in")


def global_rank(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Row number from 1 over all rows in a total order."""
    counted = running_total(rows.withColumn("__one", F.lit(1).cast("long")), order, "__one", name)
    return counted.withColumn(name, F.col(name) + 1).drop("__one")


def top(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """A top list: the order must be total."""
    return rows.orderBy(*order).limit(n)


def top_by_average(rows: DataFrame, who: str, floor: int, n: int, excluded: DataFrame | None = None) -> DataFrame:
    """Those with *more* than ``floor`` papers, by exact average, shown rounded."""
    got = rows.where(F.col("papers") > floor)
    if excluded is not None:
        got = got.join(excluded, who, "left_anti")
    average = F.col("citations") / F.col("papers")
    return got.orderBy(F.desc(average), who).limit(n).select(who, "papers", "citations", F.bround(average, 1).alias("average"))


def top_per_group(rows: DataFrame, by: str, order: list[Column], n: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col(name) <= n)


def entity_ranks(rows: DataFrame, who: str, metrics: list[str], excluded: DataFrame | None = None) -> DataFrame:
    """List positions by each metric, highest first and null last, ties by name."""
    if excluded is not None:
        rows = rows.join(excluded, who, "left_anti")
    for m in metrics:
        rows = global_rank(rows, [F.desc_nulls_last(m), F.asc(who)], f"{m}_rank")
    return rows.select(who, *[f"{m}_rank" for m in metrics])


def page(rows: DataFrame, order: list[Column], number: int, size: int, sizes: tuple[int, ...] = (25, 50, 100)) -> DataFrame:
    """One page of an ordered list. A size that isn't offered becomes the first; a page beyond the ends becomes the nearest."""
    size = size if size in sizes else sizes[0]
    n = rows.count()
    number = max(1, min(number, -(-n // size) or 1))
    return rows.orderBy(*order).offset((number - 1) * size).limit(size)


def page_label(number: int, size: int, n: int) -> str:
    first = min(n, (number - 1) * size + 1)
    return f"{first} to {min(n, number * size)} of {n}"


def chart_groups(rows: DataFrame, by: str, n: int, forced: str | None = None) -> DataFrame:
    """The ``n`` largest groups; a forced one that isn't among them takes the last place."""
    ranked = global_rank(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")), [F.desc("n"), F.asc(by)], "place")
    if forced is None:
        return ranked.where(F.col("place") <= n)
    at = ranked.agg(F.max(F.when(F.col(by) == forced, F.col("place"))).alias("at"))
    return ranked.crossJoin(F.broadcast(at)).where(F.when(F.coalesce(F.col("at"), F.lit(0)) > n, (F.col("place") < n) | (F.col(by) == forced)).otherwise(F.col("place") <= n)).drop("at")


def latest(rows: DataFrame, who: str, value: str) -> DataFrame:
    """The value with the latest dated span; undated ones only if nothing else; the smallest value of equals."""
    key = F.struct(F.col("last_year").isNotNull(), F.coalesce("last_year", F.lit(0)), F.coalesce("first_year", F.lit(0)))
    best = rows.withColumn("k", key).withColumn("r", F.row_number().over(Window.partitionBy(who).orderBy(F.desc("k"), value)))
    return best.where("r = 1").select(who, value)


def quotas(sizes: dict[str, int], n: int) -> dict[str, int]:
    """``n`` places dealt evenly to groups; what a small group can't use goes to the others, in the order of their names."""
    dealt, left, open_ = dict.fromkeys(sizes, 0), min(n, sum(sizes.values())), sorted(sizes)
    while left:
        open_ = [g for g in open_ if dealt[g] < sizes[g]]
        each = max(1, left // len(open_))
        for g in open_:
            take = min(each, sizes[g] - dealt[g], left)
            dealt[g] += take
            left -= take
    return dealt


def interleaved(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """A sample of ``n`` with even quotas per group, best first, groups taking turns. Sizes of groups go to the driver: a row each."""
    sizes = {r[by]: r["n"] for r in rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).collect()}
    due = rows.sparkSession.createDataFrame(list(quotas(sizes, n).items()), f"{by} string, quota long")
    ranked = rows.withColumn("turn", F.row_number().over(Window.partitionBy(by).orderBy(*order)))
    # the constant bound reaches the window as a group limit
    return ranked.where(F.col("turn") <= n).join(F.broadcast(due), by).where(F.col("turn") <= F.col("quota")).drop("quota").orderBy("turn", by)


def shortlist(rows: DataFrame, name: str, words: list[str], n: int = 40, generic: tuple[str, ...] = ()) -> DataFrame:
    """The ``n`` names that share most significant words with a text, then by name; names that share none aren't candidates."""
    shared = F.size(F.array_intersect(significant_words(F.col(name), generic), F.array(*[F.lit(w.lower()) for w in words]).cast("array<string>"))) if words else F.lit(0)
    return rows.select(name, shared.alias("shared")).where("shared > 0").orderBy(F.desc("shared"), name).limit(n)


def both_sets(sets: list[DataFrame], order: list[Column], n: int = 50) -> DataFrame:
    """The top list of several sets together, made anew from all their rows; a column that a set lacks is null there."""
    whole = sets[0]
    for s in sets[1:]:
        whole = whole.unionByName(s, allowMissingColumns=True)
    return top(whole, order, n)
