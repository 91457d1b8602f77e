"""Aggregation over dimensions that may hold several values, with floors that keep thin figures out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import client_round, server_round, share


def by_dimension(papers: DataFrame, values: Column, citations: Column, min_papers: int = 0, min_cited: int = 0, min_cited_for_average: int = 0, name: str = "value") -> DataFrame:
    """Per value: papers, citations, cited_papers, average and h-index.

    ``values`` is an array or a plain column; a paper counts once for each distinct value that is neither null nor empty. Kept are values
    with *more* than ``min_papers`` papers and at least ``min_cited`` cited ones. The average is over papers with a known number
    and null below ``min_cited_for_average`` cited papers; the h-index is over cited papers.
    """
    kind = papers.select(values.alias("v")).schema["v"].dataType.simpleString()
    many = values if kind.startswith("array") else F.array(values)
    one = papers.select(F.explode(F.array_distinct(many)).alias(name), citations.alias("c")).where(F.col(name).isNotNull() & (F.col(name).cast("string") != ""))
    # a row for each number of citations: what a hot value gathers in a task are distinct numbers, not papers
    counts = one.groupBy(name, "c").agg(F.count(F.lit(1)).alias("n"))
    as_many = Window.partitionBy(name).orderBy(F.desc_nulls_last("c")).rowsBetween(Window.unboundedPreceding, 0)
    counts = counts.withColumn("at_least", F.sum("n").over(as_many))
    cited = F.col("c") > 0
    rows = counts.groupBy(name).agg(
        F.sum("n").alias("papers"), F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)).alias("citations"), F.coalesce(F.sum(F.when(cited, F.col("n"))), F.lit(0)).alias("cited_papers"),
        F.sum(F.when(F.col("c").isNotNull(), F.col("n"))).alias("known"), F.coalesce(F.max(F.when(cited, F.least("c", "at_least"))), F.lit(0)).cast("long").alias("h_index"))
    rows = rows.where((F.col("papers") > min_papers) & (F.col("cited_papers") >= min_cited))
    average = F.when(F.col("cited_papers") >= max(1, min_cited_for_average), client_round(F.col("citations") / F.col("known")).cast("long"))
    return rows.withColumn("average", average).drop("known")


def totals_per_row(authorship: DataFrame, papers: DataFrame, who: str) -> DataFrame:
    """Papers and citations, credited for each row of the authorship: an author named twice on a paper gets it twice."""
    return authorship.join(papers.select("paper", "citations"), "paper").groupBy(who).agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations"))


def totals_per_paper(authorship: DataFrame, papers: DataFrame, who: str) -> DataFrame:
    """As totals_per_row, but once a paper."""
    return totals_per_row(authorship.select("paper", who).distinct(), papers, who)


def spans(authorship: DataFrame, papers: DataFrame, *by: str) -> DataFrame:
    """Per combination: distinct papers, their citations, first and last year."""
    own = authorship.select("paper", *by).distinct().join(papers.select("paper", "year", "citations"), "paper")
    return own.groupBy(*by).agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))


def flagged_share(rows: DataFrame, by: str, flag: Column, min_rows: int = 0, digits: int = 1) -> DataFrame:
    """Per group: n, flagged, percent; groups of at least ``min_rows``."""
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(flag).alias("flagged"))
    return got.where(F.col("n") >= min_rows).withColumn("percent", share(F.col("flagged"), F.col("n"), digits))


def coverage(rows: DataFrame, by: str, present: Column, year: str, min_rows: int) -> DataFrame:
    """Per group: n, its years in order, and whether all, none or some rows have the field."""
    got = rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(present).alias("k"), F.array_sort(F.collect_set(year)).alias("years"))
    return got.where(F.col("n") >= min_rows).select(by, "n", F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"), F.when(F.col("k") == F.col("n"), "full").when(F.col("k") == 0, "none").otherwise("partial").alias("coverage"))


def best_per_group(rows: DataFrame, by: str, score: str, tie: str) -> DataFrame:
    """The row with the highest score of each group, the smallest ``tie`` of equals; nulls are no scores."""
    return rows.where(F.col(score).isNotNull()).groupBy(by).agg(F.max_by(F.struct(score, tie), F.struct(F.col(score), -F.col(tie))).alias("x")).select(by, f"x.{score}", f"x.{tie}")


def concentration(rows: DataFrame, value: str, tie: str, shares: tuple[float, ...] = (0.01, 0.1)) -> DataFrame:
    """For each share of the rows with a positive value, the percent of all value that the highest hold. At least one row counts as a share; halves go to even.

    Ranks come from a range-partitioned running count rather than from one task: see rank.global_rank.
    """
    from .rank import global_rank

    cited = rows.where(F.col(value) > 0).select(F.col(value).cast("double").alias("v"), F.col(tie).alias("t"))
    total = cited.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("s"))
    tops = total.select("n", "s", F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")).withColumn("top", F.greatest(F.lit(1), F.bround(F.col("n") * F.col("share"))).cast("long"))
    ranked = global_rank(cited, [F.desc("v"), F.asc("t")], "r")
    held = ranked.join(F.broadcast(tops), F.col("r") <= F.col("top")).groupBy("share").agg(F.sum("v").alias("h"), F.first("s").alias("s"), F.first("n").alias("cited"))
    return held.select("share", "cited", server_round(100 * F.col("h") / F.col("s"), 1).alias("percent"))


def influential_threshold(rows: DataFrame, value: str, by: str | None = None, quantile: float = 0.9, floor: int = 2, least: int = 10) -> DataFrame:
    """The exact quantile of the positive values, interpolated, cut to an integer, ``floor`` at least; ``floor`` for under ``least`` values."""
    grouped = rows.where(F.col(value) > 0).groupBy(*([by] if by else []))
    got = grouped.agg(F.count(F.lit(1)).alias("n"), F.percentile(F.col(value), quantile).alias("q"))
    threshold = F.when(F.col("n") < least, floor).otherwise(F.greatest(F.lit(floor), F.floor(F.col("q") + 1e-9)))
    return got.select(*([by] if by else []), "n", threshold.cast("long").alias("threshold"))


def quartiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """Exact, interpolated."""
    got = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.percentile(F.col(value), [0.25, 0.5, 0.75]).alias("q"))
    return got.select(by, *[F.round(F.col("q")[k], 6).alias(f"q{k + 1}") for k in range(3)])


def clamped_histogram(rows: DataFrame, value: str, most: int) -> DataFrame:
    """Counts of 0 to ``most``, larger values in the last, empty ones as 0."""
    axis = rows.sparkSession.range(most + 1).withColumnRenamed("id", "bin")
    counts = rows.groupBy(F.least(F.col(value).cast("long"), F.lit(most)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return axis.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def lifetimes(authorship: DataFrame, papers: DataFrame, who: str, influential: int) -> DataFrame:
    """Per author: first and last year, papers, citations, cited and influential papers."""
    own = authorship.select("paper", who).distinct().join(papers, "paper")
    return own.groupBy(who).agg(
        F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("citations"), F.lit(0)).alias("citations"),
        F.count_if(F.col("citations") > 0).alias("cited_papers"), F.count_if(F.col("citations") >= influential).alias("influential"))


def promising(lives: DataFrame, who: str, last_complete_year: int, most_years: int, min_papers: int, min_influential: int, n: int, conflicted: DataFrame | None = None) -> DataFrame:
    """Young, active in the last complete year and influential: by influential papers, then average, then name."""
    span = F.col("last_year") - F.col("first_year")
    got = lives.where((span <= most_years) & (F.col("papers") >= min_papers) & (F.col("influential") >= min_influential) & (F.col("last_year") >= last_complete_year))
    if conflicted is not None:
        got = got.join(conflicted, who, "left_anti")
    return got.withColumn("average", F.col("citations") / F.col("papers")).orderBy(F.desc("influential"), F.desc("average"), who).limit(n).select(who, "papers", "influential", F.round("average", 6).alias("average"))


def topic_shares(rows: DataFrame, subject: str, topic: str, subjects: list[str], top: int = 6) -> DataFrame:
    """Topics in rows and subjects in columns, in percent of the subject's rows: the union of each subject's ``top`` topics, by the sum of their shares."""
    counts = rows.where(F.col(subject).isin(subjects) & F.col(topic).isNotNull()).groupBy(subject, topic).agg(F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy(subject).orderBy(F.desc("n"), topic))).withColumn("p", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(subject)))
    chosen = ranked.where(F.col("r") <= top).select(topic).distinct()
    wide = ranked.join(chosen, topic, "left_semi").groupBy(topic).pivot(subject, subjects).agg(F.round(F.first("p"), 6))
    wide = wide.na.fill(0.0, subjects)
    return wide.withColumn("total", F.round(sum((F.col(f"`{s}`") for s in subjects), F.lit(0.0)), 6))


def field_coverage(rows: DataFrame, fields: dict[str, Column]) -> DataFrame:
    """Percent of rows with each field, rounded to integers, as rows (field, percent)."""
    one = rows.agg(*[client_round(100.0 * F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0))).cast("long").alias(name) for name, ok in fields.items()])
    return one.unpivot([], list(fields), "field", "percent")


def career(rows: DataFrame, who: str, citations: str, self_citations: str, year: str) -> DataFrame:
    """Span of years and percent of self-citations, null without citations."""
    got = rows.groupBy(who).agg(F.sum(citations).alias("c"), F.sum(self_citations).alias("s"), (F.max(year) - F.min(year)).cast("long").alias("span"))
    return got.select(who, "span", client_round(100.0 * F.coalesce("s", F.lit(0)) / F.nullif(F.col("c").cast("double"), F.lit(0.0))).cast("long").alias("self_percent"))


def with_total_row(page: DataFrame, label: str, sums: list[str]) -> DataFrame:
    """The shown rows and one more that sums the integer columns."""
    total = page.agg(*[F.sum(c).cast(page.schema[c].dataType).alias(c) for c in sums]).withColumn(label, F.lit("Total"))
    return page.unionByName(total, allowMissingColumns=True)


def gate_metrics(rows: DataFrame, metrics: dict[str, Column]) -> DataFrame:
    """Aggregates as rows (metric, value)."""
    return rows.agg(*[m.cast("long").alias(name) for name, m in metrics.items()]).unpivot([], list(metrics), "metric", "value")


def gate(new: DataFrame, old: DataFrame, drop: float = 0.03) -> DataFrame:
    """Metrics that both sides have, their relative change, and whether they fell by more than ``drop``."""
    both = new.join(old.withColumnRenamed("value", "before"), "metric")
    change = (F.col("value") - F.col("before")) / F.nullif(F.col("before").cast("double"), F.lit(0.0))
    return both.withColumn("change", F.round(change, 6)).withColumn("bad", F.coalesce(F.col("change") < -drop, F.lit(False)))


def passed(gated: DataFrame) -> DataFrame:
    """The same rows; the query fails if a metric is bad."""
    message = F.concat(F.lit("fell too far: "), F.col("metric"))
    return gated.withColumn("bad", F.when(F.col("bad"), F.raise_error(message).cast("boolean")).otherwise(F.lit(False)))


def big_groups(rows: DataFrame, by: str, over: int) -> DataFrame:
    """Groups of *more* than ``over`` rows, largest first."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > over).orderBy(F.desc("n"), by)


def corpus_totals(papers: DataFrame, authorship: DataFrame, stages: dict[str, Column], source: str = "source") -> DataFrame:
    """Rows (figure, n): papers, distinct authors and institutions, papers at each stage of the pipeline (a condition by name), and papers by source."""
    named = papers.agg(F.count(F.lit(1)).alias("papers"), *[F.count_if(c).alias(f"stage {n}") for n, c in stages.items()])
    people = authorship.agg(F.countDistinct("author").alias("authors"), F.countDistinct("institution").alias("institutions"))
    sources = papers.groupBy(F.concat(F.lit("source "), F.coalesce(F.col(source), F.lit("venue_listing"))).alias("figure")).agg(F.count(F.lit(1)).alias("n"))
    one = named.unpivot([], named.columns, "figure", "n").unionByName(people.unpivot([], people.columns, "figure", "n"))
    return one.unionByName(sources)


def source_mix(papers: DataFrame, kinds: dict[str, list[str]], source: str = "source", default: str = "venue_listing") -> DataFrame:
    """Per kind of source (each a list of sources): papers, and their percent of all, rounded to a tenth."""
    own = F.coalesce(F.col(source), F.lit(default))
    one = papers.agg(F.count(F.lit(1)).alias("__all"), *[F.count_if(own.isin(s)).alias(k) for k, s in kinds.items()])
    return one.unpivot(["__all"], list(kinds), "kind", "n").select("kind", "n", share(F.col("n"), F.col("__all"), 1).alias("percent"))


def marked_thin(rows: DataFrame, least: int = 5, cited: str = "cited_papers") -> DataFrame:
    """Whether an average rests on fewer cited papers than ``least``; the average itself stays."""
    return rows.withColumn("thin", F.col(cited) < least)


def next_baseline(gated: DataFrame) -> DataFrame:
    """The figures that the next build is compared with: the new ones if none is bad, else the old ones, so that a drop isn't forgotten. gated: as ``gate`` gives it."""
    any_bad = gated.agg(F.coalesce(F.max("bad"), F.lit(False)).alias("__bad"))
    return gated.crossJoin(F.broadcast(any_bad)).select("metric", F.when(F.col("__bad"), F.col("before")).otherwise(F.col("value")).alias("value"))
