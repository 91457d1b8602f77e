"""The bibliographic tables as views of the test tables, and the same as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, year, venue, category, citations (null for some, 0 for some), reader."""
    key = F.col("o_orderkey")
    citations = F.when(key % 7 == 0, None).when(key % 5 == 0, 0).otherwise(F.floor(F.col("o_totalprice") / 1000)).cast("long")
    return table(spark, sf_dir, "orders").select(key.alias("paper"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("category"), citations.alias("citations"), F.col("o_custkey").alias("reader"), F.col("o_orderdate").alias("published"))


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """paper, position, author, and its country and region; an author may stand twice on a paper."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").alias("position"), F.col("l_suppkey").alias("s"))
    places = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    places = places.select(F.col("s_suppkey").alias("s"), F.col("s_name").alias("author"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))
    return lines.join(places, "s").drop("s")


def credited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Papers with their authors, countries and regions as arrays, authors in order."""
    own = authorship(spark, sf_dir).groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("position", "author"))).alias("a"), F.array_sort(F.collect_set("country")).alias("countries"), F.array_sort(F.collect_set("region")).alias("regions"))
    return papers(spark, sf_dir).join(own, "paper").withColumn("authors", F.col("a.author")).drop("a")


def edges(spark: SparkSession, sf_dir: str, reach: int = 5) -> DataFrame:
    """citer, cited: of a reader's papers in order of time, each cites of the five before those that a rule on keys admits. A window over the reader's own papers, no self-join."""
    order = Window.partitionBy("reader").orderBy("published", "paper")
    before = F.array(*[F.lag("paper", k).over(order) for k in range(1, reach + 1)])
    pairs = papers(spark, sf_dir).select(F.col("paper").alias("citer"), before.alias("before")).select("citer", F.explode("before").alias("cited"))
    return pairs.where(F.col("cited").isNotNull() & ((F.col("citer") * 7 + F.col("cited")) % 3 != 0))


PAPERS = """papers AS (
    SELECT o_orderkey AS paper, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS venue, o_orderstatus AS category,
           CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 0 ELSE CAST(floor(o_totalprice / 1000) AS BIGINT) END AS citations,
           o_custkey AS reader, o_orderdate AS published FROM orders)"""
AUTHORSHIP = """authorship AS (
    SELECT l_orderkey AS paper, l_linenumber AS position, s_name AS author, n_name AS country, r_name AS region
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
EDGES = """numbered AS (SELECT paper, reader, row_number() OVER (PARTITION BY reader ORDER BY published, paper) AS r FROM papers),
edges AS (SELECT a.paper AS citer, b.paper AS cited FROM numbered a JOIN numbered b
    ON a.reader = b.reader AND b.r < a.r AND a.r - b.r <= 5 WHERE (a.paper * 7 + b.paper) % 3 <> 0)"""
ALL = f"WITH {PAPERS}, {AUTHORSHIP}, {EDGES}"
