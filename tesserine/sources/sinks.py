"""Writers of releases. A path is written as a whole; a version that is being read is never overwritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.keys import djb2_shard


def write_json(df: DataFrame, path: str) -> None:
    """Through Spark's commit protocol: readers see all of it or nothing."""
    df.write.mode("overwrite").json(path)


def write_shards(df: DataFrame, key: str, path: str, shards: int = 64) -> None:
    """Files by hash shard of the key, all rewritten; a reader that knows the key reads one shard."""
    sharded = df.withColumn("shard", djb2_shard(F.col(key), shards))
    sharded.repartition("shard").write.mode("overwrite").partitionBy("shard").parquet(path)


def read_shard(spark, path: str, key: str, value: str, shards: int = 64) -> DataFrame:
    """The rows of one key: the shard is a literal, so other shards aren't opened."""
    shard = spark.range(1).select(djb2_shard(F.lit(value), shards).alias("s")).first()["s"]
    return spark.read.parquet(path).where((F.col("shard") == shard) & (F.col(key) == value)).drop("shard")


def write_release(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Each table as gzipped CSV with a header; returns the counts for its description."""
    counts = {}
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").option("lineSep", "\n").csv(f"{path}/{name}")
        counts[name] = df.count()
    return counts


def release_tables(papers: DataFrame, authorship: DataFrame, countries: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """papers, authors (a row per paper and position), institutions' countries, and citations between papers of the release only."""
    ids = papers.select("paper").distinct()
    inside = edges.join(ids.withColumnRenamed("paper", "citer"), "citer", "left_semi").join(ids.withColumnRenamed("paper", "cited"), "cited", "left_semi")
    return {"papers": papers, "authors": authorship.join(ids, "paper", "left_semi"), "countries": countries, "citations": inside.select("citer", "cited")}


def slim_json(df: DataFrame, denied: list[str]) -> Column:
    """Rows as JSON without the denied fields; null fields are left out."""
    return F.to_json(F.struct(*[c for c in df.columns if c not in denied]))


def sitemap(tables: dict[str, tuple[DataFrame, str, str, int]], base: str) -> DataFrame:
    """tables: kind to (rows, name, score, most). The addresses of the highest of each kind."""
    parts = []
    for kind, (rows, name, score, most) in tables.items():
        best = rows.where(F.col(name).isNotNull()).orderBy(F.desc_nulls_last(score), name).limit(most)
        parts.append(best.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{base}/{kind}?name="), F.url_encode(F.col(name).cast("string"))).alias("url")))
    got = parts[0]
    for p in parts[1:]:
        got = got.unionByName(p)
    return got


def csv_field(c: Column) -> Column:
    """Quoted if it holds a comma, quote or line end; null is empty."""
    c = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def bibtex(rows: DataFrame, author: str, year: str, title: str, venue: str, order: str) -> DataFrame:
    """Entries with unique keys: surname, year and first word, with a number from the second of equals."""
    surname = F.lower(F.regexp_replace(F.element_at(F.split(F.col(author), " "), -1), "[^A-Za-z]", ""))
    word = F.lower(F.regexp_replace(F.split(F.col(title), " ").getItem(0), "[^A-Za-z0-9]", ""))
    rows = rows.withColumn("__k", F.concat_ws("", surname, F.col(year).cast("string"), word))
    n = F.row_number().over(Window.partitionBy("__k").orderBy(order))
    key = F.when(n == 1, F.col("__k")).otherwise(F.concat(F.col("__k"), n.cast("string")))
    rows = rows.withColumn("key", key)
    body = F.concat(F.lit("@inproceedings{"), F.col("key"), F.lit(",\n  title = {"), F.col(title), F.lit("},\n  author = {"), F.col(author), F.lit("},\n  booktitle = {"), F.col(venue), F.lit("},\n  year = {"), F.col(year).cast("string"), F.lit("}\n}"))
    return rows.select(order, "key", body.alias("entry"))


def content_hash(df: DataFrame) -> DataFrame:
    """One row: a hash of the rows' JSON that their order doesn't change. Rows are hashed one by one, and only sums of hashes meet."""
    h = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")) for k in range(5)]
    return df.agg(F.sha2(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *[F.coalesce(p, F.lit(0)).cast("string") for p in parts]), 256).alias("content_hash"))
