"""Incremental intake with Structured Streaming: overlapping windows, a ledger, corrections and funnel counts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import scratch_path


def latest_versions(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Of rows announced again the last one."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))).where("__r = 1").drop("__r")


class Ledger:
    """Ids that have been taken in, as a Parquet table that only grows: unlike a watermark it never forgets. A batch that is replayed after a failure
    finds its own rows under its number and writes them anew, so each id is taken once."""

    def __init__(self, spark: SparkSession, path: str, schema: str) -> None:
        self.spark, self.path, self.schema = spark, path, schema

    def rows(self) -> DataFrame:
        from ..sources.listings import read_or_empty

        return read_or_empty(self.spark, self.path, f"{self.schema}, batch long")

    def take(self, batch: DataFrame, number: int, key: str) -> DataFrame:
        """Rows of the batch whose key is new, once each; they are then in the ledger."""
        known = self.rows().where(F.col("batch") < number).select(key)
        new = batch.dropDuplicates([key]).join(known, key, "left_anti").withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(self.path)
        return self.rows().where(F.col("batch") == number).drop("batch")


def run_available(source: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Take in all that is there, from where the checkpoint stands, and end."""
    source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def stream_table(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet file or folder as a stream, with the schema that it has. A file is read as the one of its name in its folder."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    folder, _, name = path.rpartition("/")
    reader, path = reader.option("pathGlobFilter", name), folder
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def deduplicated(source: DataFrame, key: str, time: str, overlap: str = "3 days") -> DataFrame:
    """Rows once a key, for windows that overlap by so long: state older than the watermark goes, so a repeat that comes later passes. The ledger has no such end."""
    return source.withWatermark(time, overlap).dropDuplicatesWithinWatermark([key])


def windowed_counts(source: DataFrame, time: str, by: str, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """Events per window and kind; a window closes when the watermark has passed it."""
    return source.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))


def ingest(spark: SparkSession, path: str, key: str, columns: list[str], folder: str | None = None) -> DataFrame:
    """Stream a table into a ledger and return the ledger's rows: equal to a batch dedup, whatever the batches were."""
    folder = folder or scratch_path(spark, "intake")
    source = stream_table(spark, path).select(*columns)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema)
    ledger = Ledger(spark, f"{folder}/ledger", schema)
    run_available(source, lambda batch, number: ledger.take(batch, number, key), f"{folder}/checkpoint")
    return ledger.rows().drop("batch")


def kept_runs(runs: DataFrame, order: str, most: int = 24) -> DataFrame:
    """The last runs' figures."""
    return runs.orderBy(F.desc(order)).limit(most)


class PageCheckpoint:
    """Pages of an interrupted harvest, a file each beside a header, so that it goes on where it stopped. Files are written under another name first,
    and one that is torn ends what is read: it and later pages are fetched again."""

    def __init__(self, spark: SparkSession, folder: str, most_hours: float = 20) -> None:
        self.spark, self.folder, self.most_hours = spark, folder, most_hours
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(folder)
        self.system = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _write(self, name: str, value: dict) -> None:
        at, draft = (self.jvm.org.apache.hadoop.fs.Path(self.path, n) for n in (name, f".{name}.draft"))
        out = self.system.create(draft, True)
        out.write(json.dumps(value).encode())
        out.close()
        self.system.delete(at, False)
        self.system.rename(draft, at)

    def start(self, window: str, now: datetime) -> None:
        """Forget earlier pages and begin a harvest of the window."""
        self.system.delete(self.path, True)
        self._write("head.json", {"window": window, "saved": now.isoformat()})
        self.pages = 0

    def add(self, part: str, records: list[dict], token: str | None) -> None:
        """A page of one part (a set that is harvested by itself), and the token that the next page is asked with; None after the last."""
        self._write(f"page-{self.pages:08d}.json", {"page": self.pages, "part": part, "records": [json.dumps(r) for r in records], "token": token})
        self.pages += 1

    def resume(self, window: str, now: datetime) -> tuple[DataFrame, dict[str, str | None]]:
        """(records, tokens): part, page, pos and record (JSON) of the pages that can be used, and the last token of each part. Nothing if there is no
        header, it is of another window, or too old. Only tokens, one a part, come to the driver."""
        pages = self.spark.createDataFrame([], "page long, part string, records array<string>, token string")
        self.pages = 0
        if self.system.exists(self.path):
            files = self.spark.read.option("wholetext", True).text(self.folder).select("value", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"))
            head = files.where("file = 'head.json'").select(F.from_json("value", "window string, saved string").alias("h")).select("h.*").first()
            fresh = head is not None and head["window"] == window and head["saved"] and now - datetime.fromisoformat(head["saved"]) <= timedelta(hours=self.most_hours)
            if fresh:
                read = files.where("file like 'page-%'").select(F.regexp_extract("file", "([0-9]+)", 1).cast("long").alias("number"), F.from_json("value", "page long, part string, records array<string>, token string").alias("p"))
                torn = read.where("p.page is null or p.records is null").agg(F.min("number").alias("n")).first()["n"]
                pages = (read if torn is None else read.where(F.col("number") < torn)).select("p.*")
                self.pages = pages.count()
        tokens = {r["part"]: r["token"] for r in pages.groupBy("part").agg(F.max_by("token", "page").alias("token")).collect()}
        return pages.select("part", "page", F.posexplode("records").alias("pos", "record")), tokens
