"""What the training-data operators share: input selection, scratch tables in the
cluster's shared folder, and exact connected components, which are those of the graph operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import star_components as components
from ..scratch import scratch_path, shared_folder, stored

__all__ = ["blobs", "bounded_batches", "components", "held_out", "quoted", "scratch_path", "shared_folder", "stored", "texts"]

#: Arrow rows handed to Python at once; whole texts travel, so the default of 10,000 is too many.
BATCH_ROWS = 1000


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the text (null: empty), so that no other column can clash."""
    return docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).alias("text"))


def blobs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As ``texts``, with the text as UTF-8 bytes in ``data``: what Python reads fastest."""
    return texts(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("data"))


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows from now on, unless the session asks for fewer."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def held_out(id_col: Column, folds: int, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` when divided by ``folds``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold
