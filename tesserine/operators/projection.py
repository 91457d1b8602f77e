"""The record of a paper that is published."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import plain_key
from ..functions.text import has_code, short_name
from .merge import optional_link

#: Columns that a record has; those that its input lacks are null.
PLAIN = ("title", "year", "venue", "citations_by_source", "citations", "citations_updated", "category", "relevance", "doi", "countries", "institutions", "authors", "arxiv_url", "source_url", "venue_status")


def code_known(verdict: Column, stored: Column, abstract: Column) -> Column:
    """Whether code is available: by a verdict of yes or no, else as stored; an abstract can only say yes, and silence isn't no."""
    said = F.when(verdict.isin("yes", "no"), verdict == "yes")
    return F.coalesce(said, stored, F.when(has_code(abstract), F.lit(True)))


def publishable(papers: DataFrame, links: DataFrame | None = None, verdicts: DataFrame | None = None) -> DataFrame:
    """The columns that are shown of a paper, defaults filled in; the abstract isn't among them. links: title, link; verdicts: title, verdict."""
    have = set(papers.columns)
    column = lambda c, kind="string": F.col(c) if c in have else F.lit(None).cast(kind)
    rows = papers.withColumn("__key", plain_key(F.col("title")))
    if verdicts is not None:
        rows = rows.join(verdicts.groupBy(plain_key(F.col("title")).alias("__key")).agg(F.min("verdict").alias("__verdict")), "__key", "left")
    verdict = F.col("__verdict") if verdicts is not None else F.lit(None).cast("string")
    got = rows.select(
        *[column(c).alias(c) for c in PLAIN], short_name(F.col("title")).alias("short_name"), F.coalesce(column("source"), F.lit("venue_listing")).alias("source"),
        F.coalesce(column("author_verification"), F.lit("no_reference_record")).alias("author_verification"), code_known(verdict, column("has_code", "boolean"), column("abstract")).alias("has_code"))
    return got if links is None else optional_link(got, links)
