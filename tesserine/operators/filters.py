"""Predicates of the query pages; each is a Column, so that it reaches the scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import words_match


def complete(title: str = "title", year: str = "year") -> Column:
    return (F.length(F.trim(F.col(title))) > 0) & F.col(year).isNotNull()


def dimensions(category: str | None = None, venue: str | None = None, year: str | None = None, min_citations: int | None = None, country: str | None = None, institution: str | None = None, author: str | None = None, big_venues: list[str] | None = None) -> Column:
    """All that are given. The venue "Other" is any known venue that isn't big; years compare as text; lists must contain the value."""
    got = F.lit(True)
    if category:
        got = got & (F.col("category") == category)
    if venue == "Other":
        got = got & F.col("venue").isNotNull() & ~F.col("venue").isin(big_venues or [])
    elif venue:
        got = got & (F.col("venue") == venue)
    if year:
        got = got & (F.col("year").cast("string") == year)
    if min_citations is not None:
        got = got & (F.col("citations") >= min_citations)
    for name, value in (("countries", country), ("institutions", institution), ("authors", author)):
        if value:
            got = got & F.array_contains(name, value)
    return got


def search(query: str, title: str, institutions: str | None = None) -> Column:
    """All words in the title, or all in one institution."""
    got = words_match(F.col(title), query)
    return got | F.exists(institutions, lambda i: words_match(i, query)) if institutions else got


def floor_unless(query: str, floor: int) -> int:
    """A reliability floor doesn't hold while a query is active."""
    return 0 if query.strip() else floor


def seed_venues(papers: DataFrame, least: int) -> DataFrame:
    """Papers of venues with at least so many papers."""
    seeds = papers.groupBy("venue").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("venue")
    return papers.join(seeds, "venue", "left_semi")


def not_mismatched(c: str = "author_verification") -> Column:
    return ~F.col(c).eqNullSafe("mismatch")


def new_submission(id_month: Column, created: Column, floor: Column) -> Column:
    """The id's month is after the floor's, or the same and the record isn't older than the floor."""
    month = F.trunc(floor, "month")
    return (id_month > month) | ((id_month == month) & (created >= floor))


def renamed_venue(rows: DataFrame, names: dict[str, str], unknown: list[str], placeholder: str = "Unknown") -> DataFrame:
    """Venues renamed by the table, the old name kept in venue_raw; unknown ones become a placeholder and are marked missing."""
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv]) if names else None
    new = table[F.col("venue")] if names else F.lit(None).cast("string")
    lost = F.col("venue").isin(unknown) if unknown else F.lit(False)
    changed = new.isNotNull() | lost
    return rows.withColumn("venue_raw", F.when(changed, F.col("venue"))).withColumn("venue_status", F.when(lost, "missing")).withColumn("venue", F.when(lost, F.lit(placeholder)).otherwise(F.coalesce(new, F.col("venue"))))


def redundant(rows: DataFrame, field: str, implied: Column) -> DataFrame:
    """A field is null where it equals what is implied anyway."""
    return rows.withColumn(field, F.when(~F.col(field).eqNullSafe(implied), F.col(field)))


def known_or_all(rows: DataFrame, known: Column, by: str) -> DataFrame:
    """Per group the known rows if there are any, else all."""
    some = rows.groupBy(by).agg(F.max(known).alias("__any"))
    return rows.join(some, by).where(~F.col("__any") | known).drop("__any")


def params(url: Column) -> Column:
    """The query of an address as a map, decoded."""
    raw = F.str_to_map(F.coalesce(F.parse_url(url, F.lit("QUERY")), F.lit("")), F.lit("&"), F.lit("="))
    return F.map_filter(F.transform_values(raw, lambda k, v: F.url_decode(v)), lambda k, v: k != "")


def with_param(url: Column, name: str, value: str) -> Column:
    """The address with the parameter set: in place if it has it, else at the end."""
    own = rf"([?&]){name}=[^&#]*"
    pair = F.concat(F.lit(f"{name}="), F.url_encode(F.lit(value)))
    replaced = F.regexp_replace(url, F.lit(own), F.concat(F.lit("$1"), pair))
    return F.when(url.rlike(own), replaced).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), pair))


def relevance_view(papers: DataFrame, view: str, relevance: str = "relevance", yes: str = "AV", no: str = "non-AV") -> DataFrame:
    """The papers of one relevance, or with "both" those of either; papers with neither, or none, are in no view."""
    wanted = {yes: [yes], no: [no], "both": [yes, no]}
    if view not in wanted:
        raise ValueError(f"no view {view}: {yes}, {no} or both")
    return papers.where(F.col(relevance).isin(wanted[view]))


def author_view(rows: DataFrame, who: str = "author", regions: DataFrame | None = None, region: str | None = None, span: str = "span", min_span: int = 0, query: str = "") -> DataFrame:
    """Aggregated authors of a region and with a career of so many years at least. Both filters rest while a query is active; with a
    region asked for, authors without one drop out."""
    if query.strip():
        return rows
    got = rows.where(F.col(span) >= min_span) if min_span else rows
    if region and regions is not None:
        got = got.join(regions.where(F.col("region") == region).select(who).distinct(), who, "left_semi")
    return got


def institution_view(rows: DataFrame, places: DataFrame, who: str = "institution", country: str | None = None, sector: str | None = None) -> DataFrame:
    """Aggregated institutions of a country and sector (places: who, country, sector); unlike those of authors, these filters hold during a search."""
    for column, value in (("country", country), ("sector", sector)):
        if value:
            rows = rows.join(places.where(F.col(column) == value).select(who).distinct(), who, "left_semi")
    return rows
