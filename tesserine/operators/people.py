"""Authors: plausible details, credit, places and profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import author_name, is_full_name, may_be_reversed, name_parts, ordered_names, split_joined
from .rank import latest


def surnames(names: Column) -> Column:
    return F.array_distinct(F.transform(names, lambda n: F.lower(F.element_at(F.split(F.trim(n), r"\s+"), -1))))


def plausible_detail(listed: Column, detailed: Column) -> Column:
    """Whether a detailed author list can be that of the listed names: not over twice or five more, and half of the surnames shared."""
    n, d = F.size(listed), F.size(detailed)
    shared = F.size(F.array_intersect(surnames(listed), surnames(detailed))) / F.greatest(F.lit(1), F.size(surnames(listed)))
    return (d > 0) & (d <= F.greatest(2 * n, n + 5)) & (shared >= 0.5)


def shared_block(institutions: Column) -> Column:
    """Whether two authors or more carry one and the same list of at least two institutions: a paper's list, not the authors'."""
    some = F.filter(institutions, lambda x: F.size(x) > 0)
    return (F.size(some) >= 2) & (F.size(F.array_distinct(some)) == 1) & (F.size(F.get(some, F.lit(0))) >= 2)


def without_leaks(candidates: Column, coauthors: Column, most: int = 25) -> Column:
    """Without values that begin with a co-author's name and go on for a few signs only; once each, in order."""
    leak = lambda c: F.exists(coauthors, lambda n: c.startswith(n) & (F.length(c) - F.length(n) <= most))
    return F.array_distinct(F.filter(candidates, lambda c: ~leak(c)))


def credited_names(detail: Column, listed: Column) -> Column:
    """Names to credit, in order and with repeats: the detailed list if there is one, else the comma list; split, cleaned, full names only."""
    raw = F.when(F.size(detail) > 0, detail).otherwise(F.split(listed, r",\s*"))
    names = F.transform(F.flatten(F.transform(raw, split_joined)), lambda n: author_name(n))
    return F.filter(names, lambda n: n.isNotNull() & is_full_name(n))


def relabel(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows: name, title. A name that several people share becomes the name that the table (name, title, new_name) gives it for a title; other
    rows of such a name get none."""
    shared = table.select("name").distinct().withColumn("__s", F.lit(True))
    got = rows.join(table, ["name", "title"], "left").join(shared, "name", "left")
    return got.withColumn("name", F.when(F.col("__s"), F.col("new_name")).otherwise(F.col("name"))).drop("new_name", "__s")


def garbled(names: Column) -> Column:
    """Every name has two signs at most."""
    return (F.size(names) > 0) & F.forall(names, lambda n: F.length(F.trim(n)) <= 2)


def repaired_detail(names: Column, affiliations: Column, listed: Column) -> Column:
    """Garbled details rebuilt from the comma list, all with the first row's affiliations."""
    first = F.get(affiliations, F.lit(0))
    whole = F.transform(F.split(listed, r",\s*"), lambda n: F.struct(n.alias("name"), first.alias("affiliations")))
    own = F.transform(F.arrays_zip(names.alias("name"), affiliations.alias("affiliations")), lambda x: F.struct(x["name"].alias("name"), x["affiliations"].alias("affiliations")))
    return F.when(garbled(names), whole).otherwise(own)


def replaced(values: Column, dropped: list[str], split: dict[str, list[str]]) -> Column:
    """A list without wrong values, glued ones taken apart; once each, in order."""
    got = F.array_except(values, F.array(*[F.lit(x) for x in dropped])) if dropped else F.array_distinct(values)
    if split:
        table = F.create_map(*[F.lit(x) if k % 2 == 0 else F.array(*[F.lit(y) for y in x]) for kv in split.items() for k, x in enumerate(kv)])
        got = F.flatten(F.transform(got, lambda v: F.coalesce(table[v], F.array(v))))
    return F.array_distinct(got)


def country_codes(codes: Column, institutions: Column, wrong: list[tuple[str, str]]) -> Column:
    """Codes without those known to be wrong for an institution of the author."""
    bad = F.array(*[F.when(F.array_contains(institutions, i), F.lit(c)) for i, c in wrong]) if wrong else F.array().cast("array<string>")
    return F.filter(codes, lambda c: ~F.coalesce(F.array_contains(bad, c), F.lit(False)))


def author_region(places: DataFrame, institution_region: DataFrame, own_regions: DataFrame) -> DataFrame:
    """places: author, institution, first_year, last_year. The region of the latest institution that has one known; else that of the author's
    countries (own_regions: author, region) if they have just one."""
    known = latest(places.join(institution_region, "institution"), "author", "region")
    only = own_regions.distinct().groupBy("author").agg(F.count(F.lit(1)).alias("n"), F.min("region").alias("other")).where("n = 1").drop("n")
    return known.join(only, "author", "full_outer").select("author", F.coalesce("region", "other").alias("region"))


def profiles(institutions: DataFrame, countries: DataFrame, ids: DataFrame, ambiguous: DataFrame) -> DataFrame:
    """Per author with any detail: institutions by first year, undated last, countries, id, and whether the name is shared.
    institutions: author, name, first_year, last_year, papers."""
    key = F.struct(F.col("first_year").isNull().alias("undated"), "first_year", "name", "last_year", "papers")
    spans = institutions.groupBy("author").agg(F.array_sort(F.collect_list(key)).alias("s"))
    own = spans.select("author", F.transform("s", lambda x: F.struct(x["name"].alias("name"), x["first_year"].alias("first_year"), x["last_year"].alias("last_year"), x["papers"].alias("papers"))).alias("institutions"))
    got = own.join(countries.groupBy("author").agg(F.array_sort(F.collect_set("country")).alias("countries")), "author", "full_outer").join(ids, "author", "full_outer")
    return got.join(ambiguous.select("author").distinct().withColumn("ambiguous", F.lit(True)), "author", "left").withColumn("ambiguous", F.coalesce("ambiguous", F.lit(False)))


def roster(authorship: DataFrame, by: str, member: str) -> DataFrame:
    """Members of each institution that is the members' other one: by, other, members in common."""
    own = authorship.select(by, member).distinct()
    other = own.withColumnRenamed(by, "other")
    return own.join(other, member).where(F.col(by) != F.col("other")).groupBy(by, "other").agg(F.count(F.lit(1)).alias("members"))


def country_authors(authorship: DataFrame, country: str = "country") -> DataFrame:
    """Distinct authors by the authors' own countries, not their papers'."""
    return authorship.select("author", country).where(F.col(country).isNotNull()).distinct().groupBy(country).agg(F.count(F.lit(1)).alias("authors"))


def distinct_researchers(authorship: DataFrame, organisation: str = r"(?i)\b(?:university|institut\w*|college|laborator\w*)\b") -> DataFrame:
    """Names that don't read like organisations, so that one typed as an author can't rule the organisation out."""
    return authorship.where(~F.col("author").rlike(organisation)).select("author").distinct()


def lone_places(places: DataFrame) -> DataFrame:
    """Per author: institutions on one paper whose span meets no other of the author's. places: author, name, first_year, last_year, papers.

    A span that meets none begins after all that began before it have ended and ends before the next begins: one running maximum in
    order of time, rather than all pairs.
    """
    from pyspark.sql.window import Window

    dated = places.where("first_year is not null")
    order = Window.partitionBy("author").orderBy("first_year", "last_year", "name")
    before = F.max("last_year").over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("first_year").over(order)
    alone = (F.coalesce(before, F.lit(-1)) < F.col("first_year")) & (F.coalesce(after, F.lit(99_999)) > F.col("last_year"))
    several = F.count(F.lit(1)).over(Window.partitionBy("author")) > 1
    marked = dated.withColumn("a", alone & several & (F.col("papers") == 1))
    return marked.groupBy("author").agg(F.count_if("a").alias("lone"))


def union_names(enriched: DataFrame, profiles: DataFrame, name: str = "author") -> DataFrame:
    """Names that have an enrichment or a profile."""
    return enriched.select(name).unionByName(profiles.select(name)).where(F.col(name).isNotNull()).distinct()


def listed_author_stats(papers: DataFrame, authors: str = "authors", citations: str = "citations") -> DataFrame:
    """Papers and citations by name for papers that have only a comma list of authors: split, cleaned, full names, once for each time that a list has them."""
    names = papers.select(F.explode(F.split(F.col(authors), r"\s*,\s*")).alias("n"), F.col(citations).alias("c")).select(author_name(F.col("n")).alias("author"), "c")
    return names.where(F.col("author").isNotNull() & is_full_name(F.col("author"))).groupBy("author").agg(F.count(F.lit(1)).alias("papers"), F.coalesce(F.sum("c"), F.lit(0)).alias("citations"))


def country_of(institution_country: Column, author_countries: Column) -> Column:
    """The country of the institution shown; without one that of the author, if it is the only one."""
    return F.coalesce(institution_country, F.when(F.size(author_countries) == 1, F.get(author_countries, F.lit(0))))


def distinct_coauthors(authorship: DataFrame) -> DataFrame:
    """Per author, how many others share a paper; the author is none of them."""
    own = authorship.select("paper", "author").distinct()
    pairs = own.join(own.withColumnRenamed("author", "co"), "paper").where("author <> co")
    return pairs.select("author", "co").distinct().groupBy("author").agg(F.count(F.lit(1)).alias("coauthors"))


def ordered_lists(rows: DataFrame, file: str, authors: str, share: float = 0.5) -> DataFrame:
    """Author lists as "First Last, First Last". A file whose lists look reversed ("Last, First, ...") in at least ``share`` of those with several
    parts is reversed, and its lists are paired; "Last, First and Last, First" is told by itself."""
    several = F.size(name_parts(F.col(authors))) > 1
    vote = rows.where(several).groupBy(file).agg(F.avg(may_be_reversed(F.col(authors)).cast("double")).alias("__v")).select(file, (F.col("__v") >= share).alias("__reversed"))
    got = rows.join(vote, file, "left")
    return got.withColumn(authors, ordered_names(F.col(authors), F.coalesce(F.col("__reversed"), F.lit(False)))).drop("__reversed")
