"""Aggregations, ranks and series over the papers of the proxy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import axis_max, client_round, h_index, server_round
from ..operators import dimension, filters, merge, people, quality, rank, series
from . import proxies
from .proxies import ALL
from .registry import query

PARTIAL_YEAR = 2001


@query(f"""{ALL}, one AS (SELECT DISTINCT paper, country FROM authorship),
    r AS (SELECT country, citations, row_number() OVER (PARTITION BY country ORDER BY citations DESC) AS k FROM one JOIN papers USING (paper) WHERE citations > 0),
    h AS (SELECT country, count(*) FILTER (WHERE citations >= k) AS h_index FROM r GROUP BY country)
    SELECT o.country, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations, count(*) FILTER (WHERE citations > 0) AS cited_papers,
           coalesce(any_value(h.h_index), 0) AS h_index,
           CASE WHEN count(*) FILTER (WHERE citations > 0) >= 3 THEN CAST(round(sum(citations) / count(citations)) AS BIGINT) END AS average
    FROM one o JOIN papers USING (paper) LEFT JOIN h USING (country) GROUP BY o.country HAVING count(*) > 2 AND count(*) FILTER (WHERE citations > 0) >= 1""")
def dim_agg_nation(spark, sf_dir):
    return dimension.by_dimension(proxies.credited(spark, sf_dir), F.col("countries"), F.col("citations"), 2, 1, 3, "country")


@query(f"""{ALL}, v AS (SELECT CASE WHEN venue IN (SELECT venue FROM papers GROUP BY venue HAVING count(*) > (SELECT count(*) / 5 FROM papers)) THEN venue ELSE 'Other' END AS venue, citations FROM papers)
    SELECT venue, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations FROM v GROUP BY venue""")
def dim_agg_venue_other(spark, sf_dir):
    papers = proxies.papers(spark, sf_dir)
    n = papers.agg((F.count(F.lit(1)) / 5).alias("least"))
    big = papers.groupBy("venue").agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(n)).where("n > least").select("venue", F.lit(True).alias("big"))
    named = papers.join(F.broadcast(big), "venue", "left").withColumn("venue", F.when(F.col("big"), F.col("venue")).otherwise("Other"))
    return dimension.by_dimension(named, F.col("venue"), F.col("citations"), name="venue").select("venue", "papers", "citations")


@query(f"""{ALL}, r AS (SELECT category, citations, row_number() OVER (PARTITION BY category ORDER BY citations DESC) AS k FROM papers WHERE citations > 0)
    SELECT category, count(*) FILTER (WHERE citations >= k) AS h_index FROM r GROUP BY category""")
def hindex_by_category(spark, sf_dir):
    return dimension.by_dimension(proxies.papers(spark, sf_dir), F.col("category"), F.col("citations"), name="category").select("category", "h_index")


@query("""WITH r AS (SELECT l_orderkey, floor(l_quantity) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY floor(l_quantity) DESC) AS k FROM lineitem)
    SELECT l_orderkey AS reader, count(*) FILTER (WHERE q >= k) AS h FROM r GROUP BY l_orderkey""")
def hindex_array(spark, sf_dir):
    lines = proxies.table(spark, sf_dir, "lineitem")
    return lines.groupBy("l_orderkey").agg(h_index(F.collect_list(F.floor("l_quantity"))).alias("h")).select(F.col("l_orderkey").alias("reader"), "h")


@query(f"""{ALL} SELECT paper, venue, year, citations FROM papers p WHERE category = 'F' AND year = 1995 AND citations >= 100
    AND EXISTS (SELECT 1 FROM authorship a WHERE a.paper = p.paper AND a.region = 'ASIA')""")
def filter_dims(spark, sf_dir):
    papers = proxies.papers(spark, sf_dir).where(filters.dimensions(category="F", year="1995", min_citations=100))
    asian = proxies.authorship(spark, sf_dir).where("region = 'ASIA'").select("paper")
    return papers.join(asian, "paper", "left_semi").select("paper", "venue", "year", "citations")


@query(f"""{ALL}, c AS (SELECT paper, list(DISTINCT country) AS countries FROM authorship GROUP BY paper)
    SELECT paper, citations FROM papers JOIN c USING (paper) WHERE list_contains(countries, 'NATION_3') AND venue IS NOT NULL AND venue NOT IN ('1-URGENT', '2-HIGH')""")
def filter_list_membership(spark, sf_dir):
    return proxies.credited(spark, sf_dir).where(filters.dimensions(venue="Other", country="NATION_3", big_venues=["1-URGENT", "2-HIGH"])).select("paper", "citations")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'a') AND contains(lower(p_name), 're')")
def search_words(spark, sf_dir):
    return proxies.table(spark, sf_dir, "part").where(filters.search("RE a", "p_name")).select("p_partkey", "p_name")


@query(f"""{ALL} SELECT venue, year, count(*) AS papers FROM papers WHERE length(trim(venue)) > 0 AND year IS NOT NULL GROUP BY venue, year HAVING count(*) >= 3""")
def complete_records(spark, sf_dir):
    papers = proxies.papers(spark, sf_dir).where(filters.complete("venue"))
    return papers.groupBy("venue", "year").agg(F.count(F.lit(1)).alias("papers")).where(F.col("papers") >= 3)


_RANK = f"""{ALL}, p AS (SELECT * FROM papers WHERE citations IS NOT NULL)
    SELECT paper, {{by}} citations, rank() OVER ({{part}} ORDER BY citations DESC) AS rank,
           CASE WHEN count(*) OVER (PARTITION BY {{by}} citations) > 1 THEN rank() OVER ({{part}} ORDER BY citations DESC) + count(*) OVER (PARTITION BY {{by}} citations) - 1 END AS rank_to FROM p"""


@query(_RANK.format(by="", part=""))
def rank_tied_range(spark, sf_dir):
    return rank.tied_rank(proxies.papers(spark, sf_dir).select("paper", "citations"), "citations", [])


@query(_RANK.format(by="venue, year,", part="PARTITION BY venue, year"))
def rank_tied_range_within(spark, sf_dir):
    return rank.tied_rank(proxies.papers(spark, sf_dir).select("paper", "venue", "year", "citations"), "citations", ["venue", "year"])


_AUTHORS = f"""{ALL}, totals AS (SELECT author, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations
    FROM (SELECT DISTINCT paper, author FROM authorship) JOIN papers USING (paper) GROUP BY author)"""


def _authors(spark, sf_dir):
    return dimension.totals_per_paper(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "author")


@query(f"""{_AUTHORS}, t AS (SELECT *, CASE WHEN papers % 3 = 0 THEN NULL ELSE citations / papers END AS average FROM totals)
    SELECT author, row_number() OVER (ORDER BY citations DESC, author) AS citations_rank, row_number() OVER (ORDER BY papers DESC, author) AS papers_rank,
           row_number() OVER (ORDER BY average DESC NULLS LAST, author) AS average_rank FROM t""")
def entity_rank(spark, sf_dir):
    rows = _authors(spark, sf_dir).withColumn("average", F.when(F.col("papers") % 3 != 0, F.col("citations") / F.col("papers")))
    return rank.entity_ranks(rows, "author", ["citations", "papers", "average"])


@query(f"""{_AUTHORS} SELECT author, papers, citations FROM totals ORDER BY citations DESC, author LIMIT 50""")
def top_by_total(spark, sf_dir):
    return rank.top(_authors(spark, sf_dir), [F.desc("citations"), F.asc("author")], 50)


@query(f"""{_AUTHORS}, bad AS (SELECT DISTINCT author FROM authorship WHERE country = 'NATION_7')
    SELECT author, papers, citations, round_even(citations / papers, 1) AS average FROM totals WHERE papers > 20 AND author NOT IN (SELECT author FROM bad) ORDER BY citations / papers DESC, author LIMIT 20""")
def top_avg_floor(spark, sf_dir):
    conflicted = proxies.authorship(spark, sf_dir).where("country = 'NATION_7'").select("author").distinct()
    return rank.top_by_average(_authors(spark, sf_dir), "author", 20, 20, conflicted)


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 50")
def paginate(spark, sf_dir):
    rows = proxies.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return rank.page(rows, [F.desc("p_retailprice"), F.asc("p_partkey")], 2, 50)


@query(f"""{ALL} SELECT year, citations, paper FROM (SELECT *, row_number() OVER (PARTITION BY year ORDER BY citations DESC, paper) AS k FROM papers WHERE citations IS NOT NULL) WHERE k = 1""")
def best_by_year(spark, sf_dir):
    return dimension.best_per_group(proxies.papers(spark, sf_dir), "year", "citations", "paper")


@query(f"""{ALL} SELECT venue, citations, paper FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY citations DESC, paper) AS k FROM papers WHERE citations IS NOT NULL) WHERE k = 1""")
def best_by_venue(spark, sf_dir):
    return dimension.best_per_group(proxies.papers(spark, sf_dir), "venue", "citations", "paper")


@query(f"""{ALL}, n AS (SELECT paper, count(DISTINCT author) AS authors, count(DISTINCT country) AS countries FROM authorship GROUP BY paper), p AS (SELECT * FROM papers JOIN n USING (paper))
    SELECT 'cited' AS kind, (SELECT paper FROM p ORDER BY citations DESC NULLS LAST, paper LIMIT 1) AS paper UNION ALL
    SELECT 'collaborative', (SELECT paper FROM p ORDER BY authors DESC, paper LIMIT 1) UNION ALL SELECT 'international', (SELECT paper FROM p ORDER BY countries DESC, paper LIMIT 1)""")
def insights_best(spark, sf_dir):
    rows = proxies.credited(spark, sf_dir).select("paper", "citations", F.size(F.array_distinct("authors")).alias("a"), F.size("countries").alias("c"))
    best = rows.agg(*[F.max_by("paper", F.struct(F.coalesce(s, F.lit(-1)), -F.col("paper"))).alias(k) for k, s in (("cited", F.col("citations")), ("collaborative", F.col("a")), ("international", F.col("c")))])
    return best.unpivot([], ["cited", "collaborative", "international"], "kind", "paper")


@query(f"""{ALL}, y AS (SELECT p.year, r.r_name AS value FROM papers p, region r WHERE 1 = 0),
    one AS (SELECT DISTINCT paper, region FROM authorship), axis AS (SELECT DISTINCT p.year, r.r_name AS value FROM papers p, region r WHERE p.year < {PARTIAL_YEAR})
    SELECT axis.value, axis.year, CAST(count(p.paper) AS DOUBLE) AS n FROM axis LEFT JOIN (SELECT paper, region, year FROM one JOIN papers USING (paper)) p ON p.year = axis.year AND p.region = axis.value GROUP BY axis.value, axis.year""")
def year_series(spark, sf_dir):
    return series.yearly(proxies.credited(spark, sf_dir), F.col("regions"), PARTIAL_YEAR)


@query(f"""{ALL}, one AS (SELECT DISTINCT paper, year, region FROM authorship JOIN papers USING (paper) WHERE year < {PARTIAL_YEAR}), w AS (SELECT year, count(DISTINCT paper) AS w FROM one GROUP BY year)
    SELECT region AS value, year, round(100 * CAST(count(*) AS DOUBLE) / any_value(w), 6) AS n FROM one JOIN w USING (year) WHERE region IN ('ASIA', 'EUROPE') GROUP BY region, year""")
def year_series_normalized(spark, sf_dir):
    return series.yearly(proxies.credited(spark, sf_dir), F.col("regions"), PARTIAL_YEAR, ["ASIA", "EUROPE"], normalise=True, skip_zeros=True)


@query(f"""{_AUTHORS}, c AS (SELECT author, year, count(DISTINCT paper) AS n FROM authorship JOIN papers USING (paper) GROUP BY author, year),
    s AS (SELECT author, unnest(generate_series(min(year), max(year))) AS year FROM c GROUP BY author)
    SELECT author, CAST(s.year AS INTEGER) AS year, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (author, year)""")
def year_gapfill(spark, sf_dir):
    papers = proxies.papers(spark, sf_dir)
    own = proxies.authorship(spark, sf_dir).select("paper", "author").distinct().join(papers, "paper")
    return series.dense_years(own.groupBy("author", "year").agg(F.count(F.lit(1)).alias("n")), ["author"])


@query(f"""{ALL}, c AS (SELECT year, count(*) AS n FROM papers WHERE year < {PARTIAL_YEAR} GROUP BY year ORDER BY year DESC LIMIT 5)
    SELECT CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, round_even(100 * (power(arg_max(n, year) / CAST(arg_min(n, year) AS DOUBLE), 1.0 / (count(*) - 1)) - 1), 1) AS growth FROM c""")
def cagr(spark, sf_dir):
    counts = proxies.papers(spark, sf_dir).groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    return series.growth(counts, PARTIAL_YEAR, 5)


@query(f"""{ALL} SELECT venue, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year, CAST((SELECT min(year) FROM papers) AS INTEGER) AS corpus_start FROM papers GROUP BY venue""")
def active_years(spark, sf_dir):
    return series.active_years(proxies.papers(spark, sf_dir), "venue")


@query(f"""{ALL} SELECT year, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations, CAST(round(sum(citations) / count(citations)) AS BIGINT) AS average FROM papers GROUP BY year""")
def yearly_average(spark, sf_dir):
    return series.yearly_average(proxies.papers(spark, sf_dir))


@query(f"""{ALL} SELECT year, category, count(*) AS n, round(100.0 * count(*) / any_value(w), 6) AS percent FROM papers JOIN (SELECT year, count(*) AS w FROM papers GROUP BY year) USING (year)
    WHERE year < {PARTIAL_YEAR} AND category <> 'P' GROUP BY year, category""")
def category_timeline(spark, sf_dir):
    return series.category_shares(proxies.papers(spark, sf_dir), PARTIAL_YEAR, "P")


@query(f"""{ALL}, i AS (SELECT DISTINCT paper, country, country IN ('NATION_8', 'NATION_7', 'NATION_9', 'NATION_12') AS industry FROM authorship)
    SELECT category, count(*) AS n, count(*) FILTER (WHERE industry) AS flagged, round_even(100.0 * count(*) FILTER (WHERE industry) / count(*), 1) AS percent FROM i JOIN papers USING (paper) GROUP BY category""")
def category_sector_share(spark, sf_dir):
    votes = proxies.authorship(spark, sf_dir).select("paper", "country").distinct().join(proxies.papers(spark, sf_dir), "paper")
    return dimension.flagged_share(votes, "category", F.col("country").isin("NATION_8", "NATION_7", "NATION_9", "NATION_12"))


@query(f"""{ALL} SELECT venue, count(*) AS n, count(*) FILTER (WHERE category = 'F') AS flagged, round_even(100.0 * count(*) FILTER (WHERE category = 'F') / count(*), 1) AS percent
    FROM papers WHERE venue <> '5-LOW' GROUP BY venue HAVING count(*) >= 10""")
def venue_share(spark, sf_dir):
    return dimension.flagged_share(proxies.papers(spark, sf_dir).where("venue <> '5-LOW'"), "venue", F.col("category") == "F", 10)


@query(f"""{ALL}, v AS (SELECT venue || ' ' || category AS venue, year, citations FROM papers)
    SELECT venue, count(*) AS n, string_agg(DISTINCT CAST(year AS VARCHAR), ',' ORDER BY CAST(year AS VARCHAR)) AS years,
           CASE WHEN count(citations) = count(*) THEN 'full' WHEN count(citations) = 0 THEN 'none' ELSE 'partial' END AS coverage FROM v GROUP BY venue HAVING count(*) >= 50""")
def coverage_enum(spark, sf_dir):
    rows = proxies.papers(spark, sf_dir).withColumn("venue", F.concat_ws(" ", "venue", "category"))
    return dimension.coverage(rows, "venue", F.col("citations").isNotNull(), "year", 50)


@query(f"""{ALL}, n AS (SELECT paper, count(DISTINCT author) AS authors FROM authorship GROUP BY paper)
    SELECT year, round_even(avg(authors), 1) AS team, round_even(100.0 * count(*) FILTER (WHERE citations > 0) / count(*), 1) AS percent FROM papers JOIN n USING (paper) WHERE year < {PARTIAL_YEAR} GROUP BY year HAVING count(*) >= 20""")
def yearly_team_size(spark, sf_dir):
    rows = proxies.credited(spark, sf_dir).where(F.col("year") < PARTIAL_YEAR)
    got = rows.groupBy("year").agg(F.count(F.lit(1)).alias("n"), server_round(F.avg(F.size(F.array_distinct("authors"))), 1).alias("team"), F.count_if(F.col("citations") > 0).alias("k"))
    return got.where("n >= 20").select("year", "team", server_round(100.0 * F.col("k") / F.col("n"), 1).alias("percent"))


@query(f"""{ALL}, r AS (SELECT citations, row_number() OVER (ORDER BY citations DESC, paper) AS k, count(*) OVER () AS cited, sum(citations) OVER () AS s FROM papers WHERE citations > 0), s AS (SELECT unnest([0.01, 0.1])::DOUBLE AS share)
    SELECT share, any_value(cited) AS cited, round_even(100.0 * sum(citations) / any_value(s), 1) AS percent FROM r, s WHERE k <= greatest(1, round_even(cited * share, 0)) GROUP BY share""")
def concentration(spark, sf_dir):
    return dimension.concentration(proxies.papers(spark, sf_dir), "citations", "paper")


@query(f"""{ALL} SELECT venue, count(*) AS n, CASE WHEN count(*) < 10 THEN 2 ELSE greatest(2, CAST(floor(quantile_cont(citations, 0.9) + 1e-9) AS BIGINT)) END AS threshold FROM papers WHERE citations > 0 GROUP BY venue""")
def percentile_influential(spark, sf_dir):
    return dimension.influential_threshold(proxies.papers(spark, sf_dir), "citations", "venue")


@query(f"""{ALL} SELECT category, round(quantile_cont(citations, 0.25), 6) AS q1, round(quantile_cont(citations, 0.5), 6) AS q2, round(quantile_cont(citations, 0.75), 6) AS q3 FROM papers WHERE citations IS NOT NULL GROUP BY category""")
def quartiles_by_category(spark, sf_dir):
    return dimension.quartiles(proxies.papers(spark, sf_dir), "category", "citations")


_LIVES = f"""{ALL}, lives AS (SELECT author, min(year) AS first_year, max(year) AS last_year, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations,
    count(*) FILTER (WHERE citations > 0) AS cited_papers, count(*) FILTER (WHERE citations >= 150) AS influential FROM (SELECT DISTINCT paper, author FROM authorship) JOIN papers USING (paper) GROUP BY author)"""


def _lives(spark, sf_dir):
    return dimension.lifetimes(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "author", 150)


@query(f"{_LIVES} SELECT * FROM lives")
def author_lifetimes(spark, sf_dir):
    return _lives(spark, sf_dir)


@query(f"""{_LIVES}, readers AS (SELECT reader, max(year) - min(year) AS span FROM papers GROUP BY reader), c AS (SELECT least(span, 4) AS bin, count(*) AS n FROM readers GROUP BY 1)
    SELECT CAST(b AS BIGINT) AS bin, coalesce(n, 0) AS n FROM generate_series(0, 4) t(b) LEFT JOIN c ON bin = b""")
def lifetime_hist(spark, sf_dir):
    spans = proxies.papers(spark, sf_dir).groupBy("reader").agg((F.max("year") - F.min("year")).alias("span"))
    return dimension.clamped_histogram(spans, "span", 4)


@query(f"""{_LIVES} SELECT author, papers, influential, round(citations / papers, 6) AS average FROM lives WHERE last_year - first_year <= 7 AND papers >= 5 AND influential >= 3 AND last_year >= {PARTIAL_YEAR - 1}
    ORDER BY influential DESC, citations / papers DESC, author LIMIT 5""")
def promising(spark, sf_dir):
    return dimension.promising(_lives(spark, sf_dir), "author", PARTIAL_YEAR - 1, 7, 5, 3, 5)


@query(f"""{ALL} SELECT author, country, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations, CAST(min(year) AS INTEGER) AS first_year, CAST(max(year) AS INTEGER) AS last_year
    FROM (SELECT DISTINCT paper, author, country FROM authorship) JOIN papers USING (paper) GROUP BY author, country""")
def author_place_spans(spark, sf_dir):
    return dimension.spans(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "author", "country")


@query(f"""{ALL} SELECT author, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations FROM authorship JOIN papers USING (paper) GROUP BY author""")
def totals_per_row(spark, sf_dir):
    return dimension.totals_per_row(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "author")


@query(f"""{ALL} SELECT country, count(*) AS papers, CAST(coalesce(sum(citations), 0) AS BIGINT) AS citations FROM (SELECT DISTINCT paper, country FROM authorship) JOIN papers USING (paper) GROUP BY country""")
def totals_per_paper(spark, sf_dir):
    return dimension.totals_per_paper(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "country")


@query(f"""{ALL}, o AS (SELECT DISTINCT paper, country, category FROM authorship JOIN papers USING (paper) WHERE country IN ('NATION_3', 'NATION_7')), s AS (SELECT country, category, 100.0 * count(*) / sum(count(*)) OVER (PARTITION BY country) AS p FROM o GROUP BY country, category)
    SELECT category, round(coalesce(max(p) FILTER (WHERE country = 'NATION_3'), 0), 6) AS NATION_3, round(coalesce(max(p) FILTER (WHERE country = 'NATION_7'), 0), 6) AS NATION_7,
           round(round(coalesce(max(p) FILTER (WHERE country = 'NATION_3'), 0), 6) + round(coalesce(max(p) FILTER (WHERE country = 'NATION_7'), 0), 6), 6) AS total FROM s GROUP BY category""")
def pivot_topics(spark, sf_dir):
    rows = proxies.authorship(spark, sf_dir).select("paper", "country").distinct().join(proxies.papers(spark, sf_dir), "paper")
    return dimension.topic_shares(rows, "country", "category", ["NATION_3", "NATION_7"])


@query(f"""{ALL} SELECT 'citations' AS field, CAST(round(100.0 * count(citations) / count(*)) AS BIGINT) AS percent FROM papers UNION ALL
    SELECT 'cited', CAST(round(100.0 * count(*) FILTER (WHERE citations > 0) / count(*)) AS BIGINT) FROM papers UNION ALL SELECT 'venue', CAST(round(100.0 * count(venue) / count(*)) AS BIGINT) FROM papers""")
def field_coverage(spark, sf_dir):
    fields = {"citations": F.col("citations").isNotNull(), "cited": F.coalesce(F.col("citations") > 0, F.lit(False)), "venue": F.col("venue").isNotNull()}
    return dimension.field_coverage(proxies.papers(spark, sf_dir), fields)


_METRICS = """SELECT 'papers' AS metric, count(*) AS value FROM {t} UNION ALL SELECT 'cited', count(*) FILTER (WHERE citations > 0) FROM {t} UNION ALL SELECT 'citations', CAST(coalesce(sum(citations), 0) AS BIGINT) FROM {t} UNION ALL SELECT 'venues', count(DISTINCT venue) FROM {t}"""


def _metrics(papers):
    return dimension.gate_metrics(papers, {"papers": F.count(F.lit(1)), "cited": F.count_if(F.col("citations") > 0), "citations": F.coalesce(F.sum("citations"), F.lit(0)), "venues": F.countDistinct("venue")})


@query(f"{ALL} {_METRICS.format(t='papers')}")
def gate_metrics(spark, sf_dir):
    return _metrics(proxies.papers(spark, sf_dir))


@query(f"""{ALL}, fewer AS (SELECT * FROM papers WHERE paper % 20 <> 0), a AS ({_METRICS.format(t='fewer')}), b AS ({_METRICS.format(t='papers')})
    SELECT a.metric, a.value, b.value AS before, round((a.value - b.value) / CAST(b.value AS DOUBLE), 6) AS change, round((a.value - b.value) / CAST(b.value AS DOUBLE), 6) < -0.03 AS bad FROM a JOIN b USING (metric)""")
def gate_change(spark, sf_dir):
    papers = proxies.papers(spark, sf_dir)
    return dimension.gate(_metrics(papers.where("paper % 20 <> 0")), _metrics(papers))


@query(f"""{ALL} SELECT reader, max(year) - min(year) AS span, CAST(round(100.0 * sum(citations % 10) / nullif(sum(citations), 0)) AS BIGINT) AS self_percent FROM papers GROUP BY reader""")
def career_spans(spark, sf_dir):
    rows = proxies.papers(spark, sf_dir).withColumn("own", F.col("citations") % 10)
    return dimension.career(rows, "reader", "citations", "own", "year")


@query(f"""{ALL}, n AS (SELECT reader, count(*) AS n FROM papers GROUP BY reader HAVING count(*) > 15) SELECT reader, n FROM n""")
def big_groups(spark, sf_dir):
    return dimension.big_groups(proxies.papers(spark, sf_dir), "reader", 15)


@query(f"""{_AUTHORS}, t AS (SELECT author, papers, citations FROM totals ORDER BY citations DESC, author LIMIT 10) SELECT * FROM t UNION ALL SELECT 'Total', CAST(sum(papers) AS BIGINT), CAST(sum(citations) AS BIGINT) FROM t""")
def page_with_total(spark, sf_dir):
    return dimension.with_total_row(rank.top(_authors(spark, sf_dir), [F.desc("citations"), F.asc("author")], 10), "author", ["papers", "citations"])


@query(f"""{ALL}, c AS (SELECT country, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, country) AS place FROM authorship GROUP BY country), f AS (SELECT place AS spot FROM c WHERE country = 'NATION_20')
    SELECT country, n, place FROM c, f WHERE CASE WHEN spot > 5 THEN place < 5 OR country = 'NATION_20' ELSE place <= 5 END""")
def chart_forced_group(spark, sf_dir):
    return rank.chart_groups(proxies.authorship(spark, sf_dir), "country", 5, "NATION_20").withColumn("place", F.col("place").cast("long"))


@query(f"""{ALL} SELECT venue, paper, citations, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY citations DESC NULLS LAST, paper) AS k FROM papers) WHERE k <= 5""")
def top_per_group(spark, sf_dir):
    rows = proxies.papers(spark, sf_dir).select("venue", "paper", "citations")
    return rank.top_per_group(rows, "venue", [F.desc_nulls_last("citations"), F.asc("paper")], 5)


@query(f"""{ALL}, t AS (SELECT country, paper, k FROM (SELECT country, paper, row_number() OVER (PARTITION BY country ORDER BY citations DESC NULLS LAST, paper) AS k FROM (SELECT DISTINCT country, paper FROM authorship) JOIN papers USING (paper) WHERE country IN ('NATION_3', 'NATION_7')) WHERE k <= 5)
    SELECT CAST(k AS INTEGER) AS rank, max(paper) FILTER (WHERE country = 'NATION_3') AS NATION_3, max(paper) FILTER (WHERE country = 'NATION_7') AS NATION_7 FROM t GROUP BY k""")
def side_by_side(spark, sf_dir):
    own = proxies.authorship(spark, sf_dir).where(F.col("country").isin("NATION_3", "NATION_7")).select("country", "paper").distinct().join(proxies.papers(spark, sf_dir), "paper")
    best = rank.top_per_group(own, "country", [F.desc_nulls_last("citations"), F.asc("paper")], 5)
    return best.groupBy("rank").pivot("country", ["NATION_3", "NATION_7"]).agg(F.first("paper"))


@query(f"""{ALL}, s AS (SELECT author, country, region, min(year) AS a, max(year) AS b FROM authorship JOIN papers USING (paper) GROUP BY ALL)
    SELECT author, region FROM (SELECT *, row_number() OVER (PARTITION BY author ORDER BY b DESC, a DESC, region) AS k FROM s) WHERE k = 1""")
def region_of_entity(spark, sf_dir):
    spans = dimension.spans(proxies.authorship(spark, sf_dir), proxies.papers(spark, sf_dir), "author", "country", "region")
    return rank.latest(spans, "author", "region")


@query(f"""{ALL} SELECT country, count(DISTINCT author) AS authors FROM authorship GROUP BY country""")
def country_authors(spark, sf_dir):
    return people.country_authors(proxies.authorship(spark, sf_dir))


@query(f"""{ALL}, o AS (SELECT DISTINCT country, paper FROM authorship) SELECT a.country, b.country AS other, count(*) AS members FROM o a JOIN o b USING (paper) WHERE a.country <> b.country GROUP BY a.country, b.country""")
def shared_members(spark, sf_dir):
    return people.roster(proxies.authorship(spark, sf_dir), "country", "paper")


@query(f"""{ALL}, a AS (SELECT paper, list('Ann ' || translate(substr(author, 10), '0123456789', 'abcdefghij') ORDER BY position, author) AS names FROM authorship GROUP BY paper)
    SELECT paper, array_to_string(names, ', ') AS names, len(list_distinct(names)) AS distinct_names FROM a""")
def paper_authors(spark, sf_dir):
    """The names that a paper credits, in order and with repeats, from detailed lists and comma lists."""
    spelt = F.concat(F.lit("Ann "), F.translate(F.substring("author", 10, 20), "0123456789", "abcdefghij"))
    rows = proxies.authorship(spark, sf_dir).groupBy("paper").agg(F.array_sort(F.collect_list(F.struct("position", spelt.alias("name")))).alias("a")).withColumn("names", F.col("a.name"))
    detail = F.when(F.col("paper") % 2 == 0, F.col("names")).otherwise(F.array().cast("array<string>"))
    names = people.credited_names(detail, F.array_join("names", ", "))
    return rows.select("paper", names.alias("n")).select("paper", F.array_join("n", ", ").alias("names"), F.size(F.array_distinct("n")).cast("long").alias("distinct_names"))


_PLACED = f"""{ALL}, own AS (SELECT paper, author, region AS institution, CASE WHEN position % 2 = 0 THEN country END AS country FROM authorship),
    known AS (SELECT r_name AS institution, 'in ' || r_name AS k FROM region WHERE r_name <> 'ASIA'), has AS (SELECT paper, author, count(country) > 0 AS has FROM own GROUP BY paper, author),
    c AS (SELECT paper, country AS c FROM own WHERE country IS NOT NULL UNION SELECT paper, k FROM own JOIN known USING (institution) JOIN has USING (paper, author) WHERE NOT (institution = 'EUROPE' AND has))"""


@query(f"""{_PLACED} SELECT paper, string_agg(c, ',' ORDER BY c) AS countries FROM c GROUP BY paper""")
def paper_countries(spark, sf_dir):
    """A paper's countries: those of its authors, and of their institutions, but for a company's where the author has one."""
    own = proxies.authorship(spark, sf_dir).select("paper", "author", F.col("region").alias("institution"), F.when(F.col("position") % 2 == 0, F.col("country")).alias("country"))
    region = proxies.table(spark, sf_dir, "region").select(F.col("r_name").alias("institution"))
    known = region.where("institution <> 'ASIA'").withColumn("country", F.concat(F.lit("in "), F.col("institution")))
    return merge.institution_countries(own, known, region.where("institution = 'EUROPE'")).select("paper", F.array_join("countries", ",").alias("countries"))


@query(f"""{ALL}, a AS (SELECT DISTINCT paper, author FROM authorship) SELECT a.author, count(DISTINCT b.author) AS coauthors FROM a JOIN a b USING (paper) WHERE a.author <> b.author GROUP BY a.author""")
def distinct_coauthors(spark, sf_dir):
    return people.distinct_coauthors(proxies.authorship(spark, sf_dir))


@query("""SELECT o_orderpriority AS venue, CAST(y AS INTEGER) AS year FROM (SELECT o_orderpriority, unnest(generate_series(min(year(o_orderdate)), 2000, 2)) AS y FROM orders GROUP BY 1)
    WHERE (o_orderpriority, y) NOT IN (SELECT (o_orderpriority, year(o_orderdate)) FROM orders)""")
def missing_editions(spark, sf_dir):
    return series.missing_steps(proxies.papers(spark, sf_dir), "venue", 2, 2000)


@query(f"""{ALL}, l AS (SELECT venue, count(*) AS n FROM papers WHERE year < 1997 GROUP BY venue), r AS (SELECT venue, count(*) AS n FROM papers WHERE venue <> '5-LOW' GROUP BY venue)
    SELECT venue, l.n AS local, r.n AS live FROM l FULL JOIN r USING (venue) WHERE l.n IS DISTINCT FROM r.n""")
def count_drift(spark, sf_dir):
    count = lambda p: p.groupBy("venue").agg(F.count(F.lit(1)).alias("n"))
    papers = proxies.papers(spark, sf_dir)
    return quality.drift(count(papers.where("year < 1997")), count(papers.where("venue <> '5-LOW'")), "venue")


@query(f"""{ALL}, e AS (SELECT * FROM (VALUES ('1-URGENT', 10), ('5-LOW', 100000000), ('none', 1)) t(venue, min_rows)), o AS (SELECT venue, count(*) AS n, round(count(citations) / CAST(count(*) AS DOUBLE), 6) AS share FROM papers GROUP BY venue)
    SELECT venue, CAST(min_rows AS BIGINT) AS min_rows, coalesce(n, 0) AS n, coalesce(share, 0.0)::DOUBLE AS share, coalesce(n, 0) >= min_rows AND coalesce(share, 0) >= 0.8 AS ok FROM e LEFT JOIN o USING (venue)""")
def count_assertions(spark, sf_dir):
    expected = spark.createDataFrame([("1-URGENT", 10), ("5-LOW", 100_000_000), ("none", 1)], "venue string, min_rows long")
    return quality.count_assertions(proxies.papers(spark, sf_dir), "venue", F.col("citations").isNotNull(), expected, 0.8)


@query(f"""{ALL} SELECT venue, year, count(*) AS missing FROM papers WHERE citations IS NULL GROUP BY venue, year""")
def missing_work(spark, sf_dir):
    keyed = proxies.papers(spark, sf_dir).withColumn("key", F.col("paper").cast("string"))
    return quality.missing_work(keyed, F.col("citations").isNull(), "key", "venue", "year").select("venue", "year", F.size("keys").cast("long").alias("missing"))


@query("""WITH v AS (SELECT p_partkey, p_retailprice AS v FROM part), s AS (SELECT p_partkey, v, m FROM v, (VALUES (1.0), (2.0), (2.5), (3.0), (4.0), (5.0), (7.5), (10.0)) t(m))
    SELECT p_partkey, min(m * power(10, floor(log10(v / 4))) * 4) AS top FROM s WHERE m * power(10, floor(log10(v / 4))) * 4 >= v - 1e-9 GROUP BY p_partkey""")
def axis_ends(spark, sf_dir):
    return proxies.table(spark, sf_dir, "part").select("p_partkey", axis_max(F.col("p_retailprice")).alias("top"))


@query("""SELECT p_partkey, CAST(round_even(p_retailprice / 4, 0) AS BIGINT) AS even, CAST(round(p_retailprice / 4, 0) AS BIGINT) AS up FROM part""")
def two_roundings(spark, sf_dir):
    quarter = F.col("p_retailprice") / 4
    return proxies.table(spark, sf_dir, "part").select("p_partkey", server_round(quarter).cast("long").alias("even"), client_round(quarter).cast("long").alias("up"))


@query(f"""{ALL}, p AS (SELECT *, row_number() OVER (PARTITION BY venue ORDER BY md5('0|' || paper), paper) AS r FROM papers)
    SELECT paper, venue, row_number() OVER (ORDER BY md5('1|' || paper), paper) AS place FROM p WHERE r <= 20""")
def stratified_sample(spark, sf_dir):
    return quality.stratified(proxies.papers(spark, sf_dir).select("paper", "venue"), "venue", "paper", 20)


# three categories, of which the smallest has over 34 papers at each scale, so that 100 places make 34, 33 and 33
@query(f"""{ALL}, r AS (SELECT paper, category, published, row_number() OVER (PARTITION BY category ORDER BY published DESC, paper) AS turn FROM papers)
    SELECT paper, category, published, turn FROM r WHERE turn <= CASE WHEN category = (SELECT min(category) FROM papers) THEN 34 ELSE 33 END""")
def interleaved_sample(spark, sf_dir):
    return rank.interleaved(proxies.papers(spark, sf_dir).select("paper", "category", "published"), "category", [F.desc("published"), F.asc("paper")], 100)


@query(f"""{ALL}, s AS (SELECT author, country AS name, min(year) AS f, max(year) AS l, count(DISTINCT paper) AS papers FROM (SELECT *, author || region AS k FROM authorship) JOIN papers USING (paper) GROUP BY author, country),
    r AS (SELECT reader AS author, venue AS name, min(year) AS f, max(year) AS l, count(*) AS papers FROM papers GROUP BY reader, venue)
    SELECT author, count(*) FILTER (WHERE papers = 1 AND EXISTS (SELECT 1 FROM r o WHERE o.author = r.author AND o.name <> r.name) AND NOT EXISTS (SELECT 1 FROM r o WHERE o.author = r.author AND o.name <> r.name AND o.f <= r.l AND r.f <= o.l)) AS lone FROM r GROUP BY author""")
def lone_places(spark, sf_dir):
    spans = proxies.papers(spark, sf_dir).groupBy(F.col("reader").alias("author"), F.col("venue").alias("name")).agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.count(F.lit(1)).alias("papers"))
    return people.lone_places(spans)


@query(f"""{ALL}, s AS (SELECT reader, count(*) AS n FROM papers GROUP BY reader) SELECT p.reader, p.paper FROM papers p JOIN s USING (reader) WHERE n >= 12""")
def seed_venues(spark, sf_dir):
    rows = proxies.papers(spark, sf_dir).select(F.col("reader").alias("venue"), "paper")
    return filters.seed_venues(rows, 12).select(F.col("venue").alias("reader"), "paper")


@query(f"""{ALL}, r AS (SELECT venue, max(CASE WHEN category = 'P' AND year = 1995 THEN 1 ELSE 0 END) AS any_p FROM papers GROUP BY venue) SELECT venue, count(*) AS n FROM papers JOIN r USING (venue) WHERE any_p = 0 OR (category = 'P' AND year = 1995) GROUP BY venue""")
def known_or_all(spark, sf_dir):
    rows = filters.known_or_all(proxies.papers(spark, sf_dir), (F.col("category") == "P") & (F.col("year") == 1995), "venue")
    return rows.groupBy("venue").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{ALL} SELECT paper, CASE WHEN venue IN ('1-URGENT') THEN 'urgent' WHEN venue = '5-LOW' THEN 'Unknown' ELSE venue END AS venue, CASE WHEN venue IN ('1-URGENT', '5-LOW') THEN venue END AS venue_raw, CASE WHEN venue = '5-LOW' THEN 'missing' END AS venue_status FROM papers""")
def venue_rename(spark, sf_dir):
    return filters.renamed_venue(proxies.papers(spark, sf_dir).select("paper", "venue"), {"1-URGENT": "urgent"}, ["5-LOW"])


