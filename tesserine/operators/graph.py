"""The citation graph: building, cleaning and measuring edge lists (citer, cited)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import singular
from ..functions.values import server_round
from ..scratch import stored


def union_edges(*sources: DataFrame) -> DataFrame:
    """All edges once, none from a node to itself."""
    return reduce(DataFrame.unionByName, [s.select("citer", "cited") for s in sources]).where("citer <> cited").distinct()


def rekey_edges(edges: DataFrame) -> DataFrame:
    """Edges of plain keys in the space of graph keys; nodes that become one are merged."""
    return edges.select(singular(F.col("citer")).alias("citer"), singular(F.col("cited")).alias("cited")).distinct()


def carried_edges(edges: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Edges whose ends are both still among the nodes."""
    for end in ("citer", "cited"):
        edges = edges.join(nodes.select(F.col(key).alias(end)).distinct(), end, "left_semi")
    return edges


def id_edges(references: DataFrame, ids: DataFrame) -> DataFrame:
    """references: citer, id; ids: key, id. Edges between keys; unknown ids and self-references go."""
    known = ids.select(F.col("key").alias("cited"), "id")
    return references.join(known, "id").where("citer <> cited").select("citer", "cited").distinct()


def year_guard(edges: DataFrame, years: DataFrame, key: str = "paper", year: str = "year", slack: int = 2) -> DataFrame:
    """Without edges to papers that appeared more than ``slack`` years after the citer. Of a key with several years the
    latest counts for the citer and the earliest for the cited paper; an unknown year keeps the edge."""
    span = years.groupBy(key).agg(F.min(year).alias("lo"), F.max(year).alias("hi"))
    got = edges.join(span.select(F.col(key).alias("citer"), F.col("hi").alias("citer_year")), "citer", "left")
    got = got.join(span.select(F.col(key).alias("cited"), F.col("lo").alias("cited_year")), "cited", "left")
    return got.where(F.coalesce(F.col("citer_year") >= F.col("cited_year") - slack, F.lit(True))).select("citer", "cited")


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy("cited").agg(F.count(F.lit(1)).alias("citers"))


def disruption(edges: DataFrame, min_citers: int = 10) -> DataFrame:
    """CD index of each paper with enough citers and known references: the mean over its citers of -1 if the citer also
    cites one of the paper's references, else 1; rounded half to even.

    A citer c of p that shares a reference r is a pair c->p, p->r with c->r: found by joining edges with edges and then on both ends, after
    the floor has removed most targets.
    """
    counts = edges.groupBy("cited").agg(F.count(F.lit(1)).alias("n_citers")).where(F.col("n_citers") >= min_citers)
    referring = edges.select(F.col("citer").alias("cited")).distinct()
    targets = counts.join(referring, "cited", "left_semi")
    first = edges.join(targets.select("cited"), "cited", "left_semi").select(F.col("citer").alias("c"), F.col("cited").alias("p"))
    second = edges.select(F.col("citer").alias("p"), F.col("cited").alias("r"))
    third = edges.select(F.col("citer").alias("c"), F.col("cited").alias("r"))
    shared = first.join(second, "p").join(third, ["c", "r"], "left_semi").select("p", "c").distinct().groupBy("p").agg(F.count(F.lit(1)).alias("both"))
    got = targets.join(shared.withColumnRenamed("p", "cited"), "cited", "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return got.select(F.col("cited").alias("paper"), "n_citers", server_round((F.col("n_citers") - 2 * F.col("both")) / F.col("n_citers"), 3).alias("cd_index"))


def early_citations(edges: DataFrame, papers: DataFrame, as_of_year: int, years: int = 2) -> DataFrame:
    """Citers at most ``years`` after a paper; only papers at least so old, 0 if they have none."""
    old = papers.where(as_of_year - F.col("year") >= years).select(F.col("paper").alias("cited"), F.col("year").alias("y"))
    citers = edges.join(papers.select(F.col("paper").alias("citer"), F.col("year").alias("cy")), "citer")
    got = old.join(citers, "cited", "left").groupBy("cited").agg(F.count_if(F.col("cy") <= F.col("y") + years).alias("early_citations"))
    return got.withColumnRenamed("cited", "paper")


def self_citations(edges: DataFrame, authorship: DataFrame) -> DataFrame:
    """Per cited paper: citers, and how many of them share an author. Authors meet by a join on author and paper, not by comparing lists."""
    own = authorship.select("paper", "author").distinct()
    citing = edges.join(own.select(F.col("paper").alias("citer"), "author"), "citer")
    shared = citing.join(own.select(F.col("paper").alias("cited"), "author"), ["cited", "author"]).select("citer", "cited").distinct().groupBy("cited").agg(F.count(F.lit(1)).alias("self"))
    return in_degree(edges).join(shared, "cited", "left").select(F.col("cited").alias("paper"), "citers", F.coalesce("self", F.lit(0)).alias("self_citations"))


def citations_by_year(edges: DataFrame, papers: DataFrame, partial_year: int) -> DataFrame:
    """Per cited paper and each year from its own to the last complete one: citers of that year, 0 where none."""
    span = papers.where(F.col("year") < partial_year).select(F.col("paper").alias("cited"), F.explode(F.sequence("year", F.lit(partial_year - 1))).alias("at"))
    cited = edges.select("cited").distinct()
    counts = edges.join(papers.select(F.col("paper").alias("citer"), F.col("year").alias("at")), "citer").groupBy("cited", "at").agg(F.count(F.lit(1)).alias("n"))
    return span.join(cited, "cited", "left_semi").join(counts, ["cited", "at"], "left").select(F.col("cited").alias("paper"), F.col("at").alias("year"), F.coalesce("n", F.lit(0)).alias("citers"))


def coverage_figures(papers: DataFrame, edges: DataFrame, eligible: Column) -> DataFrame:
    """One row: papers that could have references, those that have some, and edges."""
    scanned = papers.where(eligible).join(edges.select(F.col("citer").alias("paper")).distinct(), "paper", "left_semi")
    return papers.agg(F.count_if(eligible).alias("eligible")).crossJoin(scanned.agg(F.count(F.lit(1)).alias("scanned"))).crossJoin(edges.agg(F.count(F.lit(1)).alias("edges")))


def star_components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for the nodes of edges (a, b); root is the smallest node reachable. Self-loops and repeated edges are harmless.

    Alternates large-star and small-star steps on stored tables until nothing changes; a round collects a count and a checksum. A
    star's centre may have a third of all edges: the joins are on a key that nothing is grouped by, so that both sides are exchanges of their
    own, which Spark splits where a partition is skewed.
    """

    def mark(df: DataFrame) -> tuple:
        r = df.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(a, b))").alias("x")).first()
        return r["n"], r["x"]

    key = F.xxhash64("a").alias("__k")

    def with_least(rows: DataFrame) -> DataFrame:
        least = rows.groupBy("a").agg(F.min("b").alias("m")).select(key, F.col("a").alias("__a"), "m")
        return rows.select(key, "a", "b").join(least, "__k").where("a = __a")

    now = stored(edges.where("a <> b").selectExpr("greatest(a, b) a", "least(a, b) b").distinct(), "graph")
    seen = mark(now)
    while seen[0]:
        large = with_least(now.unionByName(now.selectExpr("b a", "a b"))).where("b > a").selectExpr("b a", "least(a, m) b").distinct()
        small = with_least(large)
        now = stored(small.where("b <> m").selectExpr("b a", "m b").unionByName(large.groupBy("a").agg(F.min("b").alias("b"))).distinct(), "graph")
        if (after := mark(now)) == seen:
            break
        seen = after
    return now.selectExpr("a node", "b root").unionByName(now.selectExpr("b node", "b root").distinct())


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """star_components for all of ``nodes`` (column node): one without edges is its own root."""
    return nodes.select("node").distinct().join(star_components(edges), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def paper_clusters(authorship: DataFrame) -> DataFrame:
    """Per author: the groups that the author's papers fall into when two that share another co-author belong together. authorship: author, paper."""
    own = authorship.select("author", "paper").distinct()
    return clusters_by_coauthor(own.join(own.select(F.col("author").alias("co"), "paper"), "paper").select("author", "paper", "co"))


def clusters_by_coauthor(rows: DataFrame) -> DataFrame:
    """rows: author, paper, co (an author of it, the author included). As paper_clusters.

    A chain through each (author, co-author) pair's papers links them with one edge a paper, not one a pair of papers.
    """
    rows = rows.distinct()
    after = Window.partitionBy("author", "co").orderBy("paper")
    name = F.concat_ws("|", "author", F.lpad(F.col("paper").cast("string"), 20, "0"))
    chained = rows.where("author <> co").select("author", "co", "paper", name.alias("a"), F.lead(name).over(after).alias("b")).where("b is not null").select("a", "b")
    roots = connected(chained, rows.select(name.alias("node")))
    return roots.select(F.substring_index("node", "|", 1).alias("author"), "root").groupBy("author").agg(F.countDistinct("root").alias("clusters"))


def identity_conflicts(evidence: DataFrame, usual: int = 5) -> DataFrame:
    """evidence: name, paper, token (co-author or institution), surname_known. Names whose papers fall into groups that share no token, the second of
    which has two papers at least. A name with ``usual`` papers or more without any token is presumed to be one person: it has no row here."""
    own = evidence.select("name", "paper").distinct()
    node = F.concat_ws("|", "name", F.lpad(F.col("paper").cast("string"), 20, "0"))
    after = Window.partitionBy("name", "token").orderBy("paper")
    links = evidence.where("token is not null").select(node.alias("a"), F.lead(node).over(after).alias("b")).where("b is not null")
    roots = connected(links, own.select(node.alias("node"))).select(F.substring_index("node", "|", 1).alias("name"), "root")
    sizes = roots.groupBy("name", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("name").agg(F.sort_array(F.collect_list("n"), False).alias("s"))
    told = evidence.groupBy("name").agg(F.countDistinct("paper").alias("papers"), F.count("token").alias("tokens"))
    got = sizes.join(told, "name").where(~((F.col("papers") >= usual) & (F.col("tokens") == 0)))
    return got.select("name", F.size("s").cast("long").alias("groups"), ((F.size("s") >= 2) & (F.coalesce(F.get("s", F.lit(1)), F.lit(0)) >= 2)).alias("conflict"))


def ambiguity(authors: DataFrame, colliding_names: list[str], common_surnames: list[str]) -> DataFrame:
    """authors: author, clusters, lone, countries, papers_per_year, categories (all numbers). Adds score and tier.

    The name is a gate: without a name that several people share, structure counts a third and never asks for review.
    """
    words = F.split(F.lower(F.trim("author")), r"\s+")
    two = F.size(words) == 2
    prior = F.when(two & F.array_join(words, " ").isin(colliding_names), 2).when(two & F.element_at(words, -1).isin(common_surnames), 1).otherwise(0)

    def ladder(c: str, *steps: tuple[float, float]) -> Column:
        got = F.lit(0.0)
        for least, points in steps:
            got = F.when(F.col(c) >= least, points).otherwise(got)
        return got

    structure = ladder("clusters", (3, 1.0), (4, 2.0), (6, 3.0)) + ladder("lone", (2, 1.0), (4, 2.0)) + ladder("countries", (2, 0.5), (3, 1.5)) + F.when(F.col("papers_per_year") > 18, 2.0).when(F.col("papers_per_year") > 12, 1.0).otherwise(0.0) + ladder("categories", (10, 0.5))
    got = authors.withColumn("prior", prior).withColumn("structure", structure)
    high = (F.col("prior") == 2) & (F.col("clusters") >= 4) & (F.col("structure") >= 3)
    review = (F.col("clusters") >= 3) & (F.col("structure") >= 2)
    score = server_round(F.when(F.col("prior") == 0, F.col("structure") * 0.35).otherwise(F.col("prior") + F.col("structure")), 1)
    tier = F.when(F.col("prior") == 0, "prolific-single-likely").when(high, "high-confidence").when(review, "review").otherwise("weak")
    return got.withColumn("score", score).withColumn("tier", tier).drop("structure", "prior")


def citing_papers(edges: DataFrame, papers: DataFrame, authorship: DataFrame) -> DataFrame:
    """Per edge whose citer is known: the citer's columns, and whether it shares an author with the cited paper. papers: paper and what is shown of a citer."""
    own = authorship.select("paper", "author").distinct()
    shared = edges.join(own.select(F.col("paper").alias("citer"), "author"), "citer").join(own.select(F.col("paper").alias("cited"), "author"), ["cited", "author"]).select("citer", "cited").distinct()
    got = edges.join(papers.withColumnRenamed("paper", "citer"), "citer").join(shared.withColumn("self", F.lit(True)), ["citer", "cited"], "left")
    return got.withColumn("self", F.coalesce("self", F.lit(False)))


def citers_in_order(edges: DataFrame, papers: DataFrame) -> DataFrame:
    """cited, citer, year, place: a paper's citers by year, unknown years first, equal years by citer. The order is one of ranges over all edges, so a
    paper that very many cite is no single task."""
    from .rank import global_rank

    dated = edges.join(papers.select(F.col("paper").alias("citer"), "year"), "citer").select("cited", "citer", "year")
    ranked = global_rank(dated, [F.asc("cited"), F.asc_nulls_first("year"), F.asc("citer")], "__r")
    first = ranked.groupBy("cited").agg(F.min("__r").alias("__first"))
    return ranked.join(first, "cited").select("cited", "citer", "year", (F.col("__r") - F.col("__first") + 1).alias("place"))


def dataset_adoption(seeds: DataFrame, papers: DataFrame, edges: DataFrame) -> DataFrame:
    """seeds: label, place, paper; papers: paper, year. Per label with a known seed paper: the first of them, its year, how many others there are, and the
    papers that cite any of them, each once."""
    known = seeds.join(papers.select("paper", "year"), "paper")
    primary = known.groupBy("label").agg(F.min_by(F.struct("paper", "year"), "place").alias("p"), (F.count(F.lit(1)) - 1).alias("others"))
    citers = known.select("label", F.col("paper").alias("cited")).join(edges, "cited").join(papers.select(F.col("paper").alias("citer")), "citer", "left_semi").select("label", "citer").distinct()
    counts = citers.groupBy("label").agg(F.count(F.lit(1)).alias("citing"))
    return primary.join(counts, "label", "left").select("label", F.col("p.paper").alias("paper"), F.col("p.year").alias("year"), "others", F.coalesce("citing", F.lit(0)).alias("citing"))
