"""The citation graph of the proxy tables, text matching and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import plain_key
from ..operators import graph, matcher, merge
from ..streaming import intake
from . import proxies
from .proxies import ALL
from .registry import query


@query(f"{ALL} SELECT citer, cited FROM edges")
def edges_build(spark, sf_dir):
    return graph.union_edges(proxies.edges(spark, sf_dir), proxies.edges(spark, sf_dir, 2))


@query(f"{ALL} SELECT cited, count(*) AS citers FROM edges GROUP BY cited")
def indegree(spark, sf_dir):
    return graph.in_degree(proxies.edges(spark, sf_dir))


@query(f"""{ALL}, a AS (SELECT DISTINCT paper, author FROM authorship) SELECT cited AS paper, count(*) AS citers, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM a x JOIN a y ON x.author = y.author WHERE x.paper = e.citer AND y.paper = e.cited)) AS self_citations FROM edges e GROUP BY cited""")
def self_citation(spark, sf_dir):
    return graph.self_citations(proxies.edges(spark, sf_dir), proxies.authorship(spark, sf_dir))


@query(f"""{ALL} SELECT citer, cited FROM edges JOIN papers a ON a.paper = citer JOIN papers b ON b.paper = cited WHERE NOT (a.year < b.year - 2)
    UNION ALL SELECT cited, citer FROM edges JOIN papers a ON a.paper = cited JOIN papers b ON b.paper = citer WHERE NOT (a.year < b.year - 2)""")
def year_guard(spark, sf_dir):
    e = proxies.edges(spark, sf_dir)
    both = e.unionByName(e.select(F.col("cited").alias("citer"), F.col("citer").alias("cited")))
    return graph.year_guard(both, proxies.papers(spark, sf_dir))


@query(f"""{ALL}, n AS (SELECT cited, count(*) AS n_citers FROM edges GROUP BY cited HAVING count(*) >= 3),
    v AS (SELECT e.cited, CASE WHEN EXISTS (SELECT 1 FROM edges r JOIN edges x ON x.cited = r.cited WHERE r.citer = e.cited AND x.citer = e.citer) THEN -1 ELSE 1 END AS v FROM edges e)
    SELECT cited AS paper, any_value(n_citers) AS n_citers, round_even(sum(v) / count(*), 3) AS cd_index FROM n JOIN v USING (cited) WHERE cited IN (SELECT citer FROM edges) GROUP BY cited""")
def cd_index(spark, sf_dir):
    return graph.disruption(proxies.edges(spark, sf_dir), 3)


@query(f"""{ALL} SELECT t.paper, count(*) FILTER (WHERE c.year <= t.year + 2) AS early_citations FROM papers t LEFT JOIN edges e ON e.cited = t.paper LEFT JOIN papers c ON c.paper = e.citer WHERE 2001 - t.year >= 2 GROUP BY t.paper""")
def early_citations(spark, sf_dir):
    return graph.early_citations(proxies.edges(spark, sf_dir), proxies.papers(spark, sf_dir), 2001)


@query(f"""{ALL}, k AS (SELECT * FROM papers WHERE paper % 3 <> 0) SELECT citer, cited FROM edges WHERE citer IN (SELECT paper FROM k) AND cited IN (SELECT paper FROM k)""")
def carried_edges(spark, sf_dir):
    return graph.carried_edges(proxies.edges(spark, sf_dir), proxies.papers(spark, sf_dir).where("paper % 3 <> 0"), "paper")


@query(f"""{ALL}, c AS (SELECT DISTINCT cited FROM edges), s AS (SELECT p.paper, CAST(unnest(generate_series(p.year, 2000)) AS INTEGER) AS year FROM papers p WHERE p.year < 2001 AND p.paper IN (SELECT cited FROM c))
    SELECT s.paper, s.year, count(x.paper) AS citers FROM s LEFT JOIN (edges e JOIN papers x ON x.paper = e.citer) ON e.cited = s.paper AND x.year = s.year GROUP BY s.paper, s.year""")
def citations_by_year(spark, sf_dir):
    return graph.citations_by_year(proxies.edges(spark, sf_dir), proxies.papers(spark, sf_dir), 2001)


@query(f"""{ALL} SELECT (SELECT count(*) FROM papers WHERE category = 'F') AS eligible, (SELECT count(*) FROM papers WHERE category = 'F' AND paper IN (SELECT citer FROM edges)) AS scanned, (SELECT count(*) FROM edges) AS edges""")
def coverage_figures(spark, sf_dir):
    return graph.coverage_figures(proxies.papers(spark, sf_dir), proxies.edges(spark, sf_dir), F.col("category") == "F")


@query(f"""{ALL}, r AS (SELECT citer, cited * 7 + 3 AS id FROM edges), i AS (SELECT paper AS key, paper * 7 + 3 AS id FROM papers WHERE citations IS NOT NULL) SELECT DISTINCT citer, key AS cited FROM r JOIN i USING (id) WHERE citer <> key""")
def id_edges(spark, sf_dir):
    """Papers without a number of citations have no id here, so references to them go."""
    references = proxies.edges(spark, sf_dir).select("citer", (F.col("cited") * 7 + 3).alias("id"))
    ids = proxies.papers(spark, sf_dir).where("citations is not null").select(F.col("paper").alias("key"), (F.col("paper") * 7 + 3).alias("id"))
    return graph.id_edges(references, ids)


@query(f"""WITH RECURSIVE {ALL[5:]}, e AS (SELECT citer AS a, cited AS b FROM edges UNION SELECT cited, citer FROM edges), n AS (SELECT DISTINCT a AS node FROM e),
    reach AS (SELECT node, node AS seen FROM n UNION SELECT reach.node, e.b FROM reach JOIN e ON e.a = reach.seen) SELECT node, min(seen) AS root FROM reach GROUP BY node""")
def components(spark, sf_dir):
    e = proxies.edges(spark, sf_dir).select(F.col("citer").alias("a"), F.col("cited").alias("b"))
    nodes = e.select(F.col("a").alias("node")).unionByName(e.select(F.col("b").alias("node")))
    return graph.connected(e, nodes)


@query(f"""WITH RECURSIVE {ALL[5:]}, s AS (SELECT DISTINCT reader AS author, paper FROM papers JOIN authorship USING (paper)), c AS (SELECT DISTINCT s.author, s.paper, a.author AS co FROM s JOIN authorship a USING (paper)),
    e AS (SELECT DISTINCT x.author, x.paper AS a, y.paper AS b FROM c x JOIN c y ON x.author = y.author AND x.co = y.co), reach AS (SELECT author, paper, paper AS seen FROM s UNION SELECT reach.author, reach.paper, e.b FROM reach JOIN e ON e.author = reach.author AND e.a = reach.seen),
    r AS (SELECT author, paper, min(seen) AS root FROM reach GROUP BY author, paper) SELECT CAST(author AS VARCHAR) AS author, count(DISTINCT root) AS clusters FROM r GROUP BY author""")
def author_clusters(spark, sf_dir):
    """Each reader is an author of the papers read; the suppliers on them are the co-authors."""
    own = proxies.authorship(spark, sf_dir).select("paper", "author").distinct().join(proxies.papers(spark, sf_dir).select("paper", "reader"), "paper")
    return graph.clusters_by_coauthor(own.select(F.col("reader").cast("string").alias("author"), "paper", F.col("author").alias("co")))


@query("""WITH k AS (SELECT doc_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents), b AS (SELECT item_id, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM benchmark)
    SELECT d.doc_id, b.item_id FROM k d JOIN b ON contains(d.k, b.k) WHERE length(b.k) >= 16""")
def passage_contained(spark, sf_dir):
    """Passages in a text, from a word's start on: the first letters from each word meet those of the passages by a join, then the whole passage is compared."""
    items = proxies.table(spark, sf_dir, "benchmark").select("item_id", plain_key(F.col("text")).alias("k")).where("length(k) >= 16").withColumn("prefix", F.substring("k", 1, 16))
    docs = proxies.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("t"))
    heads = F.regexp_extract_all("t", F.lit("(?<![a-z0-9])(?=((?:[a-z0-9][^a-z0-9]*){16}))"), 1)
    # the passages' first letters are few: while they are, no other place of a text leaves its row
    most = 10_000
    few = [r["prefix"] for r in items.select("prefix").distinct().limit(most + 1).collect()]
    places = F.array_distinct(F.transform(heads, lambda h: F.regexp_replace(h, "[^a-z0-9]", "")))
    if len(few) <= most:
        places = F.array_intersect(places, F.lit(few).cast("array<string>")) if few else F.array().cast("array<string>")
    windows = docs.select("doc_id", F.explode(places).alias("prefix"))
    found = windows.join(items.select("item_id", "prefix"), "prefix").select("doc_id", "item_id").distinct()
    keyed = docs.select("doc_id", plain_key(F.col("t")).alias("t"))
    return found.join(keyed, "doc_id").join(items.select("item_id", "k"), "item_id").where(F.expr("contains(t, k)")).select("doc_id", "item_id")


@query("""WITH t AS (SELECT p_partkey, p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k, len(regexp_extract_all(p_name, '[A-Za-z0-9]+')) AS words, p_size AS y FROM part),
    i AS (SELECT k, min(words) < 3 OR length(k) < 15 AS short, min(1990 + y % 10) AS low, max(1990 + y % 10) AS high FROM t GROUP BY k), e AS (SELECT p_partkey AS citer, k, 1990 + (p_partkey % 12) AS y FROM t)
    SELECT DISTINCT citer, k AS cited FROM e JOIN i USING (k) WHERE NOT short OR y BETWEEN low - 1 AND high + 1""")
def passage_cited(spark, sf_dir):
    """Titles that reference texts cite as whole parts of them: each part's name, between authors and venue of a made reference; two words need a year nearby."""
    part = proxies.table(spark, sf_dir, "part")
    raw = F.concat(F.lit("A. Author and B. Writer. "), F.col("p_name"), F.lit(". In Proc. of Things, "), (F.lit(1990) + F.col("p_partkey") % 12).cast("string"), F.lit("."))
    titles = part.select(F.col("p_name").alias("title"), (F.lit(1990) + F.col("p_size") % 10).alias("year"))
    return matcher.cited_titles(part.select(F.col("p_partkey").alias("citer"), raw.alias("raw")), titles)


@query()
def benchmark_cited(spark, sf_dir):
    """Benchmark passages that whole documents hold by the rules for titles; no SQL has these rules, a test compares a plain search."""
    references = proxies.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("citer"), F.col("text").alias("raw"))
    titles = proxies.table(spark, sf_dir, "benchmark").select(F.col("text").alias("title"), F.lit(None).cast("int").alias("year"))
    return matcher.cited_titles(references, titles)


@query("""WITH k AS (SELECT doc_id, source, lang, regexp_replace(lower(text), '[^a-z0-9]', '', 'g') AS k FROM documents) SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY source, doc_id) AS r FROM k WHERE k <> '') WHERE r = 1""")
def dedup_priority(spark, sf_dir):
    docs = proxies.table(spark, sf_dir, "documents")
    return merge.priority_dedup(docs, plain_key(F.col("text")), [F.asc("source"), F.asc("doc_id")]).select("doc_id", "source")


@query("""WITH k AS (SELECT doc_id, text AS k, CASE WHEN doc_id % 3 = 0 THEN source END AS link FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS r FROM k WHERE k <> ''),
    o AS (SELECT k, arg_min(link, doc_id) AS offer FROM r WHERE r > 1 AND link IS NOT NULL AND doc_id % 2 = 0 GROUP BY k) SELECT doc_id, coalesce(link, offer) AS link FROM r LEFT JOIN o USING (k) WHERE r = 1""")
def dedup_fill(spark, sf_dir):
    docs = proxies.table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("source")).alias("link"))
    return merge.priority_dedup(docs, F.col("text"), [F.asc("doc_id")], "link", F.col("doc_id") % 2 == 0).select("doc_id", "link")


@query("""WITH n AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS lang FROM documents), p AS (SELECT doc_id % 100 AS doc_id, arg_max(source, doc_id) AS lang FROM documents GROUP BY 1) SELECT n.doc_id, coalesce(nullif(n.lang, ''), p.lang) AS lang FROM n LEFT JOIN p ON n.doc_id = p.doc_id""")
def carry_over_fill(spark, sf_dir):
    docs = proxies.table(spark, sf_dir, "documents")
    now = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("").alias("lang"))
    prior = docs.select((F.col("doc_id") % 100).alias("doc_id"), F.col("source").alias("lang"), F.col("doc_id").alias("run"))
    return merge.carry_over(now, prior, "doc_id", ["lang"], "run")


@query("""SELECT doc_id, 'semi' AS side FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) UNION ALL SELECT doc_id, 'anti' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def semi_anti(spark, sf_dir):
    docs, labels = (proxies.table(spark, sf_dir, t).select("doc_id") for t in ("documents", "labels"))
    return docs.join(labels, "doc_id", "left_semi").withColumn("side", F.lit("semi")).unionByName(docs.join(labels, "doc_id", "left_anti").withColumn("side", F.lit("anti")))


@query("""WITH r AS (SELECT o_orderkey AS row, o_custkey AS k, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 2 = 0), c AS (SELECT o_orderkey AS id, o_custkey AS k, year(o_orderdate) AS y FROM orders WHERE o_orderkey % 2 = 1),
    m AS (SELECT row, id, row_number() OVER (PARTITION BY row ORDER BY abs(r.y - c.y), id) AS n FROM r JOIN c USING (k) WHERE abs(r.y - c.y) <= 1) SELECT r.row, m.id AS match FROM r LEFT JOIN m ON m.row = r.row AND m.n = 1""")
def nearest_year(spark, sf_dir):
    p = proxies.papers(spark, sf_dir).select("paper", "reader", "year")
    rows = p.where("paper % 2 = 0").withColumnRenamed("paper", "row")
    return merge.closest_year(rows, p.where("paper % 2 = 1").withColumnRenamed("paper", "id"), "reader").select("row", "match")


@query("""WITH o AS (SELECT o_orderkey AS row, CASE WHEN o_orderkey % 4 = 0 THEN o_custkey END AS strong, CAST(floor(o_totalprice) AS BIGINT) % 997 AS weak FROM orders), r AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_custkey END AS strong, CAST(floor(abs(c_acctbal)) AS BIGINT) % 997 AS weak FROM customer),
    s AS (SELECT strong, min(id) AS s FROM r WHERE strong IS NOT NULL GROUP BY strong), w AS (SELECT weak, min(id) AS w FROM r GROUP BY weak HAVING count(*) = 1)
    SELECT o.row, coalesce(s.s, w.w) AS match, CASE WHEN s.s IS NOT NULL THEN 'strong' WHEN w.w IS NOT NULL THEN 'weak' END AS via FROM o LEFT JOIN s ON s.strong = o.strong LEFT JOIN w ON w.weak = o.weak""")
def two_key_match(spark, sf_dir):
    orders, customers = proxies.table(spark, sf_dir, "orders"), proxies.table(spark, sf_dir, "customer")
    rows = orders.select(F.col("o_orderkey").alias("row"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_custkey")).alias("strong"), (F.floor("o_totalprice") % 997).alias("weak"))
    records = customers.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_custkey")).alias("strong"), (F.floor(F.abs("c_acctbal")) % 997).alias("weak"))
    return merge.two_key_match(rows, records, "strong", "weak").select("row", "match", "via")


@query("""SELECT o_orderkey AS key, CASE WHEN o_custkey % 5 = 0 THEN o_custkey WHEN o_custkey % 3 = 0 THEN o_custkey * 10 END AS id, CASE WHEN o_custkey % 5 = 0 THEN 'first' WHEN o_custkey % 3 = 0 THEN 'second' END AS via FROM orders""")
def cascading_ids(spark, sf_dir):
    orders = proxies.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_custkey").alias("c"))
    people = orders.select("c").distinct()
    passes = [("first", people.where("c % 5 = 0").select("c", F.col("c").alias("id"))), ("second", people.where("c % 3 = 0").select("c", (F.col("c") * 10).alias("id")))]
    return merge.resolve(orders, passes, "c").select("key", "id", "via")


@query(f"""{ALL}, n AS (SELECT cited AS paper, count(*) AS n FROM edges GROUP BY cited) SELECT p.paper, coalesce(n, 0) AS count, CASE WHEN coalesce(n, 0) = coalesce(p.citations, -1) % 4 THEN '1990-01-01' ELSE '2000-01-01' END AS updated FROM papers p LEFT JOIN n USING (paper) WHERE p.citations IS NOT NULL""")
def stamp_counts(spark, sf_dir):
    counts = graph.in_degree(proxies.edges(spark, sf_dir)).select(F.col("cited").alias("paper"), F.col("citers").alias("n"))
    papers = proxies.papers(spark, sf_dir).where("citations is not null").select("paper", (F.col("citations") % 4).alias("count"), F.lit("1990-01-01").alias("updated"))
    return merge.stamp_counts(papers, counts, "paper", "2000-01-01")


@query("""WITH b AS (SELECT event_id AS id, user_id AS key, CAST(year(ts) AS INTEGER) AS year, event_id AS pos, event_type FROM events), o AS (SELECT *, CASE WHEN id % 11 = 0 THEN 'seen' WHEN event_type = 'error' THEN 'withdrawn' WHEN event_type NOT IN ('click', 'purchase', 'view') THEN 'off_topic' WHEN key % 7 = 0 THEN 'known' END AS first FROM b),
    r AS (SELECT *, coalesce(first, CASE WHEN row_number() OVER (PARTITION BY key, first IS NULL ORDER BY pos) > 1 THEN 'repeated' ELSE 'accepted' END) AS outcome FROM o) SELECT outcome, count(*) AS n FROM r GROUP BY outcome""")
def intake_funnel(spark, sf_dir):
    batch = proxies.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), F.year("ts").alias("year"), F.col("event_id").alias("pos"), "event_type")
    ids, keys = batch.where("id % 11 = 0").select("id"), batch.where("key % 7 = 0").select("key").distinct()
    got = merge.intake(batch, 1900, F.col("event_type").isin("click", "purchase", "view"), F.col("event_type") == "error", ids, keys)
    return merge.funnel(got)


@query("SELECT event_id, user_id, event_type FROM events WHERE true QUALIFY row_number() OVER (PARTITION BY event_id) = 1")
def stream_ledger(spark, sf_dir):
    return intake.ingest(spark, f"{sf_dir}/events.parquet", "event_id", ["event_id", "user_id", "event_type"])


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def late_corrections(spark, sf_dir):
    return intake.latest_versions(proxies.table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH w AS (SELECT greatest(CAST(max(ts) AS DATE) - 3, DATE '1990-01-01') AS a FROM events) SELECT count(*) AS n, any_value(a) AS window_start FROM events, w WHERE ts >= a""")
def overlap_window(spark, sf_dir):
    from ..functions.values import window_start

    events = proxies.table(spark, sf_dir, "events")
    start = events.agg(window_start(F.to_date(F.max("ts")), F.lit("1990-01-01").cast("date")).alias("window_start"))
    return events.crossJoin(F.broadcast(start)).where(F.col("ts") >= F.col("window_start")).agg(F.count(F.lit(1)).alias("n"), F.first("window_start").alias("window_start"))
