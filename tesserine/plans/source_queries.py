"""Sources, names, rules and identities over made records of the proxy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import classify, graph, merge, people
from ..scratch import scratch_path
from ..sources import listings
from . import proxies
from .proxies import ALL
from .registry import query


def _table(spark, sf_dir, name):
    return proxies.table(spark, sf_dir, name)


@query("""SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'Vision' WHEN c_nationkey % 3 = 1 THEN 'Robots' END AS venue, CASE WHEN c_nationkey % 3 < 2 THEN 2000 + c_nationkey % 3 END AS year, CASE WHEN c_nationkey % 3 = 2 THEN 'pull' ELSE 'venue_listing' END AS source,
    CAST(CASE WHEN c_nationkey % 3 = 0 THEN 2 WHEN c_nationkey % 3 = 1 THEN 1 ELSE 3 END AS BIGINT) AS file_place FROM customer""")
def listing_files(spark, sf_dir):
    """Customers as three JSON listings, read back in the order of the files: venue and year by a file's name."""
    folder = scratch_path(spark, "listings")
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 3).alias("k"))
    names = {0: "vis_2000.json", 1: "rob_2001.json", 2: "arxiv_pull.json"}
    for k, name in names.items():
        rows.where(F.col("k") == k).select("c_custkey").write.mode("overwrite").json(f"{folder}/{name}")
    schema = "c_custkey long"
    parts = [spark.read.schema(schema).option("mode", "FAILFAST").json(f"{folder}/{name}").withColumn("file", F.lit(name)) for name in names.values()]
    got = parts[0].unionByName(parts[1]).unionByName(parts[2])
    venue, year = listings.venue_from_file(F.col("file"), {"vis": "Vision", "rob": "Robots"})
    late = F.col("file").startswith("arxiv").cast("int")
    place = got.select("file", late.alias("late")).distinct()
    order = place.crossJoin(place.select(F.col("file").alias("f"), F.col("late").alias("l"))).where("struct(l, f) <= struct(late, file)").groupBy("file").agg(F.count(F.lit(1)).alias("file_place"))
    return got.join(order, "file").select("c_custkey", venue.alias("venue"), year.alias("year"), listings.source_tag(F.col("file"), {"arxiv": "pull"}).alias("source"), "file_place")


@query("""SELECT p_partkey, 0 AS entry, p_name AS title, p_brand AS authors FROM part UNION ALL SELECT p_partkey, 1, p_name || ' II', p_type FROM part""")
def strict_listing(spark, sf_dir):
    page = F.concat(F.lit('<ul><li class="entry"><b>'), F.col("p_name"), F.lit("</b> <i>"), F.col("p_brand"), F.lit('</i></li><li class="entry"><b>'), F.col("p_name"), F.lit(" II</b> <i> "), F.col("p_type"), F.lit("</i></li></ul>"))
    got = listings.strict_entries(_table(spark, sf_dir, "part").select("p_partkey", page.alias("html")), "html", '<li class="entry"', {"title": "<b>(.*?)</b>", "authors": "<i>(.*?)</i>"})
    return got.select("p_partkey", "entry", "title", "authors")


@query("""SELECT s_name AS file, 0 AS pos, 'A Title of ' || s_suppkey AS title, 'Ann Lee, Bob Ray' AS authors FROM supplier UNION ALL SELECT s_name, 1, 'Linked ' || s_suppkey, 'Cy Fox' FROM supplier UNION ALL SELECT s_name, 2, 'Tabled ' || s_suppkey, 'Di Gray' FROM supplier""")
def markdown_lists(spark, sf_dir):
    key = F.col("s_suppkey").cast("string")
    body = F.concat(F.lit("# Contents\n- [Not a paper](#a)\n## Papers\n- **A Title of "), key, F.lit("** - Ann Lee, Bob Ray [pdf](http://x)\n* [Linked "), key, F.lit("](http://y) Cy Fox\n\n| Year | Paper | Authors |\n|--|--|--|\n| 2020 | [Tabled "), key, F.lit("](http://z) | Di Gray |\n"))
    return listings.markdown_papers(_table(spark, sf_dir, "supplier").select(F.col("s_name").alias("file"), body.alias("body")))


@query("""SELECT o_orderkey, 0 AS pos, 'id' || o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS created, 'On ' || o_orderpriority || ' & more' AS title, 2 AS categories, 'token' || o_orderkey AS token FROM orders
    UNION ALL SELECT o_orderkey, 1, 'idb' || o_orderkey, NULL, 'Second', 1, 'token' || o_orderkey FROM orders""")
def harvest_pages(spark, sf_dir):
    key = F.col("o_orderkey").cast("string")
    page = F.concat(F.lit("<r><record><metadata><id>id"), key, F.lit("</id><created>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</created><title>On "), F.col("o_orderpriority"), F.lit(" &amp;\n more</title><categories>cs.CV cs.RO</categories></metadata></record><record><id>idb"), key, F.lit("</id><title>Second</title><categories>cs.CV</categories></record><resumptionToken size='2'>token"), key, F.lit("</resumptionToken></r>"))
    got = listings.oai_records(_table(spark, sf_dir, "orders").select(page.alias("xml")), "xml")
    return got.select(F.substring("token", 6, 20).cast("long").alias("o_orderkey"), "pos", "id", "created", "title", F.size("categories").alias("categories"), "token")


_NAME = "'Ann ' || translate(substr(s_name, 10), '0123456789', 'abcdefghij')"


@query(f"""SELECT s_suppkey, CASE WHEN s_suppkey % 8 = 7 THEN NULL ELSE {_NAME} END AS name, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END AS people FROM supplier""")
def author_names(spark, sf_dir):
    """Names with titles, degrees, numbers, marks and turned round, as the same clean name; what isn't a name is none."""
    key, first, last = F.col("s_suppkey"), F.lit("Ann"), F.translate(F.substring("s_name", 10, 20), "0123456789", "abcdefghij")
    name = F.concat_ws(" ", first, last)
    forms = [F.concat(F.lit("Prof. Dr. "), name), F.concat(last, F.lit(", "), first), F.concat(name, F.lit(", Ph.D.")), F.concat(name, F.lit(" 0002")), F.concat(name, F.lit("\\textsuperscript{1}")), F.concat(name, F.lit(", Senior Member, IEEE")), F.concat(F.lit("2nd "), name, F.lit("†"))]
    raw = F.lit("Equal contribution")
    for k, form in enumerate(forms):
        raw = F.when(key % 8 == k, form).otherwise(raw)
    joined = F.when(key % 2 == 0, F.concat(name, F.lit(", Bob Ray"))).otherwise(F.concat(last, F.lit(", Ann")))
    return _table(spark, sf_dir, "supplier").select("s_suppkey", text.author_name(raw).alias("name"), F.size(text.split_joined(joined)).alias("people"))


@query("""SELECT n_name, 'University of ' || n_name AS institution, n_nationkey % 4 = 0 AS valid FROM nation""")
def institution_names(spark, sf_dir):
    """Institutions without addresses, footnotes, postcodes and endings; and whether a value is one at all."""
    key, name = F.col("n_nationkey"), F.concat(F.lit("University of "), F.col("n_name"))
    forms = [F.concat(F.lit("1 "), name, F.lit(", Germany")), F.concat(name, F.lit(", 76131")), F.concat(name, F.lit(" a.b@x.edu")), F.concat(F.lit("† "), name, F.lit(" Ltd."))]
    raw = F.lit("Old Name")
    for k, form in enumerate(forms):
        raw = F.when(key % 4 == k, form).otherwise(raw)
    shaped = F.when(key % 4 == 0, name).when(key % 4 == 1, "12 Main Street").when(key % 4 == 2, "a.b@x.edu").otherwise(F.concat(F.lit("Department of "), F.col("n_name")))
    return _table(spark, sf_dir, "nation").select("n_name", text.institution(raw, {}, {}).alias("institution"), text.valid_institution(shaped).alias("valid"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'Net' || p_size WHEN p_partkey % 3 = 1 THEN 'Two Words' END AS short, 'α' || translate(CAST(p_size AS VARCHAR), '0123456789', '₀₁₂₃₄₅₆₇₈₉') || ' of ' || p_name AS plain, p_partkey % 2 = 0 AS close FROM part""")
def title_forms(spark, sf_dir):
    """What a paper calls itself, formulas in plain signs, and whether two titles are one."""
    key, size = F.col("p_partkey"), F.col("p_size").cast("string")
    title = F.when(key % 3 == 0, F.concat(F.lit("Net"), size, F.lit(": Seeing things"))).when(key % 3 == 1, "Two Words - Something else").otherwise("nothing of that kind")
    formula = F.concat(F.lit("$\\alpha_{"), size, F.lit("}$ of "), F.col("p_name"))
    other = F.when(key % 2 == 0, F.concat(F.upper("p_name"), F.lit("!"))).otherwise("0")
    return _table(spark, sf_dir, "part").select("p_partkey", text.short_name(title).alias("short"), text.latex_to_plain(formula).alias("plain"), text.title_close(0.9)(F.col("p_name"), other).alias("close"))


@query("""SELECT doc_id, coalesce(regexp_matches(text, '(?i)github\\.com|gitlab\\.com|\\b(?:code|source code|implementation)\\b[^.]{0,60}\\b(?:available|released?|open[- ]?sourced?|public(?:ly)?)\\b'), false) AS code,
    md5(regexp_replace(lower(text), '\\b(?:with the|the|of)\\b', ' ', 'g')) AS masked FROM documents""")
def abstract_signals(spark, sf_dir):
    t = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", F.coalesce(text.code_link(F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), t), F.lit(False)).alias("code"), F.md5(text.without_senses(t, ["the", "of", "with the"])).alias("masked"))


@query(f"""{ALL}, a AS (SELECT paper, len(list(DISTINCT author)) AS n FROM authorship GROUP BY paper) SELECT paper, CASE WHEN paper % 3 = 0 THEN true WHEN paper % 3 = 1 THEN n <= 1 ELSE false END AS plausible, paper % 2 = 0 AS shared, paper % 5 = 0 AS garbled FROM a""")
def detail_checks(spark, sf_dir):
    """Detailed lists against listed names: the same names, or half of them strangers; lists that authors share; names cut to pieces."""
    rows = proxies.credited(spark, sf_dir).select("paper", F.array_sort(F.array_distinct("authors")).alias("a"))
    key = F.col("paper")
    strangers = F.transform("a", lambda x, k: F.when(k == 0, x).otherwise(F.concat(F.lit("x"), x)))
    detail = F.when(key % 3 == 0, F.col("a")).when(key % 3 == 1, F.when(F.size("a") <= 1, F.col("a")).otherwise(F.transform(strangers, lambda x: F.concat(F.lit("y"), x)))).otherwise(F.array().cast("array<string>"))
    two = F.array(F.lit("U"), F.lit("V"))
    institutions = F.when(key % 2 == 0, F.array(two, two)).otherwise(F.array(two, F.array(F.lit("W"))))
    names = F.when(key % 5 == 0, F.array(F.lit("A"), F.lit("Bo"))).otherwise(F.array(F.lit("A"), F.lit("Bob")))
    return rows.select("paper", people.plausible_detail(F.col("a"), detail).alias("plausible"), people.shared_block(institutions).alias("shared"), people.garbled(names).alias("garbled"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand || '|' || p_type || '|' || p_brand || '|' || p_type ELSE 'Bob Ray' END AS rebuilt, 'University|Ann Lee of a place that goes on for long' AS kept FROM part""")
def repaired_details(spark, sf_dir):
    """Cut names rebuilt from the list, all with the first one's places; values that begin with a co-author's name go."""
    odd = F.col("p_size") % 2 == 1
    places = F.array(F.array("p_brand", "p_type"), F.array("p_type"))
    got = people.repaired_detail(F.when(odd, F.array(F.lit("Ann Lee"), F.lit("Bob Ray"))).otherwise(F.array(F.lit("A"), F.lit("B"))), places, F.lit("Ann Lee, Bob Ray"))
    whole = F.array_join(F.flatten(F.transform(got, lambda x: x["affiliations"])), "|")
    kept = people.without_leaks(F.array(F.lit("University"), F.lit("Ann Lee Lab"), F.lit("Ann Lee of a place that goes on for long"), F.lit("University")), F.array(F.lit("Ann Lee")))
    return _table(spark, sf_dir, "part").select("p_partkey", F.when(odd, F.get(got, F.lit(1))["name"]).otherwise(whole).alias("rebuilt"), F.array_join(kept, "|").alias("kept"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 AND p_size % 3 > 0 AND p_size % 2 = 1 THEN 'deep' WHEN p_partkey % 2 = 0 THEN 'flat' ELSE 'other' END AS category FROM part""")
def specific_category(spark, sf_dir):
    part = _table(spark, sf_dir, "part")
    best = part.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, "flat").otherwise("other").alias("category"))
    flat = part.select("p_partkey", F.lit("flat").alias("category"), F.lit(1).alias("title_score"), F.lit(5).alias("longest"))
    deep = part.select("p_partkey", F.lit("deep").alias("category"), (F.col("p_size") % 3).cast("int").alias("title_score"), F.when(F.col("p_size") % 2 == 1, 9).otherwise(5).alias("longest"))
    return classify.prefer_specific(best, flat.unionByName(deep), "p_partkey", "flat", "deep")


@query("""WITH s AS (SELECT CAST(o_totalprice AS DOUBLE) AS s, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS t FROM orders), e AS (SELECT min(s) AS lo, max(s) AS hi FROM s),
    c AS (SELECT least(39, CAST(floor((s - lo) / (hi - lo) * 40) AS INTEGER)) AS cell, any_value(lo) AS lo, any_value(hi) AS hi, count(*) FILTER (WHERE t = 1) AS p, count(*) AS n FROM s, e GROUP BY 1),
    r AS (SELECT lo + (hi - lo) * cell / 40 AS threshold, sum(p) OVER (ORDER BY cell DESC) AS tp, sum(n) OVER (ORDER BY cell DESC) AS said, sum(p) OVER () AS positive FROM c)
    SELECT CAST(floor(threshold) AS BIGINT) AS threshold, round(tp / said, 9) AS precision, round(tp / positive, 9) AS recall, tp / said >= 0.34 AS meets FROM r""")
def threshold_sweep(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("s"), F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(0).alias("t"))
    got = classify.threshold_sweep(rows, "s", "t", 40, 0.34)
    return got.select(F.floor("threshold").alias("threshold"), F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"), "meets")


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'Journal' ELSE 'Conference' END AS venue, CASE WHEN p_size % 2 = 0 THEN 'Conference ' || 2000 + p_size % 5 END AS presented_at, CASE WHEN p_size % 2 = 0 AND p_size % 4 = 0 THEN p_type ELSE p_brand END AS note FROM part""")
def journal_takeover(spark, sf_dir):
    """A conference paper for each part, and a journal's record of the even ones after it, half of which lack the note."""
    part = _table(spark, sf_dir, "part")
    year = F.lit(2000) + F.col("p_size") % 5
    first = part.select("p_partkey", F.lit(1).alias("place"), F.lit("Conference").alias("venue"), year.alias("year"), F.col("p_brand").alias("note"))
    later = part.where("p_size % 2 = 0").select("p_partkey", F.lit(2).alias("place"), F.lit("Journal").alias("venue"), (year + 1).alias("year"), F.when(F.col("p_size") % 4 == 0, F.col("p_type")).alias("note"))
    got = merge.journal_takeover(first.unionByName(later), "p_partkey", [F.asc("place")], ["Journal"], ["Conference"], ["note"])
    return got.select("p_partkey", "venue", "presented_at", "note")


@query("""SELECT s_suppkey, 'Lab x.edu=' || CASE WHEN s_suppkey % 2 = 0 THEN 'C' ELSE 'B' END AS scrubbed FROM supplier""")
def scrubbed_maps(spark, sf_dir):
    """Keys that become one when their addresses go: an unchanged key's value, else the most common."""
    key = F.col("s_suppkey").cast("string")
    mail = lambda n: F.concat(F.lit(f"Lab {n}."), key, F.lit("@x.edu"))
    pairs = [mail("a"), F.lit("A"), mail("b"), F.lit("B"), mail("c"), F.lit("B")]
    plain = F.create_map(*pairs, F.lit("Lab x.edu"), F.lit("C"))
    made = F.when(F.col("s_suppkey") % 2 == 0, plain).otherwise(F.create_map(*pairs))
    rows = _table(spark, sf_dir, "supplier").select("s_suppkey", text.scrub_map(made).alias("m"))
    return rows.select("s_suppkey", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("scrubbed"))


_TOKENS = f"""WITH RECURSIVE {ALL[5:]}, v AS (SELECT DISTINCT reader AS name, paper, CASE WHEN reader % 3 > 0 THEN venue END AS token FROM papers), e AS (SELECT DISTINCT x.name, x.paper AS a, y.paper AS b FROM v x JOIN v y ON x.name = y.name AND x.token = y.token),
    own AS (SELECT DISTINCT name, paper FROM v), reach AS (SELECT name, paper, paper AS seen FROM own UNION SELECT reach.name, reach.paper, e.b FROM reach JOIN e ON e.name = reach.name AND e.a = reach.seen), r AS (SELECT name, paper, min(seen) AS root FROM reach GROUP BY name, paper),
    s AS (SELECT name, root, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC) AS k FROM r GROUP BY name, root), t AS (SELECT name, count(DISTINCT paper) AS papers, count(token) AS tokens FROM v GROUP BY name)"""


@query(f"""{_TOKENS} SELECT CAST(name AS VARCHAR) AS name, count(*) AS groups, count(*) >= 2 AND coalesce(max(n) FILTER (WHERE k = 2), 0) >= 2 AS conflict FROM s JOIN t USING (name) WHERE NOT (papers >= 5 AND tokens = 0) GROUP BY name""")
def identity_conflicts(spark, sf_dir):
    """Each reader is a name; the venues are its evidence, of which every third name has none."""
    rows = proxies.papers(spark, sf_dir).select(F.col("reader").cast("string").alias("name"), "paper", F.when(F.col("reader") % 3 > 0, F.col("venue")).alias("token"))
    return graph.identity_conflicts(rows.withColumn("surname_known", F.lit(True)))


@query("""WITH a AS (SELECT 'Ann ' || CASE WHEN c_custkey % 3 = 0 THEN 'Wang' ELSE 'Lee' END || CASE WHEN c_custkey % 5 = 0 THEN ' Jr' ELSE '' END AS author, c_custkey AS k, c_custkey % 7 AS clusters, c_custkey % 5 AS lone, c_custkey % 4 AS countries FROM customer),
    p AS (SELECT *, CASE WHEN author = 'Ann Wang' THEN 2 WHEN author = 'Ann Lee' THEN 1 ELSE 0 END AS prior, CASE WHEN clusters >= 6 THEN 3.0 WHEN clusters >= 4 THEN 2.0 WHEN clusters >= 3 THEN 1.0 ELSE 0 END + CASE WHEN lone >= 4 THEN 2.0 WHEN lone >= 2 THEN 1.0 ELSE 0 END + CASE WHEN countries >= 3 THEN 1.5 WHEN countries >= 2 THEN 0.5 ELSE 0 END AS s FROM a)
    SELECT k, round_even(CASE WHEN prior = 0 THEN CAST(s AS DOUBLE) * 0.35 ELSE prior + CAST(s AS DOUBLE) END, 1) AS score, CASE WHEN prior = 0 THEN 'prolific-single-likely' WHEN prior = 2 AND clusters >= 4 AND s >= 3 THEN 'high-confidence' WHEN clusters >= 3 AND s >= 2 THEN 'review' ELSE 'weak' END AS tier FROM p""")
def ambiguous_authors(spark, sf_dir):
    k = F.col("c_custkey")
    name = F.concat(F.lit("Ann "), F.when(k % 3 == 0, "Wang").otherwise("Lee"), F.when(k % 5 == 0, " Jr").otherwise(""))
    rows = _table(spark, sf_dir, "customer").select(k.alias("k"), name.alias("author"), (k % 7).alias("clusters"), (k % 5).alias("lone"), (k % 4).alias("countries"), F.lit(1).alias("papers_per_year"), F.lit(1).alias("categories"))
    return graph.ambiguity(rows, ["ann wang"], ["lee"]).select("k", "score", "tier")
