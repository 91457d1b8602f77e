"""Readers of record listings: JSON files, web pages, Markdown, XML and dumps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from ..functions.text import clean_text, doi
from ..functions.values import nullify_empty


def read_listings(spark: SparkSession, paths: list[str], schema: str | StructType, late_prefix: str = "arxiv") -> DataFrame:
    """JSON arrays with their file name, the row's place in it, and ``file_rank``: files in the order of their names, those with the late prefix after
    all others. A file that can't be parsed fails the read."""
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    rows = rows.withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)).withColumn("pos", F.monotonically_increasing_id())
    late = F.col("file").startswith(late_prefix).cast("int")
    return rows.withColumn("file_rank", F.struct(late.alias("late"), F.col("file").alias("name")))


def venue_from_file(file: Column, table: dict[str, str]) -> tuple[Column, Column]:
    """(venue, year) that a file's name tells: a known prefix, then four digits; a name with _all tells no year."""
    name = F.regexp_replace(file, r"\.json$", "")
    prefix = F.regexp_extract(name, r"^([a-z_]+?)_?(?:\d{4}|all)", 1)
    year = F.regexp_extract(name, r"(\d{4})", 1)
    venue = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[prefix] if table else F.lit(None).cast("string")
    return venue, F.when((year != "") & ~name.contains("_all"), year.cast("int"))


def source_tag(file: Column, tags: dict[str, str], default: str = "venue_listing") -> Column:
    """The tag of the longest prefix that the file name has."""
    got = F
    for prefix in sorted(tags, key=len, reverse=True):
        got = got.when(file.startswith(prefix), tags[prefix])
    return got.otherwise(default) if tags else F.lit(default)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A Parquet table, or an empty one of the schema where there is none."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def html_entries(html: Column, entry: str, fields: dict[str, str]) -> Column:
    """An array of structs: the page cut before each match of ``entry``, and from each part the first group of each field's pattern, cleaned; null where it isn't found."""
    parts = F.split(html, rf"(?=(?:{entry}))")
    parts = F.filter(parts, lambda p: p.rlike(rf"^(?:{entry})"))

    def field(p: Column, pattern: str) -> Column:
        return F.when(p.rlike(pattern), clean_text(F.regexp_extract(p, pattern, 1)))

    return F.transform(parts, lambda p: F.struct(*[field(p, x).alias(n) for n, x in fields.items()]))


def strict_entries(pages: DataFrame, html: str, entry: str, fields: dict[str, str]) -> DataFrame:
    """As html_entries, a row each; the query fails at a part without one of the fields."""
    rows = pages.select("*", F.posexplode(html_entries(F.col(html), entry, fields)).alias("entry", "f"))
    whole = F.lit(True)
    for n in fields:
        whole = whole & F.col(f"f.{n}").isNotNull()
    first = next(iter(fields))
    checked = F.when(whole, F.col(f"f.{first}")).otherwise(F.raise_error(F.concat(F.lit("an entry can't be parsed: number "), F.col("entry").cast("string"))))
    return rows.withColumn(first, checked).select("*", *[F.col(f"f.{n}").alias(n) for n in list(fields)[1:]]).drop("f")


def bibliography_items(html: Column, css_class: str = "ltx_bibitem", least: int = 16) -> Column:
    """The texts of list items of a class."""
    items = F.regexp_extract_all(html, F.lit(rf'(?s)<li[^>]*class="[^"]*\b{css_class}\b[^"]*"[^>]*>(.*?)</li>'), 1)
    return F.filter(F.transform(items, clean_text), lambda t: F.length(t) >= least)


def select_track(dump: DataFrame, key: str, track: Column, preferred: Column, fields: list[str]) -> DataFrame:
    """Records of the track, one a key: a preferred one first, then the first by ``pos``; its empty fields from the others, in order."""
    own = Window.partitionBy(key).orderBy(preferred.desc(), "pos")
    rows = dump.where(track).withColumn("__r", F.row_number().over(own))
    wide = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    for f in fields:
        rows = rows.withColumn(f, F.first(nullify_empty(F.col(f)), ignorenulls=True).over(wide))
    return rows.where("__r = 1").drop("__r")


def inverted_index_text(positions: Column) -> Column:
    """The text that a map from word to its positions spells."""
    pairs = F.flatten(F.transform(F.map_entries(positions), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")


def page_affiliations(page: Column, most: int = 8) -> Column:
    """Affiliations above the abstract of a first page: lines that read like organisations, cut at commas and semicolons' groups, once each, case aside."""
    head = F.split(F.split(page, r"(?i)\babstract\b").getItem(0), "\n")
    hint = r"(?i)\b(?:universit\w*|institut\w*|laborator\w*|labs?|college|school of|research|center|centre|inc\.?|ltd\.?|gmbh)\b"
    lines = F.filter(head, lambda x: x.rlike(hint))
    parts = F.filter(F.flatten(F.transform(lines, lambda x: F.split(x, r"\s*[;,]\s*"))), lambda p: p.rlike(hint))
    parts = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^[\d*†‡\s]+", "")))
    lower = F.transform(parts, F.lower)
    first = F.filter(F.transform(parts, lambda p, i: F.when(F.array_position(lower, F.lower(p)) == i + 1, p)), lambda p: p.isNotNull())
    return F.slice(first, 1, most)


def work_record(rows: DataFrame) -> DataFrame:
    """Registry items (title, subtitle, author array<struct<given,family>>, DOI, print_year, online_year) as records."""
    title = F.concat_ws(": ", nullify_empty(clean_text(F.col("title"))), nullify_empty(clean_text(F.col("subtitle"))))
    names = F.transform("author", lambda a: F.concat_ws(" ", a["given"], a["family"]))
    return rows.select(title.alias("title"), F.array_join(F.filter(names, lambda n: n != ""), ", ").alias("authors"), doi(F.col("DOI")).alias("doi"), F.coalesce("print_year", "online_year").alias("year"))


def oai_records(pages: DataFrame, xml: str) -> DataFrame:
    """Harvest pages as records: id, created, title, abstract, categories, comment, and the page's resumption token."""
    def tag(c: Column, name: str) -> Column:
        pattern = rf"(?s)<(?:\w+:)?{name}(?:\s[^>]*)?>(.*?)</(?:\w+:)?{name}>"
        return F.when(c.rlike(pattern), clean_text(F.regexp_extract(c, pattern, 1)))

    records = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)<record\b.*?</record>"), 0)
    token = nullify_empty(tag(F.col(xml), "resumptionToken"))
    rows = pages.select(token.alias("token"), F.posexplode(records).alias("pos", "r"))
    return rows.select("pos", tag(F.col("r"), "id").alias("id"), tag(F.col("r"), "created").alias("created"), tag(F.col("r"), "title").alias("title"), tag(F.col("r"), "abstract").alias("abstract"), F.split(tag(F.col("r"), "categories"), " ").alias("categories"), tag(F.col("r"), "comments").alias("comment"), "token")


def markdown_papers(files: DataFrame) -> DataFrame:
    """files: file, body. Papers that Markdown lists name: bullets ``**Title** - Authors`` or ``[Title](link)``, and tables whose header names a title
    and an author column. Bullets under a contents heading don't count. A parser over lines with state, one file at a time."""
    import re

    bullet = re.compile(r"^\s*[-*+]\s+(?:\*\*(?P<b>.+?)\*\*|\[(?P<l>[^\]]+)\]\([^)]*\))\s*(?:[-–—:,.]\s*)?(?P<a>.*)$")

    def parse(body: str) -> Iterator[tuple[str, str]]:
        header, contents = None, False
        for line in body.splitlines():
            if line.lstrip().startswith("#"):
                contents, header = "contents" in line.lower(), None
            elif line.count("|") >= 2:
                cells = [x.strip() for x in line.strip().strip("|").split("|")]
                if header is None:
                    names = [x.lower() for x in cells]
                    at = next((k for k, x in enumerate(names) if "title" in x or "paper" in x), None)
                    by = next((k for k, x in enumerate(names) if "author" in x), None)
                    header = (at, by)
                elif header[0] is not None and header[0] < len(cells) and not re.fullmatch(r"[:\- ]*", cells[header[0]]):
                    title = re.sub(r"\[([^\]]+)\]\([^)]*\)", r"\1", cells[header[0]]).strip("* ")
                    yield title, cells[header[1]] if header[1] is not None and header[1] < len(cells) else ""
            else:
                header = None
                if not contents and (m := bullet.match(line)):
                    yield (m["b"] or m["l"]).strip(), re.sub(r"\s*\[[^\]]*\]\([^)]*\)", "", m["a"]).strip(" .")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(f, k, t, a) for f, body in zip(b["file"], b["body"], strict=True) for k, (t, a) in enumerate(parse(body or ""))]
            yield pd.DataFrame(rows, columns=["file", "pos", "title", "authors"])

    return files.select("file", "body").mapInPandas(run, "file string, pos int, title string, authors string")
