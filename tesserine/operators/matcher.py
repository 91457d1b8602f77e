"""Title containment: which known titles a raw reference text cites."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.keys import plain_key, text
from ..scratch import stored

#: A title of fewer words or letters is short and needs stronger evidence; longer ones are looked up by a prefix.
SHORT_WORDS, SHORT_LETTERS, PREFIX, YEAR_REACH = 3, 15, 16, 250
#: Bits of the filter of prefixes, 4 MB at any number of titles.
CELLS = 1 << 25
# The marks of reference structure that may stand before and after a title, and those that end a sentence.
BEFORE, AFTER, STRONG = set('.,;"“”‘�?!()[]\n'), set('.,;"“”’�?!()[]'), set('."“”‘’�?!')
WORD, YEAR = re.compile("[A-Za-z0-9]+"), re.compile("(?:19|20)[0-9]{2}[a-z]?")


class Entry:
    """A reference text as words of letters and digits, and what stands between them."""

    def __init__(self, raw: str) -> None:
        self.raw = raw
        spans = [m.span() for m in WORD.finditer(raw)]
        self.words = [raw[a:b] for a, b in spans]
        self.spans = spans
        # gaps[k] stands before word k; the last one after all
        ends = [0, *(b for _, b in spans)]
        starts = [*(a for a, _ in spans), len(raw)]
        self.gaps = [raw[a:b] for a, b in zip(ends, starts, strict=True)]
        self.offsets = [0]
        for w in self.words:
            self.offsets.append(self.offsets[-1] + len(w))
        self.letters = "".join(self.words).lower()

    def strong_start(self, k: int) -> bool:
        return k == 0 or bool(STRONG & set(self.gaps[k])) or bool(YEAR.fullmatch(self.words[k - 1]))

    def may_start(self, k: int) -> bool:
        """At the entry's start; after structure, a line's hyphen, a number; or straight after an author: capital, full stop, surname."""
        if self.strong_start(k) or BEFORE & set(self.gaps[k]) or self.gaps[k].startswith("- ") or self.words[k - 1].isdigit():
            return True
        if not self.gaps[k].isspace():
            return False
        # a surname may be of several words, joined by hyphens or letters outside a-z
        at = k - 1
        while at > 0 and (self.gaps[at] in ("-", "�") or self.gaps[at].isalpha()):
            at -= 1
        initial = self.words[at - 1] if at > 0 else ""
        return len(initial) == 1 and initial.isupper() and "." in self.gaps[at] and self.words[at][0].isupper()

    def strong_end(self, k: int) -> bool:
        """Behind word k - 1: the entry's end, a sentence's end, a year, or the venue."""
        if k == len(self.words) or STRONG & set(self.gaps[k]):
            return True
        w = self.words[k]
        return bool(YEAR.fullmatch(w)) or w in ("In", "pp", "arXiv") or (w[:2] == "In" and w[2:3].isupper())

    def may_end(self, k: int) -> bool:
        return self.strong_end(k) or bool(AFTER & set(self.gaps[k]))

    def has_year(self, a: int, b: int, low: int, high: int) -> bool:
        near = self.raw[max(0, a - YEAR_REACH) : b + YEAR_REACH]
        return any(low <= int(y) <= high for y in re.findall(r"(?<![0-9])(?:19|20)[0-9]{2}(?![0-9])", near))

    def prefixes(self, sizes: list[int]) -> Iterator[str]:
        """What may be looked up: from each word where a title may start, its first letters."""
        for k in range(len(self.words)):
            if self.may_start(k):
                at = self.offsets[k]
                for n in sizes:
                    if at + n <= len(self.letters):
                        yield self.letters[at : at + n]

    def cited(self, titles: list[tuple[str, bool, int | None, int | None]]) -> set[str]:
        """Of candidate titles (key, short, first and last year), those that stand here; one inside a longer one that stands here is none."""
        word_at = {o: k for k, o in enumerate(self.offsets)}
        hits = []
        for key, short, low, high in titles:
            at = self.letters.find(key)
            while at >= 0:
                a, b = word_at.get(at), word_at.get(at + len(key))
                if a is not None and b is not None and a < len(self.words) and self.may_start(a) and self.may_end(b):
                    sure = not short or (self.strong_start(a) and self.strong_end(b) and low is not None and self.has_year(self.spans[a][0], self.spans[b - 1][1], low - 1, high + 1))
                    if sure:
                        hits.append((at, at + len(key), key))
                at = self.letters.find(key, at + 1)
        return {k for a, b, k in hits if not any(c <= a and b <= d and d - c > b - a for c, d, _ in hits)}


def title_index(papers: DataFrame, title: str = "title", year: str = "year") -> DataFrame:
    """key, short, low, high, prefix: a key that several papers share has the years of all."""
    once = papers.groupBy(F.col(title).alias("title")).agg(F.min(year).alias("low"), F.max(year).alias("high"))
    keyed = once.select(plain_key(F.col("title")).alias("key"), F.size(F.regexp_extract_all(text(F.col("title")), F.lit("([A-Za-z0-9]+)"))).alias("words"), "low", "high").where("key <> ''")
    got = keyed.groupBy("key").agg(F.min("words").alias("words"), F.min("low").alias("low"), F.max("high").alias("high"))
    short = (F.col("words") < SHORT_WORDS) | (F.length("key") < SHORT_LETTERS)
    return got.select("key", short.alias("short"), "low", "high", F.substring("key", 1, PREFIX).alias("prefix"))


def prefix_filter(prefix: Column, index: DataFrame) -> bytes:
    """A bit for each hash that a prefix has, so at most CELLS / 64 rows reach the driver. What it lets through by chance finds nothing in the join."""
    cell = F.pmod(F.crc32(prefix.cast("binary")), F.lit(CELLS)).cast("int")
    words = index.select(cell.alias("c")).groupBy(F.shiftright("c", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, c % 64))").alias("bits")).toArrow()
    out = np.zeros(CELLS // 64, "<i8")
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def cited_titles(references: DataFrame, papers: DataFrame, title: str = "title", year: str = "year") -> DataFrame:
    """references: citer, raw. Rows (citer, cited): the keys of titles that a reference text holds as a whole part of it.

    Equal texts are read once, told by their SHA-256. Titles meet texts by an equi-join on their first PREFIX letters (all letters of shorter
    ones) at each place where a title may start and a bit filter says that some title may begin so; candidates are then checked in
    the text. The work follows the number of distinct texts, places and matches, not texts times titles.
    """
    index = stored(title_index(papers, title, year), "titles")
    sizes = [r["n"] for r in index.select(F.length("prefix").alias("n")).distinct().orderBy("n").collect()]
    shipped = references.sparkSession.sparkContext.broadcast(prefix_filter(F.col("prefix"), index))

    @pandas_udf("array<string>")
    def prefixes(raw: pd.Series) -> pd.Series:
        bits = shipped.value

        def there(prefix: str) -> int:
            cell = zlib.crc32(prefix.encode()) % CELLS
            return bits[cell >> 3] >> (cell & 7) & 1

        return raw.map(lambda r: [*filter(there, dict.fromkeys(Entry(r).prefixes(sizes)))])

    @pandas_udf("array<string>")
    def check(raw: pd.Series, titles: pd.Series) -> pd.Series:
        # a missing year arrives as a float that equals nothing
        whole = lambda y: None if y is None or y != y else int(y)
        return pd.Series([sorted(Entry(r).cited([(t["key"], t["short"], whole(t["low"]), whole(t["high"])) for t in ts])) for r, ts in zip(raw, titles, strict=True)])

    entry = F.unhex(F.sha2(F.col("raw").cast("binary"), 256)).alias("entry")
    # so many parts as are asked for: by their bytes, small texts would be read in a few tasks
    parts = int(references.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    texts = references.where("raw is not null").select("raw").distinct().select("raw", entry).repartition(parts, "entry")
    found = texts.select("entry", F.explode(prefixes("raw")).alias("prefix")).join(index, "prefix")
    candidates = found.groupBy("entry").agg(F.collect_set(F.struct("key", "short", "low", "high")).alias("titles"))
    checked = texts.join(candidates, "entry").select("entry", F.explode(check("raw", "titles")).alias("cited"))
    return references.select("citer", entry).join(checked, "entry").select("citer", "cited").distinct()


def split_entries(c):
    """Numbered reference lists as an array of entries of over 15 signs."""
    parts = F.split(c, r"(?:^|\n)\s*(?:\[\d{1,3}\][.)]?|\d{1,3}[.)])\s+")
    return F.filter(F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"^\s+|\s+$", ""))), lambda p: F.length(p) > 15)
