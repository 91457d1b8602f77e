"""E-mail addresses in scraped text: each gives way to its domain, or goes."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache
from string import ascii_letters, ascii_lowercase, digits

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

# The domains that aren't countries; countries have the codes of ISO 3166, but for those without a domain and four more.
GENERIC = "com org net edu gov mil int info biz name pro aero coop museum mobi asia cat jobs tel travel app dev tech technology cloud online site xyz science global group honda".split()
WITHOUT_DOMAIN, MORE_DOMAINS = {"bl", "bq", "bv", "eh", "gb", "mf", "sj", "um"}, {"ac", "eu", "su", "uk"}
# What an address is written with. Letters with marks count, other scripts don't: a word of those that touches an address stays.
HOST = frozenset(ascii_letters + digits + "-.")
LOWER = frozenset(ascii_lowercase + digits + "._%+-")
LOCAL = frozenset(ascii_letters + digits + "._%+-") | {chr(k) for k in range(0xC0, 0x250)}
UNSEEN = frozenset("​‌‍﻿")
BRACKETS = {"}": "{", "]": "[", ")": "("}
BLANKS = "".join(c for c in map(chr, range(0x3001)) if unicodedata.category(c) == "Zs")
#: The longest list of local parts in brackets.
MOST_IN_BRACKETS = 300


@cache
def top_level() -> frozenset[str]:
    countries = {str(c).lower() for c in SparkContext._active_spark_context._jvm.java.util.Locale.getISOCountries()}
    return frozenset(countries - WITHOUT_DOMAIN | MORE_DOMAINS | set(GENERIC))


def plain_letters(text: str) -> str:
    """Letters of mathematical alphabets, which some typefaces come out as, as plain ones."""
    return "".join(unicodedata.normalize("NFKC", c) if "\U0001d400" <= c <= "\U0001d7ff" else c for c in text) if any(c >= "\U0001d400" for c in text) else text


def back(text: str, at: int, signs: frozenset[str]) -> int:
    """Where the run of ``signs`` begins that ends before ``at``."""
    while at and text[at - 1] in signs:
        at -= 1
    return at


class Finder:
    """Looks at each @ from the right: the host behind it, then the local part or the list in brackets before it."""

    def __init__(self, domains: frozenset[str]) -> None:
        self.domains = domains

    def host(self, text: str, at: int) -> int:
        """The end of the longest host name that begins at ``at``: labels of which the last is a known domain, in small letters or capitals; 0 if there is none."""
        end = at
        while end < len(text) and text[end] in HOST:
            end += 1
        while end > at:
            labels = text[at:end].split(".")
            last = labels[-1]
            if len(labels) > 1 and all(labels) and last.lower() in self.domains and (last.islower() or last.isupper()):
                return end
            end = text.rfind(".", at, end)
        return 0

    def brackets(self, text: str, end: int) -> int:
        """Where a list in brackets begins that ends before ``end``, or several joined by full stops; ``end`` if there is none."""
        start = end
        while start and (opening := BRACKETS.get(text[start - 1])):
            at = text.rfind(opening, max(0, start - MOST_IN_BRACKETS - 2), start - 1)
            if at < 0 or any(c in text[at + 1 : start - 1] for c in (text[start - 1], "@", "\n")):
                break
            end, start = at, at - 1
            if not at or text[at - 1] != ".":
                break
        return end

    def local(self, text: str, at: int) -> int:
        """Where the local part of the @ at ``at`` begins; there itself if it has none."""
        seen = back(text, at, UNSEEN)
        word = back(text, seen, frozenset(" \t"))
        if (start := self.brackets(text, word)) < word or (start := back(text, seen, LOCAL)) < seen:
            return start
        # apart from the @, only a word in small letters is a local part
        start = back(text, word, LOWER)
        if word < seen and start < word and text[start] not in "._%+-" and (not start or text[start - 1] not in LOCAL):
            return start
        return seen

    def address(self, text: str, at: int) -> tuple[int, int, int] | None:
        """Start, start of the host, and end of what is written around the @."""
        host = at + 1
        while host < len(text) and text[host] in UNSEEN:
            host += 1
        host += host < len(text) and text[host] in " \t"
        end = self.host(text, host)
        return (self.local(text, at), host, end) if end else self.cut_off(text, at)

    def cut_off(self, text: str, at: int) -> tuple[int, int, int] | None:
        """A dotted name in small letters before a host that has lost its end."""
        start = back(text, at, frozenset(ascii_lowercase + digits + "._"))
        parts = re.split("[._]", text[start:at])
        end = at + 1
        while end < len(text) and text[end] in ascii_lowercase + digits + "-":
            end += 1
        whole = len(parts) > 1 and all(parts) and end > at + 1 and text[at + 1] in ascii_lowercase
        apart = (not start or text[start - 1] not in LOCAL) and (end == len(text) or not (text[end].isalnum() or text[end] in "_.@-"))
        return (start, at + 1, end) if whole and apart else None

    def found(self, text: str | None) -> list[str]:
        """The addresses, in order: with a local part and a whole host."""
        if not text or "@" not in text:
            return []
        text, out = plain_letters(text), []
        at = text.rfind("@")
        while at >= 0:
            got = self.address(text, at)
            if got and got[0] < at and self.host(text, got[1]) == got[2] and text[got[0] : at].strip("".join(UNSEEN)):
                out.append(text[got[0] : got[2]])
                at = got[0]
            at = text.rfind("@", 0, at)
        return out[::-1]

    def parts_in_brackets(self, text: str) -> str:
        """Without lists such as {ann@air.,bob@mail.} before the end that their hosts share."""
        at = text.rfind("}")
        while at >= 0:
            start = text.rfind("{", max(0, at - 2 * MOST_IN_BRACKETS), at)
            inside = text[start + 1 : at]
            rest = at + 1 + text.startswith(".", at + 1)
            if start >= 0 and "@" in inside and "\n" not in inside and "}" not in inside and self.host(text, rest):
                text = text[:start] + gap(text, start) + text[rest:]
                at = start
            at = text.rfind("}", 0, at)
        return text

    def stripped(self, text: str | None, keep_domain: bool) -> str | None:
        if not text or "@" not in text:
            return text
        plain = plain_letters(text)
        now = self.parts_in_brackets(plain)
        at = now.rfind("@")
        while at >= 0:
            # what an address leaves behind may be the host of the one glued on before it, so the way is from the right
            if got := self.address(now, at):
                start, host, end = got
                at = start
                now = now[:start] + (gap(now, start) + now[host:end] if keep_domain else "") + now[end:]
            at = now.rfind("@", 0, at)
        if now == plain:
            return text
        return " ".join(x for x in re.split("[ \t]+", once(now) if keep_domain else now)).strip()


class PlainFinder:
    """Addresses in one piece: the longest local part, the @, and labels up to the last one that begins with one of ``domains``, the first that fits.

    What a regular expression of these three parts matches from left to right, in time that follows the text's length.
    """

    def __init__(self, domains: Iterable[str]) -> None:
        self.domains = [*domains]

    def host(self, text: str, at: int) -> int:
        """The end of the host that begins at ``at``; 0 if there is none."""
        end = at
        while end < len(text) and text[end] in HOST:
            end += 1
        # no label is empty
        twice = text.find("..", at, end)
        dot = text.rfind(".", at, end if twice < 0 else twice + 1) if text[at : at + 1] != "." else -1
        while dot > at:
            for d in self.domains:
                if text.startswith(d, dot + 1):
                    return dot + 1 + len(d)
            dot = text.rfind(".", at, dot)
        return 0

    def addresses(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Start, place of the @, and end of each address, in order."""
        done, at = 0, text.find("@")
        while at >= 0:
            start, end = at, self.host(text, at + 1)
            while start > done and text[start - 1] in LOCAL:
                start -= 1
            if end and start < at:
                yield start, at, end
                done = end
            at = text.find("@", max(done, at + 1))

    def found(self, text: str | None) -> list[str]:
        return [text[a:b] for a, _, b in self.addresses(text)] if text else []

    def stripped(self, text: str | None, keep_domain: bool) -> str | None:
        spans = [*self.addresses(text)] if text else []
        if not spans:
            return text
        borders = [0, *(x for a, at, b in spans for x in (a, at + 1 if keep_domain else b)), len(text)]
        return re.sub("[ \t]{2,}", " ", "".join(text[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))).strip(BLANKS)


def gap(text: str, at: int) -> str:
    """A space if a word would be glued on."""
    return " " if at and text[at - 1].isalnum() else ""


def once(text: str) -> str:
    """Of one domain several times in a list, the first."""
    out, done, before = [], 0, None
    for m in re.finditer(r"[\w.-]+", text):
        word = m[0].rstrip(".")
        if "." not in word or not word.isascii() or not all(word.split(".")) or not (word[-2:].isalpha() and len(word.rpartition(".")[2]) > 1):
            before = None
            continue
        end = m.start() + len(word)
        between = text[before[1] : m.start()].strip() if before else None
        if before and before[0] == word and between.removesuffix("and").strip() in ("", ",", ";", "|", "/"):
            out.append(text[done : before[1]])
            done = end
        before = (word, end)
    return "".join([*out, text[done:]])


def strip_addresses(c: Column, keep_domain: bool = True, domains: Iterable[str] | None = None) -> Column:
    """Each e-mail address gives way to its domain, or goes. A domain that then repeats in a list stands once. Texts without @ are as they were; null stays null.
    ``domains``: only plain addresses in these, see ``PlainFinder``; each gives way wherever it stands, runs of spaces and tabs become one space, and spaces of all kinds go at the ends."""
    finder = Finder(top_level()) if domains is None else PlainFinder(domains)

    @pandas_udf("string")
    def strip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: finder.stripped(t, keep_domain))

    return strip(c)


def find_addresses(c: Column, domains: Iterable[str] | None = None) -> Column:
    """All whole addresses of a text, as an array; null has none. ``domains``: only plain ones in these, see ``PlainFinder``."""
    finder = Finder(top_level()) if domains is None else PlainFinder(domains)

    @pandas_udf("array<string>")
    def find(texts: pd.Series) -> pd.Series:
        return texts.map(finder.found)

    return F.coalesce(find(c), F.array().cast("array<string>"))


def scrub_map(c: Column, keep_domain: bool = True) -> Column:
    """A map of strings with addresses stripped from keys and values; of keys that become one the value of an unchanged key wins, else the most common, the first of equals."""
    finder = Finder(top_level())

    def one(keys, values) -> dict[str, str]:
        offers: dict[str, list[tuple[bool, str]]] = {}
        for k, v in zip(keys, values, strict=True):
            new = finder.stripped(k, True)
            offers.setdefault(new, []).append((new == k, finder.stripped(v, keep_domain)))
        out = {}
        for k, own in offers.items():
            votes = Counter(v for _, v in own)
            # of equal counts a Counter names the first
            out[k] = next((v for same, v in own if same), votes.most_common(1)[0][0])
        return out

    @pandas_udf("map<string,string>")
    def scrub(keys: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([None if k is None else one(k, v) for k, v in zip(keys, values, strict=True)])

    return scrub(F.map_keys(c), F.map_values(c))
