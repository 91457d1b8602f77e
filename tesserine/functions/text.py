"""Cleaning of names, venues, institutions, addresses and markup, as Column expressions; rule tables are arguments."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterable, Mapping
from functools import cache, reduce
from operator import or_

import pandas as pd
from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from .addresses import find_addresses, scrub_map, strip_addresses
from .keys import let, plain_key, unescape

__all__ = ["find_addresses", "scrub_map", "strip_addresses"]


def mapped(c: Column, table: Mapping[str, str]) -> Column:
    """The table's value for the key, or null."""
    if not table:
        return F.lit(None).cast("string")
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def venue_name(c: Column, aliases: Mapping[str, str]) -> Column:
    """By the alias of the whole name, else of the name without years, else the acronym in brackets at its end, else that name."""
    plain = squeezed(F.regexp_replace(c, r"\b(?:19|20)\d\d\b", ""))
    acronym = F.regexp_extract(plain, r"\(([A-Z][A-Za-z&-]{1,14})\)\s*$", 1)
    return F.coalesce(mapped(F.trim(c), aliases), mapped(plain, aliases), F.when(acronym != "", acronym), plain)


# Hyphens and apostrophes that typefaces have, words before a name, degrees and grades behind it, numerals that stay capitals, what isn't said of a person.
HYPHENS, APOSTROPHES = "‐‑‒–−", "’‘ʼ`´ʹ"
TITLES = ["prof", "professor", "dr", "dr-ing", "pd", "priv-doz", "doz", "docent", "assoc", "asst", "mr", "mrs", "ms", "mx", "miss"]
DEGREES = ["phd", "md", "msc", "bsc", "ieee"]
GRADES = ["member", "members", "fellow", "life", "senior", "student", "graduate"]
NUMERALS = ["II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X"]
NO_NAME = ["and", "correspond\\w*", "equal\\s+contrib\\w*", "contributed\\s+equally", "co-?\\s?first", "project\\s+lead", "these\\s+authors", "senior\\s+author", "first\\s+author", "contribution"]


def words_of(c: Column) -> Column:
    return F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")


def _from_first(items: Column, skipped: Column) -> Column:
    """An array from the first item on that isn't skipped (an array of booleans beside it); the whole array if all are."""
    at = F.array_position(skipped, F.lit(False)).cast("int")
    return F.when(at > 0, F.slice(items, at, F.size(items))).otherwise(items)


def _to_last(items: Column, skipped: Column) -> Column:
    return F.reverse(_from_first(F.reverse(items), F.reverse(skipped)))


def _said(word: Column) -> Column:
    """A word without full stops, in small letters."""
    return F.lower(F.translate(word, ".", ""))


def _folded(word: Column) -> Column:
    """A word in capitals with the first letter of each of its parts alone in capitals; an initial stays."""
    capitals = ~word.rlike(r"\p{Ll}") & word.rlike(r"\p{Lu}.*\p{Lu}") & ~word.isin(NUMERALS)
    apart = F.regexp_replace(word, "([-'.])", "$1 ")
    return F.when(capitals, F.regexp_replace(F.initcap(F.lower(apart)), "([-'.]) ", "$1")).otherwise(word)


def author_name(c: Column, known: Mapping[str, str] | None = None) -> Column:
    """A person's name for crediting, or null if nothing of the kind is left.

    In order: entities and hyphens; what follows markup or an address goes; numbering and titles before it; degrees and grades behind commas;
    marks and digits at the end; "Last, First" turned round, other commas cut; nicknames; ``known`` spellings; apostrophes
    but before a capital; acronyms glued on; capitals folded; then only Latin letters may be left, and no phrase about authors.
    """
    c = F.translate(F.translate(unescape(c), HYPHENS, "-" * len(HYPHENS)), APOSTROPHES, "'" * len(APOSTROPHES))
    c = F.regexp_replace(F.get(F.split(c, r"[\\{}@]", 2), F.lit(0)), r"(?i)\d*footnotemark.*$", "")
    before = lambda w, k: _said(w).isin(TITLES) | w.rlike(r"^\d+(?:st|nd|rd|th)$") | w.isin("and", "AND") | ((k > 0) & (_said(w) == "em"))
    c = let(words_of(c), lambda words: F.array_join(_from_first(words, F.transform(words, before)), " "))
    c = let(let(c, _without_tail), lambda c: squeezed(F.regexp_replace(c, r"\([^()]*\)?|\[[^\[\]]*\]?|[\"“][^\"”]*[\"”]?", " ")))
    if known:
        c = let(c, lambda c: F.coalesce(mapped(c, known), c))
    c = F.regexp_replace(F.regexp_replace(c, r"'(?!\p{Lu})", ""), r"(?<=\p{Ll})\p{Lu}{2,}\S*", "")
    c = F.array_join(F.transform(words_of(c), lambda w, k: F.when((k > 0) & w.isin(NUMERALS), w).otherwise(_folded(w))), " ")
    if known:
        c = let(c, lambda c: F.coalesce(mapped(c, known), c))
    no_name = r"(?i)\b(?:" + "|".join(NO_NAME) + r")\b"
    return let(c, lambda c: F.when(c.rlike(r"^[\p{IsLatin}\p{M} .'-]+$") & c.rlike(r"\p{IsLatin}.*\p{IsLatin}") & ~c.rlike(no_name), c))


def _without_tail(c: Column) -> Column:
    """A name without degrees, grades, marks and places behind it, turned round if its last name comes first."""
    parts = F.transform(F.split(c, ","), lambda p: F.trim(F.regexp_replace(p, r"[\s\d*∗†‡§¶‖·\p{So}\p{Sk}\p{Sm}\p{No}]+$", "")))
    said = lambda p: F.translate(_said(p), " ", "")
    grade = lambda p: F.forall(words_of(p), lambda w: _said(w).isin([*GRADES, "ieee", "and"]))
    kept = F.filter(parts, lambda p: (p != "") & ~said(p).isin(DEGREES) & ~grade(p))
    graded = c.rlike(r"(?i)\b(?:members?|fellow)\s*,|\bIEEE\b")

    def ungraded(words: Column) -> Column:
        return F.array_join(F.when(graded, _to_last(words, F.transform(words, lambda w: _said(w).isin([*GRADES, "ieee"])))).otherwise(words), " ")

    def turned(parts: Column) -> Column:
        head, other = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        n, m = F.size(words_of(head)), F.size(words_of(other))
        reversed_ = (F.size(parts) == 2) & (((n == 1) & (m <= 3)) | ((n == 2) & (m == 1) & (F.upper(other) != other) & ~other.contains(".")))
        return F.when(reversed_, F.concat_ws(" ", other, head)).otherwise(head)

    return let(F.transform(kept, lambda p, k: F.when(k == 0, let(words_of(p), ungraded)).otherwise(p)), turned)


def split_joined(c: Column) -> Column:
    """"A B, C D" as two names; other values as one."""
    two = c.rlike(r"^\S+(?: \S+)+, \S+(?: \S+)+$")
    return F.when(two, F.split(c, ", ")).otherwise(F.array(c))


def is_full_name(c: Column) -> Column:
    """At least two words, and not an organisation's."""
    organisation = r"(?i)\b(?:university|universit\w*|institute?|college|laborator\w*|labs?|department|school|gmbh|inc|ltd|corporation|research)\b"
    return (F.size(F.split(F.trim(c), r"\s+")) >= 2) & ~c.rlike(organisation)


def name_parts(c: Column) -> Column:
    """What commas part, without blanks around and empty parts."""
    return F.filter(F.transform(F.split(c, ","), lambda p: F.trim(p)), lambda p: p != "")


def joined_parts(c: Column) -> Column:
    """What the word "and" parts."""
    return F.split(F.trim(c), r"\s*,?\s+and\s+")


def is_joined_reversed(c: Column) -> Column:
    """"Last, First and Last, First": each part has one comma."""
    parts = joined_parts(c)
    return (F.size(parts) > 1) & F.forall(parts, lambda p: F.size(F.split(p, ",")) == 2)


def may_be_reversed(c: Column) -> Column:
    """Whether a list reads "Last, First, Last, First": an even number of parts, one of which at least is a single word; or joined so by "and"."""
    parts = name_parts(c)
    return is_joined_reversed(c) | ((F.size(parts) % 2 == 0) & F.exists(parts, lambda p: ~p.contains(" ")))


def _turned(first: Column, last: Column) -> Column:
    return F.trim(F.concat_ws(" ", F.trim(first), F.trim(last)))


def ordered_names(c: Column, reversed_list: Column) -> Column:
    """"First Last, First Last" of a list in any of its forms. Lists of an odd number of parts can't be paired and stay, as do blank ones."""
    parts, joined = name_parts(c), joined_parts(c)
    turned = F.array_join(F.transform(joined, lambda p: _turned(F.get(F.split(p, ","), F.lit(1)), F.get(F.split(p, ","), F.lit(0)))), ", ")
    plain = F.array_join(F.filter(F.transform(joined, lambda p: F.btrim(p, F.lit(", "))), lambda p: p != ""), ", ")
    places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(parts) - 2), F.lit(2))
    pairs = F.array_join(F.transform(places, lambda k: _turned(F.get(parts, k + 1), F.get(parts, k))), ", ")
    paired = reversed_list & (F.size(parts) > 0) & (F.size(parts) % 2 == 0)
    return F.when(is_joined_reversed(c), turned).when(F.size(joined) > 1, plain).when(paired, pairs).otherwise(c)


# Country names besides those of ISO 3166 in English, and legal forms.
MORE_COUNTRIES = ["USA", "U.S.A", "US", "UK", "U.K", "China", "P.R. China", "PR China", "P. R. China", "People's Republic of China", "Korea", "Republic of Korea", "South Korea", "Russia", "Taiwan", "R.O.C", "Hong Kong", "Macau", "Vietnam", "Iran", "The Netherlands", "Czech Republic", "Turkey"]
LEGAL_FORMS = ["inc", "ltd", "llc", "gmbh", "corp", "co", "co ltd", "limited", "incorporated", "ag", "bv", "plc", "srl", "spa", "sa"]


@cache
def country_names() -> tuple[str, ...]:
    """The English names of the countries of ISO 3166, and MORE_COUNTRIES."""
    jvm = SparkContext._active_spark_context._jvm.java.util
    names = {str(jvm.Locale("", c).getDisplayCountry(jvm.Locale.ENGLISH)) for c in jvm.Locale.getISOCountries()}
    return tuple(sorted(names | set(MORE_COUNTRIES)))


def repaired_letters(c: Column) -> Column:
    """Letters that were read as two of another encoding, put right; other texts as they are."""
    twice = c.rlike(r"^(?:[\x00-\x7F]|[\xC2-\xDF][\x80-\xBF])*$") & c.rlike(r"[\xC2-\xDF]")
    return F.when(twice, F.decode(F.encode(c, "ISO-8859-1"), "UTF-8")).otherwise(c)


def institution(c: Column, by_hand: Mapping[str, str], learnt: Mapping[str, str]) -> Column:
    """An institution's name: letters put right, without addresses, footnotes, postcodes, and countries and legal forms at its end; then through
    the table by hand, the learnt one, and that by hand again."""
    c = strip_addresses(let(unescape(c), repaired_letters), keep_domain=False)
    c = F.regexp_replace(c, r"^[\s\d*†‡§,.;:()-]+|[\s*†‡§,;:(-]+$", "")
    parts = F.filter(F.transform(F.split(c, ","), lambda p: squeezed(F.regexp_replace(p, r"(?<![\w-])(?:[A-Z]{1,2}-)?\d{4,6}(?![\w-])", " "))), lambda p: p != "")
    behind = lambda p: F.btrim(p, F.lit(". ")).isin([*country_names()]) | _said(p).isin(LEGAL_FORMS)
    legal = lambda w, k: (k > 0) & _said(w).isin(LEGAL_FORMS)
    c = let(parts, lambda parts: F.array_join(_to_last(parts, F.transform(parts, behind)), ", "))
    c = let(words_of(c), lambda words: F.btrim(F.array_join(_to_last(words, F.transform(words, legal)), " "), F.lit(" ,")))
    for table in (by_hand, learnt, by_hand):
        c = let(c, lambda c, table=table: F.coalesce(mapped(c, table), c))
    return c


INSTITUTION = r"(?i)\b(?:universit\w*|institut\w*|college|polytechnic\w*|school|academy|laborator\w*|labs?|research|center|centre|hospital|ETH|MIT|EPFL|KAIST)\b"


def split_institutions(c: Column) -> Column:
    """Several organisations in one value, if every part between semicolons, slashes or "and" is one; else the value alone."""
    parts = F.transform(F.split(c, r"\s*;\s*|\s+/\s+|\s+and\s+"), lambda p: F.trim(p))
    return F.when((F.size(parts) > 1) & F.forall(parts, lambda p: p.rlike(INSTITUTION)), parts).otherwise(F.array(c))


def no_institution(c: Column) -> dict[str, Column]:
    """Why a value isn't an institution, by name: each a condition."""
    words, shaped = words_of(c), c.rlike(INSTITUTION)
    countries = [*country_names()]
    first, last = F.rtrim(F.get(words, F.lit(0)), F.lit(".,")), F.btrim(F.element_at(F.split(c, ","), -1), F.lit(" ."))
    uneven = lambda x, y: F.length(F.translate(c, x, "")) != F.length(F.translate(c, y, ""))
    return {
        "too short": F.length(c) < 2,
        "no letters": ~c.rlike(r"\p{L}"),
        "a link": c.rlike(r"https?://|www\."),
        "a domain": c.rlike(r"^\S+\.[a-z]{2,4}$"),
        "an address": c.contains("@") | c.rlike(r"(?i)\be-?mails?\b|\[at\]|\(at\)"),
        "a footnote": c.rlike(r"(?i)footnote|\bwork (?:was )?done\b|\bcorrespond\w+ author|\bequal\w* contribut|\bproject (?:lead|page)\b"),
        "thanks": c.rlike(r"(?i)\b(?:supported|funded|provided|sponsored|acknowledg\w*|grant)\b"),
        "a sentence": c.rlike(r"(?i)^(?:and|the authors?|of|with|we|this|these|is|are|was)\b|\b(?:is|are|was|were) (?:with|at|from)\b") | (F.size(words) > 15),
        "a person": c.rlike(r"^(?:\p{Lu}\. ?)+\p{Lu}\p{Ll}+$"),
        "a street": c.rlike(r"(?i)^\d+[a-z]?\s|\b(?:street|avenue|road|box|floor|boulevard)\b|stra(?:ss|ß)e\s*\d|\bstr\.\s*\d"),
        "a postcode": c.rlike(r"^[A-Z]{2},? \d{5}\b|\b\d{5}(?:-\d{4})?$|^[A-Z]-\d{4,5}\b|^[A-Z]\d[A-Z] ?\d[A-Z]\d$"),
        "a number": c.rlike(r"\d{6}") | (c.rlike(r"^\p{L}+\.? \d{1,4}$") & ~shaped),
        "a part": c.rlike(r"(?i)^(?:department|dept\.?|faculty|school|division|chair) of\b") & ~c.rlike(r"(?i)universit|institute of technology"),
        "a country": c.isin(countries),
        "a place": ~shaped & ((c.contains(",") & last.isin(countries)) | (first.isin(countries) & (F.size(words) <= 4))),
        "lost letters": c.contains("�") | c.contains("\\"),
        "half a bracket": uneven("(", ")") | uneven("[", "]"),
    }


def valid_institution(c: Column, always: Iterable[str] = (), never: Iterable[str] = ()) -> Column:
    """Whether a value is an institution: listed as always one; else not listed as never one, and for none of the reasons of no_institution not one. Null isn't."""
    bad = reduce(or_, no_institution(c).values())
    never, always = [*never], [*always]
    bad = bad | c.isin(never) if never else bad
    return F.coalesce((c.isin(always) if always else F.lit(False)) | ~bad, F.lit(False))


def sector(c: Column, industry: Iterable[str], academic: Iterable[str]) -> Column:
    """industry or academic by the lists, else by how the name reads, else null."""
    return F.when(c.isin([*industry]), "industry").when(c.isin([*academic]), "academic").when(c.rlike(INSTITUTION), "academic").when(c.rlike(r"(?i)\b(?:inc|ltd|llc|gmbh|ag|corp|corporation|technologies|motors|robotics)\b"), "industry")


def short_name(c: Column) -> Column:
    """What a paper calls its method: before a colon (6 words, 40 signs at most), before a spaced dash (3 words), before a verb, or a name with inner capitals in brackets."""
    colon, dash = F.regexp_extract(c, r"^([^:]{1,40}):\s", 1), F.regexp_extract(c, r"^(\S+(?:\s\S+){0,2})\s[-–—]\s", 1)
    verb, bracket = F.regexp_extract(c, r"^([A-Z]\w*[A-Z0-9]\w*)\s(?:is|are|can|enables|makes|improves)\b", 1), F.regexp_extract(c, r"\(([A-Z]\w*[a-z]\w*[A-Z]\w*)\)", 1)
    return F.coalesce(F.when((colon != "") & (F.size(F.split(colon, " ")) <= 6), colon), *[F.when(x != "", x) for x in (dash, verb, bracket)])


def has_code(c: Column) -> Column:
    """Whether an abstract says that code is or will be available; null if there is no abstract."""
    return c.rlike(r"(?i)github\.com|gitlab\.com|\b(?:code|source code|implementation)\b[^.]{0,60}\b(?:available|released?|open[- ]?sourced?|public(?:ly)?)\b")


def code_link(learnt: Column, stored: Column, abstract: Column) -> Column:
    return F.coalesce(learnt, stored, has_code(abstract))


def arxiv_id(c: Column) -> Column:
    """The id in a link or text, without version, or null."""
    got = F.regexp_extract(c, r"(?<!\d)(\d{4}\.\d{4,5})(?:v\d+)?(?!\d)", 1)
    return F.when(got != "", got)


def id_month(c: Column) -> Column:
    """The month that an id names, as its first day."""
    return F.to_date(F.when(c.rlike(r"^\d{2}(?:0[1-9]|1[0-2])\.\d{4,5}"), F.concat(F.lit("20"), F.substring(c, 1, 2), F.lit("-"), F.substring(c, 3, 2), F.lit("-01"))))


def doi(c: Column) -> Column:
    """Lower-cased, without resolver and final marks; null if it isn't one."""
    got = F.lower(F.regexp_replace(F.trim(c), r"(?i)^(?:https?://(?:dx\.)?doi\.org/|doi:\s*)", ""))
    got = F.regexp_replace(got, r"[.,;)\s]+$", "")
    return F.when(got.rlike(r"^10\.\d{4,9}/\S+$"), got)


def looks_like_paper_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^(?:[0-9a-f]{40}|CorpusId:\d+|ARXIV:\d{4}\.\d{4,5}|DOI:10\.\d{4,9}/\S+)$"), F.lit(False))


def clean_text(c: Column) -> Column:
    """Text of a marked-up field: tags go, entities turn into signs, spaces before marks and doubled ones go."""
    c = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1>", " ")
    c = unescape(F.regexp_replace(c, r"(?s)<[^<>]*>", " "))
    return F.regexp_replace(squeezed(c), r" ([,.;:!?)\]])", "$1")


def significant_words(c: Column, generic: Iterable[str] = ()) -> Column:
    words = F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 2))
    return F.array_except(words, F.array(*[F.lit(g) for g in generic])) if [*generic] else words


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def title_close(threshold: float = 0.92):
    """Whether two titles are one: equal keys, one in the other if over 20 signs, or a ratio of matching blocks at least the threshold."""

    @pandas_udf("boolean")
    def close(a: pd.Series, b: pd.Series) -> pd.Series:
        def one(x, y):
            if not x or not y:
                return False
            return x == y or (min(len(x), len(y)) > 20 and (x in y or y in x)) or difflib.SequenceMatcher(None, x, y).ratio() >= threshold

        return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])

    return lambda a, b: close(plain_key(a), plain_key(b))


def label(c: Column, names: Mapping[str, str]) -> Column:
    """The table's label, else the slug in words with capitals."""
    return F.coalesce(mapped(c, names), F.initcap(F.regexp_replace(c, "[_-]+", " ")))


def without_senses(c: Column, phrases: Iterable[str]) -> Column:
    """Lower-cased, phrases in which a word has another sense masked, longest first."""
    pattern = "|".join(re.escape(p.lower()) for p in sorted(phrases, key=len, reverse=True))
    c = F.lower(F.coalesce(c, F.lit("")))
    return F.regexp_replace(c, rf"\b(?:{pattern})\b", " ") if pattern else c


# Macros that stand for a sign, and raised and lowered digits.
SIGNS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "lambda": "λ", "mu": "μ", "pi": "π", "sigma": "σ", "theta": "θ", "omega": "ω", "times": "×", "pm": "±", "leq": "≤", "geq": "≥", "approx": "≈", "infty": "∞", "rightarrow": "→", "cdot": "·", "sim": "∼", "eta": "η", "kappa": "κ", "nu": "ν", "xi": "ξ", "rho": "ρ", "tau": "τ", "phi": "φ", "chi": "χ", "psi": "ψ", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "Phi": "Φ", "le": "≤", "ge": "≥", "neq": "≠", "to": "→", "in": "∈", "cup": "∪", "cap": "∩", "circ": "°", "ell": "ℓ", "ldots": "…", "dots": "…", "nabla": "∇", "partial": "∂", "sum": "∑", "equiv": "≡", "propto": "∝"}
_UP, _DOWN = str.maketrans("0123456789+-n", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻ⁿ"), str.maketrans("0123456789+-", "₀₁₂₃₄₅₆₇₈₉₊₋")


def plain_math(text: str) -> str:
    """Formulas ($...$, $$...$$, \\(...\\) and \\[...\\]) in plain signs; sums of money aren't formulas: macros of SIGNS, wrappers such as \\mathbf{x}, raised and lowered digits. Unknown macros stay as written."""

    def group(s: str, i: int) -> tuple[str, int]:
        if i < len(s) and s[i] == "{":
            depth, j = 1, i + 1
            while j < len(s) and depth:
                depth += {"{": 1, "}": -1}.get(s[j], 0)
                j += 1
            return s[i + 1 : j - 1 if not depth else j], j
        return s[i : i + 1], i + 1

    def turn(s: str) -> str:
        out, i = [], 0
        while i < len(s):
            if m := re.compile(r"\\([A-Za-z]+)").match(s, i):
                name, i = m[1], m.end()
                if name in SIGNS:
                    out.append(SIGNS[name])
                elif name in ("mathbf", "mathrm", "mathit", "mathcal", "mathbb", "text", "textbf", "textit", "emph", "operatorname", "bm"):
                    inner, i = group(s, i)
                    out.append(turn(inner))
                else:
                    out.append(m[0])
            elif s[i] in "^_":
                inner, j = group(s, i + 1)
                inner, table = turn(inner), _UP if s[i] == "^" else _DOWN
                known = all(ord(x) in table for x in inner)
                out.append(inner.translate(table) if known and inner else s[i] + inner)
                i = j
            elif s[i] in "{}":
                i += 1
            else:
                out.append(s[i])
                i += 1
        return "".join(out)

    def span(m: re.Match) -> str:
        inner = next(x for x in m.groups() if x is not None)
        money = m[0][1] != "$" and m[0][0] == "$" and inner[0].isdigit() and " " in inner and not set("\\^_=") & set(inner)
        return m[0] if money else turn(inner)

    return re.sub(r"\$\$(.+?)\$\$|\\\((.+?)\\\)|\\\[(.+?)\\\]|\$([^$]+)\$", span, text, flags=re.DOTALL)


@pandas_udf(StringType())
def latex_to_plain(s: pd.Series) -> pd.Series:
    return s.map(plain_math, na_action="ignore")
