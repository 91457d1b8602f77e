"""Numbers, dates, arrays and maps: small expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a chart's axis within a power of ten.
AXIS_STEPS = (1, 2, 2.5, 3, 4, 5, 7.5, 10)


def server_round(c: Column, digits: int = 0) -> Column:
    """Half to even."""
    return F.bround(c, digits)


def client_round(c: Column, digits: int = 0) -> Column:
    """Half up; for values that aren't negative."""
    return F.round(c, digits)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent; null where the whole is 0."""
    return server_round(100.0 * part / F.nullif(whole.cast("double"), F.lit(0.0)), digits)


def growth_rate(first: Column, last: Column, steps: Column, digits: int = 1) -> Column:
    """Compound growth in percent a step; null without steps or a first value."""
    ratio = last / F.nullif(first.cast("double"), F.lit(0.0))
    return F.when(steps > 0, server_round(100 * (F.pow(ratio, 1.0 / steps) - 1), digits))


def h_index(counts: Column) -> Column:
    """The largest h such that h of the counts are h at least; nulls don't count."""
    falling = F.sort_array(F.filter(counts, lambda x: x.isNotNull()), asc=False)
    return F.size(F.filter(F.transform(falling, lambda x, i: x >= i + 1), lambda ok: ok)).cast("long")


def axis_max(c: Column) -> Column:
    """The smallest 4 x step x 10^k that is not below the value; 4 for values of 0 or less."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(c / 4.0)))
    step = F.coalesce(*[F.when(s * power * 4 >= c - 1e-9, s * power * 4) for s in AXIS_STEPS])
    return F.when(c <= 0, F.lit(4.0)).otherwise(step)


def window_start(window_end: Column, floor: Column, overlap_days: int = 3) -> Column:
    """Where the next incremental window begins: some days before the last one's end, not before the floor."""
    return F.greatest(F.date_sub(window_end, overlap_days), floor)


def overlaps(first: Column, last: Column, other_first: Column, other_last: Column) -> Column:
    """Two closed spans share a point."""
    return (first <= other_last) & (other_first <= last)


def nullify_empty(c: Column, kind: str = "string") -> Column:
    """Null for what counts as missing when filling: empty text, array or map."""
    missing = (c == "") if kind == "string" else F.size(c) == 0
    return F.when(missing, None).otherwise(c)


def words_match(c: Column, query: str) -> Column:
    """Every word of the query is somewhere in the text, in any order and case; an empty query matches all."""
    found = F.lit(True)
    for w in query.lower().split():
        found = found & F.lower(F.coalesce(c, F.lit(""))).contains(w)
    return found


def substring_count(c: Column, word: Column) -> Column:
    """Occurrences that don't overlap; 0 for an empty word."""
    n = (F.length(c) - F.length(F.replace(c, word, F.lit("")))) / F.nullif(F.length(word), F.lit(0))
    return F.coalesce(n, F.lit(0)).cast("long")


def days_since(date: Column, today: Column, never: int | None = None) -> Column:
    """Whole days from a date to today; for no date ``never``."""
    days = F.datediff(today.cast("date"), date.cast("date"))
    return days if never is None else F.coalesce(days, F.lit(never))
