"""Mixing sources: temperature weights found by bisection, realised as budgeted permutations of blocks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, quoted, stored
from .tokens import id_counts

#: Documents to a block, and blocks to a source: either way a window over blocks, or over a block's documents, stays small.
BLOCK_DOCS, MOST_BLOCKS = 512, 1 << 16
SRC, KEY = "__tesserine_source__", "__tesserine_"


def temperature(tokens: list[float], exponent: float) -> list[float]:
    """Weights in proportion to the shares raised to ``exponent``: 1 keeps the shares, 0 levels them. Sources without tokens weigh 0."""
    total = sum(tokens)
    raised = [math.exp(exponent * math.log(t / total)) if t else 0.0 for t in tokens]
    return [r / sum(raised) for r in raised]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def bisect(fits: Callable[[float], bool], low: float = 0.0, high: float = 1.0, steps: int = 60) -> float:
    """The smallest exponent that fits, where ``fits`` turns from false to true once; ``high`` if none does."""
    if fits(low):
        return low
    for _ in range(steps):
        middle = (low + high) / 2
        low, high = (low, middle) if fits(middle) else (middle, high)
    return high


@dataclass
class Plan:
    """Per source: name, tokens, documents, weight, budget in tokens, and repeats = budget / tokens. exponent: as bisected."""

    sources: list[str | None]
    tokens: list[int]
    documents: list[int]
    weights: list[float]
    budgets: list[int]
    exponent: float

    @property
    def repeats(self) -> list[float]:
        return [b / t if t else 0.0 for b, t in zip(self.budgets, self.tokens, strict=True)]


def plan_weights(sources: list[tuple[str | None, int, int]], budget: int | str = "total", max_repeats: float | None = None, target_entropy: float | None = None) -> Plan:
    """sources: (name, tokens, documents). The flattest temperature mix that fits.

    ``budget``: tokens to deal out, "total" for as many as there are, or "cover" for the least that take each source
    once in full. With ``max_repeats`` no source may be read more often. With ``target_entropy`` (in nats) the mix may not be flatter
    than that; a target below the entropy of the shares themselves gives an exponent up to 8. A limit that no exponent
    meets (say a budget beyond max_repeats times all tokens) is an error.
    """
    names, tokens, documents = ([s[k] for s in sources] for k in range(3))
    if not sum(tokens):
        return Plan(names, tokens, documents, [0.0] * len(names), [0] * len(names), 1.0)

    def dealt(a: float) -> tuple[list[float], float]:
        w = temperature(tokens, a)
        return w, {"total": float(sum(tokens)), "cover": max(t / x for t, x in zip(tokens, w, strict=True) if t)}.get(budget, budget)

    def within_repeats(a: float) -> bool:
        w, total = dealt(a)
        return max(x * total / t for t, x in zip(tokens, w, strict=True) if t) <= max_repeats * (1 + 1e-9)

    exponent = 0.0
    if max_repeats is not None:
        exponent = bisect(within_repeats)
        if not within_repeats(exponent):
            raise ValueError(f"no mix reads each source at most {max_repeats} times within {budget} tokens")
    if target_entropy is not None:
        exponent = max(exponent, bisect(lambda a: entropy(temperature(tokens, a)) <= target_entropy, high=8.0))
        if max_repeats is not None and not within_repeats(exponent):
            raise ValueError("the target entropy breaks the repetition limit")
    w, total = dealt(exponent)
    return Plan(names, tokens, documents, w, [round(x * total) for x in w], exponent)


def words(text: Column) -> Column:
    """A cheaper ``token_count`` than id_counts, by built-in functions: white space between words, and one for the end. Null and empty texts count 1.
    It takes a text without spaces for one token, so weights by it aren't those of the ids."""
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, " \n\t\r", "")) + 1).cast("long")


class Mix:
    """A plan for ``docs`` and the cuts that realise it.

    Each reading of a source goes through its blocks in an order that a hash of seed, reading and block gives, and through a
    block's documents likewise. Readings before the last are whole. The last stops at the document that fills the budget, which is
    a pair of hashes per source: so the mix of a table is a filter on the table, with a row per source broadcast, and moves no text.
    Shares and budgets count ``token_count`` of each text, by default the ids that packing and storing make of it.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", token_count: Callable[[Column], Column] = id_counts, seed: int = 0, max_sources: int = 10_000, **how) -> None:
        self.spark, self.id_col, self.source_col, self.seed = docs.sparkSession, id_col, source_col, seed
        bounded_batches(self.spark)
        slim = docs.select(quoted(id_col).cast("long").alias("doc_id"), quoted(source_col).cast("string").alias("source"), token_count(quoted(text_col)).alias("n_tokens"))
        self.slim = stored(slim, "mix")
        totals = self.slim.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("d")).orderBy(F.col("source").asc_nulls_first()).limit(max_sources + 1).collect()
        if len(totals) > max_sources:
            raise ValueError(f"over {max_sources} sources; raise max_sources if the driver has room for a row of each")
        self.plan = plan_weights([(r["source"], r["t"], r["d"]) for r in totals], **how)
        self.cuts = self._cuts()

    def _blocks(self, documents: int) -> int:
        return max(1, min(MOST_BLOCKS, -(-documents // BLOCK_DOCS)))

    def _sources(self, rows: list[tuple], schema: str) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(rows, f"{SRC} string, {schema}"))

    def _keyed(self, df: DataFrame, source: Column, key: Column, readings: list[tuple], schema: str) -> DataFrame:
        """``df`` with the source's row (readings), its block, and a row for each reading, ordered by block_order and doc_order."""
        joined = df.join(self._sources(readings, schema), source.eqNullSafe(F.col(SRC)), "inner").withColumn(f"{KEY}block", F.pmod(F.xxhash64(F.lit(self.seed), key), F.col(f"{KEY}blocks")))
        each = joined.withColumn(f"{KEY}reading", F.explode(F.sequence(F.col(f"{KEY}first"), F.col(f"{KEY}last"))))
        at = [F.lit(self.seed), F.col(f"{KEY}reading"), F.coalesce(F.col(SRC), F.lit(""))]
        return each.withColumn(f"{KEY}block_order", F.xxhash64(*at, F.col(f"{KEY}block"))).withColumn(f"{KEY}doc_order", F.xxhash64(*at, key, F.lit(1)))

    def _rows(self, partial_only: bool = False) -> list[tuple]:
        """(source, blocks, first reading, last reading): the last one may be partial."""
        p = self.plan
        last = [max(0, math.ceil(r - 1e-12) - 1) for r in p.repeats]
        return [(s, self._blocks(d), n if partial_only else 0, n) for s, d, n, b in zip(p.sources, p.documents, last, p.budgets, strict=True) if b > 0]

    def _cuts(self) -> dict[str | None, tuple[int, int]]:
        """Per source, the block and the document (as hashes) at which the last reading has filled the budget."""
        schema = f"{KEY}blocks int, {KEY}first int, {KEY}last int"
        due = {s: b - t * max(0, math.ceil(b / t - 1e-12) - 1) for s, b, t in zip(self.plan.sources, self.plan.budgets, self.plan.tokens, strict=True) if b > 0}
        if not due:
            return {}
        need = self._sources(list(due.items()), "due long").withColumnRenamed(SRC, "due_source")
        rows = self._keyed(self.slim, F.col("source"), F.col("doc_id"), self._rows(partial_only=True), schema).select("source", "n_tokens", F.col(f"{KEY}block_order").alias("b"), F.col(f"{KEY}doc_order").alias("d"))
        blocks = rows.groupBy("source", "b").agg(F.sum("n_tokens").alias("t"))
        ahead = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        met = blocks.withColumn("before", F.coalesce(F.sum("t").over(ahead), F.lit(0))).join(need, F.col("source").eqNullSafe(F.col("due_source"))).where("before < due")
        last = met.groupBy("source").agg(F.max(F.struct("b", "before", "due")).alias("x")).select(F.col("source").alias("s"), "x.*").collect()
        edge = self._sources([(r["s"], r["b"], r["due"] - r["before"]) for r in last], "eb long, left long")
        inside = rows.join(edge, F.col("source").eqNullSafe(F.col(SRC)) & (F.col("b") == F.col("eb")))
        inside = inside.groupBy("source", "d", "left").agg(F.sum("n_tokens").alias("t")).withColumn("before", F.coalesce(F.sum("t").over(Window.partitionBy("source").orderBy("d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        ends = {r["source"]: r["d"] for r in inside.where("before < left").groupBy("source").agg(F.max("d").alias("d")).collect()}
        return {r["s"]: (r["b"], ends[r["s"]]) for r in last}

    def applied(self, df: DataFrame, key: Column, source: Column) -> DataFrame:
        """``df``'s rows, each as often as the plan reads it, with the helper columns."""
        rows = [(*r, *self.cuts[r[0]]) for r in self._rows()]
        keyed = self._keyed(df, source, key, rows, f"{KEY}blocks int, {KEY}first int, {KEY}last int, {KEY}cut_block long, {KEY}cut_doc long")
        b, d = F.col(f"{KEY}block_order"), F.col(f"{KEY}doc_order")
        before = (b < F.col(f"{KEY}cut_block")) | ((b == F.col(f"{KEY}cut_block")) & (d <= F.col(f"{KEY}cut_doc")))
        return keyed.where((F.col(f"{KEY}reading") < F.col(f"{KEY}last")) | before)

    def rows(self, docs: DataFrame) -> DataFrame:
        """The mixed documents, with the columns of ``docs``."""
        return self.applied(docs, quoted(self.id_col).cast("long"), quoted(self.source_col).cast("string")).select(*[quoted(c) for c in docs.columns])

    def schedule(self) -> DataFrame:
        """doc_id, source, reading, n_tokens, weight, position: where in the mix a document stands, from 0 to 1, so that any stretch of the order holds each source by its weight."""
        p = self.plan
        plan = self._sources([(s, w, float(b), t) for s, w, b, t in zip(p.sources, p.weights, p.budgets, p.tokens, strict=True)], "weight double, budget double, total long").withColumnRenamed(SRC, "plan_source")
        taken = self.applied(self.slim, F.col("doc_id"), F.col("source")).select("doc_id", "source", "n_tokens", F.col(f"{KEY}reading").alias("reading"), F.col(f"{KEY}block_order").alias("b"), F.col(f"{KEY}doc_order").alias("d"))
        blocks = taken.groupBy("source", "reading", "b").agg(F.sum("n_tokens").alias("t"))
        ahead = Window.partitionBy("source", "reading").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        blocks = blocks.select(F.col("source").alias("bs"), F.col("reading").alias("br"), F.col("b").alias("bb"), F.coalesce(F.sum("t").over(ahead), F.lit(0)).alias("base"))
        inside = Window.partitionBy("source", "reading", "b").orderBy("d", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
        placed = taken.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(blocks, F.col("source").eqNullSafe(F.col("bs")) & (F.col("reading") == F.col("br")) & (F.col("b") == F.col("bb")))
        return placed.join(plan, F.col("source").eqNullSafe(F.col("plan_source"))).select(
            "doc_id", "source", "reading", "n_tokens", "weight", ((F.col("total") * F.col("reading") + F.col("base") + F.col("inside")) / F.col("budget")).alias("position"))


def mix_schedule(docs: DataFrame, **how) -> DataFrame:
    """One row per reading of a document: see Mix and Mix.schedule.

    The budget is met to within one document a source. Null and empty texts count one token; a null source is a source of its own; a
    null id is an id like any other; rows repeated are dealt each. An empty table gives no rows.
    """
    return Mix(docs, **how).schedule()


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """The mixed documents themselves, with the columns of ``docs``; a document read twice is two rows."""
    return Mix(docs, **how).rows(docs)
