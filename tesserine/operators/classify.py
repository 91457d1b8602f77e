"""Rule cascades, a linear scorer over phrases, and how to judge them."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import without_senses
from ..functions.values import substring_count


# The border of a word of A-Z, digits and _, and the letters that case folding adds to two of these.
BORDER = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
FOLDED = {"s": "s\u017f", "S": "S\u017f", "k": "k\u212a", "K": "K\u212a"}


def alternation(phrases: Iterable[str], ascii_words: bool = False) -> str:
    """One pattern for all phrases as whole words, case aside: one pass over a text instead of one a phrase.
    ``ascii_words``: only A-Z, digits and _ make words, as for SQL's regular expressions; else letters of all scripts do."""
    phrases = sorted(set(phrases), key=lambda p: (-len(p), p))
    spelt = "|".join("".join(f"[{FOLDED[c]}]" if c in FOLDED else re.escape(c) for c in p) for p in phrases)
    if not ascii_words:
        return rf"(?i)\b(?:{spelt})\b"
    # few places have a first letter of a phrase, and only there the costlier border is looked for
    first = "".join(sorted({FOLDED.get(p[0], re.escape(p[0])) for p in phrases if p})) if all(phrases) else ""
    return "(?i)" + (f"(?=[{first}])" if first else "") + f"{BORDER}(?:{spelt}){BORDER}"


def mentions(c: Column, phrases: Iterable[str], ascii_words: bool = False) -> Column:
    phrases = [*phrases]
    return F.coalesce(c.rlike(alternation(phrases, ascii_words)), F.lit(False)) if phrases else F.lit(False)


def phrases_found(c: Column, phrases: Iterable[str], ascii_words: bool = False) -> Column:
    """The phrases that a text holds, once each, in small letters."""
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(alternation(phrases, ascii_words)), 0)
    return F.array_distinct(F.transform(found, lambda p: F.lower(F.translate(p, "\u017f\u212a", "sk"))))


def linear_score(title: Column, abstract: Column, weights: Mapping[str, tuple[float, float]], intercept: float, strong: Iterable[str] = (), bias: float = 0.0, ascii_words: bool = False) -> Column:
    """intercept + the title and abstract weights of the phrases each holds + bias if the title holds a strong phrase. Phrases are found once, as an array."""
    table = F.create_map(*[F.lit(x) for p, (t, a) in weights.items() for x in (p.lower(), F.array(F.lit(float(t)), F.lit(float(a))))])

    def _adding(table: Column, k: int):
        return lambda total, phrase: total + table[phrase][k]

    total = F.lit(float(intercept))
    for c, k in ((title, 0), (abstract, 1)):
        total = total + F.aggregate(phrases_found(c, weights, ascii_words), F.lit(0.0), _adding(table, k))
    return total + F.when(mentions(title, strong, ascii_words), float(bias)).otherwise(0.0)


def explained_score(title: Column, abstract: Column, weights: Mapping[str, tuple[float, float]], intercept: float, threshold: float, both: Column | None = None, ascii_words: bool = False) -> Column:
    """The score, how far from the threshold it is, and the phrases found, sorted. ``both``: the text whose phrases are listed where title and abstract
    one after the other aren't it: a title cut out of the abstract may end in the middle of a word."""
    both = F.concat_ws("\n", title, abstract) if both is None else both
    score = linear_score(title, abstract, weights, intercept, ascii_words=ascii_words)
    return F.struct(score.alias("score"), (score - threshold).alias("distance"), F.array_sort(phrases_found(both, weights, ascii_words)).alias("phrases"))


def relevance(title: Column, abstract: Column, rules: Mapping, label: Column | None = None, learnt: Column | None = None, both: Column | None = None, ascii_words: bool = False) -> Column:
    """The first that applies: a label by hand; exclusion, unless the text also learns; a title off scope; a phrase of the floor in the title or
    abstract; the topic word in the title once its other senses are masked; title-only phrases; the linear model; a learnt promotion.

    rules: yes, no, excluded, learning, off_scope, floor, topic, other_senses, title_only, weights, intercept, threshold.
    ``both``: title and abstract as one text, see ``explained_score``.
    """
    both = F.concat_ws("\n", title, abstract) if both is None else both
    got = F
    if label is not None:
        got = got.when(label == "no", "no").when(label == "yes", "yes")
    in_title, in_both = (lambda rule, c=c: mentions(c, rules[rule], ascii_words) for c in (title, both))
    got = got.when(in_title("excluded") & ~in_both("learning"), "no").when(in_title("off_scope"), "no")
    got = got.when(in_both("floor"), "yes").when(without_senses(title, rules["other_senses"]).rlike(alternation(rules["topic"], ascii_words)), "yes").when(in_title("title_only"), "yes")
    got = got.when(linear_score(title, abstract, rules["weights"], rules["intercept"], ascii_words=ascii_words) >= rules["threshold"], "yes")
    if learnt is not None:
        got = got.when(learnt == "yes", "yes")
    return got.otherwise("no")


def rests_on_one_mention(title: Column, abstract: Column, phrases: Iterable[str], labelled: Column, venue: Column, focused: Iterable[str], ascii_words: bool = False) -> Column:
    """Nothing but a single mention in the abstract speaks for a paper of a venue that isn't focused."""
    once = F.regexp_count(F.coalesce(abstract, F.lit("")), F.lit(alternation(phrases, ascii_words))) == 1
    return ~labelled & ~mentions(title, phrases, ascii_words) & once & ~F.coalesce(venue.isin([*focused]), F.lit(False))


def review_queue(rows: DataFrame, one_mention: Column, relevant: Column, key: str, done: DataFrame) -> DataFrame:
    """Relevant records with an abstract that rest on one mention, once a key, not yet judged."""
    return rows.where(one_mention & relevant & F.col("abstract").isNotNull()).dropDuplicates([key]).join(done, key, "left_anti")


def gates(title: Column, abstract: Column, gate_phrases: Mapping[str, Iterable[str]], ascii_words: bool = False) -> Column:
    """The first gate of which the title holds a phrase, or the abstract two; null if none opens."""
    got = F
    for name, phrases in gate_phrases.items():
        got = got.when(mentions(title, phrases, ascii_words) | (F.regexp_count(F.coalesce(abstract, F.lit("")), F.lit(alternation(phrases, ascii_words))) >= 2), name)
    return got.otherwise(None)


def keyword_category(rows: DataFrame, key: str, title: str, abstract: str, taxonomy: Mapping[str, Iterable[str]]) -> DataFrame:
    """Per row the best category: by keyword counts in the title, then in both, then the longest keyword found, then the later name. Counts are of substrings.
    Rows without any keyword get none. The taxonomy is a list of literals beside each row, not a join."""
    t, both = F.lower(F.coalesce(F.col(title), F.lit(""))), F.lower(F.concat_ws(" ", title, abstract))
    scores = []
    for name, words in taxonomy.items():
        words = [w.lower() for w in words]
        in_title = sum((substring_count(F.col("__t"), F.lit(w)) for w in words), F.lit(0))
        in_both = sum((substring_count(F.col("__b"), F.lit(w)) for w in words), F.lit(0))
        longest = F.greatest(*[F.when(F.col("__b").contains(w), len(w)).otherwise(0) for w in words], F.lit(0))
        scores.append(F.struct(in_title.alias("title_score"), in_both.alias("score"), longest.alias("longest"), F.lit(name).alias("category")))
    best = rows.select(key, t.alias("__t"), both.alias("__b")).select(key, F.array_max(F.array(*scores)).alias("x"))
    return best.select(key, F.when(F.col("x.score") > 0, F.col("x.category")).alias("category"), F.when(F.col("x.score") > 0, F.col("x.title_score")).otherwise(0).alias("title_score"), "x.score")


def prefer_specific(best: DataFrame, scores: DataFrame, key: str, general: str, specific: str) -> DataFrame:
    """The specific category instead of the general one where its title score is as high and its longest keyword longer. scores: key, category, title_score, longest."""
    g = scores.where(F.col("category") == general).select(key, F.col("title_score").alias("__gt"), F.col("longest").alias("__gl"))
    s = scores.where(F.col("category") == specific).select(key, F.col("title_score").alias("__st"), F.col("longest").alias("__sl"))
    got = best.join(g, key, "left").join(s, key, "left")
    better = (F.col("category") == general) & (F.col("__st") >= F.col("__gt")) & (F.col("__sl") > F.col("__gl"))
    return got.withColumn("category", F.when(F.coalesce(better, F.lit(False)), specific).otherwise(F.col("category"))).drop("__gt", "__gl", "__st", "__sl")


def last_resort(category: Column, explains: Column, names_topic: Column, learnt: Column, relevant: Column) -> Column:
    """explainability where nothing else fits or no topic is named, then the learnt label, then misc for relevant papers."""
    return F.when(explains & (~names_topic | category.isNull()), "explainability").otherwise(F.coalesce(category, learnt, F.when(relevant, "misc").otherwise("uncategorized")))


def confusion(rows: DataFrame, truth: Column, said: Column, weight: Column | None = None) -> DataFrame:
    """One row: tp, fp, fn, tn (weighted), precision, recall, f1 and accuracy; null where undefined. Rows without a truth don't count."""
    w = weight if weight is not None else F.lit(1.0)
    got = rows.select(truth.cast("boolean").alias("t"), said.cast("boolean").alias("s"), w.cast("double").alias("w")).where("t is not null and s is not null")
    cells = got.agg(*[F.coalesce(F.sum(F.when((F.col("t") == t) & (F.col("s") == s), F.col("w"))), F.lit(0.0)).alias(n) for n, t, s in (("tp", True, True), ("fp", False, True), ("fn", True, False), ("tn", False, False))])
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    cells = cells.withColumn("precision", F.round(tp / F.nullif(tp + fp, zero), 6)).withColumn("recall", F.round(tp / F.nullif(tp + fn, zero), 6))
    return cells.withColumn("f1", F.round(2 * tp / F.nullif(2 * tp + fp + fn, zero), 6)).withColumn("accuracy", F.round((tp + tn) / F.nullif(tp + fp + fn + tn, zero), 6))


def threshold_sweep(rows: DataFrame, score: str, truth: str, steps: int = 400, target_precision: float = 0.9) -> DataFrame:
    """On an even grid of thresholds: precision and recall. A row falls into a grid cell once; running sums over cells do the rest."""
    ends = rows.agg(F.min(score).alias("lo"), F.max(score).alias("hi"))
    cell = F.least(F.lit(steps - 1), F.floor((F.col(score) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * steps))
    cells = rows.crossJoin(F.broadcast(ends)).groupBy(F.coalesce(cell, F.lit(0)).cast("int").alias("cell"), "lo", "hi").agg(F.count_if(F.col(truth) == 1).alias("p"), F.count(F.lit(1)).alias("n"))
    above, all_ = Window.orderBy(F.desc("cell")), Window.partitionBy()
    got = cells.select((F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("cell") / steps).alias("threshold"), F.sum("p").over(above).alias("tp"), F.sum("n").over(above).alias("said"), F.sum("p").over(all_).alias("positive"))
    got = got.select("threshold", (F.col("tp") / F.col("said")).alias("precision"), (F.col("tp") / F.nullif(F.col("positive"), F.lit(0))).alias("recall"))
    return got.withColumn("meets", F.col("precision") >= target_precision)


def train_linear(rows: DataFrame, features: list[str], label: str, weight: str | None = None, elastic: float = 0.5, strength: float = 0.01):
    """Logistic regression on 0/1 phrase columns with class-balanced weights; returns (weights by feature, intercept)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    share = rows.agg(F.avg(F.col(label).cast("double")).alias("p")).first()["p"]
    base = F.col(weight) if weight else F.lit(1.0)
    balanced = rows.withColumn("__w", base * F.when(F.col(label) == 1, 0.5 / max(share, 1e-9)).otherwise(0.5 / max(1 - share, 1e-9)))
    made = VectorAssembler(inputCols=features, outputCol="__f").transform(balanced)
    model = LogisticRegression(featuresCol="__f", labelCol=label, weightCol="__w", elasticNetParam=elastic, regParam=strength, maxIter=100).fit(made)
    return dict(zip(features, np.array(model.coefficients).tolist(), strict=True)), float(model.intercept)
