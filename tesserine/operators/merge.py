"""Merging records: priority dedup, carry-over from an earlier run, folding and filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import plain_key
from ..functions.values import nullify_empty
from ..scratch import stored


def priority_dedup(rows: DataFrame, key: Column, order: list[Column], fill: str | None = None, filler: Column | None = None) -> DataFrame:
    """The first row of each key in the order; rows with a blank key go. With ``fill``, a winner that lacks the column gets it from the
    first loser that is a ``filler`` and has it."""
    keyed = rows.withColumn("__k", key).where(F.coalesce(F.col("__k"), F.lit("")) != "")
    own = Window.partitionBy("__k").orderBy(*order)
    numbered = keyed.withColumn("__r", F.row_number().over(own))
    first = numbered.where("__r = 1").drop("__r")
    if not fill:
        return first.drop("__k")
    offered = F.when(filler if filler is not None else F.lit(True), nullify_empty(F.col(fill)))
    offers = numbered.where("__r > 1").select(F.col("__k").alias("__ok"), offered.alias("__o"), "__r").where("__o is not null").groupBy("__ok").agg(F.min_by("__o", "__r").alias("__o"))
    return first.join(offers, F.col("__k") == F.col("__ok"), "left").withColumn(fill, F.coalesce(nullify_empty(F.col(fill)), F.col("__o"))).drop("__k", "__ok", "__o")


def journal_takeover(rows: DataFrame, key: str, order: list[Column], journals: list[str], conferences: list[str], fill: list[str]) -> DataFrame:
    """Of a key's records the first stays, unless it is a conference's and a journal that presents there has the key too: then the
    first such journal record stays, with ``presented_at`` set and its empty fields filled from the conference record. If a
    journal record came first, only presented_at is set, from the first conference record after it."""
    own = Window.partitionBy(key).orderBy(*order)
    r = F.row_number().over(own)
    named = rows.withColumn("__r", r).withColumn("__j", F.col("venue").isin(journals)).withColumn("__c", F.col("venue").isin(conferences))
    whole = Window.partitionBy(key)
    first = F.min("__r").over(whole)
    fields = [*fill, "venue", "year"]
    record = F.struct("__r", *fields)
    named = named.withColumn("__first_c", F.min(F.when((F.col("__r") == 1) & F.col("__c"), record)).over(whole)).withColumn("__any_c", F.min(F.when(F.col("__c") & (F.col("__r") > first), record)).over(whole))
    named = named.withColumn("__j_r", F.min(F.when(F.col("__j"), F.col("__r"))).over(whole))
    takes = F.col("__first_c").isNotNull() & F.col("__j_r").isNotNull()
    kept = named.where(F.when(takes, F.col("__r") == F.col("__j_r")).otherwise(F.col("__r") == 1))
    label = lambda c: F.concat_ws(" ", F.col(f"{c}.venue"), F.col(f"{c}.year").cast("string"))
    kept = kept.withColumn("presented_at", F.when(takes, label("__first_c")).when(F.col("__j") & F.col("__any_c").isNotNull(), label("__any_c")))
    for c in fill:
        kept = kept.withColumn(c, F.when(takes, F.coalesce(nullify_empty(F.col(c)), F.col(f"__first_c.{c}"))).otherwise(F.col(c)))
    return kept.drop(*[c for c in kept.columns if c.startswith("__")])


def carry_over(now: DataFrame, prior: DataFrame, key: str, fields: list[str], order: str) -> DataFrame:
    """Fields that a record lacks come from the earlier run's record of the key; of several, the last in ``order``."""
    last = prior.groupBy(key).agg(*[F.max_by(f, order).alias(f"__{f}") for f in fields])
    got = now.join(last, key, "left")
    for f in fields:
        got = got.withColumn(f, F.coalesce(nullify_empty(F.col(f)), F.col(f"__{f}")))
    return got.drop(*[f"__{f}" for f in fields])


def first_seen(now: DataFrame, index: DataFrame, key: str, other_key: str, today: str, placeholder: str, backfill_limit: int = 20_000) -> DataFrame:
    """When a record was first seen: by its key, else by its other id, the earliest of several; else today. If more records than the
    limit are new at once, the index is taken to be young and they get the placeholder."""
    by_key = index.groupBy(key).agg(F.min("seen").alias("__a"))
    by_other = index.where(F.col(other_key).isNotNull()).groupBy(other_key).agg(F.min("seen").alias("__b"))
    got = now.join(by_key, key, "left").join(by_other, other_key, "left").withColumn("first_seen", F.coalesce("__a", "__b")).drop("__a", "__b")
    new = got.agg(F.count_if(F.col("first_seen").isNull()).alias("__new"))
    fresh = F.when(F.col("__new") > backfill_limit, F.lit(placeholder)).otherwise(F.lit(today)).cast("date")
    return got.crossJoin(F.broadcast(new)).withColumn("first_seen", F.coalesce("first_seen", fresh)).drop("__new")


def fold_by_id(rows: DataFrame, other_id: str, is_preprint: Column, key: str, fields: list[str]) -> DataFrame:
    """A preprint whose id a listed record carries is folded into the first such record by key: it fills its empty
    fields and goes. Listed records among each other, and preprints, stay."""
    marked = rows.withColumn("__p", is_preprint)
    listed = marked.where(~F.col("__p") & F.col(other_id).isNotNull())
    target = listed.groupBy(other_id).agg(F.min(key).alias("__target"))
    folded = marked.where(F.col("__p")).join(target, other_id)
    offers = folded.groupBy(F.col("__target").alias(key)).agg(*[F.min_by(nullify_empty(F.col(f)), F.when(nullify_empty(F.col(f)).isNotNull(), F.col(key))).alias(f"__{f}") for f in fields])
    kept = marked.join(folded.select(key), key, "left_anti").join(offers, key, "left")
    for f in fields:
        kept = kept.withColumn(f, F.coalesce(nullify_empty(F.col(f)), F.col(f"__{f}")))
    return kept.drop("__p", *[f"__{f}" for f in fields])


def fill_from(rows: DataFrame, side: DataFrame, key: str, field: str, source: str, stamp: str | None = None) -> DataFrame:
    """An empty field is filled from a side table (its key unique); ``stamp`` then names the source."""
    got = rows.join(side.select(key, F.col(field).alias("__side")), key, "left")
    empty = nullify_empty(F.col(field)).isNull() & F.col("__side").isNotNull()
    if stamp:
        got = got.withColumn(stamp, F.when(empty, F.lit(source)).otherwise(F.col(stamp)))
    return got.withColumn(field, F.when(empty, F.col("__side")).otherwise(F.col(field))).drop("__side")


def stamp_counts(papers: DataFrame, counts: DataFrame, key: str, graph_date: str) -> DataFrame:
    """Counts from the graph replace old ones, 0 where the graph has none; the date moves only if the count does."""
    got = papers.join(counts.select(key, F.col("n").alias("__n")), key, "left").withColumn("__n", F.coalesce("__n", F.lit(0)))
    date = F.when(F.col("__n").eqNullSafe(F.col("count")), F.col("updated")).otherwise(F.lit(graph_date))
    return got.withColumn("updated", date).withColumn("count", F.col("__n")).drop("__n")


def closest_year(rows: DataFrame, candidates: DataFrame, key: str, most: int = 1) -> DataFrame:
    """The candidate that shares the key and is closest in year, at most ``most`` away; the smallest id of equals."""
    pairs = rows.join(candidates.select(key, F.col("year").alias("__y"), F.col("id").alias("__id")), key)
    away = F.abs(F.col("year") - F.col("__y"))
    near = pairs.where(away <= most).groupBy("row").agg(F.min_by("__id", F.struct(away, F.col("__id"))).alias("match"))
    return rows.join(near, "row", "left")


def two_key_match(rows: DataFrame, records: DataFrame, strong: str, weak: str) -> DataFrame:
    """Each row's record by the strong key, else by the weak key if only one record has it; ``via`` tells which."""
    by_strong = records.where(F.col(strong).isNotNull()).groupBy(strong).agg(F.min("id").alias("__s"))
    by_weak = records.where(F.col(weak).isNotNull()).groupBy(weak).agg(F.min("id").alias("__w"), F.count(F.lit(1)).alias("__n")).where("__n = 1").drop("__n")
    got = rows.join(by_strong, strong, "left").join(by_weak, weak, "left")
    return got.withColumn("match", F.coalesce("__s", "__w")).withColumn("via", F.when(F.col("__s").isNotNull(), strong).when(F.col("__w").isNotNull(), weak)).drop("__s", "__w")


def resolve(rows: DataFrame, passes: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """passes: (name, table of key and id), the first that has the row's key gives its id and is named in ``via``; a null id is a miss."""
    got = rows
    for k, (_, table) in enumerate(passes):
        got = got.join(table.groupBy(key).agg(F.min("id").alias(f"__{k}")), key, "left")
    ids = [F.col(f"__{k}") for k in range(len(passes))]
    via = F.coalesce(*[F.when(i.isNotNull(), F.lit(name)) for i, (name, _) in zip(ids, passes, strict=True)])
    return got.withColumn("id", F.coalesce(*ids)).withColumn("via", via).drop(*[f"__{k}" for k in range(len(passes))])


def zip_ids(rows: DataFrame, names: str, others: str, ids: str) -> DataFrame:
    """Names and ids side by side, for rows where both lists have one length and name the same people."""
    norm = lambda c: F.transform(c, lambda x: F.regexp_replace(F.lower(x), "[^a-z]", ""))
    same = (F.size(names) == F.size(others)) & (F.size(others) == F.size(ids)) & (norm(names) == norm(others))
    return rows.where(same).select("*", F.posexplode(F.arrays_zip(F.col(names).alias("name"), F.col(ids).alias("id"))).alias("position", "pair")).select(*rows.columns, "position", "pair.name", "pair.id")


def institution_countries(authorship: DataFrame, known: DataFrame, industry: DataFrame) -> DataFrame:
    """Per paper its countries, sorted: those that authors have, and those known of their institutions, except that a
    company's gives nothing to an author who has a country. authorship: paper, author, institution, country."""
    placed = authorship.join(known.select("institution", F.col("country").alias("__k")), "institution", "left")
    placed = placed.join(industry.select("institution", F.lit(True).alias("__i")), "institution", "left")
    has = F.max(F.col("country").isNotNull()).over(Window.partitionBy("paper", "author"))
    added = F.when(~(F.coalesce("__i", F.lit(False)) & has), F.col("__k"))
    both = placed.select("paper", F.array("country", added).alias("c")).select("paper", F.explode("c").alias("c")).where("c is not null")
    return both.groupBy("paper").agg(F.array_sort(F.collect_set("c")).alias("countries"))


def intake(batch: DataFrame, floor_year: int, in_focus: Column, withdrawn: Column, known_ids: DataFrame, known_keys: DataFrame) -> DataFrame:
    """Each row of a batch (id, key, year, pos) with its outcome, the first that applies: old, seen, withdrawn, off_topic, known, repeated
    (an accepted row before it has the id or key), accepted. Null ids and keys equal nothing.

    Only accepted rows take an id or key, so a repeated one doesn't stand in the way of later rows. Rows of one id and key count once;
    of those left, a row that comes first for both its id and its key is accepted, and settles all others of either: a round of
    joins on keys and places, over again for what is still open, which a chain of conflicts of the length n takes n / 2 times.
    """
    got = batch.join(known_ids.select("id", F.lit(True).alias("__s")).distinct(), "id", "left").join(known_keys.select("key", F.lit(True).alias("__t")).distinct(), "key", "left")
    outcome = F.when(F.col("year") < floor_year, "old").when(F.col("__s"), "seen").when(withdrawn, "withdrawn").when(~in_focus, "off_topic").when(F.col("__t"), "known")
    got = stored(got.withColumn("outcome", outcome).drop("__s", "__t"), "intake")
    fresh = got.where("outcome is null").select("pos", F.coalesce(F.col("id").cast("string"), F.concat(F.lit("\0"), F.col("pos").cast("string"))).alias("i"), F.coalesce(F.col("key").cast("string"), F.concat(F.lit("\0"), F.col("pos").cast("string"))).alias("k"))
    open_ = stored(fresh.groupBy("i", "k").agg(F.min("pos").alias("pos")), "intake-open")
    taken = None
    while open_.take(1):
        first_i, first_k = (open_.groupBy(c).agg(F.min("pos").alias(f"first_{c}")) for c in ("i", "k"))
        now = stored(open_.join(first_i, "i").join(first_k, "k").where("pos = first_i and pos = first_k").select("i", "k", "pos"), "intake-taken")
        taken = now if taken is None else taken.unionByName(now)
        open_ = stored(open_.join(now.select("i"), "i", "left_anti").join(now.select("k"), "k", "left_anti"), "intake-open")
    accepted = F.lit(False) if taken is None else F.coalesce(F.col("__a"), F.lit(False))
    if taken is not None:
        got = got.join(taken.select("pos", F.lit(True).alias("__a")), "pos", "left")
    return got.withColumn("outcome", F.coalesce("outcome", F.when(accepted, "accepted").otherwise("repeated"))).drop("__a")


def funnel(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def person_key(name: Column) -> Column:
    """A person's name as letters only, case and order of words kept."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}]", "")


def affiliations_by_person(authorship: DataFrame, known: DataFrame) -> DataFrame:
    """authorship: paper, position, author, affiliations; known: paper, author, affiliations. Authors of a paper without affiliations get those that
    ``known`` has for the person on that paper; what an author has stays. Of several the first in order counts."""
    side = known.where(F.size("affiliations") > 0).groupBy(F.col("paper").alias("__p"), person_key(F.col("author")).alias("__n")).agg(F.min("affiliations").alias("__f"))
    got = authorship.join(side, (F.col("paper") == F.col("__p")) & (person_key(F.col("author")) == F.col("__n")), "left")
    has = F.coalesce(F.size("affiliations") > 0, F.lit(False))
    return got.withColumn("affiliations", F.when(has, F.col("affiliations")).otherwise(F.coalesce("__f", "affiliations"))).drop("__p", "__n", "__f")


def asked_ids(names: DataFrame) -> DataFrame:
    """names: name, id. Each id once, with how many names share it: what a look-up is asked for."""
    return names.where("id is not null").groupBy("id").agg(F.countDistinct("name").alias("names"))


def fan_out(names: DataFrame, results: DataFrame) -> DataFrame:
    """names: name, id; results: id and more. What a look-up found for an id goes to every name that has it."""
    return names.where("id is not null").select("name", "id").distinct().join(results, "id")


def optional_link(papers: DataFrame, links: DataFrame, title: str = "title", link: str = "link") -> DataFrame:
    """Papers with the link of their title's key, null without; of several the first in order."""
    side = links.groupBy(plain_key(F.col(title)).alias("__k")).agg(F.min(link).alias(link)).where(F.col("__k") != "")
    return papers.drop(link).join(side, plain_key(F.col(title)) == F.col("__k"), "left").drop("__k")


def key_intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both have, once each."""
    return left.select(key).where(F.col(key).isNotNull()).distinct().join(right.select(key), key, "left_semi")
