"""Line deduplication: a log-template tree finds lines that recur, but for their variable fields, across documents."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bounded_batches, quoted, stored
from .simhash import copy_groups

KEY = "__tesserine_id__"
#: Bits of the bucket set that tells which leaves may recur: the most that is ever broadcast is this over 8 bytes.
BUCKET_BITS = 20
#: So many recurring lines at most are broadcast, 16 bytes each; beyond, they meet the documents in a join.
BROADCAST_LINES = 1 << 17
FIELD = b"<*>"
_digit = re.compile(rb"[0-9]").search


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line; one with a digit is a variable field, and so is one that reads ``<*>`` itself."""
    tokens = line.split()
    if _digit(line):
        tokens = [t if t.isalpha() or not _digit(t) else FIELD for t in tokens]
    return tokens


def leaf(tokens: list[bytes], depth: int) -> int:
    """The leaf of the fixed-depth tree that a line comes to: by its token count, then its leading tokens."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b"%d " % len(tokens) + b" ".join(tokens[:depth])) >> 1


def line_id(tokens: list[bytes]) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(b" ".join(tokens))


class Leaf:
    """The templates below one leaf: token hashes, 0 for a generalised field."""

    def __init__(self, similarity: float) -> None:
        self.similarity = similarity
        self.templates: np.ndarray | None = None
        self.size = 0

    def add(self, tokens: np.ndarray) -> int:
        """The template that a line joins: the one that equals it in most tokens, ``similarity`` of them at least (the first of several), which
        then gives up the others; or a new one."""
        if self.size:
            equal = (self.templates[: self.size] == tokens).sum(1)
            best = int(equal.argmax())
            if equal[best] >= self.similarity * len(tokens):
                own = self.templates[best]
                own[own != tokens] = 0
                return best
        if self.templates is None:
            self.templates = np.zeros((4, len(tokens)), np.uint32)
        elif self.size == len(self.templates):
            self.templates = np.concatenate([self.templates, np.zeros_like(self.templates)])
        self.templates[self.size] = tokens
        self.size += 1
        return self.size - 1


def _lines(data: bytes, depth: int) -> Iterator[tuple[int, list[bytes]]]:
    """Leaf and tokens of each distinct line of a text that isn't blank."""
    for line in dict.fromkeys(data.split(b"\n")):
        if tokens := masked(line):
            yield leaf(tokens, depth), tokens


def fixed(tokens: list[bytes]) -> int:
    """How many tokens of a line aren't fields."""
    return len(tokens) - tokens.count(FIELD)


def _leaf_counts(rows: DataFrame, depth: int, long_words: int) -> DataFrame:
    """leaf, n, n_long: how many lines come to a leaf, a document's equal lines once, and how many of them have ``long_words`` fixed words."""

    def run(batches):
        seen: Counter[int] = Counter()
        seen_long: Counter[int] = Counter()

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (list(seen), list(seen.values()), [seen_long[at] for at in seen])], ["leaf", "n", "n_long"])
            seen.clear()
            seen_long.clear()
            return batch

        for b in batches:
            for data in b.column("data"):
                for at, tokens in _lines(data.as_py(), depth):
                    seen[at] += 1
                    if len(tokens) >= long_words and fixed(tokens) >= long_words:
                        seen_long[at] += 1
                if len(seen) > 500_000:
                    yield out()
        yield out()

    return rows.select("data").mapInArrow(run, "leaf long, n long, n_long long").groupBy("leaf").agg(F.sum("n").alias("n"), F.sum("n_long").alias("n_long"))


def _bucket(leaf_col: str) -> Column:
    return F.col(leaf_col).bitwiseAND(F.lit((1 << BUCKET_BITS) - 1))


def recurring_lines(docs: DataFrame, id_col: str, text_col: str, min_docs: int, depth: int, similarity: float, long_words: int, long_docs: int) -> tuple[DataFrame, DataFrame]:
    """(occurrences, recurring): doc_id, line and text hash of each line below a leaf that may recur; the lines that do."""
    spark = docs.sparkSession
    rows = docs.select(quoted(id_col).cast("long").alias("doc_id"), F.coalesce(quoted(text_col), F.lit("")).cast("binary").alias("data")).withColumn("text_hash", F.unhex(F.md5("data")))
    busy = stored(_leaf_counts(rows, depth, long_words).where((F.col("n") >= min_docs) | (F.col("n_long") >= long_docs)).select("leaf"), "leaves")
    bits = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in busy.select(_bucket("leaf").alias("b")).distinct().collect():
        bits[r["b"]] = 1
    shipped = spark.sparkContext.broadcast(np.packbits(bits).tobytes())

    def find(batches):
        may = np.unpackbits(np.frombuffer(shipped.value, np.uint8)).tobytes()
        last = (1 << BUCKET_BITS) - 1
        for b in batches:
            out = []
            for key, data, h in zip(b.column("doc_id").to_pylist(), b.column("data").to_pylist(), b.column("text_hash").to_pylist(), strict=True):
                own = {line_id(tokens): (at, tokens) for at, tokens in _lines(data, depth) if may[at & last]}
                out += [(key, at, line, h, b" ".join(tokens)) for line, (at, tokens) in own.items()]
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            for start in range(0, max(1, len(out)), 20_000):
                part = out[start : start + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in part], t) for k, t in enumerate(kinds)], ["doc_id", "leaf", "line", "text_hash", "masked"])

    found = stored(rows.mapInArrow(find, "doc_id long, leaf long, line binary, text_hash binary, masked binary").join(busy, "leaf", "left_semi"), "lines")
    lines = found.groupBy("leaf", "line").agg(F.min("masked").alias("masked"))

    def cluster(batches):
        from zlib import crc32

        at, below, out = None, {}, []
        for b in batches:
            for where, line, text in zip(b.column("leaf").to_pylist(), b.column("line").to_pylist(), b.column("masked").to_pylist(), strict=True):
                if where != at:
                    at, below = where, {}
                words = text.split(b" ")
                tokens = np.array([0 if x == FIELD else crc32(x) or 1 for x in words], np.uint32)
                tree = below.setdefault(len(tokens), Leaf(similarity))
                out.append((line, where, len(tokens) << 32 | tree.add(tokens), fixed(words) >= long_words))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.binary(), pa.int64(), pa.int64(), pa.bool_()))], ["line", "leaf", "place", "long"])
            out.clear()

    tree = stored(lines.repartition("leaf").sortWithinPartitions("leaf", "line").mapInArrow(cluster, "line binary, leaf long, place long, long boolean"), "templates")
    # a long line counts for itself, too: without leaf and place
    own = F.struct(F.lit(None).cast("binary").alias("line"), "leaf", "place"), F.struct("line", F.lit(0).cast("long").alias("leaf"), F.lit(0).cast("long").alias("place"))
    kind = F.explode(F.when(F.col("long"), F.array(*own)).otherwise(F.array(own[0]))).alias("kind")
    lines = tree.select(F.col("line").alias("of"), kind).select("of", F.xxhash64("kind.line", "kind.leaf", "kind.place").alias("kind"), F.when(F.col("kind.line").isNull(), min_docs).otherwise(long_docs).alias("needed"))
    lines = stored(lines, "kinds")
    holders = stored(found.select("line", "text_hash").distinct().join(lines, F.col("line") == F.col("of")).select("kind", "needed", "text_hash").distinct(), "holders")

    def supported(rows: DataFrame, who: str) -> DataFrame:
        return rows.groupBy("kind", "needed").agg(F.countDistinct(who).alias("support")).where(F.col("support") >= F.col("needed")).select("kind")

    # copy groups are no more than texts, so only holders of what enough texts have are grouped
    able = stored(holders.join(supported(holders, "text_hash"), "kind", "left_semi"), "holders")
    groups = stored(copy_groups(rows, "doc_id", "data", only=stored(able.select("text_hash").distinct(), "able")).select("text_hash", "class").distinct(), "copies")
    return found, lines.join(supported(able.join(groups, "text_hash"), "class"), "kind", "left_semi").select(F.col("of").alias("line")).distinct()


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 8, depth: int = 4, similarity: float = 0.8, long_words: int = 50, long_docs: int = 2, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with all rows and columns, its texts without the lines whose template recurs.

    Lines are parsed by a tree of fixed depth: token count, then ``depth`` leading tokens, tokens with digits being variable fields. Below a leaf,
    distinct lines in the order of their hash join the template that equals them in ``similarity`` of the tokens. A template recurs
    if its support is ``min_docs`` at least: the number of different documents with such a line, where a document counts once for all of its lines
    and a group of copies counts once: equal texts, and near copies as the near-duplicate stage links them (a Jaccard similarity of 0.8 of whole sets of
    five-word shingles), among the documents with a template that many texts have. Nothing is taken off; a further document can only lower a support if
    it makes one copy group of two. So a document that has many copies keeps its text, and its copies are left to near-deduplication.

    A line with ``long_words`` fixed words doesn't recur by chance: it also recurs if ``long_docs`` documents, so counted, have it word for word
    but for its fields. Lines that are only alike need ``min_docs`` at any length, or two revisions of a document would both lose their text.

    Blank lines stay. Null texts stay null and empty ones empty; a text whose lines all go becomes empty, and its row stays. Rows repeated
    count once, being copies. ``counts`` names two more columns: lines, and lines dropped. An empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    found, recurring = recurring_lines(docs, id_col, text_col, min_docs, depth, similarity, long_words, long_docs)
    recurring = stored(recurring, "recurring")
    names, more, shipped = docs.columns, [*(counts or [])], None
    if recurring.count() <= BROADCAST_LINES:
        shipped = docs.sparkSession.sparkContext.broadcast(b"".join(sorted(r["line"] for r in recurring.collect())))
        joined = docs
    else:
        named = found.withColumnRenamed("doc_id", KEY).withColumn(KEY, F.coalesce(F.col(KEY), F.lit(-(1 << 63))))
        gone = named.join(recurring, "line", "left_semi").groupBy(KEY).agg(F.collect_set("line").alias("__tesserine_gone__"))
        joined = docs.withColumn(KEY, F.coalesce(quoted(id_col).cast("long"), F.lit(-(1 << 63)))).join(gone, KEY, "left").drop(KEY)

    def clean(batches):
        every = None if shipped is None else {shipped.value[k : k + 16] for k in range(0, len(shipped.value), 16)}
        for b in batches:
            texts, n, dropped = [], [], []
            drops = b.column("__tesserine_gone__").to_pylist() if every is None else [every] * b.num_rows
            for data, drop in zip(b.column(text_col).to_pylist(), drops, strict=True):
                n.append((data or "").count("\n") + 1)
                if drop and data:
                    drop = drop if every is not None else set(drop)
                    kept = [x for x in data.split("\n") if not (tokens := masked(x.encode())) or line_id(tokens) not in drop]
                    data = data if len(kept) == n[-1] else "\n".join(kept)
                    dropped.append(n[-1] - len(kept))
                else:
                    dropped.append(0)
                texts.append(data)
            columns = [pa.array(texts, pa.string()) if c == text_col else b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(n, pa.int64()), pa.array(dropped, pa.int64())] if more else [])], [*names, *more])

    schema = StructType([*docs.schema.fields, *(StructField(c, LongType()) for c in counts or [])])
    return joined.mapInArrow(clean, schema)
