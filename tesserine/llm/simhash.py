"""SimHash near-duplicates: fingerprints over word shingles, linked through BK-trees."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blobs, bounded_batches, components, quoted, stored

BITS = 64
#: Fingerprints that a worker remembers, for copies.
COPIES = 10_000
#: Shingles hashed at once, so that a very long text needs no more memory.
SLICE = 1 << 16
#: Bits of the bucket set that tells which texts are compared whole: what is broadcast is this over 8 bytes.
BUCKET_BITS = 20
#: Join keys that no column of the input is called.
KEY = "__tesserine_id__"
HASH = "__tesserine_hash__"


class BKTree:
    """Integers under Hamming distance. A child hangs on its integer distance to its parent; a search follows only edges within the radius."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The place of the new value; equal values get a place each, at distance 0."""
        place = len(self.values)
        at = 0
        while place:
            d = (value ^ self.values[at]).bit_count()
            if (then := self.children[at].setdefault(d, place)) == place:
                break
            at = then
        self.values.append(value)
        self.children.append({})
        return place

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Places of all values at most ``radius`` away."""
        todo = [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (value ^ self.values[at]).bit_count()
            if d <= radius:
                yield at
            todo += [child for edge, child in self.children[at].items() if d - radius <= edge <= d + radius]


def shingle_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the shingles of ``words`` words, repeats included, in slices. Only A-Z are lower-cased; fewer words are one shingle; no words give nothing."""
    from xxhash import xxh64_intdigest

    # bytes.lower and bytes.split know just A-Z and \t\n\v\f\r and space
    w = data.lower().split()
    if not w:
        return
    if len(w) <= words:
        yield np.array([xxh64_intdigest(b" ".join(w), 42)], dtype=np.uint64)
        return
    join = b" ".join
    for start in range(0, len(w) - words + 1, SLICE):
        part = w[start : start + SLICE + words - 1]
        yield np.array([xxh64_intdigest(join(x), 42) for x in zip(*(part[k:] for k in range(words)), strict=False)], dtype=np.uint64)


#: Bytes that the rolling hash takes at once, and the size of its tables of powers.
CHUNK = 1 << 16
BASE = 0x9E3779B97F4A7C15


@cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and BASE to the power of k and of -k, modulo 2**64."""
    draws = np.random.default_rng(20_240_301).integers(0, 1 << 64, size=256, dtype=np.uint64)
    steps = [np.full(CHUNK, x, np.uint64) for x in (BASE, pow(BASE, -1, 1 << 64))]
    for x in steps:
        x[0] = 1
    return draws, np.cumprod(steps[0]), np.cumprod(steps[1])


def _prefixes(x: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The polynomials of the bytes before each of ``places``, which ascend."""
    draws, up, _ = _powers()
    out, carry = np.empty(len(places), np.uint64), np.uint64(0)
    for k in range(0, len(x) + 1, CHUNK):
        part = x[k : k + CHUNK]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(draws[part] * up[: len(part)], out=sums[1:])
        sums = sums * np.uint64(pow(BASE, k, 1 << 64)) + carry
        lo, hi = np.searchsorted(places, [k, k + CHUNK])
        out[lo:hi] = sums[places[lo:hi] - k]
        carry = sums[-1]
    return out


def rolling_hashes(data: bytes, words: int) -> Iterator[np.ndarray]:
    """As shingle_hashes, but by a polynomial over bytes, from whose prefixes all shingles' hashes come by array operations.

    For sketches and similarities, which need equal hashes for equal shingles and no particular ones.
    """
    x = np.frombuffer(b" ".join(data.lower().split()), np.uint8)
    if not len(x):
        return
    gaps = np.flatnonzero(x == 32)
    words = min(words, len(gaps) + 1)
    starts, ends = np.append(0, gaps + 1)[: len(gaps) + 2 - words], np.append(gaps, len(x))[words - 1 :]
    down = _powers()[2]
    with np.errstate(over="ignore"):
        h = (_prefixes(x, ends) - _prefixes(x, starts)) * down[starts % CHUNK]
        if len(x) > CHUNK:
            block = starts // CHUNK
            h *= np.array([pow(BASE, -int(b) * CHUNK, 1 << 64) for b in range(block[-1] + 1)], np.uint64)[block]
        for mix in (0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F):
            h = (h ^ (h >> np.uint64(32))) * np.uint64(mix)
        h ^= h >> np.uint64(29)
    for k in range(0, len(h), SLICE):
        yield h[k : k + SLICE]


def fingerprint(data: bytes, words: int, sketch: Sketch | None = None) -> tuple[int, bytes | None]:
    """A bit is 1 if over half the shingle hashes set it; the fingerprint of no words is 0. Second: the min-hash sketch, if one is asked for;
    then the hashes are rolling_hashes."""
    ones, n, least = np.zeros(BITS, np.int64), 0, None
    for h in shingle_hashes(data, words) if sketch is None else rolling_hashes(data, words):
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
        if sketch is not None:
            part = sketch.least(h)
            least = part if least is None else np.minimum(least, part)
    bits = int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0]) if n else 0
    return bits, None if sketch is None else sketch.pack(least)


class Sketch:
    """``bands`` x ``rows`` minima of the shingle hashes under fixed multiply-add permutations.

    Two texts agree in each minimum with a probability equal to their Jaccard similarity, so a band is equal
    with J**rows: 16 bands of 5 miss a pair of similarity 0.8 once in 400 times, one of 0.85 once in 8,000.
    """

    def __init__(self, bands: int, rows: int) -> None:
        self.bands, self.rows = bands, rows
        x = np.random.default_rng(20_240_229).integers(0, 1 << 32, size=(2, bands * rows), dtype=np.uint32)
        self.mul, self.add = x[0] | np.uint32(1), x[1, :, None]

    def least(self, hashes: np.ndarray) -> np.ndarray:
        """The minima over the upper halves of the hashes: 32 bits are told apart, and computed with, faster than 64."""
        with np.errstate(over="ignore"):
            x = (hashes >> np.uint64(32)).astype(np.uint32)
            return np.min([(np.multiply.outer(self.mul, part) + self.add).min(1) for part in np.array_split(x, len(x) // 1024 + 1)], axis=0)

    def pack(self, least: np.ndarray | None) -> bytes:
        """All ones for a text without words."""
        if least is None:
            least = np.full(self.bands * self.rows, np.iinfo(np.uint32).max)
        return least.astype("<u4").tobytes()


def _prints(rows: DataFrame, words: int, sketch: tuple[int, int] | None, carried: tuple[str, ...] = ("doc_id",), chosen: Chosen | None = None) -> DataFrame:
    """rows: ``data`` and the columns ``carried``. Those columns, fp and, with ``sketch``, sketch; of ``chosen`` rows alone."""
    bounded_batches(rows.sparkSession)

    def run(batches):
        made = None if sketch is None else Sketch(*sketch)
        known: dict[bytes, tuple[int, bytes | None]] = {}
        for b in batches if chosen is None else chosen.of(batches):
            if len(known) > COPIES:
                known.clear()
            got = []
            for x in b.column("data").to_pylist():
                key = md5(x).digest()
                if (print_ := known.get(key)) is None:
                    print_ = known[key] = fingerprint(x, words, made)
                got.append(print_)
            out = [*(b.column(c) for c in carried), pa.array(np.array([x[0] for x in got], np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays(out + ([] if made is None else [pa.array([x[1] for x in got], pa.binary())]), [*carried, "fp", "sketch"][: len(carried) + 1 + (made is not None)])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carried)
    rows = rows if chosen is None else rows.select("*", _bucket())
    return rows.mapInArrow(run, kept + ", fp long" + ", sketch binary" * (sketch is not None))


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", sketch: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) and, with ``sketch`` = (bands, rows), sketch binary. One pass over whole texts without a shuffle."""
    return _prints(blobs(docs, id_col, text_col), words, sketch)


def key_masks(radius: int) -> list[int]:
    """Masks that keep all blocks of bits but ``radius`` of them: two values within the radius agree under one mask at least.

    radius + 4 blocks; for radius 2 these are 15 masks of 42 bits or more, so values that agree under one are at most 4 million.
    """
    blocks = radius + 4
    cut = [round(k * BITS / blocks) for k in range(blocks + 1)]
    part = [((1 << cut[k + 1]) - 1) ^ ((1 << cut[k]) - 1) for k in range(blocks)]
    return [sum(part[k] for k in kept) for kept in combinations(range(blocks), blocks - radius)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


class Forest:
    """Union-find over places."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def top(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.top(x), self.top(y)
        self.up[max(x, y)] = min(x, y)


#: Members from which a component of a shard has a tree of its own.
LARGE = 16


def jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Of two arrays of distinct hashes; 1 for two empty ones."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(1, len(x) + len(y) - both) if len(x) + len(y) else 1.0


def shingle_set(data: bytes, words: int) -> np.ndarray:
    """The distinct shingle hashes of a text."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *rolling_hashes(data, words)]))


def shard_links(fps: np.ndarray, radius: int, sketches: list[bytes] | None, least_equal: int, sure: Callable[[int, int], bool] | None = None) -> Forest:
    """The components of one shard. Values come one by one, each first searching the trees of those before. ``sure`` has the last word on a link.

    A component of LARGE members gets a tree of its own, in which a search ends at the first link, as one link joins a
    value to all of it: a large group of near copies costs a few comparisons a copy. All other values are in a common tree, of which
    every link counts. So each link between components is found.
    """
    common, forest = BKTree(), Forest(len(fps))
    inside: list[int] = []
    large: list[tuple[BKTree, list[int]]] = []
    members: dict[int, list[int]] = {}
    values = fps.view(np.uint64).tolist()
    minima = None if sketches is None else np.array([np.frombuffer(x, "<u4") for x in sketches])

    def similar(j: int, k: int) -> bool:
        return (minima is None or int((minima[j] == minima[k]).sum()) >= least_equal) and (sure is None or sure(j, k))

    for k, v in enumerate(values):
        home = None
        for tree, own in large:
            hit = next((own[p] for p in tree.within(v, radius) if similar(own[p], k)), None)
            if hit is not None:
                forest.join(hit, k)
                home = home or (tree, own)
        near = [inside[p] for p in common.within(v, radius)]
        if near and minima is not None:
            equal = (minima[near] == minima[k]).sum(1)
            near = [x for x, e in zip(near, equal.tolist(), strict=True) if e >= least_equal]
        if sure is not None:
            near = [x for x in near if sure(x, k)]
        if home is not None:
            for x in near:
                forest.join(x, k)
            home[0].add(v)
            home[1].append(k)
            continue
        joined = [k]
        for top in {forest.top(x) for x in near}:
            joined += members.pop(top, [])
        for x in near:
            forest.join(x, k)
        common.add(v)
        inside.append(k)
        if len(joined) < LARGE:
            members[forest.top(k)] = joined
        else:
            tree = BKTree()
            for x in joined:
                tree.add(values[x])
            large.append((tree, joined))
    return forest


def _linked(rows: DataFrame, radius: int, sketched: bool, least_equal: int, exact: tuple[int, float] | None = None) -> DataFrame:
    """rows: shard key columns k1, k2, node, fp[, sketch[, data]], a shard's rows next to each other in one partition. Returns star edges (a, b) of nodes.

    With ``exact`` = (words, similarity) a link also needs that Jaccard similarity of the whole shingle sets of the texts in ``data``.
    """

    def shards(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            k1, k2 = (t.column(c).to_numpy() for c in ("k1", "k2"))
            starts = np.concatenate([[0], np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1]) if len(k1) else np.array([0])
            yield t, starts[:-1], starts[1:]
            rest = t.slice(starts[-1]).combine_chunks()
        if rest is not None:
            yield rest, np.array([0]), np.array([rest.num_rows])

    def run(batches):
        for t, begin, end in shards(batches):
            a, b = [], []
            node, fp = t.column("node").to_numpy(), t.column("fp").to_numpy()
            for i, j in zip(begin, end, strict=True):
                if j - i < 2:
                    continue
                sure = None
                if exact is not None:
                    own = [shingle_set(x, exact[0]) for x in t.column("data").slice(i, j - i).to_pylist()]
                    sure = lambda x, y, own=own: jaccard(own[x], own[y]) >= exact[1]
                forest = shard_links(fp[i:j], radius, t.column("sketch").slice(i, j - i).to_pylist() if sketched else None, least_equal, sure)
                for x in range(j - i):
                    if (top := forest.top(x)) != x:
                        a.append(node[i + x])
                        b.append(node[i + top])
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long").distinct()


def _bucket() -> Column:
    """A text's place in the bucket set."""
    return F.xxhash64("text_hash").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).alias("__bucket__")


class Chosen:
    """The rows in the hash buckets of the text_hash of ``wanted``, found without a shuffle: all wanted ones, few others."""

    def __init__(self, wanted: DataFrame) -> None:
        bits = np.zeros(1 << BUCKET_BITS, np.uint8)
        for r in wanted.select(_bucket()).distinct().collect():
            bits[r["__bucket__"]] = 1
        self.shipped = wanted.sparkSession.sparkContext.broadcast(np.packbits(bits).tobytes())

    def of(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may = np.unpackbits(np.frombuffer(self.shipped.value, np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(may[b.column("__bucket__").to_numpy()]))

    def rows(self, hashed: DataFrame) -> DataFrame:
        names = hashed.columns

        def run(batches):
            for b in self.of(batches):
                yield b.select(names)

        return hashed.select("*", _bucket()).mapInArrow(run, hashed.schema)


def _similar(docs: DataFrame, words: int, radius: int, similarity: float, bands: int, rows: int, only: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """docs: doc_id and data. (prints, edges): doc_id, text_hash, fp and node of each row; the links of nodes whose Jaccard similarity is confirmed.

    Sketches and fingerprints only search: their links give loose components. The texts of those, one a node, meet in
    a second pass, a component a task, and a link holds there if the whole shingle sets have the similarity.
    """
    bounded_batches(docs.sparkSession)
    hashed = docs.withColumn("text_hash", F.unhex(F.md5("data")))
    prints = _prints(hashed, words, (bands, rows), ("doc_id", "text_hash"), None if only is None else Chosen(only))
    if only is not None:
        prints = prints.join(only, "text_hash", "left_semi")
    prints = stored(prints.withColumn("node", F.xxhash64("fp", "sketch")), "simhash")
    values = prints.groupBy("node").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("text_hash").alias("text_hash"))
    values = stored(values, "values")
    band = F.explode(F.array(*[F.struct(F.lit(k).alias("k1"), F.xxhash64(F.substring("sketch", 4 * rows * k + 1, 4 * rows)).alias("k2")) for k in range(bands)]))
    dealt = values.select(band.alias("k"), "node").select("k.*", "node")
    shared = dealt.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shards = dealt.join(shared, ["k1", "k2"]).join(values, "node").select("k1", "k2", "node", "fp", "sketch")
    places = bands * rows
    needed = int(np.ceil(similarity * places - 3 * np.sqrt(similarity * (1 - similarity) * places)))
    loose = components(_linked(shards.repartition("k1", "k2").sortWithinPartitions("k1", "k2"), radius, True, needed))
    wanted = stored(values.join(loose, "node"), "loose")
    texts = Chosen(wanted).rows(hashed.select("text_hash", "data")).groupBy("text_hash").agg(F.first("data").alias("data"))
    near = wanted.join(texts, "text_hash").select(F.col("root").alias("k1"), F.lit(0).alias("k2"), "node", "fp", "sketch", "data")
    edges = _linked(near.repartition("k1").sortWithinPartitions("k1", "node"), radius, True, needed, (words, similarity))
    return prints, edges


def _classes(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """node, class (of its component) and component_id, the smallest doc_id of the class."""
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    own = nodes.join(components(edges), "node", "left").select("node", "least", F.coalesce("root", "node").alias("class"))
    least = own.groupBy("class").agg(F.min("least").alias("component_id"))
    # a table of its own, so that the last join can split a fingerprint that many documents have
    return stored(own.join(least, "class").select("node", "class", "component_id"), "classes")


def copy_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 16, similarity: float = 0.8, bands: int = 16, rows: int = 5, only: DataFrame | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp, text_hash (MD5 of the text, null being empty), class and component_id, linked as ``simhash_groups`` says.

    ``only`` has the text_hash of the texts that take part, once each; there are no rows for others.
    """
    prints, edges = _similar(blobs(docs, id_col, text_col), words, radius, similarity, bands, rows, only)
    return prints.join(_classes(prints, edges), "node").select("doc_id", "fp", "text_hash", "class", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 16, similarity: float | None = 0.8, bands: int = 16, rows: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links).

    Two texts link if their fingerprints differ in at most ``radius`` bits and, where ``similarity`` is given,
    if their shingle sets have that Jaccard similarity at least, compared whole. Only pairs are compared whose min-hash sketches agree as pairs of the
    similarity do in 699 of 700 cases: at 0.8, in 54 of 80 places. Shingles of similarity 0.8 put fingerprints 10 bits apart, over 16 in 1 of 100 cases.

    Without ``similarity`` the linking is exact: fingerprints are dealt to shards by key_masks, so each pair within
    the radius meets in a shard. With it, shards are the bands of the sketch (see Sketch), since a radius of a
    fifth of the bits leaves no selective mask. A shard's distinct values form a BK-tree in one task, found by a shuffle: to broadcast
    the trees would take the fingerprints of all documents through the driver. A task emits a spanning
    star for each component of its shard, never its pairs; equal texts and fingerprints meet once, as one value.

    Null text counts as empty. Texts without words have fingerprint 0 and link like any others. A null id is kept, as the
    smallest of its component only if there is no other. Rows repeated share component_id. An empty table gives no rows.
    """
    fingerprint_hex = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    if similarity is not None:
        return copy_groups(docs, id_col, text_col, words, radius, similarity, bands, rows).select("doc_id", fingerprint_hex, "component_id")
    prints = stored(fingerprints(docs, words, id_col, text_col), "simhash").withColumn("node", F.col("fp"))
    nodes = prints.groupBy("node").agg(F.min("doc_id").alias("least"))
    keys = F.explode(F.array(*[F.struct(F.lit(k).alias("k1"), F.col("node").bitwiseAND(F.lit(signed(m))).alias("k2")) for k, m in enumerate(key_masks(radius))]))
    shards = nodes.select(keys.alias("k"), "node", F.col("node").alias("fp")).select("k.*", "node", "fp")
    edges = _linked(shards.repartition("k1", "k2").sortWithinPartitions("k1", "k2"), radius, False, 0)
    return prints.join(_classes(prints, edges), "node").select("doc_id", fingerprint_hex, "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each component of ``copy_groups``, all columns: that with the smallest id, a null one only if there is no other.

    A row is told by its id and text, so different texts under one id, or without one, stay each for its own component. Of
    rows of a component that repeat the smallest id, that with the smallest text hash stays.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    kept = copy_groups(docs, id_col, text_col, **how).groupBy("class").agg(first).select(F.col("first.doc_id").alias(KEY + "kept"), F.col("first.text_hash").alias(HASH + "kept"))
    text = F.coalesce(quoted(text_col), F.lit("")).cast("binary")
    rows = docs.withColumn(KEY, quoted(id_col).cast("long")).withColumn(HASH, F.unhex(F.md5(text)))
    same = F.col(KEY).eqNullSafe(F.col(KEY + "kept")) & (F.col(HASH) == F.col(HASH + "kept"))
    return rows.join(kept, same, "left_semi").dropDuplicates([KEY, HASH]).drop(KEY, HASH)


__all__ = ["BKTree", "Sketch", "copy_groups", "fingerprint", "fingerprints", "key_masks", "simhash_dedup", "simhash_groups"]
