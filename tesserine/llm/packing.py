"""Packing token streams into windows of one length by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import zlib
from bisect import insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, stored, texts
from .tokens import encoder, tokenizer_path

CAPACITY = 1024
#: Documents whose rests are divided together: enough to balance well, few enough that each group is quick.
GROUP = 800
#: A rest is cut into pieces of at most this share of a window: differencing levels several small pieces far better than two large ones.
GRAINS = 4


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Places of ``sizes`` dealt to so many windows of nearly equal sums.

    Each size begins as a partial partition with one filled window. The two partitions with the largest imbalance
    (largest minus smallest window) merge, the fullest windows of one with the emptiest of the other, until one is left.
    A partition holds its filled windows only, in rising order of their sums, the others being empty.
    """
    heap = [(-size, k, [(size, [k])]) for k, size in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, at, x), (_, other, y) = heapq.heappop(heap), heapq.heappop(heap)
        over = len(x) + len(y) - windows
        if len(y) == 1 and over <= 1:
            # the usual case: one more window, or one more piece in the emptiest
            if over == 1:
                low, own = x.pop(0)
                y = [(low + y[0][0], own + y[0][1])]
            insort(x, y[0])
        elif over <= 0:
            x = sorted(x + y)
        else:
            # of the windows that both fill, x's emptiest meet y's fullest
            meet = [(s + t, p + q) for (s, p), (t, q) in zip(x[:over], reversed(y[len(y) - over :]), strict=True)]
            x = sorted(x[over:] + y[: len(y) - over] + meet)
        low = x[0][0] if len(x) == windows else 0
        heapq.heappush(heap, (low - x[-1][0], min(at, other), x))
    return [own for _, own in heap[0][2]] if heap else []


def pack_windows(sizes: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Windows of at most ``capacity``: as few as the sum allows, and more whenever differencing leaves one too full."""
    if max(sizes, default=0) > capacity:
        raise ValueError(f"a piece of {max(sizes)} doesn't fit {capacity}")
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        got = differencing(sizes, windows)
        fullest = max((sum(sizes[k] for k in w) for w in got), default=0)
        if fullest <= capacity:
            return got
        windows += max(1, windows * (fullest - capacity) // (8 * capacity))


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: each document's ids cut into full windows and the rest into grains, in one pass without a shuffle."""
    bounded_batches(docs.sparkSession)
    grain = max(1, capacity // GRAINS)

    def run(batches):
        made = encoder(path)
        for b in batches:
            out = []
            for key, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = made.with_end(text)
                n = len(ids) // 4
                whole = n - n % capacity
                cuts = [*range(0, whole, capacity), *range(whole, n, grain), n]
                out += [(key, i, j - i, zlib.crc32(ids[4 * i : 4 * j]), n) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 5, ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document is its ids and then id 0. Full windows are sequences of their own; what is left of each document, under
    ``capacity`` ids, is cut into grains and dealt with others of its group to windows by differencing. Groups are formed by a hash of
    the piece and hold the rests of about ``group`` documents at any size of the corpus, so no task gets more than a few groups' worth, whatever the
    sources or copies. Only rows of numbers are shuffled.

    Null text counts as empty: a piece of one id. Rows repeated are packed each. A null id stays null.
    An empty table gives no rows.
    """
    cut = stored(pieces(docs, path or tokenizer_path(), id_col, text_col, capacity), "pieces")
    rests = cut.where(F.col("length") < capacity).count()
    groups = max(1, -(-2 * rests // (group * GRAINS)))
    dealt = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "ids_crc32", "doc_tokens", F.when(F.col("length") == capacity, F.col("start"))), F.lit(groups)))

    def run(batches):
        rest = None
        for b in batches:
            t = pa.Table.from_batches([b])
            t = t if rest is None else pa.concat_tables([rest, t])
            g = t.column("g").to_numpy()
            edge = np.flatnonzero(g[1:] != g[:-1]) + 1
            begin = np.concatenate([[0], edge])
            for i, j in zip(begin[:-1], begin[1:], strict=True):
                yield sequences(t.slice(i, j - i))
            rest = t.slice(begin[-1]).combine_chunks()
        if rest is not None and rest.num_rows:
            yield sequences(rest)

    def sequences(t: pa.Table) -> pa.RecordBatch:
        length, g = t.column("length").to_numpy(), int(t.column("g")[0].as_py())
        number, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        full, part = np.flatnonzero(length == capacity), np.flatnonzero(length < capacity)
        number[full] = np.arange(len(full))
        for k, window in enumerate(pack_windows(length[part].tolist(), capacity) if len(part) else []):
            own = part[window]
            number[own] = len(full) + k
            offset[own] = np.cumsum(length[own]) - length[own]
        columns = [t.column(c).combine_chunks() for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
        return pa.RecordBatch.from_arrays([*columns, pa.array(number + (g << 32)), pa.array(offset)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    order = ["g", "doc_id", "start", "ids_crc32"]
    return dealt.repartition("g").sortWithinPartitions(*order).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
