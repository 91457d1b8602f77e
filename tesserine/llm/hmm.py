"""A hidden Markov language model: Baum-Welch over partitions, exact likelihoods by the scaled forward recursion."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import free_shuffles
from .common import blobs, bounded_batches, held_out, stored

#: Tokens that one pass of the recursions holds, and tokens gathered before texts are sorted by length: many long texts side by side make few steps.
PASS, GATHER = 750_000, 2_000_000


@dataclass
class Shape:
    """Symbols: ``own`` frequent words have one each, other words share ``endings`` by their last three bytes, and the end of a text has the last.

    In stored texts a word that shares an ending but has emissions of its own (see ``lm_scores``) is told by its code: ``symbols`` plus its ending.
    """

    states: int = 8
    own: int = 4096
    endings: int = 4096

    @property
    def symbols(self) -> int:
        return self.own + self.endings + 1

    @property
    def codes(self) -> int:
        return self.symbols + self.endings

    @property
    def end(self) -> int:
        return self.own + self.endings

    def classes(self, codes: np.ndarray) -> np.ndarray:
        """The symbols of codes."""
        return np.where(codes >= self.symbols, codes - self.endings - 1, codes)

    def ending_column(self, word: Column) -> Column:
        """Which of the endings a word (binary) has."""
        return F.pmod(F.crc32(F.substring(word, -3, 3)), F.lit(self.endings)).cast("int")


@dataclass
class Model:
    """start: states; move: states x states; emit: symbols x states, columns summing to 1."""

    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    @classmethod
    def first(cls, shape: Shape, frequency: np.ndarray, seed: int = 7) -> Model:
        """Sticky states whose emissions are the symbols' frequencies, each shaken by a fixed random factor."""
        s = shape.states
        shaken = (frequency + 0.5)[:, None] * np.exp(np.random.default_rng(seed).normal(0, 0.6, (shape.symbols, s)))
        return cls(np.full(s, 1 / s), np.full((s, s), 0.1 / s) + 0.9 * np.eye(s), shaken / shaken.sum(0))

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """The maximum of the expected counts, with half a count more for each move and a little for each symbol, so that nothing is impossible."""
        s, m, e = start + 0.5, move + 0.5, emit + 0.01
        return Model(s / s.sum(), m / m.sum(1, keepdims=True), e / e.sum(0))


def _steps(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts, longest first: their places, how many are still running at each step, and their symbols step by step, without padding."""
    lengths = np.array([len(x) for x in texts])
    order = np.argsort(-lengths, kind="stable")
    # a text that is longer than a pass is a group of its own
    group = np.where(lengths[order] > PASS, -1 - np.arange(len(order)), np.cumsum(lengths[order]) // PASS)
    for own in np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []:
        size = lengths[own]
        active = np.searchsorted(-size, -np.arange(size[0]), side="left")
        starts = np.concatenate([[0], np.cumsum(active)[:-1]])
        flat = np.empty(size.sum(), np.int32)
        for k, x in enumerate(own):
            flat[starts[: size[k]] + k] = texts[x]
        yield own, active, flat


def forward(model: Model, active: np.ndarray, flat: np.ndarray, keep: tuple[np.ndarray, np.ndarray] | None = None, before: np.ndarray | None = None):
    """The natural log likelihood of each text, and the last step's vector. Each step's vector is scaled to sum 1; the logs of the scales add
    up. ``keep``: gets the vectors and scales of all steps, as ``flat`` has them. ``before``: the vector of the step before, where these go on."""
    likelihood = np.zeros(active[0])
    a, at = before, 0
    for n in active.tolist():
        a = (model.start if a is None else a[:n] @ model.move) * model.emit[flat[at : at + n]]
        scale = a.sum(1)
        a /= scale[:, None]
        likelihood[:n] += np.log(scale)
        if keep:
            keep[0][at : at + n], keep[1][at : at + n] = a, scale
        at += n
    return likelihood, a


def expected_counts(model: Model, texts: list[np.ndarray], segment: int = PASS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Of starts, moves and emissions, summed over texts, and the log likelihood. The vectors are of 32 bits, sums of 64. A pass holds one vector a
    token: on the way back, what is expected of its state takes its place.

    A text of over ``segment`` tokens is alone in its group: only the vectors at the borders of its segments are kept on the way forward, and
    each segment's are computed again on the way back, so memory doesn't grow with the longest text.
    """
    s, symbols = len(model.start), len(model.emit)
    short = Model(*(x.astype(np.float32, copy=False) for x in (model.start, model.move, model.emit)))
    start, move, emit, total = np.zeros(s), np.zeros((s, s)), np.zeros((symbols, s)), 0.0
    back = np.ascontiguousarray(short.move.T)
    for own, active, flat in _steps(texts):
        cuts = [*range(0, len(active), segment)] if len(own) == 1 else [0]
        ends = [*cuts[1:], len(active)]
        borders: list[np.ndarray | None] = [None]
        for lo, hi in zip(cuts[:-1], ends[:-1], strict=True):
            borders.append(forward(short, active[lo:hi], flat[lo:hi], before=borders[-1])[1])
        beta = np.ones((0, s), np.float32)
        for lo, hi, border in zip(cuts[::-1], ends[::-1], borders[::-1], strict=True):
            steps = active[lo:hi]
            part = flat[lo:hi] if len(own) == 1 else flat
            gamma, scale, at = np.empty((len(part), s), np.float32), np.empty(len(part), np.float32), len(part)
            total += forward(short, steps, part, keep=(gamma, scale), before=border)[0].sum()
            for t in range(len(steps) - 1, -1, -1):
                n = int(steps[t])
                at -= n
                if len(beta) < n:
                    beta = np.concatenate([beta, np.ones((n - len(beta), s), np.float32)])
                gamma[at : at + n] *= beta
                before = gamma[at - int(steps[t - 1]) :][:n] if t else border
                if before is not None:
                    ahead = short.emit[part[at : at + n]] * beta
                    ahead /= scale[at : at + n, None]
                    move += before.T @ ahead
                    beta = ahead @ back
            if border is None:
                start += gamma[: steps[0]].sum(0, dtype=np.float64)
            for k in range(s):
                emit[:, k] += np.bincount(part, gamma[:, k], minlength=symbols)
    return start, move * model.move, emit, total


def count_words(rows: DataFrame) -> DataFrame:
    """rows: data binary. How often each word (white-space separated, A-Z lower-cased) occurs: word binary, c."""

    def run(batches):
        seen: Counter[bytes] = Counter()

        def out():
            words = list(seen)
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([seen[w] for w in words], pa.int64())], ["word", "c"])
            seen.clear()
            return batch

        for b in batches:
            for data in b.column("data"):
                seen.update(data.as_py().lower().split())
                if len(seen) > 400_000:
                    yield out()
        yield out()

    return rows.select("data").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _symbolised(rows: DataFrame, counts: DataFrame, blocks: int, shape: Shape, own: dict[bytes, int], rare: np.ndarray, ends: int) -> DataFrame:
    """rows: doc_id, held_out, data; counts: word, c, number (null for a rare word); rare: the mass of rare words by ending. Each text as
    codes, with what its words' counts add up to.

    A vocabulary has no bound, so it isn't broadcast: texts are dealt to blocks, each block asks for the counts of its distinct
    words by a join, and meets the answer in one task. Output: block, doc_id, held_out, n_tokens, n_known, log_counts (the sum of
    log10(c + 0.5)), within (of log10 of the rare words' shares among those of their endings), codes (16-bit integers), numbers (of the
    words with emissions of their own, in the order of their codes, 64-bit integers).
    """
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.length("data")), F.lit(blocks)).cast("int"))
    shipped = rows.sparkSession.sparkContext.broadcast(np.log10(rare))
    columns = ["block", "doc_id", "held_out", "n_tokens", "n_known", "log_counts", "within", "codes", "numbers"]

    def ask(t: pa.Table) -> pa.Table:
        words: set[bytes] = set()
        for data in t.column("data"):
            words.update(data.as_py().lower().split())
        return pa.table([pa.array([t.column("block")[0].as_py()] * len(words), pa.int32()), pa.array(list(words), pa.binary())], ["block", "word"])

    def answer(t: pa.Table, met: pa.Table) -> pa.Table:
        place = {w: k for k, w in enumerate(met.column("word").to_pylist())}
        c, code, number = (met.column(x).to_numpy() for x in ("c", "code", "number"))
        log_c = np.log10(c + 0.5)
        ending = code - shape.own
        within = np.where((ending >= 0) & (ending < shape.endings), log_c - shipped.value[np.clip(ending, 0, shape.endings - 1)], 0.0)
        out = []
        for data in t.column("data"):
            w = data.as_py().lower().split()
            k = np.fromiter(map(place.__getitem__, w), np.int64, len(w))
            codes = np.append(code[k], shape.end)
            out.append((len(w) + 1, int((c[k] > 0).sum()) + (ends > 0), float(log_c[k].sum() + np.log10(ends + 0.5)), float(within[k].sum()), codes.astype("<u2").tobytes(), number[k[codes[:-1] >= shape.symbols]].astype("<i8").tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary())
        return pa.table([*(t.column(x).combine_chunks() for x in columns[:3]), *(pa.array([x[k] for x in out], kind) for k, kind in enumerate(kinds))], columns)

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, word binary")
    rank = F.broadcast(rows.sparkSession.createDataFrame([(bytearray(w), k) for w, k in own.items()], "word binary, rank int"))
    ending = shape.ending_column(F.col("word"))
    code = F.coalesce("rank", F.when(F.col("number").isNull(), F.lit(shape.own) + ending).otherwise(F.lit(shape.symbols) + ending))
    met = asked.join(counts, "word", "left").join(rank, "word", "left").select("block", "word", F.coalesce("c", F.lit(0)).alias("c"), code.cast("int").alias("code"), F.coalesce("number", F.lit(-1)).alias("number"))
    schema = "block int, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, within double, codes binary, numbers binary"
    return dealt.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(answer, schema)


def _arrays(t: pa.Table, column: str, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), kind) for x in t.column(column)]


def _gathered(batches, column: str, width: int):
    """Batches joined until ``column`` holds GATHER integers of ``width`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes // width
        if size > GATHER:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def with_words(shape: Shape, codes: list[np.ndarray], numbers: list[np.ndarray], known: np.ndarray) -> list[np.ndarray]:
    """Texts in which the word with the k-th of the ``known`` numbers, which ascend, is the integer ``symbols`` + k."""
    out = []
    for x, n in zip(codes, numbers, strict=True):
        y = x.astype(np.int32)
        y[x >= shape.symbols] = shape.symbols + np.searchsorted(known, n)
        out.append(y)
    return out


@dataclass
class Trained:
    """model, and the last round's expected counts: total by symbol and state, rare (those of rare words) by ending and state; words: number, v0, v1, ... by state, floats of 32 bits."""

    model: Model
    total: np.ndarray
    rare: np.ndarray
    words: DataFrame


def train(texts: DataFrame, shape: Shape, frequency: np.ndarray, rounds: int) -> Trained:
    """Baum-Welch on all rows (codes, numbers). Each partition sums its expected counts, Spark sums these by row of the model, and a model's size reaches the driver.

    The last round also sums the expected counts of each numbered word by state; these are a table, as their number grows with the corpus.
    """
    model = Model.first(shape, frequency)
    s, bounded = shape.states, 1 + shape.states + shape.symbols + shape.endings
    columns = [f"v{k}" for k in range(s)]
    schema = "row long, " + ", ".join(f"{c} double" for c in columns)
    for k in range(rounds):
        last = k + 1 == rounds
        shipped = texts.sparkSession.sparkContext.broadcast(model)

        def expect(batches, shipped=shipped, last=last):
            def batch(rows, values):
                return pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int64)), *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(s))], ["row", *columns])

            start, move, emit, rare = np.zeros(s), np.zeros((s, s)), np.zeros((shape.symbols, s)), np.zeros((shape.endings, s))
            for t in _gathered(batches, "codes", 2):
                codes = _arrays(t, "codes", "<u2")
                if last:
                    numbers = _arrays(t, "numbers", "<i8")
                    every = np.concatenate(codes)
                    known, first = np.unique(np.concatenate(numbers), return_index=True)
                    symbol = shape.classes(every[every >= shape.symbols][first].astype(np.int64))
                    codes = with_words(shape, codes, numbers, known)
                    del every, first, numbers  # before the passes, which hold most
                    m = shipped.value
                    emissions = m.emit.astype(np.float32)
                    a, b, e, _ = expected_counts(Model(m.start, m.move, np.concatenate([emissions, emissions[symbol]])), codes)
                    rare += e[shape.own : shape.end]
                    words, e = e[shape.symbols :], e[: shape.symbols]
                    np.add.at(e, symbol, words)
                    for lo in range(0, len(known), 100_000):
                        yield batch(bounded + known[lo : lo + 100_000], words[lo : lo + 100_000])
                else:
                    a, b, e, _ = expected_counts(shipped.value, [shape.classes(x) for x in codes])
                start += a
                move += b
                emit += e
            table = np.concatenate([start[None], move, emit, rare])
            rows = np.flatnonzero(table.sum(1))
            yield batch(rows, table[rows])

        read = texts.select("codes", *(["numbers"] if last else []))
        sums = read.mapInArrow(expect, schema).groupBy("row").agg(*[F.sum(c).alias(c) for c in columns])
        if last:
            sums = stored(sums, "emissions")
        table = np.zeros((bounded, s))
        for r in sums.where(F.col("row") < bounded).collect():
            table[r["row"]] = [r[c] for c in columns]
        start, move, emit, rare = np.split(table, [1, 1 + s, 1 + s + shape.symbols])
        model = model.updated(start[0], move, emit)
        shipped.unpersist()
    # sums of 64 bits over vectors of 32; each block gets these rows again, so they travel with 32
    words = sums.where(F.col("row") >= bounded).select((F.col("row") - bounded).alias("number"), *[F.col(c).cast("float").alias(c) for c in columns])
    return Trained(model, emit, rare, words)


def _asked_numbers(texts: DataFrame) -> DataFrame:
    """block, number: which numbered words a block has; a pair may be there more than once."""

    def run(batches):
        for t in _gathered(batches, "numbers", 8):
            block, numbers = t.column("block").to_numpy(), _arrays(t, "numbers", "<i8")
            for b in np.unique(block):
                own = np.unique(np.concatenate([numbers[k] for k in np.flatnonzero(block == b)]))
                for lo in range(0, len(own), 100_000):
                    part = own[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), b, np.int32)), pa.array(part)], ["block", "number"])

    return texts.select("block", "numbers").mapInArrow(run, "block int, number long")


def packed(words: DataFrame, states: int) -> DataFrame:
    """words: number, ending, c, v0, v1, ... The vs as one binary of 32-bit floats, ``expected``: as columns they would take eight bytes each in a shuffle."""

    def run(batches):
        for b in batches:
            values = np.stack([b.column(f"v{k}").to_numpy() for k in range(states)], 1).astype("<f4")
            expected = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * states), len(values), [None, pa.py_buffer(values.tobytes())])
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in ("number", "ending", "c")), expected.cast(pa.binary())], ["number", "ending", "c", "expected"])

    return words.mapInArrow(run, "number long, ending int, c long, expected binary")


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, states: int = 8, own_words: int = 4096, endings: int = 4096, rounds: int = 4, block_bytes: int = 16 << 20, own_bytes: int = 64, min_count: int = 10, shrink: float = 0.1) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Learns from all rows whose crc32(id as text) mod ``folds`` is not ``fold``. base_score is the text's log10 probability under the
    unigram counts of the training rows with half a count more for each of them and for the unknown word. score is that
    under the hidden Markov model: states emit symbols (see Shape). Among the words that share an ending, each with at least ``min_count``
    training occurrences has emissions of its own, however many such words there are: its share of the symbol in a state is in proportion to its
    expected count there in the last round plus ``shrink`` times its smoothed count. What is left of the symbol is divided among
    its rare words by their smoothed counts, an unknown word having half a count in each ending. So what is learned grows with the corpus, and only
    symbols (frequent words, endings) are broadcast. Words of over ``own_bytes`` bytes are never among the frequent ones, which bounds
    that broadcast. All sums of products are exact for the whole text.

    Null text counts as empty: only its end. Rows repeated are learned from and scored each; a null id counts as
    the empty text when held out. Without training rows the model is the first one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shape = Shape(states, own_words, endings)
    if shape.codes > 1 << 16 or rounds < 1:
        raise ValueError("codes are kept in 16 bits, and there must be a round")
    rows = blobs(docs, id_col, text_col).select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "data")
    size = rows.agg(F.sum(F.length("data")).alias("bytes"), F.count_if(~F.col("held_out")).alias("ends")).first()
    ends, blocks = size["ends"] or 0, max(1, -(-(size["bytes"] or 0) // block_bytes))
    counted = count_words(rows.where("not held_out"))
    counts = stored(counted.withColumn("number", F.when(F.col("c") >= min_count, F.monotonically_increasing_id())), "words")
    known = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = (known["n"] or 0) + ends, known["v"] + (ends > 0)

    frequent = counts.where(F.length("word") <= own_bytes).orderBy(F.desc("c"), "word").limit(own_words)
    top = [(bytes(r["word"]), r["c"]) for r in frequent.collect()]
    others = counts.join(F.broadcast(spark.createDataFrame([(bytearray(w),) for w, _ in top], "word binary")), "word", "left_anti")
    mass, rare, weight = np.full(endings, 0.5), np.full(endings, 0.5), F.col("c") + 0.5
    ending = shape.ending_column(F.col("word")).alias("ending")
    for r in others.groupBy(ending).agg(F.sum(weight).alias("m"), F.sum(F.when(F.col("number").isNull(), weight).otherwise(0.0)).alias("r")).collect():
        mass[r["ending"]] += r["m"]
        rare[r["ending"]] += r["r"]
    frequency = np.concatenate([np.pad(np.array([c for _, c in top], float), (0, own_words - len(top))), mass, [ends]])

    texts = stored(_symbolised(rows, counts, blocks, shape, {w: k for k, (w, _) in enumerate(top)}, rare, ends), "symbols")
    free_shuffles(spark)
    trained = train(texts.where("not held_out"), shape, frequency, rounds)
    free_shuffles(spark)
    m, shared = trained.model, slice(own_words, own_words + endings)
    # what one expected count of a word is worth in each state, by ending; the rare words keep the rest of their symbol
    worth = m.emit[shared] / (trained.total[shared] + shrink * mass[:, None])
    emit = m.emit.copy()
    emit[shared] = worth * (trained.rare + shrink * rare[:, None])
    shipped = spark.sparkContext.broadcast((Model(m.start, m.move, emit), worth))
    numbered = packed(counts.where("number is not null").select("number", ending, "c").join(trained.words, "number"), states)
    met = _asked_numbers(texts).join(numbered, "number")
    per_token = float(np.log10(n + 0.5 * (v + 1)))

    def score(t: pa.Table, met: pa.Table) -> pa.Table:
        model, worth = shipped.value
        known, first = np.unique(met.column("number").to_numpy(), return_index=True)
        c, of = (met.column(x).to_numpy()[first] for x in ("c", "ending"))
        expected = np.frombuffer(b"".join(met.column("expected").to_pylist()), "<f4").reshape(-1, states)[first].astype(float)
        model = Model(model.start, model.move, np.concatenate([model.emit, worth[of] * (expected + shrink * (c[:, None] + 0.5))]))
        codes = with_words(shape, _arrays(t, "codes", "<u2"), _arrays(t, "numbers", "<i8"), known)
        likelihood = np.zeros(len(codes))
        for own, active, flat in _steps(codes):
            likelihood[own] = forward(model, active, flat)[0]
        scored = likelihood / np.log(10) + t.column("within").to_numpy()
        base = t.column("log_counts").to_numpy() - t.column("n_tokens").to_numpy() * per_token
        return pa.table([*(t.column(x) for x in ("doc_id", "held_out", "n_tokens", "n_known")), pa.array(np.full(len(codes), n, np.int64)), pa.array(base), pa.array(scored)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(score, schema)
