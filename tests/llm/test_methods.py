"""Each method against a plain version of itself."""

import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

pytest.importorskip("tesserine.llm")
from pyspark.sql import functions as F  # noqa: E402
from tesserine import scratch  # noqa: E402
from tesserine.llm import common, exact, hmm, mixing, packing, quality, simhash, templates, tiff, tokens, wacz  # noqa: E402


def test_collisions_are_told_apart(spark):
    rows = [(k, f"text {k % 7}") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    weak = exact.exact_dedup(docs, keep="min", content_hash=lambda t: F.substring(F.unhex(F.md5(t.cast("binary"))), 1, 0)).collect()
    assert len(weak) == 60
    for r in weak:
        same = [k for k, t in rows if t == f"text {r['doc_id'] % 7}"]
        assert (r["keep_id"], r["group_size"], r["kept"]) == (min(same), len(same), r["doc_id"] == min(same))


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(400), draw.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2400)] + [(5, 5)]
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = top(a), top(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 255), max_size=60), st.integers(0, 255), st.integers(0, 4))
def test_bk_tree(values, wanted, radius):
    tree = simhash.BKTree()
    assert [tree.add(v) for v in values] == list(range(len(values)))
    assert sorted(tree.within(wanted, radius)) == [k for k, v in enumerate(values) if (v ^ wanted).bit_count() <= radius]


def test_key_masks_lose_no_pair():
    masks = simhash.key_masks(2)
    assert len(masks) == 15 and min(m.bit_count() for m in masks) >= 42
    for a, b in itertools.combinations(range(64), 2):
        flipped = 1 << a | 1 << b
        assert any(not flipped & m for m in masks)


@pytest.mark.parametrize("seed", range(6))
def test_shards_lose_no_link(seed):
    draw = random.Random(seed)
    centres = [draw.getrandbits(64) for _ in range(4)]
    values = [draw.choice(centres) ^ sum(1 << draw.randrange(64) for _ in range(draw.choice((1, 2, 3, 5, 9)))) for _ in range(300)] + [draw.getrandbits(64) for _ in range(50)]
    values = [v & (1 << 64) - 1 for v in values]
    draw.shuffle(values)
    for radius in (2, 5):
        forest = simhash.shard_links(np.array(values, np.uint64).view(np.int64), radius, None, 0)
        brute = simhash.Forest(len(values))
        for i, j in itertools.combinations(range(len(values)), 2):
            if (values[i] ^ values[j]).bit_count() <= radius:
                brute.join(i, j)
        assert [forest.top(k) for k in range(len(values))] == [brute.top(k) for k in range(len(values))]


def test_groups_equal_brute_force(spark):
    draw = random.Random(11)
    base = [" ".join(draw.choice("alpha beta gamma delta epsilon zeta eta theta iota".split()) + str(draw.randrange(40)) for _ in range(60)) for _ in range(40)]
    rows = []
    for k in range(300):
        words = draw.choice(base).split()
        for _ in range(draw.choice((0, 0, 1, 2))):
            words[draw.randrange(len(words))] = "changed"
        rows.append((k, " ".join(words)))
    rows += [(1000, ""), (1001, " \n"), (1002, "one"), (1003, "ONE"), (1004, None)]
    prints = [simhash.fingerprint((t or "").encode(), 3)[0] for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        return x if up[x] == x else top(up[x])

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            x, y = top(i), top(j)
            up[max(x, y)] = min(x, y)
    got = {r["doc_id"]: r for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string"), words=3, radius=2, similarity=None).collect()}
    for k, (key, _) in enumerate(rows):
        assert (got[key]["fingerprint"], got[key]["component_id"]) == (f"{prints[k]:016x}", rows[top(k)][0])


def test_near_copies_found_and_others_left(spark):
    draw = random.Random(5)
    texts = [[f"w{draw.randrange(3000)}" for _ in range(200)] for _ in range(60)]
    rows = [(k, " ".join(t)) for k, t in enumerate(texts)]
    for k, t in enumerate(texts[:30]):
        copy = list(t)
        for _ in range(3):
            copy[draw.randrange(200)] = "edit"
        rows.append((100 + k, " ".join(copy)))
    kept = {r["doc_id"] for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(60))


def test_slices_of_long_texts():
    data = b"one two three four five " * 30_000
    h = np.concatenate(list(simhash.shingle_hashes(data, 3)))
    assert len(h) == 150_000 - 2 and len(set(h.tolist())) == 5


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_long_lzw():
    data = np.random.default_rng(1).integers(0, 7, 40_000, np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("tile", [None, (32, 16)])
@pytest.mark.parametrize("kind", [np.uint8, np.uint16])
@pytest.mark.parametrize("predictor", [1, 2])
def test_tiff_round_trip(order, tile, kind, predictor):
    draw = np.random.default_rng(2)
    pages = [draw.integers(0, 250, (h, w, s)).astype(kind) for h, w, s in ((70, 50, 3), (1, 1, 1), (33, 64, 4))]
    for packing_ in (tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE):
        got = list(tiff.read_pages(tiff.write_pages(pages, packing_, predictor, 16, tile, order)))
        assert [p.number for p in got] == [0, 1, 2] and all((p.pixels == q).all() for p, q in zip(got, pages, strict=True))
        assert {(p.compression, p.predictor, p.tiled, p.bits) for p in got} == {(packing_, predictor, tile is not None, 8 * np.dtype(kind).itemsize)}


def test_tiff_rows(spark):
    good = tiff.write_pages([np.full((2, 2, 3), 7, np.uint8)] * 2)
    df = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None), (4, bytearray(good[:40]))], "k int, media binary")
    rows = tiff.tiff_pages(df, "k", "media").collect()
    assert sorted((r["k"], r["page"]) for r in rows if r["k"] == 1) == [(1, 0), (1, 1)] and rows[0]["pixels"] == b"\x07" * 12
    assert all(r["error"] for r in rows if r["k"] > 1 and r["page"] is None) and {r["k"] for r in rows} == {1, 2, 3, 4}
    ring = bytearray(tiff.write_pages([np.zeros((1, 1, 1), np.uint8)]))
    first = int.from_bytes(ring[4:8], "little")
    ring[-4:] = first.to_bytes(4, "little")
    with pytest.raises(tiff.TiffError):
        list(tiff.read_pages(bytes(ring)))


def test_several_pages_hold_a_long_text(spark):
    text = "0123456789abcdef" * 60_000
    got = tiff.text_media(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got["n_bytes"] == got["payload_bytes"] == len(text) and got["feature"].startswith("pages=2;")


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 1024), max_size=80))
def test_windows(sizes):
    got = packing.pack_windows(sizes)
    assert sorted(k for w in got for k in w) == list(range(len(sizes)))
    assert all(sum(sizes[k] for k in w) <= 1024 for w in got)


def test_differencing_is_near_equal():
    draw = random.Random(1)
    sizes = [draw.randint(1, 200) for _ in range(400)]
    sums = [sum(sizes[k] for k in w) for w in packing.differencing(sizes, 8)]
    assert len(sums) == 8 and max(sums) - min(sums) <= 2


def test_chunks_and_roots():
    ids = np.random.default_rng(4).integers(0, 50_000, 60_000).astype(np.uint32)
    ends = tokens.chunk_ends(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= 2048 and sizes[:-1].min() >= 128 and 300 < sizes.mean() < 900
    moved = tokens.chunk_ends(np.concatenate([ids[:5], ids]))
    assert len({len(ids) - e for e in ends} & {len(ids) + 5 - e for e in moved}) > 0.8 * len(ends)
    assert tokens.chunk_ends(np.zeros(5000, np.uint32))[-1] == 5000 and tokens.chunk_ends(ids[:0]) == []
    leaves = [bytes([k]) for k in range(7)]
    roots = {tokens.merkle_root(leaves[:n]) for n in range(8)} | {tokens.merkle_root(leaves[::-1])}
    assert len(roots) == 9


def test_forward_sums_over_all_paths():
    shape = hmm.Shape(states=3, own=4, endings=3)
    model = hmm.Model.first(shape, np.arange(1.0, 9.0))
    texts = [np.array([0, 5, 2, 7]), np.array([7]), np.array([1, 1, 1, 3, 7])]
    for own, active, flat in hmm._steps(texts):
        for k, likelihood in zip(own, hmm.forward(model, active, flat)[0], strict=True):
            brute = 0.0
            for path in itertools.product(range(3), repeat=len(texts[k])):
                p = model.start[path[0]] * model.emit[texts[k][0], path[0]]
                for t in range(1, len(path)):
                    p *= model.move[path[t - 1], path[t]] * model.emit[texts[k][t], path[t]]
                brute += p
            assert math.isclose(likelihood, math.log(brute), rel_tol=1e-12)


def test_training_raises_the_likelihood():
    draw = np.random.default_rng(3)
    shape = hmm.Shape(states=2, own=6, endings=2)
    texts = [np.append(draw.integers(0, 3, 30) + 3 * (k % 2), 8) for k in range(40)]
    model, seen = hmm.Model.first(shape, np.full(9, 10.0)), []
    for _ in range(8):
        start, move, emit, total = hmm.expected_counts(model, texts)
        assert math.isclose(emit.sum(), sum(map(len, texts)), rel_tol=1e-5) and math.isclose(start.sum(), 40, rel_tol=1e-5)
        seen.append(total)
        model = model.updated(start, move, emit)
    assert seen[-1] > seen[0] + 300 and all(b > a - 1 for a, b in zip(seen, seen[1:], strict=False))


def test_model_is_a_distribution(spark):
    """Over a text of one known or unknown word and the end, probabilities of words add up to those of their symbols."""
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(["a b a c", "c d\nA", "b"] * 5)], "doc_id long, text string")
    rows = hmm.lm_scores(docs, states=2, own_words=2, endings=2, rounds=2).collect()
    assert len(rows) == 15 and all(r["score"] < 0 and r["n_known"] == r["n_tokens"] for r in rows)
    train = [t for k, t in enumerate(["a b a c", "c d\nA", "b"] * 5) if zlib.crc32(str(k).encode()) % 5 != 1]
    assert rows[0]["train_tokens"] == sum(len(t.split()) + 1 for t in train)


def test_scores_by_brute_force(spark):
    """The trained query against plain recursions: symbols, rounds, emissions of single words, scores."""
    draw = np.random.default_rng(12)
    pool = [[f"{a}{b}" for b in ("xing", "ying", "ed", "lly", "")] for a in "abcd"]
    texts = [" ".join(pool[(k % 2) * 2 + int(draw.integers(0, 2))][int(draw.integers(0, 5))] for _ in range(draw.integers(0, 9))) + (f" once{k}" if k % 9 == 0 else "") for k in range(80)]
    s, own, endings, shrink, least = 2, 3, 4, 0.1, 8
    held = [zlib.crc32(str(k).encode()) % 5 == 1 for k in range(80)]
    words = [t.encode().split() for t in texts]
    c = Counter(w for x, h in zip(words, held, strict=True) if not h for w in x)
    ends = held.count(False)
    top = sorted(c, key=lambda w: (-c[w], w))[:own]
    alone = {w for w in c if c[w] >= least and w not in top}
    assert len(alone) > 3 and any(c[w] < least for w in c) and any(w not in c for x in words for w in x)

    def symbol(w):
        return top.index(w) if w in top else own + zlib.crc32(w[-3:]) % endings

    mass, rare = np.full(endings, 0.5), np.full(endings, 0.5)
    for w in c:
        if w not in top:
            mass[symbol(w) - own] += c[w] + 0.5
            rare[symbol(w) - own] += (c[w] + 0.5) * (w not in alone)
    shape = hmm.Shape(s, own, endings)
    model = hmm.Model.first(shape, np.concatenate([[c[w] for w in top], mass, [ends]]).astype(float))

    def sequence(x):
        return [symbol(w) for w in x] + [own + endings]

    def posteriors(x):
        a, b = [model.start * model.emit[x[0]]], [np.ones(s)]
        for y in x[1:]:
            a.append(a[-1] @ model.move * model.emit[y])
        for y in x[:0:-1]:
            b.insert(0, model.move @ (model.emit[y] * b[0]))
        p = a[-1].sum()
        moves = sum((np.outer(a[t], model.emit[x[t + 1]] * b[t + 1]) * model.move / p for t in range(len(x) - 1)), np.zeros((s, s)))
        return np.array(a) * np.array(b) / p, moves

    for _ in range(3):
        start, move, emit, single, left = np.zeros(s), np.zeros((s, s)), np.zeros((shape.symbols, s)), {w: np.zeros(s) for w in alone}, np.zeros((endings, s))
        for x in (x for x, h in zip(words, held, strict=True) if not h):
            gamma, moves = posteriors(sequence(x))
            start += gamma[0]
            move += moves
            for w, y, g in zip([*x, None], sequence(x), gamma, strict=True):
                emit[y] += g
                if w in alone:
                    single[w] += g
                elif own <= y < own + endings:
                    left[y - own] += g
        model = model.updated(start, move, emit)

    def emission(w):
        y = symbol(w)
        if y < own:
            return model.emit[y]
        e = y - own
        whole = model.emit[y] / (emit[y] + shrink * mass[e])
        return whole * (single[w] + shrink * (c[w] + 0.5)) if w in alone else whole * (left[e] + shrink * rare[e]) * (c[w] + 0.5) / rare[e]

    # the shares of an ending's words and of the unknown word add up to the ending
    for e in range(endings):
        whole = sum((emission(w) for w in c if w not in top and symbol(w) == own + e), np.zeros(s))
        unknown = model.emit[own + e] / (emit[own + e] + shrink * mass[e]) * (left[e] + shrink * rare[e]) * 0.5 / rare[e]
        np.testing.assert_allclose(whole + unknown, model.emit[own + e], rtol=1e-9)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = hmm.lm_scores(docs, states=s, own_words=own, endings=endings, rounds=3, block_bytes=300, min_count=least, shrink=shrink).collect()
    assert len(got) == 80
    for r in got:
        a = None
        for b in [*map(emission, words[r["doc_id"]]), model.emit[own + endings]]:
            a = (model.start if a is None else a @ model.move) * b
        assert math.isclose(r["score"], math.log10(a.sum()), rel_tol=1e-4)


def test_templates_generalise(spark):
    rows = [(k, f"unique opening number {k} of text w{k * 7919 % 1009} q{k}x\nServer {k} closed the connection to host h{k} after a timeout\nprivate {chr(97 + k)} {chr(98 + k)} {chr(99 + k)} {chr(100 + k)}") for k in range(12)]
    got = {r["doc_id"]: r for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=8, counts=("n", "gone")).collect()}
    for k, text in rows:
        lines = text.split("\n")
        # digits are fields: the first two lines are one template each
        assert got[k]["text"] == lines[2] and (got[k]["n"], got[k]["gone"]) == (3, 2)


def test_template_tree():
    tree = templates.Leaf(0.8)
    assert tree.add(np.array([1, 2, 3, 4, 5], np.uint32)) == 0 and tree.add(np.array([1, 2, 3, 4, 9], np.uint32)) == 0
    assert tree.templates[0].tolist() == [1, 2, 3, 4, 0]
    assert tree.add(np.array([1, 2, 3, 8, 9], np.uint32)) == 1 and tree.add(np.array([1, 2, 3, 4, 7], np.uint32)) == 0
    assert [tree.add(np.full(5, k + 20, np.uint32)) for k in range(10)] == list(range(2, 12))


def test_bisection():
    tokens_ = [900, 90, 10]
    flat = mixing.temperature(tokens_, 0)
    assert np.allclose(flat, 1 / 3) and np.allclose(mixing.temperature(tokens_, 1), [0.9, 0.09, 0.01])
    plan = mixing.plan_weights([(str(k), t, 5) for k, t in enumerate(tokens_)], max_repeats=4.0)
    assert math.isclose(max(plan.repeats), 4, rel_tol=0.06) and sum(plan.budgets) == pytest.approx(1000, abs=2)
    plan = mixing.plan_weights([(str(k), t, 5) for k, t in enumerate(tokens_)], target_entropy=0.6)
    assert math.isclose(mixing.entropy(plan.weights), 0.6, abs_tol=1e-9)
    plan = mixing.plan_weights([(str(k), t, 5) for k, t in enumerate(tokens_)], budget="cover", max_repeats=2.0)
    assert min(plan.repeats) >= 1 - 1e-3 and max(plan.repeats) <= 2.1
    with pytest.raises(ValueError):
        mixing.plan_weights([("a", 10, 1), ("b", 10, 1)], budget=100, max_repeats=2.0)


def test_budgets_are_met(spark):
    draw = random.Random(9)
    rows = [(k, "w " * draw.randint(0, 40), "big" if k % 10 else ("small" if k % 20 else None)) for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, budget="total", max_repeats=3.0)
    got = mix.schedule().collect()
    p = mix.plan
    for s, tokens_, budget in zip(p.sources, p.tokens, p.budgets, strict=True):
        own = [r for r in got if r["source"] == s]
        assert budget <= sum(r["n_tokens"] for r in own) < budget + 42
        per = {}
        for r in own:
            per.setdefault(r["reading"], []).append(r["doc_id"])
        for reading, ids in per.items():
            assert len(ids) == len(set(ids)) and (reading == max(per) or len(ids) == p.documents[p.sources.index(s)])
        at = sorted((r["position"], r["n_tokens"]) for r in own)
        assert at[0][0] == 0 and all(math.isclose(b[0] - a[0], a[1] / budget, rel_tol=1e-6) for a, b in zip(at, at[1:], strict=False))
    taken = sorted((r["doc_id"], r["source"]) for r in mix.rows(docs).select("doc_id", "source").collect())
    assert taken == sorted((r["doc_id"], r["source"]) for r in got) if None not in {r["source"] for r in got} else len(taken) == len(got)


class _File(BytesIO):
    def close(self):
        self.bytes = self.getvalue()


@pytest.mark.parametrize("zip64", [False, True])
def test_zip_directories(zip64):
    import zipfile

    out = _File()
    z = wacz.ZipWriter(out, zip64)
    data = {"archive/data.warc.gz": b"x" * 1000, "indexes/index.cdxj": b"i\n", "nämé": b""}
    for name, body in data.items():
        z.begin(name)
        z.write(body[:3])
        z.write(body[3:])
        z.end()
    z.close()
    with zipfile.ZipFile(BytesIO(out.bytes)) as other:
        assert {n: other.read(n) for n in other.namelist()} == data and other.testzip() is None

    def read(at, n):
        assert 0 <= at and at + n <= len(out.bytes)
        return out.bytes[at : at + n]

    members = wacz.read_directory(read, len(out.bytes))
    assert {m.name: wacz.member_bytes(read, m) for m in members} == data
    other = BytesIO()
    with zipfile.ZipFile(other, "w", zipfile.ZIP_DEFLATED) as made:
        made.comment = b"a comment PK\5\6 in it"
        for k in range(70_000 if zip64 else 3):
            made.writestr(f"f{k}", b"abc" * 50 if k < 3 else b"")
    raw = other.getvalue()
    members = wacz.read_directory(lambda at, n: raw[at : at + n], len(raw))
    assert len(members) == (70_000 if zip64 else 3) and wacz.member_bytes(lambda at, n: raw[at : at + n], members[1]) == b"abc" * 50
    with pytest.raises(wacz.ZipError):
        wacz.read_directory(lambda at, n: raw[at : at + n], len(raw) - 30)


def test_archives_with_long_records_and_without_index(spark, tmp_path):
    import zipfile

    pages = spark.createDataFrame([(k, f"http://h/{k % 40}", "same" if k % 3 == 0 else f"<p>{k}</p>") for k in range(120)], "page_id long, url string, html string")
    short = {r["page_id"]: r.asDict() for r in wacz.archived_pages(pages).collect()}
    packages = wacz.write_archives(pages, zip64=True, package_bytes=2000)
    assert packages.count() > 4
    long = wacz.read_archives(packages).collect()
    assert {r["page_id"]: {c: r[c] for c in short[0]} for r in long} == short and sum(r["payload"] is not None for r in long) == 81
    records = [wacz.page_record(k, "u", b"body %d" % k, None, False)[0] for k in range(3)]
    plain = [zlib.decompress(r, 31) for r in records]
    path = tmp_path / "noindex.wacz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_STORED) as z:
        z.writestr("archive/a.warc.gz", b"".join(records))
        z.writestr("archive/b.warc", b"".join(plain))
    got = wacz.read_archives(spark.createDataFrame([(f"file://{path}",)], "uri string")).collect()
    assert [(r["page_id"], bytes(r["payload"])) for r in got] == [(k, b"body %d" % k) for k in range(3)] * 2


def _prose(draw, n=60):
    return " ".join("".join(draw.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(n))


def test_copies_and_long_documents_take_nothing_off_a_support(spark):
    draw = random.Random(21)
    shared, section = "all rights are reserved by the owner of this page", "Section <n> of the long manual"
    texts = [f"{_prose(draw)}\n{shared}\nSection {k} of the long manual" for k in range(12)]
    texts.append("\n".join([_prose(draw)] + [f"Section {k} of the long manual" for k in range(500)]))
    texts += [texts[0]] * 300
    # lines that only the copies of one document hold stay
    texts += ["\n".join(["only here " + _prose(draw, 20)] * 2 + [_prose(draw)])] * 40
    got = templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        lines = [x for x in texts[r["doc_id"]].split("\n") if x != shared and not x.startswith(section[:8])]
        assert r["text"].split("\n") == lines


def test_one_documents_lines_are_one_document(spark):
    draw = random.Random(22)
    texts = [_prose(draw) + "\n" + "\n".join(f"Row {j} of table {k}" for j in range(400)) for k in range(7)]
    got = templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == dict(enumerate(texts))


def test_links_are_checked_by_the_whole_shingle_sets(spark):
    """Sketches of pairs of similarity 0.7 to 0.8 agree as those above 0.8 often do; only pairs above link."""
    draw = random.Random(31)
    rows = []
    for k in range(60):
        words = [f"w{draw.randrange(3000)}" for _ in range(240)]
        rows.append((k, " ".join(words)))
        for j, edits in enumerate((4, 8, 9)):
            copy = list(words)
            for at in draw.sample(range(10, 230, 12), edits):
                copy[at] = f"edit{k}{j}{at}"
            rows.append((100 + 3 * k + j, " ".join(copy)))
    sets = [set(zip(*(t.split()[i:] for i in range(5)), strict=False)) for _, t in rows]
    forest, below = simhash.Forest(len(rows)), 0
    for i, j in itertools.combinations(range(len(rows)), 2):
        same = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
        below += 0.7 <= same < 0.8
        if same >= 0.8:
            forest.join(i, j)
    assert below > 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.simhash_dedup(docs).collect()}
    assert kept == {rows[k][0] for k in range(len(rows)) if forest.top(k) == k}


def test_only_true_copies_count_once(spark):
    from xxhash import xxh64_intdigest

    draw = random.Random(41)
    # the lowest word hash is in the shared passage of all, so a sketch of one word can't tell its holders apart
    passage = " ".join(sorted(_prose(draw, 9000).split(), key=lambda w: xxh64_intdigest(w.encode()))[:30])
    texts = [_prose(draw) + "\n" + passage for _ in range(9)]
    base = [_prose(draw, 40) for _ in range(5)]
    for _ in range(60):
        words = " \n ".join(base).split(" ")
        words[draw.randrange(10)] = "changed" + _prose(draw, 1)
        texts.append(" ".join(words).replace(" \n ", "\n"))
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == texts[k].split("\n")[0] for k in range(9))
    # near copies keep their text
    assert all(got[k] == texts[k] for k in range(9, 69))


def test_long_lines_recur_from_two_documents(spark):
    draw = random.Random(51)
    passages, short = [_prose(draw, n) for n in (55, 60, 80)], _prose(draw, 20)
    numbers = " ".join(str(k) for k in range(70))
    own = [_prose(draw, 90) for _ in range(7)]
    texts = ["\n".join([own[k], short, numbers, *(p for p, n in zip(passages, (2, 5, 7), strict=True) if k < n)]) for k in range(7)]
    copied = "\n".join(_prose(draw, 70) for _ in range(2))
    texts += [copied] * 3
    # two revisions of one line, alike but no copies
    revised = _prose(draw, 100).split()
    texts += [" ".join(revised), " ".join("new" if k % 12 == 6 else w for k, w in enumerate(revised))]
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(got[k] == "\n".join([own[k], short, numbers]) for k in range(7))
    assert all(got[k] == texts[k] for k in range(7, len(texts)))


def test_one_row_of_each_component_stays(spark):
    draw = random.Random(61)
    a, b, c, d, e = (_prose(draw) for _ in range(5))
    # texts without an id, and different texts under one id, the smallest of both components
    rows = [(None, a), (None, b), (None, b), (3, c), (3, d), (7, d), (9, c), (5, e), (None, e), (None, None)]
    kept = simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, kept))) == sorted(map(repr, [(None, a), (None, b), (3, c), (3, d), (5, e), (None, None)]))


def test_segments_of_a_long_text(monkeypatch):
    draw = np.random.default_rng(9)
    shape = hmm.Shape(3, 5, 4)
    model = hmm.Model.first(shape, draw.integers(1, 9, shape.symbols).astype(float))
    texts = [draw.integers(0, shape.symbols, n).astype("<u2") for n in (200, 90, 90, 1, 33)]
    whole = hmm.expected_counts(model, texts)
    monkeypatch.setattr(hmm, "PASS", 80)
    groups = [sorted(own.tolist()) for own, _, _ in hmm._steps(texts)]
    assert [0] in groups and [1] in groups and [2] in groups
    for x, y in zip(whole, hmm.expected_counts(model, texts, segment=17), strict=True):
        np.testing.assert_allclose(x, y, rtol=1e-3)


def test_neighbours_by_brute_force(spark):
    draw = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in draw.integers(0, 26, draw.integers(2, 9))) for _ in range(draw.integers(3, 60))) for _ in range(300)]
    texts += texts[:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(draw.integers(0, 2))) for k in range(0, 2000, 2)], "doc_id long, quality int")
    model = quality.fit(docs, labels, max_labelled=100, dimensions=12)
    # labels without a document take no place in the sample
    assert len(model.labels) == 100
    got = model.score([t.encode() for t in texts])
    for text, score in zip(texts, got, strict=True):
        cosines = (model.embed(quality.term_counts(text.encode())[None]) @ model.vectors.T)[0]
        near = sorted(range(100), key=lambda k: (-cosines[k], k))[: model.neighbours]
        weights = [max(0.0, float(cosines[k])) for k in near]
        expected = sum(w * model.labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights) if sum(weights) else model.prior
        assert abs(score - expected) < 1e-4


def test_nearest_takes_the_first_of_ties():
    cosines = np.array([[0.5, 0.9, 0.5, 0.5, 0.1], [0.2, 0.2, 0.2, 0.2, 0.2]], np.float32)
    assert quality.nearest(cosines, 3).tolist() == [[True, True, True, False, False], [True, True, True, False, False]]


def test_schedule_by_brute_force(spark):
    from pyspark.sql import functions as F

    draw = np.random.default_rng(4)
    rows = [(k, "w " * int(draw.integers(0, 30)), f"s{min(3, int(draw.integers(0, 9)))}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mix = mixing.Mix(docs, budget="total", max_repeats=2.0, token_count=mixing.words)
    p = mix.plan
    n = {k: t.count(" ") + 1 for k, t, _ in rows}
    # the weights: the flattest temperature under which no source is read more than twice
    assert p.tokens == [sum(n[k] for k, _, s in rows if s == name) for name in p.sources] and max(p.repeats) <= 2 + 1e-6
    for name, w in zip(p.sources, p.weights, strict=True):
        shares = {s: t / sum(p.tokens) for s, t in zip(p.sources, p.tokens, strict=True)}
        assert abs(w - shares[name] ** p.exponent / sum(x**p.exponent for x in shares.values())) < 1e-9
    got = {}
    for r in mix.schedule().collect():
        got.setdefault((r["source"], r["reading"]), set()).add(r["doc_id"])
    # the readings: whole ones, then the documents up to the budget in the order of the hashes of block and document
    for name, budget, total, blocks in zip(p.sources, p.budgets, p.tokens, map(mix._blocks, p.documents), strict=True):
        own = {k for k, _, s in rows if s == name}
        last = max(0, math.ceil(budget / total - 1e-12) - 1)
        assert all(got[name, k] == own for k in range(last))
        block = F.pmod(F.xxhash64(F.lit(0), "doc_id"), F.lit(blocks).cast("int"))
        at = [F.lit(0), F.lit(last), F.lit(name)]
        order = [(r["b"], r["d"], r["doc_id"]) for r in docs.where(F.col("source") == name).select("doc_id", F.xxhash64(*at, block).alias("b"), F.xxhash64(*at, "doc_id", F.lit(1)).alias("d")).collect()]
        left, due = budget - total * last, set()
        for _, _, k in sorted(order):
            if left <= 0:
                break
            due.add(k)
            left -= n[k]
        assert got.get((name, last), set()) == due


@pytest.mark.parametrize("compression", [tiff.RAW, tiff.PACKBITS, tiff.LZW, tiff.ADOBE_DEFLATE])
def test_bits_and_planes(compression):
    import struct
    import zlib

    def image(tags, blocks):
        """A little-endian TIFF of one page: tags {tag: (type, values)}, and the strips."""
        out, offsets = bytearray(b"II*\0\0\0\0\0"), []
        for b in blocks:
            offsets.append(len(out))
            out += b
        tags = {**tags, tiff.STRIP_OFFSETS: (4, offsets), tiff.STRIP_COUNTS: (4, [len(b) for b in blocks])}
        entries = b""
        for tag, (kind, values) in sorted(tags.items()):
            body = struct.pack(f"<{len(values)}{tiff.FIELD[kind]}", *values)
            at = struct.pack("<I", len(out))
            if len(body) > 4:
                out += body
            entries += struct.pack("<HHI", tag, kind, len(values)) + (at if len(body) > 4 else body.ljust(4, b"\0"))
        struct.pack_into("<I", out, 4, len(out))
        return bytes(out + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")

    pack = {tiff.RAW: bytes, tiff.PACKBITS: tiff.pack_bits, tiff.LZW: tiff.lzw_encode, tiff.ADOBE_DEFLATE: zlib.compress}[compression]
    draw = np.random.default_rng(6)
    bits = draw.integers(0, 2, (9, 13)).astype(np.uint8)
    common_tags = {tiff.COMPRESSION: (3, [compression])}
    strips = [pack(np.packbits(bits[y : y + 4], axis=1).tobytes()) for y in (0, 4, 8)]
    (page,) = tiff.read_pages(image({**common_tags, tiff.WIDTH: (3, [13]), tiff.HEIGHT: (3, [9]), tiff.BITS: (3, [1]), tiff.ROWS_PER_STRIP: (3, [4])}, strips))
    assert (page.pixels[:, :, 0] == bits).all() and page.bits == 1
    planes = draw.integers(0, 256, (3, 5, 4)).astype(np.uint8)
    tags = {**common_tags, tiff.WIDTH: (3, [4]), tiff.HEIGHT: (3, [5]), tiff.BITS: (3, [8, 8, 8]), tiff.SAMPLES: (3, [3]), tiff.PLANAR: (3, [2]), tiff.ROWS_PER_STRIP: (3, [5])}
    (page,) = tiff.read_pages(image(tags, [pack(x.tobytes()) for x in planes]))
    assert (page.pixels == planes.transpose(1, 2, 0)).all()
    forged = image({**common_tags, tiff.WIDTH: (4, [1 << 31]), tiff.HEIGHT: (4, [1 << 31]), tiff.BITS: (3, [8]), tiff.ROWS_PER_STRIP: (4, [1 << 31])}, [pack(b"x")])
    with pytest.raises(tiff.TiffError):
        next(tiff.read_pages(forged))
    # what a strip would expand to beyond the page isn't made
    bomb = image({**common_tags, tiff.WIDTH: (3, [2]), tiff.HEIGHT: (3, [2]), tiff.BITS: (3, [8]), tiff.ROWS_PER_STRIP: (3, [2])}, [pack(b"\0" * 100_000)])
    assert next(tiff.read_pages(bomb)).pixels.size == 4


def test_forged_image_is_an_error_row(spark):
    good = tiff.write_pages([np.full((2, 2, 3), 7, np.uint8)])
    forged = bytearray(good)
    at = int.from_bytes(good[4:8], "little") + 2
    for k in range(2):
        forged[at + 12 * k + 8 : at + 12 * k + 12] = (1 << 30).to_bytes(4, "little")
    rows = tiff.tiff_pages(spark.createDataFrame([(1, bytearray(forged)), (2, bytearray(good))], "k int, media binary"), "k", "media").collect()
    assert sorted((r["k"], r["page"], bool(r["error"])) for r in rows) == [(1, None, True), (2, 0, False)] or [(r["k"], r["error"] is None) for r in sorted(rows)] == [(1, False), (2, True)]


def test_each_layout_is_used(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    rows = tiff.tiff_pages(tiff.store_texts(docs), "doc_id", "media").select("compression", "predictor", "tiled").distinct().collect()
    assert {tuple(r) for r in rows} == {(c, p, t is not None) for c, p, t in tiff.LAYOUTS}


def test_special_tokens_as_the_library_has_them():
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    library, made = Tokenizer.from_file(path), tokens.Encoder(path)
    for text in ("x<|endoftext|>", "<|endoftext|>", "a <|endoftext|> b  c\n<|endoftext|>", "<|endoftext", "plain words"):
        assert np.frombuffer(made.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(made.encode("x<|endoftext|>"), "<u4").tolist() == [87, 50256]


def test_recurring_lines_broadcast_or_joined(spark, small_dir, monkeypatch):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    one = sorted(templates.drop_recurring_lines(docs, min_docs=3, counts=("n", "gone")).collect())
    monkeypatch.setattr(templates, "BROADCAST_LINES", -1)
    assert sorted(templates.drop_recurring_lines(docs, min_docs=3, counts=("n", "gone")).collect()) == one
    assert sum(r["gone"] for r in one) > 0


def test_a_footer_goes_from_all_documents(spark):
    texts = [f"{' '.join(f'w{chr(97 + k % 26)}{chr(97 + j)}{chr(97 + k // 26)}' for j in range(20))}\nall rights are reserved by the owner" for k in range(40)]
    got = templates.drop_recurring_lines(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert all("reserved" not in r["text"] and r["text"] for r in got)


def test_rows_without_an_id_or_with_one_twice(spark):
    rows = [(None, f"quite different text number {c} about {c * 5}") for c in "abcde"] + [(9, "one text of nine"), (9, "another wholly different one")]
    assert simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string")).count() == 7


def test_recall_of_near_copies(spark):
    from collections import Counter, defaultdict
    from pathlib import Path

    table = Path("/root/testdata/sf0.1/documents.parquet")
    if not table.exists():
        pytest.skip("the larger tables aren't here")
    docs = spark.read.parquet(str(table)).select("doc_id", "text")
    root = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).collect()}
    first = {}
    for r in docs.collect():
        first.setdefault(r["text"] or "", r["doc_id"])
    ids, sets, holders = list(first.values()), [], defaultdict(list)
    for i, text in enumerate(first):
        w = text.encode().lower().split()
        sets.append({b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
        for shingle in sets[-1]:
            holders[shingle].append(i)
    # a pair of similarity 0.8 shares shingles that few documents have
    shared = Counter(p for own in holders.values() if len(own) <= 100 for p in itertools.combinations(own, 2))
    near = [(x, y) for (x, y), n in shared.items() if n >= 0.5 * max(len(sets[x]), len(sets[y])) and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y])]
    linked = sum(root[ids[x]] == root[ids[y]] for x, y in near)
    assert len(near) >= 30 and linked >= 0.97 * len(near)


def test_emissions_of_words_travel_with_32_bits(spark):
    shape = hmm.Shape(states=2, own=2, endings=2)
    codes, numbers = np.array([shape.symbols, shape.end], "<u2").tobytes(), np.array([7], "<i8").tobytes()
    words = hmm.train(spark.createDataFrame([(codes, numbers)] * 3, "codes binary, numbers binary"), shape, np.ones(shape.symbols), 1).words
    assert words.dtypes == [("number", "bigint"), ("v0", "float"), ("v1", "float")]
    (row,) = words.collect()
    assert row["number"] == 7 and math.isclose(row["v0"] + row["v1"], 3, rel_tol=1e-5)


def test_a_pass_holds_one_vector_a_token():
    """Of 32 bytes, with its scale, its symbol and what one sum over them takes; with two vectors a token it was 89 in all."""
    draw = np.random.default_rng(21)
    shape = hmm.Shape(states=8, own=20, endings=10)
    model = hmm.Model.first(shape, np.ones(shape.symbols))
    texts = [draw.integers(0, shape.symbols, 500).astype("<u2") for _ in range(400)]
    hmm.expected_counts(model, texts[:2])
    tracemalloc.start()
    hmm.expected_counts(model, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 * 200_000


def test_expected_counts_of_a_word_travel_as_one_binary(spark):
    values = np.array([[0.1, 2.5, 7e-9], [1e6, 0.0, 3.25]], "<f4")
    rows = [(k + 5, k, 10 + k, *map(float, values[k])) for k in range(2)]
    words = hmm.packed(spark.createDataFrame(rows, "number long, ending int, c long, v0 float, v1 float, v2 float"), 3)
    assert words.dtypes == [("number", "bigint"), ("ending", "int"), ("c", "bigint"), ("expected", "binary")]
    got = {r["number"]: r for r in words.collect()}
    for k in range(2):
        assert (got[k + 5]["ending"], got[k + 5]["c"], bytes(got[k + 5]["expected"])) == (k, 10 + k, values[k].tobytes())


def test_shuffle_files_go_once_a_table_is_stored(spark):
    def files():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {name for k in range(found.size()) if (name := found.apply(k).getName()).startswith("shuffle_")}

    gone = []
    for k in range(3):
        before = files()
        assert common.stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), f"counts{k}").count() == 7
        made = files() - before
        assert made
        scratch.free_shuffles(spark)
        time.sleep(0.5)  # Spark deletes them in the background
        gone.append(not made & files())
    assert all(gone)
