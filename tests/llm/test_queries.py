"""The registered queries over whole tables, against SQL where there is some and else against brute force."""

import hashlib
import math
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

llm = pytest.importorskip("tesserine.llm.queries")
from tesserine.llm import tiff  # noqa: E402
from tesserine.llm.tokens import tokenizer_path  # noqa: E402


@pytest.fixture(scope="module")
def db(small_dir):
    con = duckdb.connect()
    for name in os.listdir(small_dir):
        path = f"{small_dir}/{name}" + ("/*.parquet" if os.path.isdir(f"{small_dir}/{name}") else "")
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.fixture(scope="module")
def docs(db):
    return dict(db.sql("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


@pytest.fixture(scope="module")
def ids(docs):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    return {k: [*library.encode(t, add_special_tokens=False).ids, 0] for k, t in docs.items()}


def crc(values):
    return zlib.crc32(np.array(values, "<u4").tobytes())


@pytest.mark.parametrize("name", llm.ORACLE_SQL)
def test_sql(name, spark, small_dir, db):
    got = llm.QUERIES[name](spark, small_dir)
    columns = sorted(got.columns)
    theirs = db.sql(f"SELECT {', '.join(columns)} FROM ({llm.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.select(columns).collect()), key=repr) == sorted(theirs, key=repr)


def test_mixing(spark, small_dir, docs, ids):
    rows = llm.op1_mixing(spark, small_dir).collect()
    assert {r["doc_id"] for r in rows} <= set(docs) and all(0 <= r["position"] < 1 for r in rows)
    assert all(r["n_tokens"] == len(ids[r["doc_id"]]) for r in rows)
    total = sum(map(len, ids.values()))
    assert abs(sum(r["n_tokens"] for r in rows) - total) < 0.2 * total
    assert abs(sum({r["source"]: r["weight"] for r in rows}.values()) - 1) < 1e-9


def test_quality(spark, small_dir, db, docs):
    labels = dict(db.sql("SELECT doc_id, quality FROM labels").fetchall())
    rows = llm.op3_quality(spark, small_dir).collect()
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and labels.get(r["doc_id"]) is not None]
    assert sum(p == q for p, q in held) >= 0.85 * len(held)


def test_media(spark, small_dir, docs):
    rows = llm.op5_tiff(spark, small_dir).collect()
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = tiff.payload_image(raw)
        assert (r["media_bytes"], r["media_sha256"]) == (len(media), hashlib.sha256(media).hexdigest())
        counts = Counter(payload)
        entropy = -sum(c / len(payload) * math.log2(c / len(payload)) for c in counts.values())
        means = [sum(payload[k::3]) / (len(payload) / 3) for k in range(3)]
        assert f"entropy={abs(entropy):.4f}" in r["feature"] and r["feature"].split(";")[2] == "mean=" + ",".join(f"{x:.3f}" for x in means)


def test_packing(spark, small_dir, ids):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in llm.op6_packing(spark, small_dir).collect():
        own = ids[r["doc_id"]]
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(own), crc(own[r["start"] : r["start"] + r["length"]]))
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for parts, whole in [*((pieces[k], len(ids[k])) for k in ids), *((s, None) for s in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == whole or (whole is None and at <= 1024)
    filled = [sum(n for _, n in s) for s in sequences.values()]
    assert sum(1024 - n for n in filled if n & (n - 1)) < 0.04 * sum(filled)


def test_store(spark, small_dir, ids):
    at = 0
    for r in sorted(llm.op7_id_store(spark, small_dir).collect()):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids[r["doc_id"]]), crc(ids[r["doc_id"]]))
        at += r["n_tokens"]
    assert at == sum(map(len, ids.values()))


def test_lines(spark, small_dir, docs):
    for r in llm.op8_line_templates(spark, small_dir).collect():
        lines, kept = docs[r["doc_id"]].split("\n"), r["text"].split("\n") if r["text"] or r["n_lines"] > r["n_dropped"] else []
        assert (r["n_lines"], r["n_lines"] - r["n_dropped"]) == (len(lines), len(kept))
        rest = iter(lines)
        assert all(x in rest for x in kept)


def test_language_model(spark, small_dir, docs):
    words = {k: t.encode().lower().split() for k, t in docs.items()}
    held = {k: zlib.crc32(str(k).encode()) % 5 == 1 for k in docs}
    counts = Counter(w for k in docs if not held[k] for w in words[k])
    ends = sum(not h for h in held.values())
    n = sum(counts.values()) + ends
    per = math.log10(n + 0.5 * (len(counts) + 2))
    better = 0
    for r in llm.op9_hmm(spark, small_dir).collect():
        k = r["doc_id"]
        base = sum(math.log10(counts[w] + 0.5) - per for w in words[k]) + math.log10(ends + 0.5) - per
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[k], len(words[k]) + 1, sum(counts[w] > 0 for w in words[k]) + 1, n)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        better += r["score"] > base
    assert better > 0.9 * len(docs)


def test_pipeline(spark, small_dir, docs):
    import corpus_pipeline

    assert [f for _, f in corpus_pipeline.STAGES] and corpus_pipeline.ORACLE_SQL is None
    now = spark.read.parquet(f"{small_dir}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, small_dir)
        if name != "packing":
            assert now.columns == columns
            now = now.cache()
        seen[name] = [r["doc_id"] for r in now.select("doc_id").collect()]
    assert set(seen["quality"]) <= set(docs) and sorted(seen["lines"]) == sorted(seen["quality"])
    assert len(seen["near_duplicates"]) == len(set(seen["near_duplicates"])) <= len(seen["lines"])
    assert set(seen["mixing"]) == set(seen["near_duplicates"]) == set(seen["packing"])
