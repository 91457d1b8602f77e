"""Nulls, empty and long texts, repeated rows, clashing names and empty tables, for every operator on documents."""

import hashlib

import pytest

pytest.importorskip("tesserine.llm")
from tesserine.llm import exact, hmm, idstore, mixing, packing, quality, simhash, templates, tiff, tokens, wacz  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, h int, node string, line string, block int, label string, part string"
LONG = "word and another, " * 30_000
ROWS = [
    (1, "a b c d e f g h", "en", "s1"),
    (2, "a b c d e f g h", "en", "s1"),
    (3, None, "en", None),
    (4, "", None, "s1"),
    (5, LONG, "en", "s2"),
    (5, LONG, "en", "s2"),
    (6, "  \n \t \n", "en", "s2"),
    (None, "only once, with ünïcode 日本 and 12 numbers", "en", "s2"),
    (7, "x", "en", "s3"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, "k", 2, "n", "l", 3, "y", "p") for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0, "z"), (2, 1, None, "z"), (4, 0, 0, "z"), (7, None, 0, "z"), (None, 1, 1, "z"), (7, 0, 1, "z")], "doc_id long, quality int, toxic int, text string")


OPERATORS = {
    "exact": lambda d, l: exact.exact_dedup(d),
    "simhash": lambda d, l: simhash.simhash_groups(d, words=3, radius=2, similarity=None),
    "similar": lambda d, l: simhash.simhash_groups(d),
    "quality": lambda d, l: quality.quality_scores(d, l),
    "tiff": lambda d, l: tiff.text_media(d),
    "ids": lambda d, l: idstore.stored_ids(d),
    "hmm": lambda d, l: hmm.lm_scores(d, states=2, own_words=8, endings=8, rounds=1),
    "templates": lambda d, l: templates.drop_recurring_lines(d, min_docs=2, counts=("n_lines", "gone")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_a_row_for_each_row(name, docs, labels):
    rows = OPERATORS[name](docs, labels).collect()
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in rows) == sorted((r[0] is not None, r[0] or 0) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(name, nothing, labels):
    assert OPERATORS[name](nothing, labels).collect() == []


def test_packing_and_mixing(docs, nothing):
    rows = packing.pack_documents(docs).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert packing.pack_documents(nothing).collect() == []
    once = mixing.mix_schedule(docs, budget="cover", max_repeats=1e9).collect()
    assert {r["doc_id"] for r in once} == {r[0] for r in ROWS} and {r["source"] for r in once} == {r[3] for r in ROWS}
    assert mixing.mix_schedule(nothing).collect() == []
    assert mixing.mix_documents(docs, budget="total").columns == docs.columns


def test_filters_keep_all_columns(docs, labels, nothing):
    for got in (quality.drop_low_quality(docs, labels), templates.drop_recurring_lines(docs), simhash.simhash_dedup(docs)):
        assert got.schema == docs.schema
        got.collect()
    assert simhash.simhash_dedup(nothing).collect() == [] == quality.drop_low_quality(nothing, labels.limit(0)).collect()


def test_defined_values(docs, labels):
    by = {r["doc_id"]: r for r in exact.exact_dedup(docs, keep="max").collect()}
    assert (by[1]["keep_id"], by[1]["group_size"], by[1]["kept"]) == (2, 2, False)
    assert (by[3]["keep_id"], by[4]["kept"]) == (4, True) and by[3]["text_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5]["group_size"] == 2 and by[5]["kept"] and by[None]["kept"]
    by = {r["doc_id"]: r for r in simhash.simhash_groups(docs, words=3, radius=2, similarity=None).collect()}
    assert {by[k]["component_id"] for k in (3, 4, 6)} == {3} and by[3]["fingerprint"] == "0" * 16
    assert by[1]["component_id"] == by[2]["component_id"] == 1
    kept = {r["doc_id"] for r in simhash.simhash_dedup(docs).collect()}
    assert kept == {1, 3, 5, None, 7}
    by = {r["doc_id"]: r for r in tiff.text_media(docs).collect()}
    assert (by[3]["n_bytes"], by[3]["payload_bytes"], by[4]["payload_sha256"]) == (0, 192, hashlib.sha256(b" " * 192).hexdigest())
    assert all(0 <= r["score"] <= 1 for r in quality.quality_scores(docs, labels).collect())
    by = {r["doc_id"]: r for r in templates.drop_recurring_lines(docs, min_docs=2).collect()}
    assert by[3]["text"] is None and by[4]["text"] == "" and by[6]["text"] == ROWS[6][1]
    # copies of one document don't make its lines recur
    assert by[1]["text"] == ROWS[0][1]


def test_pages(spark):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://c d/", None), (4, "http://e/", ""), (None, "u", "once"), (5, "u", "é" * 50_000)]
    pages = spark.createDataFrame([(*r, 1, "b") for r in rows], "page_id long, url string, html string, h int, bucket string")
    got = {r["page_id"]: r for r in wacz.archived_pages(pages).collect()}
    assert len(got) == len(rows) and (got[1]["record_type"], got[1]["refers_to"], got[2]["record_type"]) == ("revisit", 2, "response")
    assert got[3]["refers_to"] == 4 and got[3]["payload_bytes"] == 0 and got[5]["payload_bytes"] == 100_000
    assert got[5]["payload_digest"] == wacz.base32_sha1(("é" * 50_000).encode())
    assert wacz.archived_pages(pages.limit(0)).collect() == []


def test_encoder_equals_library():
    import random

    path = tokens.tokenizer_path()
    made = tokens.Encoder(path)
    parts = ["a", "é", "ß", " ", "  ", "\n", "\t", "\n\n", "'s", "'ll", "1", "²", "!!", "日本", " ", "　", "\x1c", "<|endoftext|>", "hello", "😀", "\x85", "ª", "\r", "ا"]
    draw = random.Random(5)
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(4000)]
    whole = made.library.encode_batch(texts, add_special_tokens=False)
    for text, e in zip(texts, whole, strict=True):
        assert made.encode(text) == b"".join(x.to_bytes(4, "little") for x in e.ids), text
