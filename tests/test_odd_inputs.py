"""Queries against their SQL on texts that the test tables don't hold."""

import duckdb
import pytest

from tesserine.functions.addresses import PlainFinder
from tesserine.plans import ORACLE_SQL, QUERIES

MAIL = [
    "write a@b.community or a@b.de or x @ y.com now", "a@b.comc@d.org.f@g.net", "@b.com a@.com a@b..com a@-.com", "x@y@b.com  \t and\tmore ", "{a,b}@mail.com (c|d)@x.edu", "a@b.COM A.B@C.com.",
    "caf\u00e9@x.org \u0250\u024f@x.edu, \u4e2da@b.net", "\ta@b.com\n", "  a@b.com  ", "\u00a0a@b.com\u3000", "a@b.com, a@c.b.com; d@b.com", "no address", "a@" + "b." * 9000 + "com", "b" * 30000 + "@" + "c-" * 9000,
]
WORDS = [
    "die\u00fcber die\u00e9 ofz", "Die der", "\u00fcder und die\u00f6", "This the\u00df", "un der mit", "d\u0131e d\u0131e THI\u017f this_ this", "thi\u017fx this", "with\u00e9", "\u00e9With", "oF\u0301 the", "a" * 79 + " this",
    "x " * 38 + "der thisly", "x " * 38 + "der mitte", "y " * 18 + "the thereof", "y " * 18 + " offer", "y " * 28 + "dies", "y " * 18 + "xy without", "y " * 28 + "with\u00e9", "the\nthe", "", None,
]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder, con = tmp_path_factory.mktemp("odd"), duckdb.connect()
    docs = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(MAIL + WORDS)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    return str(folder), con


@pytest.mark.parametrize("name", ["email_count", "email_strip", "first_gate", "rule_cascade", "score_explained", "single_mention", "judge_next"])
def test_odd_texts(name, spark, odd):
    folder, db = odd
    got = QUERIES[name](spark, folder)
    columns = ", ".join(got.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(db.sql(f"SELECT {columns} FROM ({ORACLE_SQL[name]})").fetchall(), key=repr)


def test_plain_addresses_removed():
    assert PlainFinder(["com"]).stripped("ask a@b.com  or c@d.com.", keep_domain=False) == "ask or ."
