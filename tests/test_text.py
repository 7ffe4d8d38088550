import pytest
from pyspark.sql import functions as F

from textloom.functions import text, url
from textloom.queries import STEMS

GOLDEN = "art abcд мир чита давш занима искусств истор истор елк красив длин возможн скорост".split()


@pytest.mark.parametrize(
    ("given", "expected"),
    [("Hello, ab World!", ["hello", "world"]), ("МИР и Ёлка", ["мир", "елка"]), ("éclair", ["clair"]), ("a1b2 x_yzw 12 123", ["a1b2", "yzw", "123"]), ("abcд", ["abcд"]), ("", []), ("a b c", []), (None, [])],
)
def test_tokens(spark, given, expected):
    row = spark.createDataFrame([(given,)], "t string").select(text.tokens(F.col("t")).alias("x")).first()
    assert row.x == expected
    if given is not None:
        assert text.tokens_of(given) == expected


def test_stems(spark):
    words = STEMS + ["", "я", "в", "вши", "длиннейший", "читая", "ь"]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem(F.col("w")).alias("s")).collect()
    assert {r.w: r.s for r in rows} == {w: text.stem_of(w) for w in words}
    assert [text.stem_of(w) for w in STEMS] == GOLDEN


def test_snippet_and_cleanup(spark):
    rows = [("x" * 100,), ("x" * 101,), (None,)]
    got = [r.s for r in spark.createDataFrame(rows, "t string").select(text.snippet(F.col("t")).alias("s")).collect()]
    assert got == ["x" * 100, "x" * 100 + "...", ""]
    row = spark.createDataFrame([(" a\x01b  c ", "text [ 12 ] more")], "a string, b string").select(text.normalised(F.col("a")).alias("a"), text.without_footnotes(F.col("b")).alias("b")).first()
    assert (row.a, row.b) == ("a b c", "text more")


def test_bytes(spark):
    row = spark.createDataFrame([(bytearray(b"ok"), bytearray(b"\xff\x01"))], "a binary, b binary").select(text.preview(F.col("a")).alias("a"), text.preview(F.col("b")).alias("b"), text.decoded(F.col("b")).alias("c")).first()
    assert (row.a, row.b, row.c) == ("ok", "0xff01 (2 bytes)", "�\x01")


@pytest.mark.parametrize(("host", "expected"), [("m.ex.com", True), ("EX.com", True), ("badex.com", False), ("", False), (None, False)])
def test_hosts(spark, host, expected):
    row = spark.createDataFrame([(host,)], "h string").select(url.host_allowed(F.col("h"), F.array(F.lit("ex.com"))).alias("x")).first()
    assert row.x is expected


def test_host_of_url(spark):
    urls = [("https://u:p@Ex.com:80/x",), ("http://[::1]:8/",), ("nothing",), (None,)]
    assert [r.h for r in spark.createDataFrame(urls, "u string").select(url.host(F.col("u")).alias("h")).collect()] == ["ex.com", "::1", "", ""]
