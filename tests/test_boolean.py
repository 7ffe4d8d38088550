import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from textloom.operators import search
from textloom.plans import boolean as B

POSTINGS = [("aaa", 1), ("aaa", 2), ("aaa", 3), ("bbb", 2), ("bbb", 3), ("bbb", 4)]


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, "s", None if i == 5 else "text") for i in range(1, 6)], "doc_id long, source_name string, clean_text string")
    return spark.createDataFrame(POSTINGS, "term string, doc_id long").cache(), docs.cache()


@pytest.mark.parametrize(
    ("query", "order"),
    [("cat OR dog AND bird", "cat dog bird AND OR"), ("cat AND NOT (dog OR fox)", "cat dog fox OR NOT AND"), ("NOT NOT cat", "cat NOT NOT"), ("NOT cat AND dog", "cat NOT dog AND"), ("a OR b OR c", "a b OR c OR")],
)
def test_order(query, order):
    assert " ".join(B.postfix(B.parse(query))) == order


@pytest.mark.parametrize(
    ("query", "code"),
    [
        ("cat and", B.BEFORE_TERM), ("cat dog", B.BEFORE_TERM), ("cat (dog)", B.BEFORE_OPEN), ("()", B.EMPTY_PARENS), ("cat)", B.EXTRA_CLOSE), ("(cat", B.EXTRA_OPEN), ("cat NOT dog", B.BEFORE_NOT),
        ("AND cat", B.BEFORE_BINARY), ("cat AND", B.ENDS_OPEN), ("NOT", B.ENDS_OPEN), ("(", B.ENDS_OPEN), ("cat-dog", B.BAD_CHARACTER), ("abcд", B.BEFORE_TERM), ("   ", B.EMPTY), ("c!at", B.BANG), ("(cat OR )", B.EMPTY_PARENS),
    ],
)
def test_errors(query, code):
    with pytest.raises(B.QueryError) as e:
        B.parse(query)
    assert e.value.code == code


def test_error_names_the_byte():
    with pytest.raises(B.QueryError) as e:
        B.parse(" мир-x")
    assert e.value.at == 6


@pytest.mark.parametrize(
    ("query", "ids"),
    [("aaa AND bbb", {2, 3}), ("aaa OR bbb", {1, 2, 3, 4}), ("NOT aaa", {4, 5}), ("aaa AND NOT bbb", {1}), ("NOT (aaa OR bbb)", {5}), ("zzz", set()), ("NOT zzz", {1, 2, 3, 4, 5}), ("ab", set()), ("NOT ab", {1, 2, 3, 4, 5})],
)
def test_both_evaluators(tables, query, ids):
    for how in (search.search, search.search_by_sets):
        assert {r.doc_id for r in how(*tables, query).collect()} == ids


TREES = st.recursive(st.sampled_from(["aaa", "bbb", "zzz", "ab"]), lambda x: st.one_of(st.builds("NOT {}".format, x), st.builds("({} AND {})".format, x, x), st.builds("({} OR {})".format, x, x)), max_leaves=6)


@settings(max_examples=10, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(TREES)
def test_evaluators_agree(tables, query):
    everything = {1, 2, 3, 4, 5}
    sets = {"aaa": {1, 2, 3}, "bbb": {2, 3, 4}}
    expected = B.evaluate(B.parse(query), lambda t: sets.get(t, set()), set.intersection, set.union, lambda a: everything - a)
    assert {r.doc_id for r in search.search(*tables, query).collect()} == expected
    assert {r.doc_id for r in search.search_many(*tables, {"q": query}).collect()} == expected


def test_display(tables):
    rows = search.display(search.search(*tables, "NOT zzz"), tables[1], 5).orderBy("doc_id").collect()
    assert [(r.doc_id, r.snippet) for r in rows] == [(1, "text"), (2, "text"), (3, "text"), (4, "text"), (5, "")]


@pytest.mark.parametrize("query", ["NOT " * 2001 + "aaa", "(" * 2000 + "aaa" + ")" * 2000, " AND ".join(["aaa"] * 5001), " OR ".join(["NOT aaa"] * 3000), "NOT (" * 1000 + "aaa" + ")" * 1000])
def test_long_and_deep_queries(query):
    ids = B.evaluate(B.parse(query), lambda t: {1, 2, 3}, set.intersection, set.union, lambda a: {1, 2, 3, 4, 5} - a)
    assert ids == ({4, 5} if query.startswith("NOT NOT") or " OR " in query else {1, 2, 3})
    assert len(B.postfix(B.parse(query))) >= 1 and list(B.terms(B.parse(query))) == ["aaa"]


def test_queries_of_many_terms(tables):
    more = " OR ".join(f"x{i:04}" for i in range(1000))
    assert {r.doc_id for r in search.search(*tables, f"(aaa AND bbb) OR {more}").collect()} == {2, 3}
    assert {r.doc_id for r in search.search_texts(tables[1].select("doc_id", "clean_text"), f"text OR {more}").collect()} == {1, 2, 3, 4}


def test_display_is_in_order(tables):
    assert [r.doc_id for r in search.display(search.search(*tables, "NOT zzz"), tables[1], 4).collect()] == [1, 2, 3, 4]
