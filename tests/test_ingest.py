import pytest
from pyspark.sql import functions as F

from textloom.operators import graph, index, ingest, zipf
from textloom.sources import files
from textloom.sources.config import ConfigError, Http, Recrawl, parse
from textloom.sources.tables import unique_by
from textloom.streaming.index_stream import document_stream, index_stream, page_stream, snapshot, stored_frequencies, stored_postings

PAGE = "url string, url_norm string, html string, source_name string, fetched_at_unix bigint, etag string, last_modified string, content_hash string"


def _page(key, html, at, etag=None):
    return (key, key, html, "s", at, etag, None, None)


def test_upsert_keeps_what_new_rows_lack_and_repeats(spark):
    old = spark.createDataFrame([_page("a", "1", 1, "e1"), _page("b", "1", 1)], PAGE)
    new = spark.createDataFrame([_page("a", "2", 2), _page("a", "3", 3), _page("c", "9", 1)], PAGE)
    once = ingest.upsert(old, new)
    rows = {r.url_norm: (r.html, r.fetched_at_unix, r.etag) for r in once.collect()}
    assert rows == {"a": ("3", 3, "e1"), "b": ("1", 1, None), "c": ("9", 1, None)}
    assert {tuple(r) for r in ingest.upsert(once, new).collect()} == {tuple(r) for r in once.collect()}
    assert unique_by(once, "url_norm").isEmpty()


def test_upsert_applies_rows_in_turn(spark):
    """A page is stored and then said to be unchanged in one batch; another only ever was unchanged."""
    old = spark.createDataFrame([_page("a", "old", 1, "e1")], PAGE)
    touch = lambda key, at: (key, key, None, None, at, None, None, None)
    new = spark.createDataFrame([_page("a", "X", 2), touch("a", 3), touch("b", 3), _page("c", "Y", 5, "e2"), _page("c", "Z", 4, "e0"), touch("c", 6)], PAGE)
    rows = {r.url_norm: (r.html, r.fetched_at_unix, r.etag) for r in ingest.upsert(old, new).collect()}
    assert rows == {"a": ("X", 3, "e1"), "c": ("Y", 6, "e2")}
    assert ingest.upsert(old, new.limit(0)).collect() == old.collect() and ingest.upsert(old.limit(0), new.limit(0)).count() == 0


def test_values_of_one_time_come_from_one_row(spark):
    """Rows of a page at one time: all values are those of one of them, of the first in the table where it has a place."""
    rows = [(k, k, f"h{n}", "s", 5, f"e{n}", f"m{n}", f"c{n}", n) for k in "abcdefgh" for n in (2, 1, 3)]
    new = spark.createDataFrame(rows, f"{PAGE}, page_id long")
    for r in ingest.newest(new.drop("page_id"), "url_norm", "fetched_at_unix").collect():
        assert len({r.html[1:], r.etag[1:], r.last_modified[1:], r.content_hash[1:]}) == 1
    old = new.drop("page_id").limit(0)
    for out in (ingest.newest(new, "url_norm", "fetched_at_unix", "page_id"), ingest.upsert(old, new, place="page_id")):
        assert out.columns == old.columns and {(r.url_norm, r.html, r.etag, r.content_hash) for r in out.collect()} == {(k, "h1", "e1", "c1") for k in "abcdefgh"}


def test_page_store_merges_batches(spark, tmp_path):
    touch = ("a", "a", None, None, 9, None, None, None)
    for n, row in enumerate([_page("a", "1", 1, "e"), _page("a", "2", 2), touch, _page("b", "x", 4), ("z", "z", None, None, 3, None, None, None)]):
        spark.createDataFrame([row], PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        page_stream(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check", compact_every=2).awaitTermination()
        assert n == 0 or (tmp_path / "store" / "base=1").exists()
    assert sorted((r.url_norm, r.html, r.etag, r.fetched_at_unix) for r in snapshot(spark, f"{tmp_path}/store").collect()) == [("a", "2", "e", 9), ("b", "x", None, 4)]
    assert snapshot(spark, f"{tmp_path}/nothing") is None


def test_seeds_are_capped(spark):
    rows = spark.createDataFrame([(i, f"u{i}") for i in range(9)], "page_id long, url string")
    assert [r.page_id for r in ingest.capped_seeds(rows, 3, ["page_id"]).collect()] == [0, 1, 2]


def test_wide_lines_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "IDS_OF_A_LINE", 10)
    docs = spark.createDataFrame([(i, "the cat" if i % 2 else "the") for i in range(35)], "doc_id long, clean_text string")
    post = index.postings(docs)
    wide = files.wide_postings(post).collect()
    assert sorted((r.term, r.df, r.docs.count("|") + 1) for r in wide) == [("cat", 17, 2)] + [("cat", 17, 5)] * 3 + [("the", 35, 5)] + [("the", 35, 10)] * 3
    files.write_postings(post, f"{tmp_path}/p")
    assert {tuple(r) for r in files.read_postings(spark, f"{tmp_path}/p").collect()} == {tuple(r) for r in post.collect()}
    files.write_universe(docs, f"{tmp_path}/u")
    assert files.read_universe(spark, f"{tmp_path}/u").count() == 35


def test_terms_without_an_index(spark):
    docs = spark.createDataFrame([(1, "История истории мир"), (2, "the CAT, the исторический"), (3, None), (4, "cats")], "doc_id long, clean_text string")
    for terms in (["истор"], ["cat", "the"], ["истор", "мир", "cat"], []):
        expected = {tuple(r) for r in index.postings(docs).collect() if r.term in terms}
        assert {tuple(r) for r in index.postings_of(docs, terms).collect()} == expected


def test_frequencies_in_one_scan(spark):
    docs = spark.createDataFrame([(i, f"the word{i % 3} мир миры the" if i % 2 else None) for i in range(30)], "doc_id long, clean_text string")
    both = {r.term: (r.freq, r.df) for r in index.frequencies(docs).collect()}
    df = {r.term: r.df for r in index.document_frequencies(index.postings(docs)).collect()}
    assert both == {r.term: (r.freq, df[r.term]) for r in index.term_frequencies(docs).collect()}


def test_due_and_unchanged(spark):
    existing = spark.createDataFrame([("https://ex.com/a", "e", None, "h", 100), ("https://ex.com/b", None, "m", None, None)], "url_norm string, etag string, last_modified string, content_hash string, fetched_at_unix bigint")
    sources = spark.createDataFrame([("s", ["ex.com"])], "source string, allowed_domains array<string>")
    seeds = spark.createDataFrame([("http://ex.com", "s"), ("https://ex.com/a", "s"), ("https://ex.com/b", "s"), ("https://no.com", "s"), ("x", "s"), ("https://ex.com", "t")], "url string, source string")
    got = {(r.url, r.source): (r.decision, r.if_none_match, r.if_modified_since) for r in ingest.plan_fetches(seeds, sources, existing, Recrawl(), 100 + 3600).collect()}
    assert got[("https://ex.com/a", "s")] == ("not_due", None, None)
    assert got[("https://ex.com/b", "s")][0] == "not_due"
    assert got[("https://no.com", "s")][0] == "host_not_allowed"
    assert got[("x", "s")][0] == "bad_url"
    assert got[("https://ex.com", "t")][0] == "unknown_source"
    later = {r.url: (r.decision, r.if_none_match) for r in ingest.plan_fetches(seeds, sources, existing, Recrawl(), 100 + 168 * 3600).collect()}
    assert later["https://ex.com/a"] == ("fetch", "e")


def test_retries_end_in_dead_letters(spark):
    rows = spark.createDataFrame([("u", 0, "7", "retry"), ("v", 3, None, "retry"), ("w", 0, None, "store")], "url_norm string, attempts int, retry_after string, action string")
    got = {r.url_norm: (r.attempts, r.dead, r.next_attempt_at) for r in ingest.next_attempts(rows, Http(), 100).collect()}
    assert got["u"][:2] == (1, False) and 107 <= got["u"][2] < 108
    assert got["v"] == (4, True, None) and "w" not in got


def test_quota():
    assert graph.Quota.of(100, 100, 30, 50) == graph.Quota(30, 20)
    assert graph.Quota.of(100, 5, 30, 50) == graph.Quota(45, 5)
    assert graph.Quota.of(2, 3, 30, 50) == graph.Quota(2, 3)


def test_walk_is_bounded_and_ends_on_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "parent long, child long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert {tuple(r) for r in graph.reachable(edges, roots, 2).collect()} == {(1, 0), (2, 1), (3, 2)}
    assert {tuple(r) for r in graph.reachable(edges, roots, 9).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}


def test_link_tables(spark):
    pages = spark.createDataFrame([(10, 14, "Sub cat", 0), (11, 0, "P", 0), (12, 0, "R", 1)], "page_id long, page_namespace int, page_title string, page_is_redirect int")
    targets = spark.createDataFrame([(1, 14, "Root"), (3, 14, "Sub_cat"), (2, 14, "Sub_cat")], "lt_id long, lt_namespace int, lt_title string")
    links = spark.createDataFrame([(10, " Subcat ", 1), (11, "page", 2), (12, "page", 2)], "cl_from long, cl_type string, cl_target_id long")
    below, members = graph.member_edges(links, targets, pages)
    assert [tuple(r) for r in below.collect()] == [(1, 2)]
    found = graph.seeds(graph.reachable(below, spark.createDataFrame([(1,)], "id long"), 3), members, pages, "ex.org", "s", 10)
    assert [(r.url, r.page_id, r.depth) for r in found.collect()] == [("https://ex.org/wiki/P", 11, 1)]


def test_files_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([(1, "the cat and the dog"), (2, "the end"), (3, "")], "doc_id long, clean_text string")
    post = index.postings(docs)
    files.write_postings(post, f"{tmp_path}/p")
    assert {tuple(r) for r in files.read_postings(spark, f"{tmp_path}/p").collect()} == {tuple(r) for r in post.collect()}
    lexicon = index.lexicon(docs)
    files.write_lexicon(lexicon, f"{tmp_path}/z")
    assert {(int(r.rank), r.term, int(r.freq)) for r in files.read_lexicon(spark, f"{tmp_path}/z").collect()} == {(r.rank, r.term, r.freq) for r in lexicon.collect()}
    assert [r.term for r in lexicon.orderBy("rank").collect()] == ["the", "and", "cat", "dog", "end"]
    files.write_universe(docs, f"{tmp_path}/u")
    assert {r.doc_id for r in files.read_universe(spark, f"{tmp_path}/u").collect()} == {1, 2, 3}
    seeds = spark.createDataFrame([("u1", "t", 1, 0, "s1")], "url string, title string, page_id long, namespace int, source string")
    files.write_seeds(seeds, f"{tmp_path}/s")
    assert [tuple(r) for r in files.read_seeds(spark, f"{tmp_path}/s").collect()] == [("u1", "s1")]


def test_ragged_seeds_and_dumps(spark, tmp_path):
    (tmp_path / "s.tsv").write_text("url\tsource\na\tx\ty\nalone\n\nb\tz\n")
    assert {tuple(r) for r in files.read_seeds(spark, f"{tmp_path}/s.tsv").collect()} == {("a", "y"), ("b", "z")}
    (tmp_path / "d.sql").write_text("-- x\nINSERT INTO `page` VALUES (1,0,'It\\'s, (a)',0),(2,14,'B''c',NULL);\n")
    rows = files.read_dump(spark, f"{tmp_path}/d.sql", "page", ["id", "ns", "title", "redirect"]).collect()
    assert [tuple(r) for r in rows] == [("1", "0", "It's, (a)", "0"), ("2", "14", "B'c", None)]


def test_index_invariants(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{j:03d}" for j in range(i % 7 + 1)) * 2) for i in range(50)], "doc_id long, clean_text string")
    post, freq = index.postings(docs), index.term_frequencies(docs)
    tokens = index.token_rows(docs)
    assert freq.agg(F.sum("freq")).first()[0] == tokens.count()
    assert {tuple(r) for r in index.document_frequencies(post).collect()} == {(r.term, r.n) for r in post.groupBy("term").agg(F.countDistinct("doc_id").alias("n")).collect()}
    ranks = [r.rank for r in index.ranked(freq).orderBy("rank").collect()]
    assert ranks == list(range(1, len(ranks) + 1))
    assert zipf.curves(index.ranked(freq), 1, 10).count() == len(ranks)


def test_stream_equals_batch(spark, tmp_path):
    for n in range(3):
        rows = spark.createDataFrame([(10 * n + i, f"the word{i} again again", "en", "s", 1) for i in range(4)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        index_stream(document_stream(spark, f"{tmp_path}/in", 1), f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    docs = spark.read.parquet(f"{tmp_path}/in").select("doc_id", F.col("text").alias("clean_text"))
    assert {tuple(r) for r in stored_postings(spark, f"{tmp_path}/store").collect()} == {tuple(r) for r in index.postings(docs).collect()}
    assert {tuple(r) for r in stored_frequencies(spark, f"{tmp_path}/store").collect()} == {tuple(r) for r in index.term_frequencies(docs).collect()}


def test_page_stream(spark, tmp_path):
    for n, row in enumerate([_page("a", "1", 1, "e"), _page("a", "2", 2)]):
        spark.createDataFrame([row], PAGE).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        page_stream(spark.readStream.schema(PAGE).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check").awaitTermination()
    assert [(r.html, r.etag) for r in snapshot(spark, f"{tmp_path}/store").collect()] == [("2", "e")]


def test_config():
    root = {"sources": [{"name": "a", "allowed_domains": ["A.org"]}], "http": {"max_response_mb": 1}, "seeds": {"max_per_source": 5}}
    config = parse(root)
    assert config.sources[0].domain == "a.org" and config.http.max_response_bytes == 1 << 20 and config.max_per_source == 5
    for bad in ({}, {"sources": [{"name": "a"}]}, root | {"seeds": {"format": "csv"}}, root | {"logic": {"max_unique_docs": 0}}, root | {"bootstrap": {"dump_resources": ["../x"]}}):
        with pytest.raises(ConfigError):
            parse(bad)
