"""All queries over the driver's tables, with SQL that DuckDB can run beside most of them.

The SQL is written from what the operators mean, not from their plans.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import html, text, url
from textloom.operators import clean, graph, index, ingest, profile, search, zipf
from textloom.plans.boolean import parse, terms
from textloom.sources import files
from textloom.sources.config import Config, Http, Recrawl, Source
from textloom.sources.scratch import shared_dir, written
from textloom.sources.tables import clean_docs, spread, table, universe

Query = Callable[[SparkSession, str], DataFrame]

NOW = 1_700_000_000
BOOLEAN = {
    "bool_and": "the AND and",
    "bool_or": "was OR with",
    "bool_not": "NOT the",
    "bool_and_not": "the AND NOT with",
    "bool_nested": "the AND (and OR that) AND NOT with",
    "bool_double_not": "NOT NOT was",
}
FLAGSHIP = BOOLEAN["bool_nested"]
STEMS = ["art", "abcд", "мир", "читавшись", "давши", "занимались", "искусство", "история", "истории", "елка", "красивейшими", "длинный", "возможность", "скорость"]
URLS = ["HTTPS://Ex.COM/a/?q=1#f", "https://ex.com", "https://Us@EX.com/a//", "host/path", "", "//Ex.com/b"]
TITLES = ["A b/c (d)", "x:y_z-1", "a+b*c~d"]

TOKENS = "SELECT doc_id, source, replace(lower(unnest(regexp_extract_all(text, '[A-Za-z0-9А-Яа-яЁё]{3,}'))), 'ё', 'е') AS term FROM documents"
WITH_TOKENS = f"WITH tok AS ({TOKENS}), post AS (SELECT DISTINCT term, doc_id FROM tok)"
FREQ = "freq AS (SELECT term, count(*) AS freq FROM tok GROUP BY term), lex AS (SELECT row_number() OVER (ORDER BY freq DESC, term) AS rank, term, freq FROM freq)"


def _has(term: str) -> str:
    return f"SELECT doc_id FROM post WHERE term = '{term}'"


BOOLEAN_SQL = {
    "bool_and": f"{_has('the')} INTERSECT {_has('and')}",
    "bool_or": f"{_has('was')} UNION {_has('with')}",
    "bool_not": f"SELECT doc_id FROM documents EXCEPT {_has('the')}",
    "bool_and_not": f"{_has('the')} EXCEPT {_has('with')}",
    "bool_nested": f"({_has('the')} INTERSECT ({_has('and')} UNION {_has('that')})) EXCEPT {_has('with')}",
    "bool_double_not": f"SELECT doc_id FROM documents EXCEPT (SELECT doc_id FROM documents EXCEPT {_has('was')})",
}


def _boolean(name: str, by_sets: bool = False) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = clean_docs(spark, sf_dir)
        if by_sets:
            return search.search_by_sets(index.postings_of(docs, list(terms(parse(BOOLEAN[name])))), docs, BOOLEAN[name]).select("doc_id")
        return search.search_texts(docs, BOOLEAN[name])

    return run


def _on_docs(of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: of(clean_docs(spark, sf_dir))


def _on(name: str, of: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: of(table(spark, sf_dir, name))


def search_top5(spark: SparkSession, sf_dir: str, n: int = 5) -> DataFrame:
    docs = clean_docs(spark, sf_dir)
    return search.display(search.search_texts(docs, FLAGSHIP), docs, n)


def _search_many(docs: DataFrame) -> DataFrame:
    wanted = dict.fromkeys(t for q in BOOLEAN.values() for t in terms(parse(q)))
    return search.search_many(index.postings_of(docs, list(wanted)), docs, BOOLEAN)


#: Russian words and their stems, worked out by hand.
RUSSIAN = dict(zip("мир читавшись занимались искусство история истории елка Ёлка красивейшими длинный возможность скорость".split(), "мир чита занима искусств истор истор елк елк красив длин возможн скорост".split(), strict=True))


def _russian(docs: DataFrame) -> DataFrame:
    """Texts of Russian words, which ones and how often by the document's id, joined to the document's own."""
    words, n = F.array(*map(F.lit, RUSSIAN)), len(RUSSIAN)
    said = [F.element_at(words, (F.col("doc_id") * k % n + 1).cast("int")) for k in (1, 5, 7)]
    return docs.select("doc_id", "source_name", F.concat_ws(", ", *said, F.upper(said[0]), F.substring("clean_text", 1, 200)).alias("clean_text"))


#: Pages whose text was worked out by hand: what goes, footnotes, sections that end an article, a wiki's title and body.
WIKI = [
    ("drop", "<body><nav>x</nav>a<!--c-->b<script>y</script></body>", "", "a b"),
    ("footnote", "<body>text [ 12 ] more</body>", "", "text more"),
    ("section", "<body><p>a</p><h2>Ссылки</h2><p>b</p>tail</body>", "", "a tail"),
    ("title", "<body><h1> A&nbsp; B </h1>c</body>", "A B", "A B c"),
    ("wiki", "<title>T</title><body><div id=mw-content-text>x<div class=mw-parser-output>in<sup class=reference>1</sup><div id=toc>t</div></div></div></body>", "T", "in"),
    ("heading", "<body><h1 id=firstHeading>F</h1><div id=mw-content-text><table class=navbox><tr><td>n</td></tr></table>t<h2>См. также</h2><ul><li>u</li></ul></div></body>", "F", "t"),
]


def _wiki(spark: SparkSession, _: str) -> DataFrame:
    raw = spark.createDataFrame([(n, h) for n, h, _, _ in WIKI], "url_norm string, html string")
    return clean.cleaned(raw).select(F.col("url_norm").alias("name"), "title", "clean_text")


def _exported_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two walks, divided by quota in an order that a seed decides, written as a list of seeds and read again: how many
    seeds of each source."""
    path = f"{shared_dir(spark)}/textloom/{spark.sparkContext.applicationId}/seeds-{uuid.uuid4().hex}"
    edges, members, pages = _tree(spark, sf_dir)
    walks = [graph.seeds(graph.reachable(edges, spark.createDataFrame([(k + 1000,)], "id long"), 1), members, pages, "example.org", f"r{k}") for k in (0, 1)]
    files.write_seeds(graph.divided(*walks, 20, 50, shuffle_seed=42), path)
    return files.read_seeds(spark, path).groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("url").alias("urls"))


def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.capped_seeds(table(spark, sf_dir, "pages").select("page_id", "url"), 100, ["page_id"])


def _stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(w,) for w in STEMS], "word string").select("word", text.stem(F.col("word")).alias("stem"))


def _configuration() -> Config:
    return Config((Source("example", ("example.com",)), Source("org", ("example.org",))), Recrawl(), Http())


#: Two snapshots from the pages: every second page is known already, at one of several ages; every third
#: fetched page is as it was, and statuses go round.
def _existing(pages: DataFrame) -> DataFrame:
    known = pages.where("page_id % 2 = 0")
    rows = known.select(
        url.normalize_url(F.col("url")).alias("url_norm"),
        F.concat(F.lit("e"), "page_id").alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        F.when(F.col("page_id") % 3 == 0, text.content_hash(F.col("html"))).otherwise(F.lit("old")).alias("content_hash"),
        (F.lit(NOW) - F.col("page_id") % 10 * 100_000).alias("fetched_at_unix"),
        "html",
        "page_id",
    )
    return ingest.newest(rows, "url_norm", "fetched_at_unix", "page_id")


def _plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    config = _configuration()
    source = F.when(F.col("page_id") % 5 == 0, "nowhere").when(F.col("url").contains("example.org"), "org").otherwise("example")
    seeds = pages.select("url", source.alias("source"))
    planned = ingest.plan_fetches(seeds, ingest.sources_table(spark, config), _existing(pages), config.recrawl, NOW, config.urls)
    return planned.select("url", "url_norm", "host", "decision", "if_none_match")


def _results(pages: DataFrame) -> DataFrame:
    k = F.col("page_id") % 7
    return pages.select(
        url.normalize_url(F.col("url")).alias("url_norm"),
        F.when(k == 0, 429).when(k == 1, 304).when(k == 2, 500).otherwise(200).alias("status"),
        F.col("html").cast("binary").alias("body"),
        F.when(F.col("page_id") % 2 == 1, F.lit("new")).alias("etag"),
        F.lit(None).cast("string").alias("last_modified"),
        (F.lit(NOW) + F.col("page_id") % 3).cast("long").alias("fetched_at_unix"),
        F.lit("example").alias("source_name"),
        "page_id",
    )


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return ingest.route(_results(pages), _existing(pages), Recrawl())


def _upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    old = _existing(pages).select(
        F.col("url_norm").alias("url"), "url_norm", "html", F.lit("example").alias("source_name"), "fetched_at_unix", "etag", "last_modified", "content_hash"
    )
    # All results twice, and for every fourth page an answer that came later in the same batch: not modified.
    new = ingest.pages_of(_routed(spark, sf_dir), ("page_id",))
    later = pages.where("page_id % 4 = 3").select("page_id", url.normalize_url(F.col("url")).alias("url_norm"), F.lit(304).alias("status"), F.lit(None).cast("binary").alias("body"), F.lit(None).cast("string").alias("etag"))
    later = later.withColumns({"last_modified": F.lit(None).cast("string"), "fetched_at_unix": F.lit(NOW + 50).cast("long"), "source_name": F.lit("example")})
    out = ingest.upsert(old, new.unionByName(new).unionByName(ingest.pages_of(ingest.route(later, _existing(pages), Recrawl()), ("page_id",))), place="page_id")
    return out.select("url_norm", F.length("html").alias("n_chars"), "source_name", "fetched_at_unix", "etag", "content_hash")


def _hash_groups(pages: DataFrame) -> DataFrame:
    return pages.groupBy(text.content_hash(F.coalesce("html", F.lit(""))).alias("content_hash")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A category graph from the relational tables: regions are roots, nations their subcategories, customers
    and suppliers pages; every fifth customer is a redirect. One nation links back to its region (a cycle)."""
    nation = table(spark, sf_dir, "nation")
    edges = nation.select((F.col("n_regionkey") + 1000).cast("long").alias("parent"), F.col("n_nationkey").cast("long").alias("child"))
    edges = edges.unionByName(nation.where("n_nationkey = 3").select(F.col("n_nationkey").cast("long").alias("parent"), (F.col("n_regionkey") + 1000).cast("long").alias("child")))
    customer, supplier = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    one = customer.select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("page_title"), F.col("c_nationkey").cast("long").alias("parent"), (F.col("c_custkey") % 5 == 0).cast("int").alias("page_is_redirect"))
    two = supplier.select((F.col("s_suppkey") + 10_000_000).alias("page_id"), F.col("s_name").alias("page_title"), F.col("s_nationkey").cast("long").alias("parent"), F.lit(0).alias("page_is_redirect"))
    both = one.unionByName(two)
    return edges, both.select("parent", F.col("page_id").alias("child")), both.select("page_id", F.lit(0).alias("page_namespace"), "page_title", "page_is_redirect")


def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, members, pages = _tree(spark, sf_dir)
    roots = table(spark, sf_dir, "region").where("r_regionkey < 2").select((F.col("r_regionkey") + 1000).cast("long").alias("id"))
    return graph.seeds(graph.reachable(edges, roots, 3), members, pages, "example.org", "tree").drop("title", "namespace", "source")


def _quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, members, pages = _tree(spark, sf_dir)
    out = []
    for region in (0, 1):
        root = spark.createDataFrame([(region + 1000,)], "id long")
        out.append(graph.seeds(graph.reachable(edges, root, 1), members, pages, "example.org", f"r{region}", 1000))
    return graph.divided(*out, 20, 50).select("page_id", "source", "depth")


def _prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("url_norm", url.normalize_url(F.col("url")))
    return clean.cleaned(pages).select("page_id", "title", "clean_text")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "tokenize": _on_docs(lambda d: index.token_rows(d).groupBy("doc_id", "token").agg(F.count("*").alias("n"))),
        "term_frequency": _on_docs(index.term_frequencies),
        "doc_frequency": _on_docs(lambda d: index.document_frequencies(index.postings(d))),
        "postings_long": _on_docs(index.postings),
        "postings_wide": _on_docs(lambda d: files.wide_postings(index.postings(d))),
        "zipf_rank": _on_docs(index.lexicon),
        "zipf_fit": _on_docs(lambda d: zipf.fit(index.ranked(written(index.term_frequencies(d), "frequencies"))).select(F.round("s", 6).alias("s"), F.round("c", 2).alias("c"))),
        "zipf_theory": _on_docs(lambda d: zipf.curves(written(index.ranked(written(index.term_frequencies(d), "frequencies")), "ranked")).select("rank", "freq", "theory", F.round("fitted", 3).alias("fitted"))),
        "search_top5": search_top5,
        "search_many": _on_docs(_search_many),
        "sorted_set_arrays": lambda spark, _: spark.range(1).select(F.array(*map(F.lit, (3, 1, 2))).alias("a"), F.array(*map(F.lit, (2, 5, 4))).alias("b")).select(
            *[c.cast("string").alias(n) for n, c in search.sorted_sets(F.col("a"), F.col("b")).items()]
        ),
        "stem_ru": _stems,
        "url_normalize": _on("pages", lambda p: p.select("page_id", url.normalize_url(F.col("url")).alias("url_norm"))),
        "url_normalize_cases": lambda spark, _: spark.createDataFrame([(u,) for u in URLS], "url string").select("url", url.normalize_url(F.col("url")).alias("url_norm")),
        "url_host": _on("pages", lambda p: p.select("page_id", url.host(F.col("url")).alias("host"))),
        "host_allowed": _on("pages", lambda p: p.select("page_id", url.host_allowed(url.host(F.col("url")), F.array(F.lit("example.com"))).alias("allowed"))),
        "url_unquote": lambda spark, _: spark.createDataFrame([("a%20b+c",), ("%zz",), ("%D0%BC",)], "u string").select("u", url.unquoted(F.col("u")).alias("plain")),
        "make_url": lambda spark, _: spark.createDataFrame([(t,) for t in TITLES], "title string").select("title", url.page_url(F.lit("ex.org"), F.col("title")).alias("url")),
        "dump_filename": lambda spark, _: spark.createDataFrame([("ruwiki", "page"), ("ruwiki", "../x")], "project string, resource string").select(
            "project", "resource", url.dump_name(F.col("project"), F.col("resource")).alias("name")
        ),
        "snippet": _on_docs(lambda d: d.select("doc_id", text.snippet(F.col("clean_text")).alias("snippet"))),
        "html_title": _on("pages", lambda p: p.select("page_id", html.title(F.col("html")).alias("title"))),
        "html_clean_native": _on("pages", lambda p: spread(p.select("page_id", "html")).select("page_id", html.text(F.col("html")).alias("text"))),
        "html_clean_tree": _prepared,
        "clean_counters": _on("pages", lambda p: clean.skipped(p.withColumn("url_norm", url.normalize_url(F.col("url"))))),
        "profile_by_source": _on_docs(profile.by_source),
        "profile_lengths": _on("pages", lambda p: profile.lengths(p).withColumn("avg_len", F.round("avg_len", 3))),
        "profile_missing": _on("documents", lambda d: profile.missing(d, ["doc_id", "text", "source"])),
        "latest_sample": _on("events", lambda e: profile.latest(e, "ts", "event_id").select("event_id", "user_id", "event_type")),
        "universe": _on_docs(universe),
        "doc_count": _on_docs(profile.count),
        "content_hash_dedup": _on("pages", _hash_groups),
        "recrawl_decision": _plan,
        "fetch_routing": lambda s, d: _routed(s, d).select("url_norm", "status", "action"),
        "crawl_counters": lambda s, d: ingest.counters(_routed(s, d)),
        "retry_queue": lambda s, d: ingest.next_attempts(_routed(s, d).withColumns({"retry_after": F.lit("30"), "attempts": F.lit(0)}), Http(), NOW).select("url_norm", "attempts", "dead", F.floor("next_attempt_at").alias("at")),
        "upsert_snapshot": _upserted,
        "category_bfs": _walk,
        "stem_table": _on_docs(lambda d: index.lexicon(_russian(d)).where(F.col("term") >= "\x80").select("term", "freq", "df")),
        "bool_russian": _on_docs(lambda d: search.search_texts(_russian(d), "(история OR Ёлка) AND NOT миры")),
        "html_clean_wiki": _wiki,
        "seed_export": _exported_seeds,
        "seed_cap": _capped,
        "seed_quota": _quota,
    }
    for name in BOOLEAN:
        out[name] = _boolean(name)
        out[f"{name}_sets"] = _boolean(name, by_sets=True)
    return out


_NORM = (
    "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) || '://' || lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) || "
    "CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN '/' ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/$', '') END || "
    "CASE WHEN regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) <> '' THEN '?' || regexp_extract(url, '^[^?#]*\\?([^#]*)', 1) ELSE '' END"
)
_HOST = "regexp_replace(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1), ':.*$', '')"
_PAGES = f"WITH u AS (SELECT *, {_NORM} AS url_norm, {_HOST} AS host FROM pages)"
_OLD = f"""k AS (SELECT url_norm, 'e' || page_id AS etag, CASE WHEN page_id % 3 = 0 THEN sha256(html) ELSE 'old' END AS content_hash,
  {NOW} - page_id % 10 * 100000 AS seen_at, html FROM u WHERE page_id % 2 = 0),
o AS (SELECT url_norm, arg_max(etag, seen_at) AS etag, arg_max(content_hash, seen_at) AS content_hash, max(seen_at) AS fetched_at_unix, arg_max(html, seen_at) AS html FROM k GROUP BY url_norm)"""
_ROUTED = f"""{_PAGES}, {_OLD}, s AS (SELECT page_id, {NOW} + page_id % 3 AS seen_at, url_norm, html, CASE page_id % 7 WHEN 0 THEN 429 WHEN 1 THEN 304 WHEN 2 THEN 500 ELSE 200 END AS status,
  CASE WHEN page_id % 2 = 1 THEN 'new' END AS etag, sha256(html) AS content_hash FROM u),
r AS (SELECT s.*, CASE WHEN status = 429 THEN 'retry' WHEN status = 304 THEN 'unchanged' WHEN status <> 200 THEN 'failed'
  WHEN o.content_hash = s.content_hash THEN 'unchanged' ELSE 'store' END AS action FROM s LEFT JOIN o USING (url_norm))"""


def _plain(markup: str) -> str:
    """SQL for the text of markup."""
    out = f"regexp_replace({markup}, '<[^>]*>', ' ', 'gs')"
    for reference, char in html.REFERENCES:
        out = f"replace({out}, '{reference}', '{char.replace(chr(39), chr(39) * 2)}')"
    return out


def _html_text() -> str:
    out = "coalesce(html, '')"
    for tag in html.DROPPED:
        out = f"regexp_replace({out}, '<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'gis')"
    out = f"regexp_replace({out}, '<!--.*?-->', ' ', 'gs')"
    out = f"regexp_replace({out}, '^.*?<body[^>]*>', '', 'is')"
    squeezed = f"trim(regexp_replace({_plain(out)}, '[\\s\\x1c-\\x1f\\x85\\p{{Z}}]+', ' ', 'g'))"
    return f"trim(regexp_replace(regexp_replace({squeezed}, '\\[\\s*\\d+\\s*\\]', ' ', 'g'), '\\s+', ' ', 'g'))"


_TITLE = f"trim(regexp_replace({_plain(chr(40) + 'regexp_extract(html, ' + chr(39) + '(?is)<h1[^>]*>(.*?)</h1>' + chr(39) + ', 1)' + chr(41))}, '[\\s\\x00-\\x1f\\x7f\\p{{Z}}]+', ' ', 'g'))"
_CUSTOMERS = "SELECT c_custkey AS page_id, c_name AS title, c_nationkey AS nation FROM customer WHERE c_custkey % 5 <> 0 UNION ALL SELECT s_suppkey + 10000000, s_name, s_nationkey FROM supplier"


def _values(rows: list[tuple], names: str) -> str:
    quoted = ", ".join("(" + ", ".join("NULL" if v is None else "'" + str(v).replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {quoted}) AS t({names})"


_RUSSIAN_SQL = f"""WITH words AS (SELECT [{", ".join(f"'{w}'" for w in RUSSIAN)}] AS w, [{", ".join(f"'{x}'" for x in RUSSIAN.values())}] AS x),
  places AS (SELECT doc_id, unnest([doc_id % {len(RUSSIAN)}, doc_id * 5 % {len(RUSSIAN)}, doc_id * 7 % {len(RUSSIAN)}, doc_id % {len(RUSSIAN)}]) AS place FROM documents),
  said AS (SELECT doc_id, x[place + 1] AS stem FROM places, words)"""


def oracle_sql() -> dict[str, str]:
    out = {
        "tokenize": f"WITH tok AS ({TOKENS}) SELECT doc_id, term AS token, count(*) AS n FROM tok GROUP BY ALL",
        "term_frequency": f"{WITH_TOKENS} SELECT term, count(*) AS freq FROM tok GROUP BY term",
        "doc_frequency": f"{WITH_TOKENS} SELECT term, count(*) AS df FROM post GROUP BY term",
        "postings_long": f"{WITH_TOKENS} SELECT term, doc_id FROM post",
        "postings_wide": f"""{WITH_TOKENS}, lines AS (SELECT term, count(*) AS n, string_agg(doc_id::VARCHAR, '|' ORDER BY doc_id) AS docs FROM post GROUP BY term, doc_id // {files.IDS_OF_A_LINE})
            SELECT term, CAST(sum(n) OVER (PARTITION BY term) AS BIGINT) AS df, docs FROM lines""",
        "zipf_rank": f"{WITH_TOKENS}, {FREQ} SELECT rank, term, freq, df FROM lex JOIN (SELECT term, count(*) AS df FROM post GROUP BY term) USING (term)",
        "zipf_fit": f"{WITH_TOKENS}, {FREQ} SELECT round(-regr_slope(ln(freq), ln(rank)), 6) AS s, round(exp(regr_intercept(ln(freq), ln(rank))), 2) AS c FROM lex WHERE rank BETWEEN 10 AND 10000",
        "zipf_theory": f"""{WITH_TOKENS}, {FREQ}, fit AS (SELECT -regr_slope(ln(freq), ln(rank)) AS s, exp(regr_intercept(ln(freq), ln(rank))) AS c FROM lex WHERE rank BETWEEN 10 AND 10000),
            top AS (SELECT freq AS f1 FROM lex WHERE rank = 1)
            SELECT rank, freq, f1 / rank::DOUBLE AS theory, round(c * pow(rank::DOUBLE, -s), 3) AS fitted FROM lex, fit, top""",
        "search_top5": f"""{WITH_TOKENS}, hit AS ({BOOLEAN_SQL['bool_nested']})
            SELECT doc_id, source AS source_name, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS snippet
            FROM documents WHERE doc_id IN (SELECT doc_id FROM hit ORDER BY doc_id LIMIT 5)""",
        "search_many": f"{WITH_TOKENS} " + " UNION ALL ".join(f"SELECT '{n}' AS query, doc_id FROM ({q})" for n, q in BOOLEAN_SQL.items()),
        "sorted_set_arrays": "SELECT '[2]' AS both, '[1, 2, 3, 4, 5]' AS either, '[1, 3]' AS first",
        "stem_ru": _values(list(zip(STEMS, "art abcд мир чита давш занима искусств истор истор елк красив длин возможн скорост".split(), strict=True)), "word, stem"),
        "url_normalize": f"SELECT page_id, {_NORM} AS url_norm FROM pages",
        "url_normalize_cases": _values(list(zip(URLS, ["https://ex.com/a?q=1", "https://ex.com/", "https://Us@ex.com/a/", None, None, "https://ex.com/b"], strict=True)), "url, url_norm"),
        "url_host": f"SELECT page_id, {_HOST} AS host FROM pages",
        "host_allowed": f"SELECT page_id, {_HOST} = 'example.com' OR {_HOST} LIKE '%.example.com' AS allowed FROM pages",
        "url_unquote": _values([("a%20b+c", "a b+c"), ("%zz", "%zz"), ("%D0%BC", "м")], "u, plain"),
        "make_url": _values(list(zip(TITLES, ["https://ex.org/wiki/A_b%2Fc_(d)", "https://ex.org/wiki/x:y_z-1", "https://ex.org/wiki/a%2Bb%2Ac~d"], strict=True)), "title, url"),
        "dump_filename": _values([("ruwiki", "page", "ruwiki-latest-page.sql.gz"), ("ruwiki", "../x", None)], "project, resource, name"),
        "snippet": "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE coalesce(text, '') END AS snippet FROM documents",
        "html_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
        "html_clean_native": f"SELECT page_id, {_html_text()} AS text FROM pages",
        "html_clean_tree": f"SELECT page_id, {_TITLE} AS title, {_html_text()} AS clean_text FROM pages",
        "clean_counters": "SELECT count(*) FILTER (WHERE html <> '') AS n_processed, count(*) FILTER (WHERE coalesce(html, '') = '') AS n_skipped FROM pages",
        "profile_by_source": "SELECT source AS source_name, count(*) AS n FROM documents GROUP BY source",
        "profile_lengths": "SELECT min(n) AS min_len, max(n) AS max_len, round(avg(n), 3) AS avg_len, count(*) FILTER (WHERE n = 0) AS n_empty, count(*) FILTER (WHERE n < 1000) AS n_short FROM (SELECT strlen(coalesce(html, '')) AS n FROM pages)",
        "profile_missing": "SELECT count(*) FILTER (WHERE doc_id IS NULL OR text IS NULL OR source IS NULL) AS n_missing FROM documents",
        "latest_sample": "SELECT event_id, user_id, event_type FROM events ORDER BY ts DESC, event_id LIMIT 30",
        "universe": "SELECT doc_id FROM documents",
        "doc_count": "SELECT count(*) AS n FROM documents",
        "content_hash_dedup": "SELECT sha256(coalesce(html, '')) AS content_hash, min(page_id) AS page_id, count(*) AS n FROM pages GROUP BY 1",
        "recrawl_decision": f"""{_PAGES}, {_OLD}, d AS (SELECT url, url_norm, host, o.fetched_at_unix AS seen, etag,
              CASE WHEN page_id % 5 = 0 THEN NULL WHEN url LIKE '%example.org%' THEN 'example.org' ELSE 'example.com' END AS domain FROM u LEFT JOIN o USING (url_norm)),
            e AS (SELECT *, CASE WHEN domain IS NULL THEN 'unknown_source' WHEN NOT (host = domain OR host LIKE '%.' || domain) THEN 'host_not_allowed'
              WHEN seen IS NOT NULL AND {NOW} - seen < 168 * 3600 THEN 'not_due' ELSE 'fetch' END AS decision FROM d)
            SELECT url, url_norm, host, decision, CASE WHEN decision = 'fetch' THEN etag END AS if_none_match FROM e""",
        "fetch_routing": f"{_ROUTED} SELECT url_norm, status, action FROM r",
        "crawl_counters": f"""{_ROUTED} SELECT 'example' AS source_name, count(*) AS processed, count(*) FILTER (WHERE action IN ('store', 'unchanged')) AS ok,
            count(*) FILTER (WHERE action = 'unchanged') AS unchanged, count(*) FILTER (WHERE action = 'failed') AS failed FROM r""",
        "retry_queue": f"{_ROUTED} SELECT url_norm, 1 AS attempts, false AS dead, {NOW + 30} AS at FROM r WHERE action = 'retry'",
        "upsert_snapshot": f"""{_ROUTED}, a AS (SELECT url_norm, seen_at, action = 'store' AS st, html, etag, content_hash FROM r WHERE action IN ('store', 'unchanged')
              UNION ALL SELECT url_norm, {NOW} + 50, false, NULL, NULL, NULL FROM u WHERE page_id % 4 = 3),
            n AS (SELECT url_norm, max(seen_at) AS seen_at, bool_or(st) AS st, arg_max(html, seen_at) FILTER (WHERE st) AS html, arg_max(etag, seen_at) FILTER (WHERE st AND etag IS NOT NULL) AS etag,
              arg_max(content_hash, seen_at) FILTER (WHERE st) AS content_hash FROM a GROUP BY url_norm)
            SELECT url_norm, length(coalesce(n.html, o.html)) AS n_chars, 'example' AS source_name, coalesce(n.seen_at, o.fetched_at_unix) AS fetched_at_unix,
              coalesce(n.etag, o.etag) AS etag, coalesce(n.content_hash, o.content_hash) AS content_hash
            FROM o FULL JOIN n USING (url_norm) WHERE o.url_norm IS NOT NULL OR st""",
        "stem_table": f"""{_RUSSIAN_SQL} SELECT stem AS term, count(*) AS freq, count(DISTINCT doc_id) AS df FROM said GROUP BY stem""",
        "bool_russian": f"""{_RUSSIAN_SQL} SELECT DISTINCT doc_id FROM said WHERE stem IN ('истор', 'елк') AND doc_id NOT IN (SELECT doc_id FROM said WHERE stem = 'мир')""",
        "html_clean_wiki": _values([(n, t, c) for n, _, t, c in WIKI], "name, title, clean_text"),
        "seed_cap": "SELECT page_id, url FROM pages ORDER BY page_id LIMIT 100",
        "seed_export": f"""WITH t AS ({_CUSTOMERS}), m AS (SELECT title, n_regionkey AS region FROM t JOIN nation ON nation = n_nationkey WHERE n_regionkey < 2),
            z AS (SELECT count(*) FILTER (WHERE region = 0) AS n0, count(*) FILTER (WHERE region = 1) AS n1 FROM m),
            q AS (SELECT least(20, n0, 50) AS f0, n0, least(n1, 50 - least(20, n0, 50)) AS f1 FROM z),
            w AS (SELECT 'r0' AS source, f0 + least(n0 - f0, 50 - f0 - f1) AS n FROM q UNION ALL SELECT 'r1', f1 FROM q)
            SELECT source, n, n AS urls FROM w WHERE n > 0""",
        "category_bfs": f"""WITH RECURSIVE e AS (SELECT n_regionkey + 1000 AS a, n_nationkey AS b FROM nation UNION ALL SELECT n_nationkey, n_regionkey + 1000 FROM nation WHERE n_nationkey = 3),
            w(id, depth) AS (SELECT r_regionkey + 1000, 0 FROM region WHERE r_regionkey < 2 UNION SELECT b, depth + 1 FROM w JOIN e ON a = id WHERE depth < 3),
            c AS (SELECT id, min(depth) AS depth FROM w GROUP BY id)
            SELECT 'https://example.org/wiki/' || replace(replace(title, ' ', '_'), '#', '%23') AS url, page_id, depth FROM ({_CUSTOMERS}) JOIN c ON id = nation""",
        "seed_quota": f"""WITH t AS ({_CUSTOMERS}), m AS (SELECT page_id, n_regionkey AS region FROM t JOIN nation ON nation = n_nationkey WHERE n_regionkey < 2),
            k AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY page_id) AS rn, count(*) OVER (PARTITION BY region) AS n FROM m),
            z AS (SELECT max(CASE region WHEN 0 THEN least(n, 1000) ELSE 0 END) AS n0, max(CASE region WHEN 1 THEN least(n, 1000) ELSE 0 END) AS n1 FROM k),
            q AS (SELECT least(20, n0, 50) AS f0, n0, n1, least(n1, 50 - least(20, n0, 50)) AS f1 FROM z)
            SELECT page_id, 'r' || region AS source, 1 AS depth FROM k, q
            WHERE rn <= CASE region WHEN 0 THEN f0 + least(n0 - f0, 50 - f0 - f1) ELSE f1 END""",
    }
    for name, q in BOOLEAN_SQL.items():
        out[name] = out[f"{name}_sets"] = f"{WITH_TOKENS} {q}"
    return out


__all__ = ["oracle_sql", "queries", "search_top5"]
