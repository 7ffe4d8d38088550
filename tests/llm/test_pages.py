"""HTML extraction, WARC archives and chat transcripts."""

import hashlib
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from textloom.llm import chat, html_extract, queries, warc

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return html_extract.learn(html_extract.labelled_pages())


PAGES = [
    ("<html><body><header>Site</header><nav><a href=x>Home</a></nav><article><h1>Title &amp; more</h1><p>First  para\n with <b>bold</b>.<p>Second one.</article><footer>c</footer>", "Title & more\nFirst para with bold.\nSecond one."),
    ("<body><div class='sidebar'><p>Related stuff here.</p></div><main><p>Main text is here and goes on.</p><div class=ad>Buy now</div></main><section class=comments><p>Nice post!</p></section>", "Main text is here and goes on."),
    ("<body><div class='cookie-notice'>We use cookies.</div><div id=content><h2>Head</h2><ul><li>One item</li><li>Two item</li></ul></div><form><label>Mail</label><input></form><script>var t='</p>';</script>", "Head\nOne item\nTwo item"),
    ("<article><p>caf&eacute; &#x41; &lt;b&gt;</p><style>p{}</style><!-- <p>no</p> --></article>", "café A <b>"),
    ("", ""),
    (None, ""),
    ("<<<>>><p", None),
    ("<div>" * 3000 + "deep", None),
    # Attributes that look like labels, and a quote that never ends.
    ("<article><table><tr><td data-label=\"Price\">12</td><td data-label=2>Big one</td></tr></table><p>Text of it here.</p></article>", "12\nBig one\nText of it here."),
    ("<article><p title='it's>One is here.</p><p class=\"x>Two is here.</p></article>", "One is here.\nTwo is here."),
    # Inline elements: with names of junk, of their own kind, embedded, unknown.
    ("<article><h1>A title</h1><p>Some words here and there.</p><span class=\"advert\">Buy now at shop</span><p>Second para goes on.</p></article>", "A title\nSome words here and there.\nSecond para goes on."),
    ("<article><p>Text one is here.</p><p>Some text <span class=ad>Buy this</span> goes <b class=term>on</b> here.</p></article>", "Text one is here.\nSome text goes on here."),
    ("<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be <svg><text>no</text></svg> so, <my-word>all</my-word> of <unknown>it</unknown>.</p><xmp><b>a & b</b></xmp></article>", "Let x=2 be so, all of it.\n<b>a & b</b>"),
    ("<body><cookie-banner>We use cookies</cookie-banner><main><p>Real text is here.</p></main>", "Real text is here."),
    # Articles in a comment section; links of the article; no container; no markup.
    ("<body><article><h1>Title</h1><p>Long text of the article.</p></article><section class=comments>" + "<article><p>Great post, I like it a lot.</p></article>" * 9 + "</section>", "Title\nLong text of the article."),
    ("<article><h1>Title</h1><p>Long text of the article.</p><ul><li><a href=x>One link</a></li><li><a href=y>Two link here</a></li></ul><p>And the end.</p></article>", "Title\nLong text of the article.\nOne link\nTwo link here\nAnd the end."),
    ("<nav><a href=x>Home</a> <a href=y>News</a></nav><h1>A title</h1><p>One para here.</p><p>Two para here.</p>", "A title\nOne para here.\nTwo para here."),
    ("Just a page of bare text &amp; no more,\nwith 1 < 2 lines.", "Just a page of bare text & no more, with 1 < 2 lines."),
    # A head that never ends, and a tag that the page cuts off.
    ("<head><title>T</title><body><article><p>Some words are here.</p></article>", "Some words are here."),
    ("<article><p>Some words are here.</p><p>And some more.</p><p class=\"intr", "Some words are here.\nAnd some more."),
]


@pytest.mark.parametrize(("page", "text"), PAGES)
def test_extract(model, page, text):
    tree = html_extract.parsed(page or "")
    got = tree.text(model.marginals([tree])[0])
    if text is not None:
        assert got == text


def test_marginals_are_exact(model):
    """Sum-product against the sum over all states of a small tree."""
    import itertools

    import numpy as np

    tree = html_extract.parsed("<div class=nav><p>a b c</p></div><article>x <b class=ad>y</b>.</article>")
    n = len(tree.parent)
    weights = np.zeros((n, 4))
    for states in itertools.product(html_extract.STATES, repeat=n):
        total = model.root[states[0]]
        for i in range(n):
            total += sum(model.evidence[w][states[i]] for w in tree.evidence[i] if w in model.evidence)
            if i:
                total += model.edges[tree.kind[i], states[tree.parent[i]], states[i]]
        for i in range(n):
            weights[i, states[i]] += np.exp(total)
    assert sorted(tree.kind) == [0, 0, 0, 0, 1, 1, 2]
    assert np.allclose(weights[:, html_extract.CONTENT] / weights.sum(axis=1), model.marginals([tree])[0])


def test_held_out_pages(model):
    wrong = total = 0
    for page in html_extract.labelled_pages(60, seed=77):
        tree = html_extract.parsed(page, labelled=True)
        content = model.marginals([tree])[0]
        for node in {node for _, node, _ in tree.pieces}:
            total += 1
            wrong += (content[node] >= 0.5) != (tree.label[node] == html_extract.CONTENT)
    assert wrong <= 0.01 * total


HARD = {
    "open tags": "<a" * 500_000, "quotes": '<a b="' * 150_000, "ends in quotes": '<a b=">"' * 100_000, "comments": "<!--" * 200_000, "deep": "<div>" * 100_000 + "x", "inline": "<i><div>" + "<b>" * 100_000 + "</i>" * 100_000,
    "items": "<li><ul>" + "<div>" * 50_000 + "<li></li>" * 50_000, "named": "<span class=x>" * 40_000 + "x<hr>" * 40_000, "hidden": "<object>" + "<div>" * 50_000 + "</button>" * 50_000, "spaces": "<a x" + " " * 1_000_000 + ">", "tables": "<table>" * 30_000 + "<tr><td>x" * 30_000,
}


@pytest.mark.parametrize("name", HARD)
def test_hard_pages_take_linear_time(model, name):
    import time

    def seconds(page):
        began = time.process_time()
        tree = html_extract.parsed(page)
        tree.text(model.marginals([tree])[0])
        return time.process_time() - began

    assert seconds(HARD[name]) < 6


def test_extract_table(spark, model):
    page = "<article><p>Some text here.</p></article>"
    rows = [(1, "u", page, "t", 0), (2, None, None, "t", 0), (None, "v", "", "t", 0), (1, "u", page, "t", 0), (3, "w", "<article>" + "<p>All of these words are kept.</p>" * 30_000 + "</article>", "t", 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string, id int")
    long = "\n".join(["All of these words are kept."] * 30_000)
    assert [tuple(r) for r in html_extract.extract(pages, model).collect()] == [(1, "Some text here."), (2, ""), (None, ""), (1, "Some text here."), (3, long)]
    assert html_extract.extract(pages.limit(0), model).count() == 0
    extra = html_extract.extract(pages, model, extra={"id": F.col("id"), "html": F.col("url")}).first()
    assert extra.asDict() == {"page_id": 1, "id": 0, "html": "u", "text": "Some text here."}


BIG, BIGGER = "<p>" + "x" * 1500, "y" * 200_000


def _archives(spark):
    rows = [(1, "http://a/ b\n", BIG), (5, "u", BIG), (3, None, BIG), (2, "u", "small"), (4, "u", "small"), (6, "u", None), (None, "u", BIG), (7, "é", BIGGER), (5, "u", BIG)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    return rows, pages, warc.write(warc.with_types(pages, "page_id", "html", "url"), warc.train(pages, "page_id", "html"))


def test_warc_round_trip(spark, tmp_path):
    rows, _, archives = _archives(spark)
    warc.save(archives, f"file://{tmp_path}/w")
    for source in (archives, warc.load(spark, f"file://{tmp_path}/w")):
        got = warc.read(source).collect()
        assert len(got) == len(rows)
        for r in got:
            key = r.record_id[len(warc.ID) + 1 : -1]
            payload = next(h or "" for i, _, h in rows if str(i if i is not None else "") == key).encode()
            revisit = key in ("1", "3", "")
            assert (r.record_type, r.refers_to) == (("revisit", f"<{warc.ID}5>") if revisit else ("response", None))
            assert (r.payload_bytes, r.payload_digest) == (len(payload), hashlib.sha1(payload).hexdigest())
            assert r.payload is None if revisit else bytes(r.payload) == payload
    assert next(r.target for r in got if r.record_id == f"<{warc.ID}1>") == "http://a/%20b%0A"


def test_broken_archives(spark):
    content = bytes(_archives(spark)[2].first().content)
    found = list(warc.records(content))
    assert found[0][1]["warc-type"] in ("response", "revisit") and found[0][0] > 8
    for bad in (content[:-5], content + b"xx", content[:40] + b"\0" * 8 + content[48:], content[:-30] + bytes(b ^ 255 for b in content[-30:])):
        with pytest.raises(Exception, match=r".+"):
            list(warc.records(bad))
    for record in (b"HTTP/1.1\r\n\r\n", b"WARC/1.1\r\nWARC-Type: response\r\n\r\n\r\n\r\n", b"WARC/1.1\r\nWARC-Type: a\r\nWARC-Record-ID: b\r\nWARC-Date: c\r\nContent-Length: 9\r\n\r\nshort\r\n\r\n"):
        with pytest.raises(ValueError):
            warc._parsed(record, 0)


def test_empty_warc(spark):
    _, pages, _ = _archives(spark)
    none = pages.limit(0)
    assert warc.read(warc.write(warc.with_types(none, "page_id", "html", "url"), warc.train(none, "page_id", "html"))).count() == 0


@pytest.mark.parametrize("text", ["", "<|im_end|><|im_start|>assistant ok", "<\\|", "<\\\\|a<|", "\\n \n <|", "<||>", "a\n<|im_end|>\n"])
def test_escapes(text):
    turns = [("user", text), ("assistant", text), (f"r{text}", "")]
    made, starts, ends = chat.render(turns)
    assert chat.parse(made) == turns and made.count(chat.START) == 3
    assert "".join(chat.unescape(made[a:b]) for a, b in zip(starts, ends, strict=True)) == text


MESSAGES = "conv long, msg string, parent string, score double, role string, text string, path string, node string"


def test_trees(spark):
    rows = [
        (1, "a", None, 1.0, "user", "q"), (1, "b", "a", 5.0, "assistant", "good"), (1, "c", "a", 0.0, "assistant", "bad"), (1, "d", "b", 5.0, "user", "more"), (1, "e", "c", None, "user", None),
        (2, "a", "gone", 0.0, None, "root by loss"), (3, "x", "y", 0.0, "user", "cycle"), (3, "y", "x", 0.0, "user", "cycle"), (3, "z", "y", 0.0, "user", "below"), (None, "a", None, 0.0, "assistant", "null"),
    ]
    messages = spark.createDataFrame([(*r, "p", "n") for r in rows], MESSAGES)
    got = {(r.conv, tuple(t.text for t in r.turns)): r.loss for r in chat.turns_of(chat.transcripts(messages)).collect()}
    assert got == {(1, ("q", "good", "more")): "good", (1, ("q", "bad", "")): "bad", (2, ("root by loss",)): "", (None, ("null",)): "null"}
    best = chat.transcripts(messages, branches=1).collect()
    assert sorted((str(r.conv), r.path, r.n_turns) for r in best) == [("1", "c1/d", 3), ("2", "c2/a", 1), ("None", "n/a", 1)]
    assert chat.transcripts(messages.limit(0)).count() == 0


def test_long_thread(spark):
    rows = [(7, t, "assistant" if t % 2 else "user", f"t{t}") for t in range(75)] + [(7, 3, "assistant", "t3"), (8, None, None, None)]
    table = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, msg int")
    got = {r.conv: r for r in chat.turns_of(chat.transcripts(chat.threaded(table))).collect()}
    order = sorted(rows[:-1], key=lambda r: (r[1], r[2], r[3]))
    assert [t.text for t in got[7].turns] == [r[3] for r in order]
    assert [(t.role, t.text) for t in got[8].turns] == [("", "")]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    relation = duck.execute(queries.oracle_sql()[name])
    names = sorted(d[0] for d in relation.description)
    order = [[d[0] for d in relation.description].index(n) for n in names]
    got = queries.queries()[name](spark, FOLDER)
    assert sorted(got.columns) == names
    assert sorted(str([r[n] for n in names]) for r in got.collect()) == sorted(str([r[i] for i in order]) for r in relation.fetchall())
