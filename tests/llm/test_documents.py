"""Near-duplicates, decontamination and the pipeline against brute force."""

import os
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textloom.llm import decontaminate, language_id, near_dedup, quality
from textloom.llm.common import dealt
from textloom.llm.components import components
from textloom.llm.queries import table

FOLDER = "/root/testdata/sf0.001"
ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _set(text, k):
    words = [w.translate(ASCII) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _groups(rows, k, percent):
    """Smallest id reachable, by comparing all pairs."""
    sets = [(i, _set(t, k)) for i, t in rows if i is not None]
    above = {i: i for i, _ in sets}

    def root(x):
        while above[x] != x:
            x = above[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and 100 * len(s & t) >= percent * len(s | t):
                x, y = root(i), root(j)
                above[max(x, y)] = min(x, y)
    return {i: root(i) for i in above}


def _corpus():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(2000)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(0, None), (1, ""), (2, "  \n"), (3, "one two"), (4, "ONE two"), (5, "one"), (None, "one two"), (6, "two one")]
    for i in range(7, 70):  # near copies of one text, some of them only linked through others
        own = list(base)
        for _ in range(rng.randint(0, 9)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, " ".join(own)))
    rows += [(i, " ".join(base)) for i in range(70, 80)] + [(70, " ".join(base))]
    for i in range(80, 110):  # texts that share a passage
        rows.append((i, " ".join(base[:40]) + " " + " ".join(rng.choice(words) for _ in range(60))))
    rows += [(200, "long " * 60_000), (201, " ".join(rng.choice(words) for _ in range(30_000)))]
    return rows


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, percent):
    rows = _corpus()
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, component_id int, key string")
    expected = _groups(rows, k, percent)
    got = near_dedup.groups(docs, k, percent).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.kept and r.component_id is None
        else:
            assert (r.component_id, r.kept) == (expected[r.doc_id], expected[r.doc_id] == r.doc_id), r
    sizes = {r.doc_id: r.n_shingles for r in got}
    assert all(sizes[i] == len(_set(t, k)) for i, t in rows)


def test_first_of_each(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "other"), (3, "other"), (None, "other"), (4, None)], "doc_id long, text string")
    left = near_dedup.first_of_each(docs)
    assert left.columns == ["doc_id", "text"]
    assert sorted((str(r.doc_id) for r in left.collect())) == ["1", "3", "4", "None"]
    assert near_dedup.first_of_each(docs.limit(0)).count() == 0


def test_rows_of_an_id_with_different_texts_stay(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "g h i j k l"), (1, "a b c d e f"), (2, "m n")], "doc_id long, text string")
    assert sorted(r.text for r in near_dedup.first_of_each(docs).collect()) == ["a b c d e f", "g h i j k l", "m n"]


def test_many_texts_of_one_template(spark):
    """20,000 texts that share most of their words but are not near enough."""
    import time

    rng = random.Random(11)
    frame = [f"t{i}" for i in range(40)]
    rows = []
    for i in range(20_000):
        own = list(frame)
        for k in range(0, 40, 10):
            own[k] = f"f{rng.randrange(60)}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    got = near_dedup.groups(docs, 3, 85).collect()
    assert time.monotonic() - began < 150 and len(got) == 20_000
    sample = rng.sample(got, 40)
    sets = {i: _set(t, 3) for i, t in rows}
    for r in sample:  # all links of a text
        near = [i for i, s in sets.items() if 100 * len(s & sets[r.doc_id]) >= 85 * len(s | sets[r.doc_id])]
        assert len({g.component_id for g in got if g.doc_id in near}) == 1


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2001 + i) for i in range(100)]
    expected = _groups([], 1, 1)
    above = {x: x for e in edges for x in e}
    for _ in above:
        changed = False
        for a, b in edges:
            low = min(above[a], above[b])
            changed |= above[a] != low or above[b] != low
            above[a] = above[b] = low
        if not changed:
            break
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert expected == {} and got == {x: above[x] for a, b in edges if a != b for x in (a, b)}


def _edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        at, kind = rng.randrange(len(out)), rng.randrange(3)
        if kind == 0:
            out[at] = f"new{rng.randrange(99)}"
        elif kind == 1:
            out.insert(at, "the")
        elif len(out) > 1:
            del out[at]
    return out


@pytest.mark.parametrize("block", [500_000, 60])
def test_leaks(spark, monkeypatch, block):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rng = random.Random(7)
    words = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 30
    items = [(i, [rng.choice(words) for _ in range(rng.randint(12, 50))]) for i in range(8)]
    benchmark = spark.createDataFrame([(i, " ".join(w).capitalize() + ".") for i, w in items] + [(90, None), (91, ""), (92, "!!")], "item_id long, text string")
    rows, expected = [(0, None), (1, ""), (2, "the of and " * 20_000)], set()
    for n in range(3, 63):
        filler = [rng.choice(words) for _ in range(rng.randint(0, 200))]
        if n % 2:
            item, own = items[n % len(items)]
            filler[len(filler) // 2 : len(filler) // 2] = _edited(rng, own, rng.randint(0, int(0.2 * len(own))))
            expected.add((n, item))
        rows.append((n, ", ".join(filler)))
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, edits string, at int")
    found = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, benchmark).collect()}
    assert found == expected
    kept = decontaminate.without_leaks(docs, benchmark)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in expected} and kept.columns == docs.columns
    assert decontaminate.leaks(docs.limit(0), benchmark).count() == 0 and decontaminate.leaks(docs, benchmark.limit(0)).count() == 0


def test_short_items_match_unedited():
    index = decontaminate.Index([1, 2], ["yes or no", "alpha beta gamma delta"])
    got = index.find(pa.array(["he said Yes, or no!", "yes and no", "alpha beta gamma", None]))
    assert [(doc, item, edits) for doc, item, edits, _ in got] == [(0, 0, 0)]


def test_words_of_any_script_and_punctuation():
    item = "Wie viele Äpfel hat der Baum im alten Garten hinter dem Haus des Bäckers"
    printed = [f"x “{item.replace(' ', chr(0xA0), 3)}”—y", item.replace(" der", "… der").replace(" im", " – im").upper(), "«" + item.replace(" ", "\u2003") + "»", item.replace("Äpfel", "Birnen")]
    index = decontaminate.Index([1], [item])
    assert [(doc, edits) for doc, _, edits, _ in index.find(pa.array(printed))] == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_the_exact_way(monkeypatch):
    """Items that the repetitions do not find at the recall are found all the same."""
    monkeypatch.setattr(decontaminate, "MOST_REPETITIONS", 4)
    rng = random.Random(13)
    items = [[f"w{rng.randrange(3000)}" for _ in range(400)] for _ in range(6)]
    index = decontaminate.Index(list(range(6)), [" ".join(i) for i in items])
    assert all(c.places is not None and not c.repetitions for c in index.classes)
    texts = [" ".join(["x"] * 30 + _edited(rng, items[i % 6], 80) + ["y"] * 30) for i in range(30)] + [" ".join(rng.choice(items)[:200]), "", None]
    assert {(doc, item) for doc, item, _, _ in index.find(pa.array(texts))} == {(i, i % 6) for i in range(30)}


def test_recall_of_fresh_copies():
    rng = random.Random(21)
    words = [f"w{i}" for i in range(400)]
    items = [[rng.choice(words) for _ in range(rng.randint(12, 60))] for _ in range(60)]
    index = decontaminate.Index(list(range(60)), [" ".join(i) for i in items])
    texts = [" ".join(["x"] * 5 + _edited(rng, items[i % 60], int(0.2 * len(items[i % 60]))) + ["y"] * 5) for i in range(600)]
    found = {(doc, item) for doc, item, _, _ in index.find(pa.array(texts))}
    assert sum((i, i % 60) in found for i in range(600)) >= 0.985 * 600


def test_equal_items(spark):
    item = "one two three four five six seven eight nine ten"
    benchmark = spark.createDataFrame([(i, item) for i in range(5)] + [(9, item.upper()), (9, None), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {item} y"), (1, f"x {item} y"), (None, item), (2, "x"), (3, None)], "doc_id long, text string")
    got = decontaminate.leaks(docs, benchmark)
    assert got.columns == ["doc_id", "item_id", "edits", "item_words", "at"]
    assert sorted(str((r.doc_id, r.item_id)) for r in got.collect()) == sorted(str((d, i)) for d in (1, 1, None) for i in (0, 1, 2, 3, 4, 9, None))


CLASHING = "id long, kept boolean, score double, label int, component long, c0 string, f0 int, item string, ids string"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1], ids=lambda s: s[0])
def test_stages_take_any_row(spark, stage):
    """Nulls in any column, empty and very long texts, repeated rows, an empty table, clashing columns."""
    docs = table(spark, FOLDER, "documents").limit(40).collect()
    benchmark = table(spark, FOLDER, "benchmark").where("text is not null").first().text
    own = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    long = " ".join(r.text or "" for r in docs) * 12
    own += [(None, own[0][1], None, None, None), (900, None, None, None, None), (901, "", "en", "", 0), (902, " \n\t", "en", "s", 3), (903, long, "en", "s", len(long)), own[3], own[3], (904, f"{own[4][1]} {benchmark}", "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = spark.createDataFrame([(*r, 1, True, 0.5, 0, 7, "c", 3, "i", None) for r in own], f"{schema}, {CLASHING}")
    kept = stage[1](spark, rows, FOLDER)
    assert kept.columns == rows.columns
    plain = stage[1](spark, spark.createDataFrame(own, schema), FOLDER)
    got = [tuple(r)[:5] for r in kept.collect()]
    assert sorted(map(str, got)) == sorted(str(tuple(r)) for r in plain.collect())
    assert set(map(str, got)) <= set(map(str, own)) and got
    there = {r[0] for r in got}
    expected = {"language_id": {903}, "quality_rules": set(), "near_duplicates": {900, 901, 902, 903}, "decontamination": {900, 901, 902}}
    gone = {"language_id": {900, 901, 902}, "quality_rules": {900, 901, 902}, "near_duplicates": set(), "decontamination": {904}}
    assert expected[stage[0]] <= there and not gone[stage[0]] & there
    if stage[0] == "near_duplicates":
        assert [r[0] for r in got].count(own[3][0]) == 1
    assert stage[1](spark, rows.limit(0), FOLDER).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_texts_of_one_row_group_meet_several_tasks(spark, tmp_path):
    """A file with one row group has splits without rows; its texts are dealt to all tasks, each row once."""
    table(spark, FOLDER, "documents").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    docs = table(spark, str(tmp_path), "documents")
    kept = corpus_pipeline.in_known_language(spark, docs, str(tmp_path))
    per_task = [r["count"] for r in kept.groupBy(F.spark_partition_id()).count().collect()]
    assert len(per_task) >= 4 and max(per_task) <= sum(per_task) / 2
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in corpus_pipeline.in_known_language(spark, docs.repartition(8), str(tmp_path)).collect())
    assert sorted(map(tuple, dealt(docs).collect())) == sorted(map(tuple, docs.collect()))
    even = docs.repartition(8)
    assert dealt(even) is even and dealt(docs.limit(0)).count() == 0


def test_encoding_takes_any_row(spark):
    rows = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "a b", 3), (1, "a b", 3), (2, "word " * 60_000, 4)], "doc_id long, text string, n_tokens int")
    got = corpus_pipeline.encoded(spark, rows, FOLDER).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.decoded[:5]) for r in got if r.doc_id != 2) == sorted([("None", 0, ""), ("1", 0, ""), ("1", 2, "a b"), ("1", 2, "a b")])
    assert corpus_pipeline.encoded(spark, rows.limit(0), FOLDER).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
def test_pipeline(spark):
    import sentencepiece

    docs = table(spark, FOLDER, "documents")
    labels, benchmark = table(spark, FOLDER, "labels"), table(spark, FOLDER, "benchmark").collect()
    profiles = language_id.calibrated(language_id.learn(docs), docs)
    least = dict(zip(profiles.names, profiles.least.tolist(), strict=True))
    said = {r.doc_id: r for r in language_id.predict(docs, profiles).collect()}
    good = {r.doc_id for r in quality.score(docs, quality.learn(docs, labels)).where("kept").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id in good and said[r.doc_id].score >= least.get(said[r.doc_id].lang_pred, 2)]
    first = {i for i, c in _groups(rows, near_dedup.SHINGLE_WORDS, near_dedup.PERCENT).items() if i == c}
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    wanted = [words(b.text) for b in benchmark]

    def distance(item, text):
        row = [0] * (len(text) + 1)
        for n, w in enumerate(item, 1):
            new = [n]
            for j, t in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
            row = new
        return min(row)

    def holds(text):
        own = words(text)
        there = set(own)
        return any(sum(w in there for w in item) >= len(item) - int(0.2 * len(item)) and distance(item, own) <= int(0.2 * len(item)) for item in wanted)

    left = {i: t for i, t in rows if i in first and not holds(t)}
    library = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    got = {r.doc_id: (r.n_tokens, list(r.ids), r.decoded) for r in corpus_pipeline.run(spark, FOLDER).collect()}
    assert set(got) == set(left)
    assert all(got[i] == (len(ids := library.encode(t)), ids, library.decode(ids)) for i, t in left.items())
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "language_id" and len(corpus_pipeline.STAGES) == 5
