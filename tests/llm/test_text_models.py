"""Language ID, quality rules, toxicity, language model and SentencePiece on small tables."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from textloom.llm import language_id, lm, quality, spm, toxicity

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SCHEMA = "doc_id long, text string, lang string, score string, id int, kept string, ids string"


def _docs(spark, rows):
    """A table whose other columns have the names of results."""
    return spark.createDataFrame([(i, t, l, "x", 1, "y", "z") for i, t, l in rows], SCHEMA)


def _sentence(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def spoken():
    rng = random.Random(3)
    return {"en": ["the", "thing", "with", "other", "than"], "fr": ["eaux", "que", "été", "où", "le"]}, rng


def test_language_id(spark, spoken):
    words, rng = spoken
    rows = [(i, _sentence(rng, words[l], 30), l) for i, l in enumerate(["en", "fr"] * 10)]
    profiles = language_id.learn(_docs(spark, rows + [(None, None, "en"), (90, "abc", None)]))
    assert profiles.names == ["en", "fr"]
    tests = [(1, "the other thing", None), (2, "QUE ÉTÉ EAUX", None), (3, None, None), (4, "", None), (5, "123 !!", None), (None, "the thing with", None), (1, "the other thing", None), (7, "the " * 30_000, None)]
    got = [(r.doc_id, r.lang_pred, r.score) for r in language_id.predict(_docs(spark, tests), profiles).collect()]
    assert [(i, l) for i, l, _ in got] == [(1, "en"), (2, "fr"), (3, "und"), (4, "und"), (5, "und"), (None, "en"), (1, "en"), (7, "en")]
    assert all(0 <= s <= 1 for _, _, s in got) and got[2][2] == 0 and got[0] == got[6]
    kept = language_id.in_learned_language(_docs(spark, tests), language_id.calibrated(profiles, _docs(spark, rows)))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert [r.doc_id for r in kept.collect()] == [1, 2, None, 1, 7]
    empty = _docs(spark, [])
    nothing = language_id.learn(empty)
    assert nothing.names == [] and language_id.predict(empty, profiles).count() == 0
    assert language_id.in_learned_language(_docs(spark, tests), language_id.calibrated(nothing, empty)).count() == 0


def _bundle(text):
    """The bundled vector of a text, one n-gram and one number at a time."""
    codes = [ord(c) if c.isalpha() else 0 for c in f" {text.lower()} "]
    vectors = {c: [int(x) for x in language_id.letter_vectors(np.array([c]))[0]] for c in set(codes)}
    n = language_id.DIMENSIONS
    out = [0] * n
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b:
            for i in range(n):
                out[i] += vectors[a][(i - 2) % n] * vectors[b][(i - 1) % n] * vectors[c][i]
    return out


def test_language_id_is_bind_bundle_and_cosine(spark, spoken):
    words, _ = spoken
    rng = random.Random(12)
    rows = [(i, _sentence(rng, words[l], 4), l) for i, l in enumerate(["en", "fr"] * 3)]
    profiles = language_id.learn(_docs(spark, rows))
    sums = {}
    for _, text, lang in rows:
        sums[lang] = [x + y for x, y in zip(sums.get(lang, [0] * language_id.DIMENSIONS), _bundle(text), strict=True)]
    length = lambda v: math.sqrt(sum(x * x for x in v))
    for text in ["the thing", "été, OÙ?", "other eaux", "q"]:
        own = _bundle(text)
        cosines = {l: sum(x * y for x, y in zip(own, v, strict=True)) / length(own) / length(v) for l, v in sums.items()}
        (name,), (score,) = profiles.predict([text])
        assert name == max(sorted(cosines), key=cosines.get) and math.isclose(score, max(0, max(cosines.values())), abs_tol=1e-5)


def test_unlearned_languages_go(spark, spoken):
    """Scripts and letters that no prototype has, of any length."""
    words, rng = spoken
    rows = [(i, _sentence(rng, words[l], 60), l) for i, l in enumerate(["en", "fr"] * 40)]
    docs = _docs(spark, rows)
    profiles = language_id.calibrated(language_id.learn(docs), docs)
    foreign = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("бвгджзклмн ", "漢字日本語文書") for n in (20, 200, 2000) for _ in range(20)]
    kept = language_id.in_learned_language(_docs(spark, [(i, t, None) for i, t in enumerate(foreign)] + rows), profiles).collect()
    assert sum(r.lang is None for r in kept) <= 2 and sum(r.lang is not None for r in kept) == len(rows)


def test_all_languages_are_learned(spark):
    rng = random.Random(14)
    names = [f"l{i:03}" for i in range(600)]
    own = {n: ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzàéüßñ", k=6)) for _ in range(3)] for n in names}
    profiles = language_id.learn(_docs(spark, [(i, " ".join(own[n]), n) for i, n in enumerate(names)]))
    assert profiles.names == names
    said, _ = profiles.predict([" ".join(own[n]) for n in names])
    assert said == names


def test_models_learn_from_all_rows(spark, monkeypatch):
    """More rows than any bound that models once had: prototypes, trees and thresholds take each of them."""
    rng = random.Random(15)
    texts = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(6000)]
    profiles = language_id.learn(_docs(spark, [(i, t, "en") for i, t in enumerate(texts)]))
    whole = sum(language_id.bundles(texts[at : at + 500]).sum(axis=0, dtype=np.float64) for at in range(0, len(texts), 500))
    assert np.allclose(profiles.vectors[0], whole / np.sqrt((whole**2).sum()), atol=1e-12)

    seen, grow, judge = [], quality.Forest.grow, quality.Forest.with_thresholds
    monkeypatch.setattr(quality.Forest, "grow", staticmethod(lambda rows: seen.append(len(rows)) or grow(rows)))
    monkeypatch.setattr(quality.Forest, "with_thresholds", lambda self, good, bad: seen.extend([len(good), len(bad)]) or judge(self, good, bad))
    docs = spark.range(24_000).selectExpr("id as doc_id", "concat_ws(' ', transform(sequence(1, 55), i -> concat('w', hash(id, i), if(id % 10 = 0, '$$$', '')))) as text")
    forest = quality.learn(docs, spark.range(24_000).selectExpr("id as doc_id", "cast(id % 10 > 0 as int) as quality"))
    assert seen == [24_000, 21_600, 2400]
    assert quality.good_rows(docs, forest).selectExpr("count(*)", "count_if(doc_id % 10 = 0)").first()[:] == (21_600, 0)


def test_samples_are_bounded(spark):
    """Null and repeated ids and a value with nearly all rows."""
    from textloom.llm.common import bounded_sample

    rows = spark.range(20_000).selectExpr("cast(null as long) as id", "'x' as text", "if(id % 100 = 0, 'b', 'a') as by")
    assert 200 < bounded_sample(rows, 500).count() < 900
    got = {r.by: r["count"] for r in bounded_sample(rows, 500, by="by").groupBy("by").count().collect()}
    assert 200 < got["a"] < 900 and got["b"] == 200
    assert bounded_sample(rows.limit(0), 5).count() == bounded_sample(rows.limit(0), 5, by="by").count() == 0


def test_bundles_do_not_depend_on_their_batch():
    texts = ["the thing", "été où", "日本語 текст " * 50, "", "x"]
    together = language_id.bundles(texts)
    assert all((language_id.bundles([t])[0] == row).all() for t, row in zip(texts, together, strict=True))


def _base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        again += line in seen and bool(re.search(r"[^\x20\x09-\x0D]", line))
        seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return [len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered)]


TRICKY = [None, "", " ", "a", "a b c a b c", "x\ny\nx\n\n\n \n \nx", "é è ü 日本", "#*$%&|<> |", "a a a a a", "w " * 70_000, "l1\r\nl1\r\nl1", "\n".join(["one two three"] * 5)]


def test_quality_statistics():
    base, _ = quality.statistics(pa.array(TRICKY, pa.string()))
    assert [[int(base[b][i]) for b in quality.BASE] for i in range(len(TRICKY))] == [_base(t) for t in TRICKY]


def test_quality_rules(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, _sentence(rng, words, 80) if i % 4 else _sentence(rng, ["a***", "b%%%", "c&&&", *(f"{w}$$$" for w in words)], 80), None) for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(60)] + [(None, 1), (5, None)], "doc_id long, quality int")
    docs = _docs(spark, rows + [(200, None, None), (201, "few words", None)])
    forest = quality.learn(docs, labels)
    got = {r.doc_id: r.kept for r in quality.score(docs, forest).collect()}
    assert got == {i: i % 4 > 0 for i in range(120)} | {200: False, 201: False}
    assert {r.doc_id for r in quality.good_rows(docs, forest).collect()} == {i for i, k in got.items() if k}
    unlabelled = quality.learn(docs, labels.limit(0))
    assert {r.doc_id for r in quality.good_rows(docs, unlabelled).collect()} == set(range(120))
    assert quality.score(_docs(spark, []), forest).count() == 0


def test_quality_path_lengths():
    """Each tree holds all rows here: leaves by a plain walk, and the anomaly that their depths and sizes give."""
    rng = np.random.default_rng(4)
    rows = np.round(rng.random((60, 3)) ** 3, 2)
    forest = quality.Forest.grow(rows, trees=5, joint=6)

    def mean_path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def leaf(root, row):
        at, level = root, 0
        while forest.inner[at]:
            at, level = forest.child[at] + (1 if row[forest.rule[at]] > forest.split[at] else 0), level + 1
        return int(at), level

    got = forest.anomaly(rows)
    assert [len(r) for r in forest.roots] == [6, 5, 5, 5]
    for group, roots in enumerate(forest.roots):
        lengths = np.zeros(len(rows))
        for root in roots.tolist():
            found = [leaf(root, row) for row in rows]
            sizes = Counter(at for at, _ in found)
            assert all(group == 0 or forest.rule[i] == group - 1 for i in range(root, max(sizes)) if forest.inner[i])
            lengths += [level + mean_path(sizes[at]) for at, level in found]
        assert np.allclose(got[:, group], 2 ** (-lengths / len(roots) / mean_path(60)))
    assert len({int(forest.rule[i]) for r in forest.roots[0] for i in [r] if forest.inner[i]}) > 1


def test_quality_forest_grows_on_the_natural_share(spark, monkeypatch):
    grown, grow = [], quality.Forest.grow
    monkeypatch.setattr(quality.Forest, "grow", staticmethod(lambda rows: grown.append(rows) or grow(rows)))
    rng = random.Random(5)
    words = [f"w{i}" for i in range(500)]
    rows = [(i, _sentence(rng, words if i % 10 else [f"{w}$$$" for w in words], 80), None) for i in range(1000)]
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(1000)], "doc_id long, quality int")
    forest = quality.learn(_docs(spark, rows), labels, rows=200)
    (own,) = grown
    bad = (own[:, 0] > 0).mean()
    assert 100 < len(own) < 300 and 0.02 < bad < 0.25
    assert {r.doc_id for r in quality.good_rows(_docs(spark, rows), forest).collect()} == {i for i in range(1000) if i % 10}


def test_toxicity(spark):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in "ban dor lim sur tek".split() for b in "a en os il".split()]
    rows = [(i, _sentence(rng, words, 40) + (" vrakhul " if i % 4 == 0 else " ") + _sentence(rng, words, 40), None) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None), (0, 0)], "doc_id long, toxic int")
    docs = _docs(spark, rows + [(300, None, None), (301, "", None), (302, "VRAKHUL", None)])
    classifier = toxicity.learn(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, classifier).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(150, 200)) and got[300] == got[301] < 0.5
    one_kind = toxicity.learn(docs, labels.where("toxic = 0"))
    assert {round(r.score, 9) for r in toxicity.score(docs, one_kind).collect()} == {round(1 / 152, 9)} or one_kind.intercept < 0
    assert toxicity.score(_docs(spark, []), classifier).count() == 0


def _buckets(text):
    """The buckets of a text's n-grams, one at a time."""
    codes = [ord(c) if c.isalnum() else 32 for c in f" {text.lower()} "]
    found, m = set(), (1 << 32) - 1
    for start in range(len(codes)):
        h = 0
        for k, c in enumerate(codes[start : start + max(toxicity.SIZES)]):
            h = (h ^ (c + k)) * 0x9E3779B1 & m
            h ^= h >> 15
            if k + 1 in toxicity.SIZES:
                found.add((h * 0x85EBCA6B & m) >> (32 - toxicity.BUCKET_BITS))
    return found


def test_toxicity_counts_and_scores_as_a_plain_loop(spark):
    rng = random.Random(6)
    words = "ban dor lim sur tek vrak été".split()
    rows = [(i, _sentence(rng, words[: 5 + 2 * (i % 3 == 0)], 12), None) for i in range(90)] + [(90, "", None), (91, "x", None)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(92)], "doc_id long, toxic int")
    own = [(t, int(i % 3 == 0)) for i, t, _ in rows]
    counted = toxicity._counted(spark.createDataFrame(own, "text string, label int").coalesce(1)).collect()
    for label, name in ((1, "toxic"), (0, "other")):
        expected = Counter(b for t, l in own if l == label for b in _buckets(t))
        got = np.concatenate([np.frombuffer(r[name], np.int32) for r in sorted(counted, key=lambda r: r.block)])
        assert {int(b): int(got[b]) for b in np.flatnonzero(got)} == expected
    classifier = toxicity.learn(_docs(spark, rows), labels)
    # The features tell the classes apart by the ratio of their smoothed rates.
    n = Counter(l for _, l in own)
    seen = [Counter(b for t, l in own if l == label for b in _buckets(t)) for label in (0, 1)]
    assert all(seen[0][b] + seen[1][b] >= toxicity.LEAST_TEXTS for b in np.flatnonzero(classifier.feature >= 0).tolist())
    for r in toxicity.score(_docs(spark, rows), classifier).collect():
        total = classifier.intercept + sum(classifier.weight[f] for b in _buckets(rows[r.doc_id][1]) if (f := classifier.feature[b]) >= 0)
        assert math.isclose(r.score, 1 / (1 + math.exp(-total)), rel_tol=1e-4, abs_tol=1e-6) and sum(n.values()) == 92


def test_lm(spark):
    texts = [(1, "the cat sat The"), (2, "the dog"), (3, None), (4, "cat unseen"), (None, "the"), (1, "the cat sat The")]
    docs = _docs(spark, [(i, t, None) for i, t in texts])
    train = docs.where("doc_id < 3")
    model, counts = lm.learn(train)
    c = Counter(w for i, t in texts if i and i < 3 for w in (t or "").lower().split())
    c["<end>"] = 3
    n, v = sum(c.values()), len(c)
    rows = lm.score(docs, model, counts).orderBy("doc_id", "n_tokens").collect()
    for r, (_, t) in zip(rows, sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        words = [*(t or "").lower().split(), "<end>"]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(c[w] > 0 for w in words), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words), rel_tol=1e-9)
        assert r.score < 0
    assert lm.score(_docs(spark, []), model, counts).count() == 0
    # The outcomes' probabilities after any history sum to one.
    every = np.arange(lm.CLASSES * lm.WIDTH)
    history = np.array([0, 1])
    total = sum(np.exp(lm.log_probabilities(model, np.append(history, o), np.arange(3))[-1]) for o in every[:: lm.WIDTH // 4].tolist())
    whole = np.exp([lm.log_probabilities(model, np.append(history, o), np.arange(3))[-1] for o in every.tolist()]).sum()
    assert total <= 1 and math.isclose(whole, 1, rel_tol=1e-3)


def _mixed(x):
    """The 64-bit mixing function in whole numbers."""
    m = (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ x >> 27) * 0x94D049BB133111EB & m
    return x ^ x >> 31


def _log10_score(model, counts, text):
    """The model's score of a text, one token at a time."""
    words = [w.encode() for w in text.lower().split()]
    groups = lm.CLASSES * lm.WIDTH
    total, history = 0.0, [lm.START, lm.START]
    for word in [*words, None]:
        outcome = model.end if word is None else model.dictionary.get(word, model.end + 1)
        last, skipped = history[-1], history[-2]
        group = outcome // model.width
        hashed = lambda kind, a, b=0: _mixed((_mixed(a + (kind << 40)) + b) % (1 << 64))
        levels = [
            (1, 0, [hashed(1, last), hashed(2, last, skipped), hashed(3, skipped)], group // lm.WIDTH),
            (lm.CLASSES, group // lm.WIDTH, [hashed(4, last, group // lm.WIDTH)], group % lm.WIDTH),
            (groups, group, [hashed(5, last, group)], outcome % model.width),
        ]
        for table, (free, bias, features, target) in zip(model.tables, levels, strict=True):
            logits = [float(x) for x in table[bias]]
            for h in features:
                logits = [x + float(y) for x, y in zip(logits, table[free + h % (len(table) - free)], strict=True)]
            total += (logits[target] - math.log(sum(math.exp(x) for x in logits))) / math.log(10)
        if word is not None and word not in model.dictionary:
            total += math.log10((counts.get(word, 0) + 1) / model.rare)
        history.append(zlib.crc32(word) if word is not None else 0)
    return total


def test_lm_scores_as_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 40)
    rng = random.Random(8)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(i, _sentence(rng, words, rng.randint(0, 40)), None) for i in range(200)]
    docs = _docs(spark, rows)
    model, counts = lm.learn(docs.where("doc_id < 150"))
    assert len(model.dictionary) == 40 and any(np.abs(t[lm._free(k) :]).max() > 0 for k, t in enumerate(model.tables))
    counted = {bytes(r.word): r.n for r in counts.collect()}
    for r in lm.score(docs, model, counts).collect():
        assert math.isclose(r.score, _log10_score(model, counted, rows[r.doc_id][1]), rel_tol=1e-4), r


def test_lm_sums_as_a_plain_loop():
    rng = np.random.default_rng(3)
    for n, hot in ((1, 1), (5, 2), (3000, 40), (3000, 2900)):
        to, values, sums = rng.integers(0, hot, n), rng.random((n, 4), dtype=np.float32), np.zeros((3000, 4), np.float32)
        expected = np.zeros((3000, 4))
        for t, v in zip(to.tolist(), values.tolist(), strict=True):
            expected[t] += v
        lm._add_rows(sums, to, values)
        assert np.allclose(sums, expected, rtol=1e-4)


def test_lm_first_gradient_is_the_gradient(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 3} c{i % 5} a d{i}") for i in range(40)], "doc_id long, text string")
    model, _ = lm.learn(docs.where("doc_id < 0"))
    trained, _ = lm.learn(docs)
    for table, own in zip(model.tables, trained.tables, strict=True):
        assert table.shape == own.shape
    bare = [np.where(np.arange(len(t))[:, None] < lm._free(k), t, 0).astype(np.float32) for k, t in enumerate(trained.tables)]
    bare = lm.Model(**(vars(trained) | {"tables": bare}))
    texts = pa.array([r.text for r in docs.collect()]).cast(pa.binary())
    numbers, lengths, words = lm._numbered(bare, texts)
    found = lm._outcomes(bare, [w for own in words for w in own], numbers, lengths)
    whole, first = ([np.zeros(t.shape, np.float32) for t in bare.tables for _ in range(2)] for _ in range(2))
    met = [np.zeros((len(bare.tables[k]), lm._free(k)), np.float32) for k in range(2)]
    lm._gradient(bare, *found, whole)
    lm._first_gradient(bare, *found, first, met)
    lm._expected(bare, first, met)
    assert all(np.allclose(a, b, rtol=1e-3, atol=1e-3) for a, b in zip(whole, first, strict=True))


@pytest.mark.parametrize(("limit", "expected"), [(3, 3), (6, 6), (9, 9), (100, 16)])
def test_lm_dictionary_takes_words_in_order_of_their_counts(spark, monkeypatch, limit, expected):
    monkeypatch.setattr(lm, "DICTIONARY", limit)
    # One word of 9, six of 5, nine of 1: the limit falls among equals.
    counts = spark.createDataFrame([(bytearray(f"w{i}".encode()), 9 if i == 0 else 5 if i < 7 else 1) for i in range(16)], "word binary, n long")
    found = lm._frequent(counts)
    assert len(found) == expected
    assert [n for _, n in found] == sorted([9, *[5] * 6, *[1] * 9], reverse=True)[:limit]


def test_lm_clashing_names(spark):
    names = "row known base model outside rare times add seen n_tokens word score".split()
    docs = spark.createDataFrame([(1, "a b a", *range(12)), (2, None, *range(12))], f"doc_id long, text string, {', '.join(f'`{n}` int' for n in names)}")
    model, counts = lm.learn(docs)
    got = lm.score(docs, model, counts, extra={n: F.col(n) for n in names[:9]}).orderBy("doc_id").collect()
    assert [(r.doc_id, r.row, r.known, r.seen, r.n_tokens, r.n_known) for r in got] == [(1, 0, 1, 8, 4, 4), (2, 0, 1, 8, 1, 1)]


def test_lm_beyond_the_dictionary(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 2)
    docs = spark.createDataFrame([(1, "a a a b b c c d"), (2, "c d d e")], "doc_id long, text string")
    model, counts = lm.learn(docs.where("doc_id = 1"))
    c = Counter("a a a b b c c d".split()) + Counter({"<end>": 1})
    for r in lm.score(docs, model, counts).collect():
        words = [*("a a a b b c c d" if r.doc_id == 1 else "c d d e").split(), "<end>"]
        assert r.n_known == sum(c[w] > 0 for w in words)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (9 + 5 + 1)) for w in words), rel_tol=1e-9)


def test_lm_learns_from_every_text(spark, monkeypatch):
    seen, summed = Counter(), lm._summed
    monkeypatch.setattr(lm, "_summed", lambda texts, *rest, **named: seen.update(r.text for r in texts.collect()) or summed(texts, *rest, **named))
    docs = spark.createDataFrame([(i, f"w{i} x") for i in range(5000)], "doc_id long, text string")
    lm.learn(docs)
    assert seen == Counter(f"w{i} x" for i in range(5000))


def test_lm_tells_rare_words_apart(spark, monkeypatch):
    monkeypatch.setattr(lm, "DICTIONARY", 2)
    docs = spark.createDataFrame([(i, "x y r1 x" if i % 2 else "y x r2 y") for i in range(100)], "doc_id long, text string")
    model, counts = lm.learn(docs)
    tests = spark.createDataFrame([(1, "r1 x"), (2, "r1 y"), (3, "r2 x"), (4, "r2 y")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in lm.score(tests, model, counts).collect()}
    assert got[1] > got[2] + 0.1 and got[4] > got[3] + 0.1


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer")
def test_spm(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(4)
    texts = ["", " ", " " * 70, "a" + " " * 37 + "b", "\n\n a", "x\t\ty", "▁▁ a▁b", "日本語 😀 é", "\x00a", "<s> </s>", "a" * 300, "ab" * 100 + "c", "Hello world. " * 3000]
    texts += ["".join(rng.choice("aabcdeehiinorstt  ▁\n=-/.é") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    with open(MODEL, "rb") as f:
        model = f.read()
    docs = _docs(spark, [(i, t, None) for i, t in enumerate(texts)] + [(None, None, None)])
    got = {r.doc_id: (list(r.ids), r.decoded) for r in spm.transcode(docs, model).collect()}
    assert got.pop(None) == ([], "")
    for i, t in enumerate(texts):
        ids = library.encode(t)
        assert got[i] == (ids, library.decode(ids)), repr(t[:80])
    bpe = spm.BpeModel(model)
    for _ in range(300):
        ids = [rng.choice([rng.randrange(0, 259), rng.randrange(32000)]) for _ in range(rng.randint(0, 12))]
        assert bpe.decode(ids) == library.decode(ids)
    with pytest.raises(ValueError):
        bpe.decode([32000])
    assert spm.transcode(_docs(spark, []), model).count() == 0
