"""A hashed maximum-entropy language model, and add-one unigram scores.

Tokens are the words of a text (runs of other characters than ASCII white space, A-Z lower-cased), then one
end. The model predicts a class first, then a group of words within it, then the outcome within the group,
each by a softmax over hashed features: a bias and the last word, for the class also the last two words, and the word
before the last (a skip). Features are hashed from the words themselves, in the dictionary or not. Outcomes are the
words of the dictionary, the end, and RARE, which stands for all other words; a rare word's probability is RARE's times
its add-one share among the rare words and one unseen word. So the model is a distribution over the same
vocabulary as the unigram score. Outcomes and hash rows grow with the distinct words, up to the sizes below.

Counts and weights cover all training texts. The weights start at the outcomes' frequencies and follow distributed
gradient updates, each over a shard of the texts that a hash of the id gives, all shards once: each task sums the
expected and the observed features over its texts, the sums are added by block, and the driver takes a step. The gradient
of a weight is observed less expected; its step is that over the logarithmic mean of both (which makes it
the logarithm of their ratio), over the features of a context. The first shard is the largest: as long as
there are but biases, expectations are products of counts and frequencies. Scoring adds sparse rows of the weights in
numpy, a batch of tokens at a time.

The most frequent words travel to the executors with their counts (a bounded dictionary); only words
beyond it are joined with the counts by a shuffle, each once for a text.

Defined results: null and empty texts are a lone end; without training texts all words are unseen and
the model is uniform over its outcomes; equal rows get equal results; only the named columns are read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import limit_batches, mix, slices, written

#: Classes, and groups of outcomes in each. A group takes as many outcomes as the dictionary needs.
CLASSES, WIDTH = 16, 128
#: Words whose counts travel to the executors; words that a task counts before it hands them on.
DICTIONARY, COUNTED_AT_ONCE = 1 << 17, 300_000
#: Hashed rows of each weight table: at least, at most, and distinct words for each row.
LEAST_ROWS, MOST_ROWS, WORDS_PER_ROW = 1 << 13, 1 << 15, 128
#: Shares of the texts in each round's shard; what is added to sums, and the most that a weight may be.
SHARDS, DAMPING, MOST = (0.8, 0.1, 0.1), 3.0, 8.0
#: Hashed features of a context of each table.
FEATURES = (3, 1, 1)
#: Tasks of a round at least, and words for each where there are more: a task sends sums of some 20 MB.
TASKS, TASK_WORDS = 6, 1 << 24
_TOKENS, _CONTEXTS, _BLOCK = 1 << 16, 1 << 12, 1 << 15

#: What stands before the first word; words have 32-bit keys.
START = 1 << 32


def tokens(text: bytes) -> list[bytes]:
    """The words of a text; bytes.split() and bytes.lower() know ASCII only."""
    return text.lower().split()


def count(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): how often each word occurs in all texts."""
    limit_batches(texts.sparkSession)

    def run(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for part in slices(batch, "text"):
                for text in part.column("text").cast(pa.binary()).to_pylist():
                    if text:
                        counts.update(tokens(text))
                if len(counts) > COUNTED_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])
                    counts = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()), pa.array(counts.values(), pa.int64())], ["word", "n"])

    parts = texts.select(F.col(text_col).alias("text")).mapInArrow(run, "word binary, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """dictionary: number of each frequent word, which is its outcome. keys, counts: of these words. rare: the sum of
    count plus one over all other words and one unseen word. tables: weights of class, of group within a class and
    of outcome within a group, by hashed feature."""

    dictionary: dict[bytes, int]
    keys: np.ndarray
    counts: np.ndarray
    end_count: int
    n: int
    v: int
    rare: float
    tables: list[np.ndarray]

    @property
    def width(self) -> int:
        """Outcomes of a group."""
        return self.tables[2].shape[1]

    @property
    def end(self) -> int:
        """The outcome of the end; the next one is RARE."""
        return CLASSES * WIDTH * self.width - 2

    def numbers(self, words: list[bytes]) -> np.ndarray:
        """The dictionary numbers of words, -1 for others."""
        return np.fromiter(map(self.dictionary.get, words, repeat(-1)), np.int64, len(words))


def _with_ends(values: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The values of all words of a batch, and end after each text."""
    is_end = np.zeros(len(values) + len(lengths), bool)
    is_end[np.cumsum(lengths + 1) - 1] = True
    out = np.full(len(is_end), end, values.dtype)
    out[~is_end] = values
    return out


def _outcomes(model: Model, words: list[bytes], numbers: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The outcomes of all texts of a batch, each with its end, the place of each outcome in its text, and the words' keys."""
    keys = np.zeros(len(numbers), np.uint64)
    inside = numbers >= 0
    keys[inside] = model.keys[numbers[inside]]
    beyond = np.flatnonzero(~inside)
    keys[beyond] = np.fromiter(map(zlib.crc32, map(words.__getitem__, beyond.tolist())), np.uint64, len(beyond))
    ends = np.cumsum(lengths + 1) - 1
    place = np.arange(len(numbers) + len(lengths)) - np.repeat(ends - lengths, lengths + 1)
    return _with_ends(np.where(inside, numbers, model.end + 1), lengths, model.end), place, _with_ends(keys, lengths, 0)


def _hash(kind: int, a: np.ndarray, b: np.ndarray | int = 0) -> np.ndarray:
    return mix(mix(a + np.uint64(kind << 40)) + np.asarray(b).astype(np.uint64))


def _features(model: Model, outcomes: np.ndarray, place: np.ndarray, keys: np.ndarray):
    """For each table, of a batch of tokens: its number, and the context of each token, the rows that it adds up (first
    its bias) and the target."""
    before = np.full((2, len(outcomes)), START, np.uint64)
    for k in (1, 2):
        before[k - 1, k:] = np.where(place[k:] >= k, keys[:-k], np.uint64(START))
    last, skipped = before
    group = outcomes // model.width
    both, of_class, of_group = _hash(2, last, skipped), _hash(4, last, group // WIDTH), _hash(5, last, group)
    hashed = [[_hash(1, last), both, _hash(3, skipped)], [of_class], [of_group]]
    biases, targets = [np.zeros(len(group), np.int64), group // WIDTH, group], [group // WIDTH, group % WIDTH, outcomes % model.width]
    for k, (context, bias, target) in enumerate(zip((both, of_class, of_group), biases, targets, strict=True)):
        free = _free(k)
        mask = np.uint64(len(model.tables[k]) - free - 1)  # there are a power of two
        yield k, context, [bias, *[free + (h & mask).astype(np.int64) for h in hashed[k]]], target


def _contexts(features):
    """For each table its number, the rows of each distinct context, how often it occurs, and the context and the target
    of each token."""
    for k, context, rows, target in features:
        first, of, times = _distinct(context)
        yield k, [r[first] for r in rows], times, of, target


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where one of each distinct value is, which of these each value is, and how often each occurs."""
    order = values.argsort()
    ordered = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(new)
    of = np.empty(len(values), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[starts], of, np.diff(starts, append=len(values))


def _free(table: int) -> int:
    """The biases of a table, its first rows."""
    return (1, CLASSES, CLASSES * WIDTH)[table]


def _logits(table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    out = table.take(rows[0], axis=0)
    for r in rows[1:]:
        out += table.take(r, axis=0)
    return out


class Normalisers:
    """The logarithms of the sums over outcomes of contexts that were met, as many as there is room for: a context
    has one place in each table's arrays, and a later one takes it over."""

    def __init__(self, places: int = 1 << 18):
        self.mask = np.uint64(places - 1)
        self.contexts = np.zeros((3, places), np.uint64)
        self.values = np.zeros((3, places), np.float32)

    def of(self, table: np.ndarray, k: int, context: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        at = (context & self.mask).astype(np.int64)
        out = self.values[k].take(at)
        missing = np.flatnonzero(self.contexts[k].take(at) != context)
        if len(missing):
            first, of, _ = _distinct(context[missing])
            first = missing[first]
            sums = np.empty(len(first), np.float32)
            for i in range(0, len(first), _CONTEXTS):  # what fits a processor's cache
                x = _logits(table, [r[first[i : i + _CONTEXTS]] for r in rows])
                sums[i : i + _CONTEXTS] = np.exp(x, out=x).sum(axis=1)
            np.log(sums, out=sums)
            out[missing] = sums[of]
            self.contexts[k, at[first]] = context[first]
            self.values[k, at[first]] = sums
        return out


def log_probabilities(model: Model, outcomes: np.ndarray, place: np.ndarray, keys: np.ndarray | None = None, known: Normalisers | None = None) -> np.ndarray:
    """The natural log probability of each outcome given those before it in its text. Without keys, those of the
    outcomes' words. known: what earlier calls with this model have found."""
    known = known or Normalisers(1 << 10)
    if keys is None:
        inside = outcomes < len(model.keys)
        keys = np.where(inside, model.keys[np.where(inside, outcomes, 0)] if len(model.keys) else 0, outcomes).astype(np.uint64)
    total = np.zeros(len(outcomes))
    for own in _batches(place):
        for k, context, rows, target in _features(model, outcomes[own], place[own], keys[own]):
            table = model.tables[k]
            total[own] -= known.of(table, k, context, rows)
            flat = table.reshape(-1)
            for r in rows:
                total[own] += flat.take(r * table.shape[1] + target)
    return total


def _batches(place: np.ndarray):
    """Slices of about _TOKENS tokens, or one text that has more."""
    starts = np.append(np.flatnonzero(place == 0), len(place))
    at = 0
    while at < len(place):
        to = int(starts[max(np.searchsorted(starts, at + _TOKENS, "right") - 1, np.searchsorted(starts, at, "right"))])
        yield slice(at, to)
        at = to


def _gradient(model: Model, outcomes: np.ndarray, place: np.ndarray, keys: np.ndarray, sums: list[np.ndarray]) -> None:
    """Add to sums (for each table how often its features are expected, then how often they occur)."""
    for own in _batches(place):
        for k, rows, times, of, target in _contexts(_features(model, outcomes[own], place[own], keys[own])):
            p = np.exp(_logits(model.tables[k], rows))
            p *= (times / p.sum(axis=1)).astype(np.float32)[:, None]
            for r in rows[1:]:  # the biases are the frequencies in all texts
                _add_rows(sums[2 * k], r, p)
                _add_seen(sums[2 * k + 1], r[of], target)


def _first_gradient(model: Model, outcomes: np.ndarray, place: np.ndarray, keys: np.ndarray, sums: list[np.ndarray], met: list[np.ndarray]) -> None:
    """As _gradient(), of a model that has but biases: what its features meet is counted in met (for each of the first two
    tables by row and bias), and _expected() makes sums of that."""
    for own in _batches(place):
        for k, context, rows, target in _features(model, outcomes[own], place[own], keys[own]):
            for r in rows[1:]:
                _add_seen(sums[2 * k + 1], r, target)
                if k < 2:
                    _add_seen(met[k], r, rows[0])
            if k == 2:
                first, _, times = _distinct(context)
                _add_rows(sums[4], rows[1][first], _frequencies(model, k).take(rows[0][first], axis=0) * times[:, None].astype(np.float32))


def _expected(model: Model, sums: list[np.ndarray], met: list[np.ndarray]) -> None:
    for k, own in enumerate(met):
        sums[2 * k] += own @ _frequencies(model, k)


def _frequencies(model: Model, k: int) -> np.ndarray:
    """The outcomes' probabilities for each bias of a table."""
    return np.exp(model.tables[k][: _free(k)])


def _add_seen(sums: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> None:
    np.add.at(sums.reshape(-1), rows * sums.shape[1] + targets, np.float32(1))


def _add_rows(sums: np.ndarray, to: np.ndarray, values: np.ndarray) -> None:
    """Add each row of values to the row of sums that `to` names: the first of each, then the second, and so on, as
    long as there are many; what is left of the few frequent rows is summed at once."""
    order = to.argsort()
    ordered = to[order]
    starts = np.flatnonzero(np.diff(ordered, prepend=-1))
    times = np.diff(starts, append=len(to))
    done = 0
    while len(starts) > 64:
        sums[ordered[starts]] += values[order[starts + done]]
        done += 1
        more = times > done
        starts, times = starts[more], times[more]
    for a, n in zip(starts.tolist(), times.tolist(), strict=True):
        sums[ordered[a]] += values[order[a + done : a + n]].sum(axis=0)


def _numbered(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[list[bytes]]]:
    words = [tokens(t or b"") for t in texts.cast(pa.binary()).to_pylist()]
    return model.numbers(list(chain.from_iterable(words))), np.array([len(w) for w in words]), words


def _frequent(counts: DataFrame) -> list[tuple[bytes, int]]:
    """The DICTIONARY most frequent words with their counts, of equal counts those whose hash is least.

    Sorting with a limit would send the driver as many words from every task. Instead a histogram of a few hundred rows
    finds the step of counts that the limit falls in, one of that step the count, and a bound on the hash leaves of the
    words with this count not many more than there is room for."""
    step, share = F.floor(F.log2("n") * 16), F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / float(1 << 30)

    def limit(of: DataFrame, by: F.Column, room: int):
        """The value of `by` that the limit falls on, room for its words, and how many it has."""
        for r in of.groupBy(by.alias("by")).count().orderBy(F.desc("by")).collect():
            if r["count"] > room:
                return r.by, room, r["count"]
            room -= r["count"]
        return None, room, 0

    at, room, n = limit(counts, step, DICTIONARY)
    wanted = F.lit(True)
    if at is not None:
        least, room, n = limit(counts.where(step == at), F.col("n"), room)
        wanted = (F.col("n") > least) | (F.col("n") == least) & (share < (room + 8 * room**0.5 + 64) / n)
    found = counts.where(wanted).select("word", "n", share.alias("share")).collect()
    return [(bytes(r.word), r.n) for r in sorted(found, key=lambda r: (-r.n, r.share, r.word))[:DICTIONARY]]


def learn(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """A model of the texts, and (word, n) for all of them."""
    spark = texts.sparkSession
    counts = written(count(texts, text_col), "counts")
    n_words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_texts = texts.count()
    best = _frequent(counts)
    dictionary = {word: i for i, (word, _) in enumerate(best)}
    known = np.array([n for _, n in best], np.int64)
    keys = np.fromiter((zlib.crc32(w) for w in dictionary), np.uint64, len(dictionary))
    # All words but the model's, each one's count plus one, and one unseen word.
    rare = float(n_words - known.sum() + distinct - len(known) + 1)
    width = -(-(len(known) + 2) // (CLASSES * WIDTH))
    rows = min(MOST_ROWS, max(LEAST_ROWS, 1 << (distinct // WORDS_PER_ROW).bit_length()))
    shapes = (CLASSES, WIDTH, width)
    tables = [np.zeros((_free(k) + rows, n), np.float32) for k, n in enumerate(shapes)]
    share = np.full(CLASSES * WIDTH * width, 1e-9)
    share[: len(known)] = known
    share[-2], share[-1] = max(n_texts, 1e-3), max(n_words - known.sum(), 1e-3)
    if n_texts:
        share = (share / share.sum()).reshape(shapes)
        for k, table in enumerate(tables):
            part = share.sum(axis=tuple(range(k + 1, 3)))
            table[: _free(k)] = np.maximum(np.log(part / part.sum(axis=-1, keepdims=True)), -30).reshape(-1, shapes[k])
    model = Model(dictionary, keys, known, n_texts, n_words + n_texts, distinct + bool(n_texts), rare, tables)

    own = texts.select(F.pmod(F.xxhash64(id_col), F.lit(1000)).alias("shard"), F.col(text_col).alias("text"))
    begin = 0
    for i, part in enumerate(SHARDS):
        end = 1000 if i == len(SHARDS) - 1 else begin + round(1000 * part)
        shard = own.where(F.col("shard").between(begin, end - 1)).select("text")
        sums = _summed(shard.coalesce(max(TASKS, int(n_words * part) // TASK_WORDS)), model, first=i == 0)
        for k, table in enumerate(model.tables):
            hashed = slice(_free(k), None)
            expected, seen = sums[2 * k][hashed], sums[2 * k + 1][hashed]
            table[hashed] += np.log((seen + DAMPING) / (expected + DAMPING)) / FEATURES[k]
            np.clip(table[hashed], -MOST, MOST, out=table[hashed])
        begin = end
    return model, counts


def _summed(texts: DataFrame, model: Model, first: bool) -> list[np.ndarray]:
    """How often each feature of each table is expected, and how often it occurs, in the texts; first: the model has but
    biases."""
    shipped = texts.sparkSession.sparkContext.broadcast(model)
    shapes = [t.shape for t in model.tables for _ in range(2)]

    def run(batches):
        model = shipped.value
        sums = [np.zeros(s, np.float32) for s in shapes]
        met = [np.zeros((len(model.tables[k]), _free(k)), np.float32) for k in range(2 * first)]
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                numbers, lengths, words = _numbered(model, part.column("text"))
                found = _outcomes(model, list(chain.from_iterable(words)), numbers, lengths)
                _first_gradient(model, *found, sums, met) if first else _gradient(model, *found, sums)
        _expected(model, sums, met)
        at = 0
        for own in sums:
            own = own.reshape(-1)
            for b in range(0, len(own), _BLOCK):
                if (x := own[b : b + _BLOCK]).any():
                    half = ((x.view(np.uint32) + 0x8000) >> 16).astype(np.uint16)  # rounded to 8 bits, which halves the shuffle
                    yield pa.RecordBatch.from_pydict({"block": pa.array([at + b], pa.int64()), "x": pa.array([half.tobytes()], pa.binary())})
            at += len(own)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [(np.frombuffer(x, np.uint16).astype(np.uint32) << 16).view(np.float32) for x in pdf.x]
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "x": [np.sum(parts, axis=0, dtype=np.float32).tobytes()]})

    out = np.zeros(sum(a * b for a, b in shapes), np.float32)
    got = texts.mapInArrow(run, "block long, x binary").groupBy("block").applyInPandas(total, "block long, x binary").toArrow()
    for batch in got.to_batches():
        for block, x in zip(batch.column("block").to_pylist(), batch.column("x"), strict=True):
            own = np.frombuffer(x.as_buffer(), np.float32)
            out[block : block + len(own)] = own
    shipped.unpersist()
    ends = np.cumsum([a * b for a, b in shapes])
    return [x.reshape(s) for x, s in zip(np.split(out, ends[:-1]), shapes, strict=True)]


def score(docs: DataFrame, model: Model, counts: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, extra columns, n_tokens, n_known, train_tokens, base_score, score) of each text, under whatever names: tokens,
    those that occur in the training texts, tokens of those, and the log10 probabilities by add-one unigrams and by the
    model."""
    spark = docs.sparkSession
    limit_batches(spark)
    shipped = spark.sparkContext.broadcast(model)
    extra = extra or {}
    own = docs.select(*[c.alias(f"c{i}") for i, c in enumerate([F.col(id_col), *extra.values(), F.col(text_col)])])
    kept = own.columns[:-1]

    def run(batches):
        model = shipped.value
        found_sums = Normalisers()
        logs = np.append(np.log10(model.counts + 1.0), 0.0)  # the last is that of words beyond the dictionary
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, f"c{len(kept)}"):
                numbers, lengths, words = _numbered(model, part.column(len(kept)))
                text = np.repeat(np.arange(len(lengths)), lengths)
                sums = lambda x: np.bincount(text, x, minlength=len(lengths))
                outcomes, place, keys = _outcomes(model, list(chain.from_iterable(words)), numbers, lengths)
                by_token = log_probabilities(model, outcomes, place, keys, found_sums) / np.log(10)
                starts = np.cumsum(lengths + 1) - lengths - 1
                beyond, at, rare, times = numbers < 0, 0, [], []
                for w, n in zip(words, lengths.tolist(), strict=True):
                    found = Counter([w[i] for i in np.flatnonzero(beyond[at : at + n]).tolist()])
                    rare.append(list(found))
                    times.append(list(found.values()))
                    at += n
                columns = {
                    "row": row + np.arange(len(lengths)),
                    "n_tokens": lengths + 1,
                    "known": sums(~beyond).astype(np.int64) + (model.end_count > 0),
                    "outside": sums(beyond).astype(np.int64),
                    "base": sums(logs[numbers]) + np.log10(model.end_count + 1.0),
                    "model": np.add.reduceat(by_token, starts),
                }
                row += len(lengths)
                arrays = [*part.columns[:-1], *[pa.array(x) for x in columns.values()], pa.array(rare, pa.list_(pa.binary())), pa.array(times, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(arrays, [*kept, *columns, "rare", "times"])

    schema = ", ".join([f"{c} {own.schema[c].dataType.simpleString()}" for c in kept])
    schema += ", row long, n_tokens long, known long, outside long, base double, model double, rare array<binary>, times array<long>"
    rows = written(own.mapInArrow(run, schema), "scored")
    pairs = rows.select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    found = pairs.join(counts.hint("merge"), "word")
    more = found.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"), F.sum("times").alias("seen"))
    out = rows.drop("rare", "times").join(more.hint("merge"), "row", "left")
    add = F.coalesce("add", F.lit(0.0))
    base = F.col("base") + add - F.col("n_tokens") * F.log10(F.lit(float(model.n + model.v + 1)))
    scored = F.col("model") + add - F.col("outside") * F.log10(F.lit(model.rare))
    known = F.col("known") + F.coalesce("seen", F.lit(0))
    named = out.select(*kept, "n_tokens", known, F.lit(model.n).cast("long"), base, scored)
    return named.toDF(id_col, *extra, "n_tokens", "n_known", "train_tokens", "base_score", "score")
