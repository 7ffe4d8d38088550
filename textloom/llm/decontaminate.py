"""Benchmark decontamination: documents that hold a benchmark item, up to a share of edited words.

Words are runs of letters and digits, of any script, of the lower-cased text. Each item is embedded by CGK random walks:
the walk stands on a word, emits it, and moves on or stays by a random bit of the step and the word, so
that equal stretches meet again after an edit and edit distance becomes Hamming distance. A repetition
samples a few places of the embedding; item-sized windows of a document with the same words there are
candidates. Repetitions are added until edited copies of the items, fresh ones in the end, are found at the target
recall; items that MOST_REPETITIONS do not find so have all their anchored windows compared. An exact edit distance over
words decides.

Windows that cannot match are spared the walks, by bounds that lose nothing: e edits leave one of e+1
stretches of an item whole, so a match holds one of its n-grams of that length, and it holds enough words
of the items' vocabulary, and enough of its rare ones.

The benchmark's distinct texts are taken in blocks of a bounded number of words, each of which passes over all documents.

Defined results: null and empty texts hold nothing; items without words match nothing; an item of
fewer than five words matches only unedited; equal items, rows and ids each give their own rows; an empty
table gives an empty table; only the named columns are read (the filter passes all columns on).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import kept_rows, limit_batches, letters_and_digits, mix, slices, text_bytes, window_hashes, word_hashes, word_spans, written

#: Edited words that a copy may have, as a share of the item's, and the recall of candidates among
#: copies with as many edits.
EDITS, RECALL = 0.2, 0.995
#: Sampled places of a repetition, and repetitions at most before the exact way.
PLACES, MOST_REPETITIONS = 3, 96
#: Words of the benchmark in a block, at most (unless one item has more).
BLOCK_WORDS = 500_000
#: Blocks that a filter holds at once.
BLOCKS_AT_ONCE = 2
#: A word of the benchmark is rare if fewer items than this share (or three) have it.
RARE = 0.03
SEED = 23


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and the first word of each text (one more at the end)."""
    data, offs = text_bytes(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, first = word_spans(data, offs, inside=letters_and_digits(data))
    return word_hashes(data, starts, ends), first


@dataclass
class Class:
    """Items of like length, and the sampled embeddings that find them."""

    items: list[int]
    shortest: int
    window: int
    need_vocabulary: int
    need_rare: int
    stretch: int
    grams: np.ndarray
    repetitions: list[tuple[int, list[int]]] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    #: Of a class without repetitions: its items' n-grams in order, and the item and place of each.
    places: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _sampled(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int, places: list[int]) -> np.ndarray:
    """A key of the words that the walk of each start emits at the places; behind its end it stands on word 0."""
    at, key = starts.copy(), np.zeros(len(starts), np.uint64)
    for step in range(places[-1] + 1):
        word = np.where(at < ends, ids[np.minimum(at, len(ids) - 1)], 0).astype(np.uint64)
        if step in places:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(1))
        at += (mix(word * np.uint64(0xD6E8FEB86659FD93) + np.uint64(seed * 4096 + step)) >> np.uint64(63)).astype(np.int64)
    return key


def _distance(item: np.ndarray, text: np.ndarray) -> int:
    """Least edit distance between item and any run of text."""
    place = np.arange(len(text) + 1)
    row, new = np.zeros(len(text) + 1, np.int64), np.zeros(len(text) + 1, np.int64)
    for n, word in enumerate(item.tolist()):
        new[0] = n + 1
        np.minimum(row[:-1] + (text != word), row[1:] + 1, out=new[1:])
        new -= place
        np.minimum.accumulate(new, out=new)
        new += place
        row, new = new, row
    return int(row.min())


@dataclass
class Copies:
    """Edited copies of items of a class: their words, the starts of windows that may find them, each window's item (its
    place in the class) and end, and the first window of each copy."""

    n: int
    words: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    item: np.ndarray
    first: np.ndarray

    @staticmethod
    def of(items: list[int], texts: list[np.ndarray], margins: list[int]) -> Copies:
        ends = np.cumsum([len(t) for t in texts])
        windows = [2 * m + 1 for m in margins]
        first = np.cumsum([0, *windows[:-1]])
        starts = np.concatenate([e - len(t) + np.arange(w) for e, t, w in zip(ends.tolist(), texts, windows, strict=True)])
        return Copies(len(items), np.concatenate(texts), starts, np.repeat(ends, windows), np.repeat(items, windows), first)

    def found(self, seed: int, places: list[int], keys: np.ndarray) -> np.ndarray:
        """Which copies a repetition finds; keys: those of the class's items."""
        same = _sampled(self.words, self.starts, self.ends, seed, places) == keys[self.item]
        return np.logical_or.reduceat(same, self.first)


class Index:
    """The items of a block, ready to be found in documents."""

    def __init__(self, item_ids: list, texts: list[str | None], edits: float = EDITS, recall: float = RECALL):
        hashes, first = words(pa.array(texts, pa.string()))
        self.vocabulary = np.unique(hashes)
        numbered = np.searchsorted(self.vocabulary, hashes) + 1
        self.item_ids = item_ids
        self.items = [numbered[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.hashes = [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        self.most = [int(edits * len(i) + 1e-9) for i in self.items]
        some = [np.unique(i) for i in self.items if len(i)]
        often = np.bincount(np.concatenate(some), minlength=len(self.vocabulary) + 1) if some else np.zeros(1, np.int64)
        self.rare = often < max(3, RARE * len(self.items))
        self.rare[0] = False
        # Most words of a document are in no item: a small table of hash bits tells before the search does.
        self.near = np.zeros(1 << 18, bool)
        self.near[(self.vocabulary >> np.uint64(46)).astype(np.int64)] = True
        grouped: dict[tuple[int, bool], list[int]] = {}
        for n, item in enumerate(self.items):
            if len(item):
                enough = int(self.rare[item].sum()) - self.most[n] >= 2
                grouped.setdefault((int(np.log(len(item)) / np.log(1.3)), enough), []).append(n)
        self.classes = [self._class(own, recall) for _, own in sorted(grouped.items())]
        self.near_grams = {}
        for own in self.classes:
            near = self.near_grams.setdefault(own.stretch, np.zeros(1 << 20, bool))
            near[(own.grams >> np.uint64(44)).astype(np.int64)] = True
        del self.hashes

    def _class(self, own: list[int], recall: float) -> Class:
        lengths = [len(self.items[n]) for n in own]
        stretch = min(-(-(x - self.most[n]) // (self.most[n] + 1)) for x, n in zip(lengths, own, strict=True))
        out = Class(
            own,
            min(lengths),
            max(x + self.most[n] for x, n in zip(lengths, own, strict=True)),
            min(x - self.most[n] for x, n in zip(lengths, own, strict=True)),
            max(0, min(int(self.rare[self.items[n]].sum()) - self.most[n] for n in own)),
            stretch,
            np.unique(np.concatenate([window_hashes(self.hashes[n], stretch) for n in own])),
        )
        flat = np.concatenate([self.items[n] for n in own])
        ends = np.cumsum(lengths)
        starts = ends - lengths
        rng = np.random.default_rng(SEED)
        copies, made = [self._edited(own, rng)], []
        missed = [np.ones(copies[0].n, bool)]
        while True:
            if len(out.repetitions) >= 4 and sum(m.sum() for m in missed) <= (1 - recall) * sum(c.n for c in copies):
                fresh = self._edited(own, rng)
                left = ~np.logical_or.reduce([fresh.found(*r, k) for r, k in zip(out.repetitions, made, strict=True)])
                if left.sum() <= (1 - recall) * fresh.n:
                    return out
                copies.append(fresh)
                missed.append(left)
            if len(out.repetitions) == MOST_REPETITIONS:
                break
            seed = len(out.repetitions) + 1
            places = sorted(rng.choice(out.shortest, min(PLACES, out.shortest), replace=False).tolist())
            keys = _sampled(flat, starts, ends, seed, places)
            order = np.argsort(keys, kind="stable")
            out.repetitions.append((seed, places))
            out.keys.append((keys[order], np.array(own)[order]))
            made.append(keys)
            for m, c in zip(missed, copies, strict=True):
                m &= ~c.found(seed, places, keys)
        # The recall is not reached: n-grams and their places in the items lead to all windows that may match.
        grams = [window_hashes(self.hashes[n], stretch) for n in own]
        flat_grams = np.concatenate(grams)
        order = np.argsort(flat_grams, kind="stable")
        items = np.repeat(own, [len(g) for g in grams])
        where = np.concatenate([np.arange(len(g)) for g in grams])
        out.repetitions, out.keys, out.places = [], [], (flat_grams[order], items[order], where[order])
        return out

    def _edited(self, own: list[int], rng: np.random.Generator) -> Copies:
        """Copies of items with as many random edits as allowed, between words of no item."""
        picks = list(range(len(own))) if len(own) <= 64 else rng.choice(len(own), 64, replace=False).tolist()
        items, texts, margins = [], [], []
        for i in picks:
            n = own[i]
            for _ in range(max(1, 256 // len(picks))):
                copy = self.items[n].tolist()
                for _ in range(self.most[n]):
                    at, kind = int(rng.integers(len(copy))), int(rng.integers(3))
                    if kind == 0:
                        copy[at] = 0
                    elif kind == 1:
                        copy.insert(at, 0)
                    elif len(copy) > 1:
                        del copy[at]
                margin = max(1, self.most[n])
                items.append(i)
                texts.append(np.array([0] * margin + copy + [0] * margin))
                margins.append(margin)
        return Copies.of(items, texts, margins)

    def find(self, texts: pa.Array) -> list[tuple[int, int, int, int]]:
        """(text number, item number, edits, first word of the region) of each item that a text holds."""
        hashes, first = words(texts)
        if not len(hashes) or not len(self.vocabulary):
            return []
        ids = np.zeros(len(hashes), np.int64)
        may = np.flatnonzero(self.near[(hashes >> np.uint64(46)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, hashes[may]), len(self.vocabulary) - 1)
        ids[may] = np.where(self.vocabulary[at] == hashes[may], at + 1, 0)
        known, rare = (np.r_[0, np.cumsum(x, dtype=np.int32)] for x in (ids > 0, self.rare[ids]))
        counts = np.diff(first)
        doc_of = np.repeat(np.arange(len(counts)), counts)
        hits: dict[tuple[int, int], list[int]] = {}
        for stretch, near in self.near_grams.items():
            grams = window_hashes(hashes, stretch)
            anchors = np.flatnonzero(near[(grams >> np.uint64(44)).astype(np.int64)])
            anchors = anchors[doc_of[anchors] == doc_of[anchors + stretch - 1]]
            for own in self.classes:
                if own.stretch == stretch and len(anchors):
                    at = anchors[np.isin(grams[anchors], own.grams)]
                    self._candidates(own, ids, first, doc_of, known, rare, at, grams[at], hits)
        out = []
        for (doc, n), places in sorted(hits.items()):
            item, most = self.items[n], self.most[n]
            best, where, done = most + 1, 0, -1
            for start in sorted(set(places)):
                if best == 0 or start < done:
                    continue
                a, b = max(int(first[doc]), start - most), min(int(first[doc + 1]), start + 2 * len(item) + 2 * most)
                done = start + len(item) // 2  # later starts lie in the part that is compared now
                exact = len(item) <= b - start and np.array_equal(ids[start : start + len(item)], item)
                if not exact and int(np.isin(item, ids[a:b]).sum()) < len(item) - most:
                    continue
                edits = 0 if exact else _distance(item, ids[a:b])
                if edits < best:
                    best, where = edits, (start if exact else a)
            if best <= most:
                out.append((doc, n, best, where - int(first[doc])))
        return out

    def _candidates(self, own: Class, ids, first, doc_of, known, rare, anchors, anchor_grams, hits) -> None:
        """Add to hits, by text and item, the starts of windows that a repetition finds, or all that have an n-gram in its
        place."""
        if not len(anchors):
            return
        if own.places is not None:
            grams, items, places = own.places
            found = anchor_grams
            low, high = np.searchsorted(grams, found), np.searchsorted(grams, found, "right")
            for anchor, a, b in zip(anchors.tolist(), low.tolist(), high.tolist(), strict=True):
                doc = int(doc_of[anchor])
                for k in range(a, b):
                    hits.setdefault((doc, int(items[k])), []).append(max(int(first[doc]), anchor - int(places[k])))
            return
        low = np.maximum(anchors - own.window + own.stretch, first[doc_of[anchors]])
        mark = np.zeros(len(ids) + 1, np.int32)
        np.add.at(mark, low, 1)
        np.add.at(mark, anchors + 1, -1)
        starts = np.flatnonzero(np.cumsum(mark[:-1]))
        ends = first[doc_of[starts] + 1]
        end = np.minimum(starts + own.window, ends)
        enough = (rare[end] - rare[starts] >= own.need_rare) & (known[end] - known[starts] >= own.need_vocabulary)
        starts, ends = starts[enough], ends[enough]
        for (seed, places), (keys, items) in zip(own.repetitions, own.keys, strict=True):
            found = _sampled(ids, starts, ends, seed, places)
            low, high = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
            for k in np.flatnonzero(high > low):
                for item in items[low[k] : high[k]].tolist():
                    hits.setdefault((int(doc_of[starts[k]]), item), []).append(int(starts[k]))


def _blocks(benchmark: DataFrame, text_col: str):
    """An Index for each block of the benchmark's distinct texts, one in the driver's memory at a time; its items are
    the texts' hashes."""
    texts = benchmark.where(F.col(text_col).isNotNull()).select(F.col(text_col).alias("text")).distinct()
    own = texts.select(_text_key("text").alias("item"), "text")
    size = own.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    n = -(-size // BLOCK_WORDS)
    for block in range(n):
        rows = own.where(F.pmod(F.xxhash64("text"), F.lit(n)) == block).orderBy("item", "text").collect()
        if rows:
            yield Index([r.item for r in rows], [r.text for r in rows])


def _text_key(column: str) -> F.Column:
    return F.sha2(F.col(column), 256)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item, edits, item_words, at) of each document and item that it holds: the least edits, the
    item's number of words, and the word of the document where the part that holds it begins."""
    spark = docs.sparkSession
    limit_batches(spark)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {own.schema['id'].dataType.simpleString()}, key string, edits int, item_words int, at long"
    out = spark.createDataFrame([], schema)
    for index in _blocks(benchmark, item_text_col):
        shipped = spark.sparkContext.broadcast(index)

        def run(batches, shipped=shipped):
            index = shipped.value
            for batch in batches:
                for part in slices(batch, "text"):
                    found = index.find(part.column("text"))
                    if found:
                        doc, item, edits, at = zip(*found, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                part.column("id").take(pa.array(doc)),
                                pa.array([index.item_ids[n] for n in item]),
                                pa.array(edits, pa.int32()),
                                pa.array([len(index.items[n]) for n in item], pa.int32()),
                                pa.array(at, pa.int64()),
                            ],
                            ["id", "key", "edits", "item_words", "at"],
                        )

        out = out.unionByName(written(own.mapInArrow(run, schema), "leaks"))
        shipped.unpersist()
    items = benchmark.select(F.col(item_col).alias("item"), _text_key(item_text_col).alias("key"))
    return out.join(items, "key").select(F.col("id").alias(id_col), F.col("item").alias(item_col), "edits", "item_words", "at")


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that hold no item. BLOCKS_AT_ONCE blocks are searched in a pass, then the rows are
    written, so that no more indexes are on the executors at a time."""
    shipped = []
    for index in _blocks(benchmark, item_text_col):
        if len(shipped) == BLOCKS_AT_ONCE:
            docs = written(docs, "without-leaks")
            for own in shipped:
                own.unpersist()
            shipped = []
        shipped.append(docs.sparkSession.sparkContext.broadcast(index))

        def judge(own=shipped[-1]):
            def keep(texts):
                mask = np.ones(len(texts), bool)
                mask[[doc for doc, *_ in own.value.find(texts)]] = False
                return mask

            return keep

        docs = kept_rows(docs, text_col, judge)
    return docs
