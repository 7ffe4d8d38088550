"""Quality rules: statistics of each text, and an isolation forest that finds texts whose statistics
are anomalous: the shorter the mean path on which random splits isolate a text, the more anomalous.

The forest has a group of trees over all statistics, each split of which takes a random one at a random value, and
for each rule a group of trees that split on its statistic alone, so that an extreme of one rule is not hidden by the
ordinary spread of the others. Each group's threshold comes from labelled rows: the one that finds most bad
texts while it rejects hardly any good ones; a group that cannot tell them apart rejects nothing. The statistics are shares, so long clean texts look like short ones.

Defined results: a null or empty text has no words and fails the base rule; without labelled rows of
both kinds no text is anomalous; ties at a threshold are kept; equal rows get equal results; only the
named columns are read (the filter passes all columns on).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import SPACE, bounded_sample, join_sized, kept_rows, mix, text_bytes, window_hashes, with_scores, word_hashes, word_spans, written

#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, REPEAT_WINDOW, MOST_REPEATED_PERCENT = 50, 3, 50
#: Trees over all statistics, trees of each rule, and rows that each tree draws for itself from all labelled ones.
JOINT_TREES, TREES, SUBSAMPLE = 96, 32, 256
#: The group and threshold chosen next maximise the share of bad texts newly found less GOOD_WEIGHT times
#: that of good ones rejected, and find LEAST_FOUND of the bad ones at least.
GOOD_WEIGHT, LEAST_FOUND = 50, 0.02
SEED = 7

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["symbol_share", "dup_line_share", "repeat_share", "word_length", "upper_share", "digit_share", "mark_share"]

_LINE_END = np.zeros(256, bool)
_LINE_END[10] = True


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SYMBOL, _UPPER, _DIGIT = _class(SYMBOLS), _class(bytes(range(65, 91))), _class(bytes(range(48, 58)))
_MARK = _class(b"!?~^_=+/\\@{}[]()\";")


def _sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of values between offsets that follow each other."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def statistics(column: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The base statistics of each text, and the matrix of RULES."""
    data, offs = text_bytes(column)
    n = len(offs) - 1
    point = (data & 0xC0) != 0x80
    starts, ends, first = word_spans(data, offs)
    n_words = np.diff(first)
    inside = point & ~SPACE[data]
    base = {"n_words": n_words, "word_chars": _sums(inside, offs), "n_symbols": _sums(_SYMBOL[data], offs)}

    # Lines: equal to an earlier one of the same text, and with a word.
    line_start, line_end, line_first = word_spans(data, offs, _LINE_END)
    line_doc = np.repeat(np.arange(n), np.diff(line_first))
    keys = mix(word_hashes(data, line_start, line_end) ^ mix(line_doc.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    has_word = np.searchsorted(starts, line_start) < np.searchsorted(starts, line_end)
    base["n_dup_lines"] = np.bincount(line_doc[again & has_word], minlength=n)
    lines = np.bincount(line_doc[has_word], minlength=n)

    # Windows found twice or more in a text cover its repeated words.
    word_doc = np.repeat(np.arange(n), n_words)
    windows = window_hashes(word_hashes(data, starts, ends), REPEAT_WINDOW)
    at = np.flatnonzero(word_doc[: len(windows)] == word_doc[REPEAT_WINDOW - 1 :]) if len(windows) else np.zeros(0, np.int64)
    keys = mix(windows[at] ^ mix(word_doc[at].astype(np.uint64)))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    twice = np.zeros(len(keys), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    covered = np.zeros(len(word_doc), bool)
    for k in range(REPEAT_WINDOW):
        covered[at[twice] + k] = True
    base["n_repeat_words"] = np.bincount(word_doc[covered], minlength=n)

    chars, words, points = np.maximum(base["word_chars"], 1), np.maximum(n_words, 1), np.maximum(_sums(point, offs), 1)
    features = np.stack(
        [
            base["n_symbols"] / points,
            base["n_dup_lines"] / np.maximum(lines, 1),
            base["n_repeat_words"] / words,
            base["word_chars"] / words,
            _sums(_UPPER[data], offs) / chars,
            _sums(_DIGIT[data], offs) / chars,
            _sums(_MARK[data], offs) / chars,
        ],
        axis=1,
    )
    return base, features


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < LEAST_WORDS) | (100 * base["n_repeat_words"] > MOST_REPEATED_PERCENT * base["n_words"])


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among n rows."""
    n = np.asarray(n, np.float64)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class Forest:
    """Trees as arrays by node: whether it splits, on which statistic and value, the left child (the right one follows
    it), and at leaves the path length. roots has the first nodes of each group's trees: those over all statistics, then
    those of each rule."""

    inner: np.ndarray
    rule: np.ndarray
    split: np.ndarray
    child: np.ndarray
    length: np.ndarray
    roots: list[np.ndarray]
    scale: float
    thresholds: np.ndarray

    @staticmethod
    def grow(rows: np.ndarray, trees: int = TREES, subsample: int = SUBSAMPLE, seed: int = SEED, joint: int = JOINT_TREES) -> Forest:
        rng = np.random.default_rng(seed)
        size, rules = min(subsample, len(rows)), rows.shape[1]
        depth = int(np.ceil(np.log2(max(size, 2))))
        nodes: list[list[float]] = []
        roots = [np.zeros(joint, np.int64), *(np.zeros(trees, np.int64) for _ in range(rules))]
        for group, own_roots in enumerate(roots):
            among = np.arange(rules) if group == 0 else np.array([group - 1])
            for tree in range(len(own_roots)):
                own_roots[tree] = len(nodes)
                nodes.append([0, 0, 0, 0, 0])
                todo = [(len(nodes) - 1, rows[rng.choice(len(rows), size, replace=False)], 0)]
                while todo:
                    at, own, level = todo.pop()
                    low, high = (own[:, among].min(axis=0), own[:, among].max(axis=0)) if len(own) else (np.zeros(1), np.zeros(1))
                    differ = np.flatnonzero(low < high)
                    if level >= depth or not len(differ):
                        nodes[at] = [0, 0, 0, 0, level + float(_path(len(own)))]
                        continue
                    k = int(rng.choice(differ))
                    rule, value = int(among[k]), float(rng.uniform(low[k], high[k]))
                    nodes[at] = [1, rule, value, len(nodes), 0]
                    left = own[:, rule] <= value
                    todo += [(len(nodes), own[left], level + 1), (len(nodes) + 1, own[~left], level + 1)]
                    nodes += [[0, 0, 0, 0, 0], [0, 0, 0, 0, 0]]
        table = np.array(nodes)
        whole = lambda k: table[:, k].astype(np.int64)
        return Forest(table[:, 0] > 0, whole(1), table[:, 2], whole(3), table[:, 4], roots, float(_path(size)) or 1.0, np.full(len(roots), np.inf))

    def anomaly(self, rows: np.ndarray) -> np.ndarray:
        """For each row and group 0 to 1; the shorter the mean path, the higher."""
        out = np.zeros((len(rows), len(self.roots)))
        flat, first = rows.reshape(-1), np.arange(len(rows))[:, None] * rows.shape[1]
        for group, roots in enumerate(self.roots):
            at = np.broadcast_to(roots, (len(rows), len(roots)))
            while (inner := self.inner[at]).any():
                at = np.where(inner, self.child[at] + (flat[first + self.rule[at]] > self.split[at]), at)
            out[:, group] = 2.0 ** (-self.length[at].mean(axis=1) / self.scale)
        return out

    def calibrated(self, good: np.ndarray, bad: np.ndarray) -> Forest:
        """This forest with the thresholds that tell the rows of good and bad texts apart."""
        return self.with_thresholds(self.anomaly(good), self.anomaly(bad))

    def with_thresholds(self, good: np.ndarray, bad: np.ndarray) -> Forest:
        """As calibrated(), from what anomaly() gives for the rows."""
        thresholds = np.full(len(self.roots), np.inf)
        own, other = np.sort(good, axis=0), bad
        todo = np.ones(len(bad), bool)  # bad texts that no group finds yet
        while todo.any():
            best = (0.0, -1, 0.0)
            for rule in np.flatnonzero(np.isinf(thresholds)):
                left = np.sort(other[todo, rule])
                steps = np.unique(np.r_[own[:, rule], left])
                lost = 1 - np.searchsorted(own[:, rule], steps, "right") / len(own)
                found = (len(left) - np.searchsorted(left, steps, "right")) / len(bad)
                gain = np.where(found >= LEAST_FOUND, found - GOOD_WEIGHT * lost, 0)
                k = int(gain.argmax())
                if gain[k] > best[0]:  # halfway to the next anomaly seen
                    best = (gain[k], int(rule), (float(steps[k]) + float(steps[k + 1])) / 2)
            if best[1] < 0:
                break
            thresholds[best[1]] = best[2]
            todo &= other[:, best[1]] <= best[2]
        return replace(self, thresholds=thresholds)

    def anomalous(self, anomaly: np.ndarray) -> np.ndarray:
        return (anomaly > self.thresholds).any(axis=1)


def _gathered(rows: DataFrame, of, width: int, dtype) -> tuple[np.ndarray, np.ndarray]:
    """On the driver the labels of all rows (label, features), and of(features) as a matrix: a few bytes a row, packed by
    the executors."""

    def run(batches):
        for batch in batches:
            features = batch.column("features").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), len(RULES))
            label = batch.column("label").to_numpy(zero_copy_only=False).astype(np.int8)
            yield pa.RecordBatch.from_pydict({"label": pa.array([label.tobytes()], pa.binary()), "found": pa.array([of(features).astype(dtype).tobytes()], pa.binary())})

    parts = rows.select("label", "features").mapInArrow(run, "label binary, found binary").collect()
    return np.frombuffer(b"".join(r.label for r in parts), np.int8), np.frombuffer(b"".join(r.found for r in parts), dtype).reshape(-1, width)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int | None = None) -> Forest:
    """A forest over the statistics of all labelled texts (of about `rows` of them, if that is given) that the base rule lets
    pass, good (label 1) and bad (label 0) in their natural shares, since anomalies are rare; each tree draws its rows
    from all. Thresholds count all these texts. A document with several labels takes the least."""
    marked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    marked = marked.where(F.col("label").isin(0, 1))
    marked = written(marked if rows is None else bounded_sample(marked, rows, key="id"), "marked")
    chosen = join_sized(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), marked, "id", docs.count(), marked.count())

    def judge():
        def of(texts):
            base, features = statistics(texts)
            return [base_failed(base), pa.array(features.tolist(), pa.list_(pa.float64()))]

        return of

    got = with_scores(chosen, "id", "text", judge, [("failed", pa.bool_()), ("features", pa.list_(pa.float64()))], {"label": F.col("label")})
    got = written(got.where(~F.col("failed")).select("label", "features"), "labelled")
    label, features = _gathered(got, lambda x: x, len(RULES), np.float64)
    if not (label == 1).any() or not (label == 0).any():
        return Forest.grow(np.zeros((2, len(RULES))))
    forest = Forest.grow(features[np.lexsort((*features.T, label))])
    shipped = docs.sparkSession.sparkContext.broadcast(forest)
    label, anomaly = _gathered(got, lambda x: shipped.value.anomaly(x), len(forest.roots), np.float32)
    return forest.with_thresholds(anomaly[label == 1], anomaly[label == 0])


def score(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base statistics, base_failed, anomaly, kept) of each row."""
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def judge():
        def of(texts):
            base, features = statistics(texts)
            failed, anomaly = base_failed(base), shipped.value.anomaly(features)
            return [*[base[b].astype(np.int64) for b in BASE], failed, anomaly.max(axis=1), ~failed & ~shipped.value.anomalous(anomaly)]

        return of

    fields = [(b, pa.int64()) for b in BASE] + [("base_failed", pa.bool_()), ("anomaly", pa.float64()), ("kept", pa.bool_())]
    return with_scores(docs, id_col, text_col, judge, fields)


def good_rows(docs: DataFrame, forest: Forest, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that neither fail the base rule nor are anomalous."""
    shipped = docs.sparkSession.sparkContext.broadcast(forest)

    def judge():
        def keep(texts):
            base, features = statistics(texts)
            return ~base_failed(base) & ~shipped.value.anomalous(shipped.value.anomaly(features))

        return keep

    return kept_rows(docs, text_col, judge)
