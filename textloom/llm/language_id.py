"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. A letter n-gram is the product (binding) of its letters'
vectors, each rotated (permuted) by its place; a document is the sum (bundling) of its n-grams'
vectors, and a language prototype is the sum of its documents. The language of a document is that of
the prototype with the largest cosine.

N-grams take lower-cased letters; everything else separates words, and a word's ends count as one
blank letter. All n-grams with a letter in the middle count.

Defined results: null texts and texts without letters are `und` with score 0, as are all texts if
nothing could be learned; ties go to the language that sorts first; rows with a null language or no
letters teach nothing; equal rows get equal results; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import kept_rows, limit_batches, mix, with_scores

UNKNOWN = "und"
DIMENSIONS = 1024
#: A text resembles a learned language if its cosine is at least half that which LOW of the language's own texts stay below,
#: and more than that of unrelated vectors, which is 0 with a standard deviation of DIMENSIONS ** -0.5, exceeds with the
#: chance BY_CHANCE for any prototype.
LOW, BY_CHANCE = 0.005, 0.001
_ROWS, _GRAMS, _DENSE = 256, 8192, 1 << 22

_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(codes: np.ndarray) -> np.ndarray:
    """The +1/-1 vector of each code point, the same on every machine."""
    blocks = np.arange(DIMENSIONS // 64, dtype=np.uint64)
    bits = mix(mix(codes.astype(np.uint64) + np.uint64(1))[:, None] + blocks * np.uint64(0x9E3779B97F4A7C15))
    return (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1).reshape(len(codes), DIMENSIONS)


def bundles(texts: list[str]) -> np.ndarray:
    """The bundled trigram vectors of each text (rows of zeros for texts without letters)."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    lowered = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.fromiter(map(len, lowered), np.int64, len(lowered)))
    codes = np.where(_is_letter()[codes], codes, 0)
    middle = np.flatnonzero(codes[1:-1]) + 1
    if not len(middle):
        return out
    seen = np.zeros(0x110000, bool)
    seen[codes] = True
    alphabet = np.flatnonzero(seen)
    n = len(alphabet)
    place = np.zeros(0x110000, np.int32)
    place[alphabet] = np.arange(n)
    small = place[codes].astype(np.int64)
    grams = (small[middle - 1] * n + small[middle]) * n + small[middle + 1]
    if n**3 <= _DENSE:  # number the n-grams that occur without sorting
        there = np.zeros(n**3, bool)
        there[grams] = True
        distinct = np.flatnonzero(there)
        number = np.zeros(n**3, np.int64)
        number[distinct] = np.arange(len(distinct))
        grams = number[grams]
    else:
        distinct, grams = np.unique(grams, return_inverse=True)
    vectors = letter_vectors(alphabet)
    vectors[alphabet == 0] = letter_vectors(np.zeros(1, np.int64))
    turned = [np.roll(vectors, 2, axis=1), np.roll(vectors, 1, axis=1), vectors]
    doc = doc[middle]
    for at in range(0, len(distinct), _GRAMS):  # a block of n-grams at a time bounds the memory
        own = distinct[at : at + _GRAMS]
        bound = turned[0][own // (n * n)] * turned[1][own // n % n] * turned[2][own % n]
        inside = (grams >= at) & (grams < at + _GRAMS) if len(distinct) > _GRAMS else slice(None)
        counts = np.bincount(doc[inside] * len(own) + grams[inside] - at, minlength=len(texts) * len(own))
        out += counts.reshape(len(texts), len(own)).astype(np.float32) @ bound.astype(np.float32)
    return out


def _in_rows(texts: list[str]):
    for at in range(0, len(texts), _ROWS):
        yield bundles(texts[at : at + _ROWS])


@dataclass(frozen=True)
class Profiles:
    """Language names in order, their prototypes, scaled to length 1, and the least cosine of a text that resembles each."""

    names: list[str]
    vectors: np.ndarray
    least: np.ndarray | None = None

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.names:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        names: list[str] = []
        scores: list[float] = []
        for rows in _in_rows(texts):
            rows = rows.astype(np.float64)
            lengths = np.sqrt((rows * rows).sum(axis=1))
            cosines = rows @ self.vectors.T / np.maximum(lengths, 1e-9)[:, None]
            best = cosines.argmax(axis=1)
            names += [self.names[b] if l else UNKNOWN for b, l in zip(best.tolist(), lengths.tolist(), strict=True)]
            scores += np.clip(cosines[np.arange(len(rows)), best], 0, 1).tolist()
        return names, scores


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """Prototypes of all languages, each from all of its rows."""
    limit_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column("lang").to_pylist(), [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            for bundled in _in_rows(texts):
                for row in bundled.astype(np.int64):
                    lang = langs[at]
                    sums[lang] = sums[lang] + row if lang in sums else row
                    at += 1
        if sums:
            yield pa.RecordBatch.from_pydict({"lang": list(sums), "vector": [v.tolist() for v in sums.values()]})

    parts = rows.mapInArrow(run, "lang string, vector array<bigint>")
    sums = parts.select("lang", F.posexplode("vector").alias("at", "x")).groupBy("lang", "at").agg(F.sum("x").alias("x"))
    found = sums.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("at", "x"))).getField("x").alias("vector")).collect()
    found = sorted((r.lang, r.vector) for r in found)
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)
    lengths = np.sqrt((vectors**2).sum(axis=1))
    some = lengths > 0
    return Profiles([n for (n, _), s in zip(found, some, strict=True) if s], vectors[some] / lengths[some][:, None])


def calibrated(profiles: Profiles, labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Profiles:
    """The profiles with the least cosine of each language, from all of its rows."""
    if not profiles.names:
        return profiles
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    said = predict(rows, profiles, "lang", "text").where("lang = lang_pred")
    low = {r.lang: r.low for r in said.groupBy("lang").agg(F.percentile_approx("score", LOW, 10_000).alias("low")).collect()}
    chance = NormalDist().inv_cdf(1 - BY_CHANCE / len(profiles.names)) * DIMENSIONS**-0.5
    return replace(profiles, least=np.array([max(chance, low.get(n, 0.0) / 2) for n in profiles.names]))


def predict(docs: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, extra columns, lang_pred, score) of each row; score is the best cosine, 0 to 1."""
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    def judge():
        return lambda texts: shipped.value.predict([t or "" for t in texts.to_pylist()])

    return with_scores(docs, id_col, text_col, judge, [("lang_pred", pa.string()), ("score", pa.float64())], extra)


def in_learned_language(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """The rows, with all columns, whose text resembles a learned language: not `und`, and with the least cosine of that
    language or more (profiles come from calibrated()). Where nothing was learned no text does."""
    shipped = docs.sparkSession.sparkContext.broadcast(profiles)

    def judge():
        least = dict(zip(shipped.value.names, shipped.value.least, strict=True)) if shipped.value.names else {}

        def keep(texts):
            names, scores = shipped.value.predict([t or "" for t in texts.to_pylist()])
            return [n in least and s >= least[n] for n, s in zip(names, scores, strict=True)]

        return keep

    return kept_rows(docs, text_col, judge)
