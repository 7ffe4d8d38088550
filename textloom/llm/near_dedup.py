"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct k-word shingles; with fewer words, the whole sequence is its one
shingle. Words are runs of other characters than ASCII white space, with A-Z lower-cased. Two
permutations give the whole signature: the first scatters the shingles over a fixed universe, the second,
shifted circularly by i, ranks them for coordinate i, whose value is the least rank. Bands of
coordinates that agree make candidates, and the exact Jaccard similarity of the full sets decides.

Documents with equal sets are one node. In a bucket all members are compared with one pivot first.
Members that are linked to one same document need no comparison with each other; buckets that hold others
are compared again, in the pairs across components that an exact prefix filter over their full sets leaves.
So a group of thousands of copies costs about one comparison a member, and no link between groups is lost.

Defined results: null texts and texts without words have no shingles and are linked with nothing; rows
with a null id are linked with nothing and stay; rows of the same id are one document; ties (equal
sets) go to the smallest id; an empty table gives an empty table; operators on ids read only the
named columns, and the filter passes all columns on.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import LOWER, by_ids, join_hot, join_sized, mix, sequence_hash, text_bytes, window_hashes, with_scores, word_hashes, word_spans, written
from textloom.llm.components import components

#: Words of a shingle and the least similarity in percent, unless a caller says otherwise.
SHINGLE_WORDS, PERCENT = 5, 80
#: Signature coordinates; the chance that a pair just at the threshold shares no band may be MISS at most.
COORDINATES, MISS = 320, 1e-5
UNIVERSE_BITS = 20
#: Buckets of the table of shingle frequencies, as a power of two: at least, and at most (16 MB).
LEAST_BITS, MOST_BITS = 20, 22
_SHINGLES, _BLOCK = 4096, 1 << 14

_tables: list[tuple[np.ndarray, np.ndarray]] = []


def banding(percent: int) -> tuple[int, int]:
    """Bands, and coordinates in each: as many coordinates as MISS allows, for the fewest false candidates."""
    for rows in range(COORDINATES, 0, -1):
        bands = COORDINATES // rows
        if (1 - (percent / 100) ** rows) ** bands <= MISS:
            return bands, rows
    return COORDINATES, 1


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all shifts of the ranking one as rows of a view."""
    if not _tables:
        rng = np.random.Generator(np.random.PCG64(85))
        n = 1 << UNIVERSE_BITS
        scatter, rank = rng.permutation(n).astype(np.int32), rng.permutation(n).astype(np.int32)
        _tables.append((scatter, np.lib.stride_tricks.sliding_window_view(np.r_[rank, rank[:COORDINATES]], COORDINATES)))
    return _tables[0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """COORDINATES values of a set of shingle hashes."""
    scatter, shifted = _permutations()
    at = scatter[(shingles >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)]
    parts = [shifted[at[i : i + _SHINGLES]].min(axis=0) for i in range(0, len(at), _SHINGLES)]
    return np.min(parts, axis=0)


def band_keys(signed: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key of each band of each signature; bands never share a key but by chance."""
    parts = signed[:, : bands * rows].reshape(len(signed), bands, rows).astype(np.uint64)
    weights = mix(np.arange(1, bands * rows + 1, dtype=np.uint64)).reshape(bands, rows) | np.uint64(1)
    return mix((parts * weights).sum(axis=2, dtype=np.uint64) + weights[:, 0])


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offs = text_bytes(texts)
    data = LOWER[data]
    starts, ends, first = word_spans(data, offs)
    words = word_hashes(data, starts, ends)
    windows = window_hashes(words, k)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            own = np.sort(windows[a : b - k + 1])
            out.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            out.append(np.array([sequence_hash(words[a:b])] if b > a else [], np.uint64))
    return out


def signed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, set_key, bands) of each row; rows without shingles have no key and bands."""
    bands, rows = banding(percent)

    def judge():
        def of(texts):
            sets = shingle_sets(texts, k)
            some = [i for i, s in enumerate(sets) if len(s)]
            keys: list = [None] * len(sets)
            found: list = [None] * len(sets)
            if some:
                banded = band_keys(np.stack([signature(sets[i]) for i in some]), bands, rows).view(np.int64)
                for i, own in zip(some, banded, strict=True):
                    found[i] = own
                    keys[i] = np.array([mix(sets[i]).sum(dtype=np.uint64), mix(sets[i] ^ np.uint64(0x5BD1E995)).sum(dtype=np.uint64)], np.uint64).tobytes()
            return [np.array([len(s) for s in sets], np.int64), pa.array(keys, pa.binary()), pa.array(found, pa.list_(pa.int64()))]

        return of

    fields = [("n_shingles", pa.int64()), ("set_key", pa.binary()), ("bands", pa.list_(pa.int64()))]
    return with_scores(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), "doc", "text", judge, fields)


def _sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(doc, own): the whole shingle sets of the documents with these ids."""

    def judge():
        return lambda texts: [pa.array([s.view(np.int64) for s in shingle_sets(texts, k)], pa.list_(pa.int64()))]

    return with_scores(by_ids(docs, ids, ids.count(), "left_semi"), "doc", "text", judge, [("own", pa.list_(pa.int64()))])


def _linked(pairs: DataFrame, n: int, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the n pairs (u, v) whose sets are similar enough. u may be a pivot of many pairs.
    The sets are long, so they are never broadcast."""
    one = pairs.join(sets.select(F.col("doc").alias("v"), F.col("own").alias("of_v")).hint("merge"), "v")
    both = join_hot(one, sets.select(F.col("doc").alias("u"), F.col("own").alias("of_u")).hint("merge"), "u", n, counts=pairs.groupBy("u").count())
    same = F.size(F.array_intersect("of_u", "of_v"))
    checked = both.select("u", "v", same.alias("same"), (F.size("of_u") + F.size("of_v")).alias("sizes"))
    return checked.where(100 * F.col("same") >= percent * (F.col("sizes") - F.col("same"))).select("u", "v")


def _frequencies(rest: DataFrame) -> np.ndarray:
    """For each hash bucket of shingles how many the sets have; as many buckets as shingles, within bounds."""
    shingles = rest.agg(F.coalesce(F.sum(F.size("own")), F.lit(0))).first()[0]
    bits = min(MOST_BITS, max(LEAST_BITS, int(shingles).bit_length()))

    def run(batches):
        counts = np.zeros(1 << bits, np.int32)
        for batch in batches:
            own = batch.column("own").flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            at, n = np.unique(own >> np.uint64(64 - bits), return_counts=True)
            counts[at.astype(np.int64)] += n.astype(np.int32)
        for b in range(0, len(counts), _BLOCK):
            if counts[b : b + _BLOCK].any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([b], pa.int64()), "counts": [counts[b : b + _BLOCK].tobytes()]})

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        sums = np.sum([np.frombuffer(x, np.int32) for x in pdf.counts], axis=0, dtype=np.int64)
        return pd.DataFrame({"block": [int(pdf.block.iloc[0])], "counts": [np.minimum(sums, 2**31 - 1).astype(np.int32).tobytes()]})

    parts = rest.select("own").mapInArrow(run, "block long, counts binary").groupBy("block").applyInPandas(total, "block long, counts binary")
    out = np.zeros(1 << bits, np.int32)
    for r in parts.collect():
        out[r.block : r.block + _BLOCK] = np.frombuffer(r.counts, np.int32)
    return out


def _across(rest: DataFrame, percent: int) -> DataFrame:
    """All pairs (u, v) of different labels that may be similar enough, for rest (doc, label, own).

    Of two sets that are, the first shingles in any order of all shingles overlap: a set of n needs
    n - ceil(percent * n) + 1 of them, and what follows the first common one must suffice for the overlap.
    Rare shingles come first, so a text whose own edits exceed what the similarity allows meets nothing.
    Rows of a shingle's most frequent label are not paired with each other, and the other rows of a shingle that many
    texts begin with are dealt to several tasks (join_hot)."""
    shipped = rest.sparkSession.sparkContext.broadcast(_frequencies(rest))
    kinds = [f"{c} {rest.schema[c].dataType.simpleString()}" for c in ("doc", "label")]

    def run(batches):
        often = shipped.value
        shift = np.uint64(65 - len(often).bit_length())
        for batch in batches:
            tokens, sizes, places, rows = [], [], [], []
            for i, own in enumerate(batch.column("own")):
                shingles = own.values.to_numpy(zero_copy_only=False)
                order = np.lexsort((shingles, often[(shingles.view(np.uint64) >> shift).astype(np.int64)]))
                first = order[: len(order) + percent * len(order) // -100 + 1]
                tokens.append(shingles[first])
                places.append(np.arange(len(first), dtype=np.int32))
                sizes.append(np.full(len(first), len(order), np.int32))
                rows.append(np.full(len(first), i))
            take = pa.array(np.concatenate(rows))
            columns = [pa.array(np.concatenate(x)) for x in (tokens, sizes, places)]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("doc").take(take), batch.column("label").take(take)], ["token", "n", "at", "doc", "label"])

    starts = written(rest.mapInArrow(run, f"token long, n int, at int, {', '.join(kinds)}"), "starts")
    counted = starts.groupBy("token", "label").count()
    modes = counted.groupBy("token").agg(F.max_by("label", F.struct("count", "label")).alias("mode"), (F.sum("count") - F.max("count")).alias("others"))
    modes = written(modes.where("others > 0"), "modes")
    right = starts.join(modes.drop("others"), "token")
    left = right.where("label <> mode")
    right = right.select("token", "mode", *[F.col(c).alias(f"{c}2") for c in ("n", "at", "doc", "label")])
    apart = (F.col("label") != F.col("label2")) & ((F.col("label2") == F.col("mode")) | (F.col("doc") < F.col("doc2")))
    enough = F.least(F.col("n") - F.col("at"), F.col("n2") - F.col("at2")) * (100 + percent) >= percent * (F.col("n") + F.col("n2"))
    total = modes.agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0]
    met = join_hot(left.drop("mode"), right, "token", total, counts=modes.select("token", F.col("others").alias("count")))
    return met.where(apart & enough).select(F.least("doc", "doc2").alias("u"), F.greatest("doc", "doc2").alias("v"))


def groups(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row: the smallest id that chains of links reach,
    and whether it is the row's own."""
    own = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    rows = written(signed(own, k, percent, "doc", "text"), "signed")
    some = rows.where(F.col("set_key").isNotNull() & F.col("doc").isNotNull())
    classes = written(some.groupBy("set_key").agg(F.min("doc").alias("rep"), F.count("*").alias("count"), F.any_value("bands").alias("bands")), "classes")
    n, repeated = rows.count(), classes.where("count > 1")
    copies = join_sized(some.select("doc", "set_key"), repeated.select("set_key", "rep"), "set_key", n, repeated.count(), counts=repeated.select("set_key", "count"))
    links = written(copies.where("doc <> rep").select(F.col("rep").alias("u"), F.col("doc").alias("v")), "links")

    banded = classes.select("rep", F.explode("bands").alias("key"))
    buckets = written(banded.groupBy("key").agg(F.count("*").alias("count"), F.min("rep").alias("pivot")).where("count > 1"), "buckets")
    members = join_sized(banded, buckets.select("key", "pivot"), "key", n * banding(percent)[0], buckets.count(), counts=buckets.select("key", "count"))
    members = written(members, "members")
    size = members.count()
    ids = written(members.select(F.col("rep").alias("doc")).distinct(), "ids")
    sets = written(_sets(own, ids, k), "sets")

    pairs = written(members.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct(), "pairs")
    links = links.unionByName(written(_linked(pairs, pairs.count(), sets, percent), "links"))
    found = components(links)

    # Buckets whose members are still apart.
    labels = found.withColumnsRenamed({"node": "rep", "component": "label"})
    placed = join_sized(members.select("key", "rep"), labels, "rep", size, labels.count(), "left")
    placed = placed.withColumn("label", F.coalesce("label", "rep"))
    mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("count")).where("low <> high")
    mixed = written(mixed.select("key", "count"), "mixed")
    apart = join_sized(placed, mixed.select("key"), "key", size, mixed.count(), counts=mixed).select(F.col("rep").alias("doc"), "label").distinct()
    rest = written(apart.join(sets.hint("merge"), "doc"), "rest")
    new = written(_across(rest, percent).distinct().join(pairs.hint("merge"), ["u", "v"], "left_anti"), "pairs")
    if n_new := new.count():
        more = written(_linked(new, n_new, sets, percent), "links")
        if more.limit(1).count():
            found = components(links.unionByName(more))
    out = join_sized(rows.drop("bands", "set_key"), found.select(F.col("node").alias("doc"), "component"), "doc", n, found.count(), "left")
    component = F.coalesce("component", "doc")
    return out.select(F.col("doc").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("doc"), F.lit(True)).alias("kept"))


def first_of_each(docs: DataFrame, k: int = SHINGLE_WORDS, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows, with all columns, that are the first of their group. Of rows with the same id, which are one document to
    groups(), one of each different text stays."""
    found = written(groups(docs, k, percent, id_col, text_col), "groups")
    gone = found.where(~F.col("kept")).select(id_col).distinct()
    left = by_ids(docs, gone, gone.count(), "left_anti")
    if found.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count():
        left = left.where(F.col(id_col).isNull()).unionByName(left.where(F.col(id_col).isNotNull()).dropDuplicates([id_col, text_col]))
    return left.select(*docs.columns)
