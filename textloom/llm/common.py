"""What the operators of this subpackage share: limits on what Python holds at once, joins that survive hot keys,
and words as flat numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.sources.scratch import limit_batches as bound_batches
from textloom.sources.scratch import remove_written, shared_dir, written
from textloom.sources.session import ship_package

#: Bytes of text that one numpy pass works on; a longer single text is a pass of its own.
CHUNK_BYTES = 1 << 20
#: Seed of samples.
SEED = 17


def limit_batches(spark: SparkSession) -> None:
    """Let executors run this package, on Arrow batches of bounded size."""
    ship_package(spark)
    bound_batches(spark)


#: Partitions for each core that dealt() makes.
SHARES = 4


def dealt(rows: DataFrame) -> DataFrame:
    """The rows of a table of files, dealt to all cores if one task would read over twice its share of them, as where a file
    has one large row group (such a file has many splits, but only one of them has rows); else nothing is shuffled. Rows are
    counted by the files' footers. The dealing needs no sort, so its task holds little besides the row group."""
    counts = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not counts or max(counts) * cores <= 2 * sum(counts):
        return rows
    bound_batches(rows.sparkSession)
    return rows.withColumn("_place", F.monotonically_increasing_id()).repartition(SHARES * cores, "_place").drop("_place")


def fold(id_col: str, n: int) -> F.Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def join_hot(left: DataFrame, right: DataFrame, key: str, total: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has each key a few times at most.

    Keys that hold over a thousandth of left's `total` rows, of which there are 1000 at most (so
    they can be broadcast), are dealt to as many salts as needed; right's rows of these keys are
    copied to each salt. No task gets a key with a third of all rows. counts: (key, count) of left,
    if that is known."""
    limit = max(64, total // 1000)
    counts = left.groupBy(key).count() if counts is None else counts
    hot = F.broadcast(counts.where(F.col("count") > limit).select(F.col(key), F.ceil(F.col("count") / limit).cast("int").alias("_n")))
    salt = F.coalesce(F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.col("_n")), F.lit(0)).cast("int")
    l = left.join(hot, key, "left").withColumn("_salt", salt).drop("_n")
    r = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_n"), F.lit(1)) - 1))).drop("_n")
    return l.join(r, [key, "_salt"], how).drop("_salt")


#: Rows of a few numbers that may be broadcast (some 16 MB); beyond that, joins shuffle.
BROADCAST_IDS = 1_000_000


def join_sized(left: DataFrame, right: DataFrame, key: str, total: int, n: int, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """As join_hot(), but without a shuffle where right's n rows, of a few numbers each, may be broadcast."""
    if n <= BROADCAST_IDS:
        return left.join(F.broadcast(right), key, how)
    return join_hot(left, right, key, total, how, counts)


def by_ids(rows: DataFrame, ids: DataFrame, n: int, how: str) -> DataFrame:
    """rows semi- or anti-joined (how) with n distinct ids, a table of one column."""
    (key,) = ids.columns
    return rows.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, key, how)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column as one uint8 array and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """batch in runs of rows whose texts take `limit` bytes together, or one row that takes more."""
    _, offs = text_bytes(batch.column(column))
    at = 0
    while at < len(batch):
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


#: The ASCII white space that separates words, and A-Z in lower case.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_alnum: list[np.ndarray] = []
_rng = np.random.Generator(np.random.PCG64(20240607))
_BYTE = _rng.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all others (a bijection)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 1), _BASE, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def letters_and_digits(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters and digits of any script."""
    if not _alnum:
        _alnum.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    out = _alnum[0][:256][data] & (data < 128)
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead]
        size = 1 + (first >= 0xC0) + (first >= 0xE0) + (first >= 0xF0)
        code = first & np.array([0, 0, 0x1F, 0x0F, 0x07], np.uint8)[size]
        code = code.astype(np.int64)
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | data[lead[more] + k] & 0x3F
        word = _alnum[0][code]
        for k in range(4):
            out[lead[word & (size > k)] + k] = True
    return out


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE, inside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word in data, and for each text the number of the first word at or
    after its start (one more at the end). inside: which bytes belong to words, if not all but space."""
    inside = ~space[data] if inside is None else inside
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start = inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; the same on every machine and in every run."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    first = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=first[1:])
    pos = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    at = pos + np.repeat(starts, lengths)
    sums = np.add.reduceat(_BYTE[data[at]] * _powers(int(lengths.max()))[pos], first)
    return mix(sums + lengths.astype(np.uint64))


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each k words that follow each other."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : len(words) - k + 1 + i]
    return mix(out)


def sequence_hash(words: np.ndarray) -> np.uint64:
    """A 64-bit hash of all words in order."""
    return mix(np.atleast_1d((words * _powers(len(words))).sum(dtype=np.uint64) + np.uint64(len(words))))[0]


def with_scores(docs: DataFrame, id_col: str, text_col: str, judge, fields: list[tuple[str, pa.DataType]], extra: dict[str, F.Column] | None = None) -> DataFrame:
    """(id, extra columns, fields) of each row, under whatever names. judge() is called once in a task and gives a
    function from an Arrow array of texts to one array for each field."""
    from pyspark.sql.pandas.types import from_arrow_type
    from pyspark.sql.types import StructField, StructType

    limit_batches(docs.sparkSession)
    extra = extra or {}
    own = docs.select(*[c.alias(f"c{i}") for i, c in enumerate([F.col(id_col), *extra.values(), F.col(text_col)])])
    kept = own.columns[:-1]
    names = [*kept, *[f"f{i}" for i in range(len(fields))]]

    def run(batches):
        of = judge()
        for batch in batches:
            for part in slices(batch, f"c{len(kept)}"):
                got = of(part.column(len(kept)))
                columns = part.columns[:-1] + [g if isinstance(g, pa.Array) else pa.array(g, t) for g, (_, t) in zip(got, fields, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = StructType([own.schema[n] for n in kept] + [StructField(f"f{i}", from_arrow_type(t)) for i, (_, t) in enumerate(fields)])
    return own.mapInArrow(run, schema).toDF(id_col, *extra, *[n for n, _ in fields])


def kept_rows(docs: DataFrame, text_col: str, judge) -> DataFrame:
    """The rows, with all their columns, whose texts judge()'s function keeps (an array of booleans)."""
    limit_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches):
        of = judge()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part in slices(batch, f"c{at}"):
                yield pa.RecordBatch.from_arrays(part.filter(pa.array(np.asarray(of(part.column(at)), bool))).columns, names)

    names = docs.columns
    return docs.mapInArrow(run, docs.schema)


def bounded_sample(rows: DataFrame, bound: int, key: str | None = None, by: str | None = None) -> DataFrame:
    """About `bound` rows (for each value of `by`, of which null has none); all rows if there are fewer.

    With a key, whose values must be distinct, its hash chooses them. Without one a random number does, since a hash would
    take repeated rows all or none; its seed is fixed, so equal scans give equal samples."""
    share = F.rand(SEED) if key is None else F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    if by is None:
        return rows.where(share < min(1.0, bound / max(1, rows.count())))
    limits = written(rows.where(F.col(by).isNotNull()).groupBy(by).agg((F.lit(float(bound)) / F.count("*")).alias("_limit")), "limits")
    chosen = rows.withColumn("_share", share)
    joined = chosen.join(F.broadcast(limits) if limits.count() <= BROADCAST_IDS // 16 else limits.hint("merge"), by)
    return joined.where("_share < _limit").select(*rows.columns)
