"""Incremental ingest: what to do with each seed and fetch result, and keyed upserts into snapshots.

Fetching itself is outside the engine: results come as a table or a stream (url_norm, status, body, etag,
last_modified, retry_after, fetched_at_unix). `now` is a parameter, so decisions can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions.text import content_hash, decoded
from textloom.functions.url import host, host_allowed, normalize_url
from textloom.sources.config import Config, Http, Recrawl


def sources_table(spark, config: Config) -> DataFrame:
    """(source, allowed_domains): a row for each configured source, so it can be broadcast."""
    return spark.createDataFrame([(s.name, list(s.allowed_domains)) for s in config.sources], "source string, allowed_domains array<string>")


def plan_fetches(seeds: DataFrame, sources: DataFrame, existing: DataFrame, recrawl: Recrawl, now: int, rules=None) -> DataFrame:
    """Seeds (url, source) with url_norm, host, decision and the headers of a conditional request.

    decision: unknown_source, bad_url, host_not_allowed, not_due, or fetch. existing: (url_norm, etag,
    last_modified, content_hash, fetched_at_unix), one row for each url_norm."""
    norm = normalize_url(F.col("url")) if rules is None else normalize_url(F.col("url"), rules)
    own = seeds.select("url", "source", norm.alias("url_norm")).withColumn("host", host(F.col("url_norm")))
    known = own.join(F.broadcast(sources), "source", "left")
    old = existing.select("url_norm", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"), F.coalesce("fetched_at_unix", F.lit(0)).alias("_at"))
    joined = known.join(old, "url_norm", "left")
    there = F.col("_at").isNotNull()
    due = ~there | F.lit(not recrawl.enabled) | (F.lit(now) - F.col("_at") >= F.lit(int(recrawl.revisit_after_hours * 3600)))
    decision = (
        F.when(F.col("allowed_domains").isNull(), "unknown_source")
        .when(F.col("url_norm").isNull(), "bad_url")
        .when(~host_allowed(F.col("host"), F.col("allowed_domains")), "host_not_allowed")
        .when(~due, "not_due")
        .otherwise("fetch")
    )
    ask = (F.col("_decision") == "fetch") & there & F.lit(recrawl.enabled and recrawl.only_if_changed)
    return joined.withColumn("_decision", decision).select(
        "url",
        "url_norm",
        "source",
        "host",
        F.col("_decision").alias("decision"),
        F.when(ask & F.lit(recrawl.use_etag), F.col("_etag")).alias("if_none_match"),
        F.when(ask & F.lit(recrawl.use_last_modified), F.col("_modified")).alias("if_modified_since"),
    )


def route(results: DataFrame, existing: DataFrame, recrawl: Recrawl, http: Http = Http()) -> DataFrame:  # noqa: B008
    """Fetch results with content_hash and action: retry (429), unchanged (304 or equal content), too_large, failed
    (any other status than 200), or store."""
    old = existing.select("url_norm", F.col("content_hash").alias("_hash"))
    size = F.octet_length("body")
    compare = F.lit(recrawl.enabled and recrawl.only_if_changed and recrawl.use_content_hash)
    hashed = F.when(F.lit(recrawl.use_content_hash), content_hash(F.col("body")))
    action = (
        F.when(F.col("status") == 429, "retry")
        .when(F.col("status") == 304, "unchanged")
        .when(F.coalesce(F.col("status") != 200, F.lit(True)), "failed")
        .when(size > http.max_response_bytes, "too_large")
        .when(compare & F.col("_hash").isNotNull() & (F.col("_hash") == F.col("content_hash")), "unchanged")
        .otherwise("store")
    )
    return results.withColumn("content_hash", hashed).join(old, "url_norm", "left").withColumn("action", action).drop("_hash")


def next_attempts(routed: DataFrame, http: Http, now: int) -> DataFrame:
    """Rows to retry, whose attempts (a column) are not used up, with attempts and next_attempt_at: after the wait
    that the host names, or the default one, and a share of a second by the URL's hash. The rest are dead letters."""
    wait = F.coalesce(F.expr("try_cast(retry_after AS double)"), F.lit(http.too_many_wait_sec))
    spread = F.pmod(F.xxhash64("url_norm"), F.lit(1000)) / 1000.0
    tried = F.coalesce("attempts", F.lit(0)) + 1
    return (
        routed.where("action = 'retry'")
        .withColumn("attempts", tried)
        .withColumn("dead", F.col("attempts") > http.too_many_retries)
        .withColumn("next_attempt_at", F.when(~F.col("dead"), F.lit(float(now)) + wait + spread))
    )


def backoff(http: Http, attempt: Column) -> Column:
    """Seconds before the attempt after a broken connection: linear, null once the retries are used up."""
    return F.when(attempt <= http.retries, F.lit(http.backoff_sec) * attempt)


def pages_of(routed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Routed results as rows of raw pages: stored ones whole, unchanged ones with the time alone. keep: other columns."""
    stored = F.col("action") == "store"
    return routed.where(F.col("action").isin("store", "unchanged")).select(
        F.col("url_norm").alias("url"),
        "url_norm",
        F.when(stored, decoded(F.col("body"))).alias("html"),
        F.when(stored, F.col("source_name")).alias("source_name"),
        "fetched_at_unix",
        F.when(stored, F.col("etag")).alias("etag"),
        F.when(stored, F.col("last_modified")).alias("last_modified"),
        F.when(stored, F.col("content_hash")).alias("content_hash"),
        *keep,
    )


def newest(rows: DataFrame, key: str, time_col: str, place: str | None = None) -> DataFrame:
    """One row for each key: of each column the last value that is not null, as if the rows were applied one after the
    other. Of rows of one time that with the least `place` (a column of numbers that the result lacks) is the last, or
    without one that with the largest hash of all its columns, so values of one row stay together. A partial aggregate,
    so hot keys do not meet whole."""
    kept = [c for c in rows.columns if c != place]
    turn = F.struct(F.col(time_col), *([-F.col(place)] if place else []), F.xxhash64(*kept))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_turn")))
    values = [F.max(c).alias(c) if c == time_col else last(c).alias(c) for c in kept if c != key]
    return rows.withColumn("_turn", turn).groupBy(key).agg(*values).select(*kept)


def upsert(old: DataFrame, new: DataFrame, key: str = "url_norm", time_col: str = "fetched_at_unix", bare: tuple[str, ...] = ("url",), place: str | None = None) -> DataFrame:
    """The next snapshot: new rows, in the order of their times, replace old ones of their key, value by value where they
    have one, so a value that a new row lacks survives. Rows without values (but the key, the time and those that
    `bare` names) touch a key that is there and make no new one. Applying the same rows twice changes nothing more.
    place: as newest() takes it, a column of new alone."""
    fresh = newest(new, key, time_col, place)
    l, r = old.alias("o"), fresh.alias("n")
    merged = l.join(r, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    there = F.col(f"o.{key}").isNotNull()
    for c in old.columns:
        if c not in (key, time_col, *bare):
            there = there | F.col(f"n.{c}").isNotNull()
    return merged.where(there).select(*[F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns])


def capped_seeds(seeds: DataFrame, most: int, order: list[str]) -> DataFrame:
    """The first `most` seeds in an order (max_unique_docs of the configuration)."""
    return seeds.orderBy(*order).limit(most)


def counters(routed: DataFrame, source_col: str = "source_name") -> DataFrame:
    """(source_name, processed, ok, unchanged, failed)."""
    return routed.groupBy(F.col(source_col).alias("source_name")).agg(
        F.count("*").alias("processed"),
        F.count_if(F.col("action").isin("store", "unchanged")).alias("ok"),
        F.count_if(F.col("action") == "unchanged").alias("unchanged"),
        F.count_if(F.col("action").isin("failed", "too_large")).alias("failed"),
    )


#: Rows of a host that one task numbers.
ROWS_PER_SHARE = 10_000


def paced(fetches: DataFrame, delay_sec: float = 0.8, concurrency: int = 2) -> DataFrame:
    """Planned fetches with start_after: seconds from the run's start, so spaced that a host gets a request each
    delay_sec / concurrency at most. Hosts with many rows are numbered in shares, so no task gets a whole one."""
    shares = fetches.groupBy("host").agg(F.ceil(F.count("*") / ROWS_PER_SHARE).cast("int").alias("_shares"))
    large = F.broadcast(shares.where("_shares > 1")) if shares.where("_shares > 1").count() < 10_000 else shares.where("_shares > 1")
    own = fetches.join(large, "host", "left").withColumn("_shares", F.coalesce("_shares", F.lit(1)))
    own = own.withColumn("_share", F.pmod(F.xxhash64("url_norm"), F.col("_shares")))
    place = F.row_number().over(Window.partitionBy("host", "_share").orderBy("url_norm")) - 1
    turn = place * F.col("_shares") + F.col("_share")
    return own.withColumn("start_after", F.floor(turn / concurrency) * delay_sec).drop("_shares", "_share")


def low_watermark(progress: DataFrame, index_col: str = "idx", done_col: str = "done") -> DataFrame:
    """(next_idx): the first index that is not done, so that a run that resumes there skips nothing."""
    return progress.agg(F.coalesce(F.min(F.when(~F.col(done_col), F.col(index_col))), F.max(index_col) + 1, F.lit(0)).alias("next_idx"))
