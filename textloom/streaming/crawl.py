"""Requests turned away as too many: attempts of each URL and the waits of hosts, kept as streaming state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.sources.config import Http

RESULT = "host string, url_norm string, attempts int, next_attempt_at double, dead boolean"
TOO_MANY = 429


def retries(results: DataFrame, http: Http = Http()) -> DataFrame:  # noqa: B008
    """For a stream (host, url_norm, status, retry_after double, at double) the URLs to try again.

    Each URL has http.too_many_retries attempts, after which it is a dead letter, and waits as long as its answer says;
    how long its host asks to wait, host_waits() says. The state is one number for a URL that is being retried, so
    a host with many URLs is spread over all tasks; it goes when the URL is answered or dead. It survives restarts with
    the checkpoint. (A timeout by the clock would keep availableNow triggers running for ever.)"""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tried, out = (state.get[0] if state.exists else 0), []
        for frame in frames:
            waits = frame["retry_after"].fillna(http.too_many_wait_sec)
            for status, at, wait in zip(frame["status"].tolist(), frame["at"].tolist(), waits.tolist(), strict=True):
                if status != TOO_MANY:
                    tried = 0
                    continue
                tried += 1
                dead = tried > http.too_many_retries
                out.append((*key, tried, None if dead else at + wait, dead))
                if dead:
                    tried = 0
        if tried:
            state.update((tried,))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["host", "url_norm", "attempts", "next_attempt_at", "dead"])

    return results.groupBy("host", "url_norm").applyInPandasWithState(step, RESULT, "tried int", "append", GroupStateTimeout.NoTimeout)


def host_waits(results: DataFrame, http: Http = Http()) -> DataFrame:  # noqa: B008
    """(host, until): when each host may be asked again, the latest that its answers say. A built-in aggregate: partial
    sums come first, so no task sees all rows of a host. Of a stream its updates."""
    until = F.col("at") + F.coalesce("retry_after", F.lit(http.too_many_wait_sec))
    return results.where(F.col("status") == TOO_MANY).groupBy("host").agg(F.max(until).alias("until"))
