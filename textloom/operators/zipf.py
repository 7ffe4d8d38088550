"""Rank-frequency laws of a lexicon (rank, term, freq)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit(lexicon: DataFrame, first: int = 10, last: int = 10_000) -> DataFrame:
    """(s, c): freq = c * rank ** -s by least squares of the logarithms over ranks first to last."""
    own = lexicon.where(F.col("rank").between(first, last) & (F.col("freq") > 0))
    x, y = F.log(F.col("rank").cast("double")), F.log(F.col("freq").cast("double"))
    return own.agg((-F.regr_slope(y, x)).alias("s"), F.exp(F.regr_intercept(y, x)).alias("c"))


def curves(lexicon: DataFrame, first: int = 10, last: int = 10_000) -> DataFrame:
    """(rank, freq, theory, fitted): the law with s = 1 through the first rank, and the fitted one. The two
    constants are one row, so the join is a broadcast of it."""
    top = lexicon.agg(F.max_by("freq", -F.col("rank")).cast("double").alias("f1"))
    rank = F.col("rank").cast("double")
    joined = lexicon.join(F.broadcast(top)).join(F.broadcast(fit(lexicon, first, last)))
    return joined.select("rank", "freq", (F.col("f1") / rank).alias("theory"), (F.col("c") * F.pow(rank, -F.col("s"))).alias("fitted"))


def plot(curve: DataFrame, path: str) -> None:
    """A log-log picture of curves(), where matplotlib is installed."""
    import matplotlib

    matplotlib.use("Agg")
    from matplotlib import pyplot

    # Ranks on a geometric grid suffice for the eye, and bound what comes to the driver.
    grid = curve.where((F.col("rank") <= 100) | (F.floor(F.log(F.col("rank")) * 50) != F.floor(F.log(F.col("rank") - 1) * 50))).orderBy("rank").toPandas()
    figure, axes = pyplot.subplots()
    axes.loglog(grid["rank"], grid["freq"], ".", label="corpus")
    axes.loglog(grid["rank"], grid["theory"], "-", label="s = 1")
    axes.loglog(grid["rank"], grid["fitted"], "--", label="fit")
    axes.legend()
    figure.savefig(path, dpi=200)
