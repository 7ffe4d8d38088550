"""Seed pages by a bounded walk through a category graph, and their division between two sources."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.url import page_url, title_key
from textloom.sources.scratch import written

#: The namespaces of pages and of categories.
MAIN, CATEGORY = 0, 14


def member_edges(links: DataFrame, targets: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Category to category, and category to page, as (parent, child), from link tables:
    links (cl_from, cl_type, cl_target_id), targets (lt_id, lt_namespace, lt_title), pages (page_id, page_namespace,
    page_title, page_is_redirect). A category is its target's id; of equal targets the least counts."""
    kind = F.lower(F.trim(F.col("cl_type").cast("string")))
    own = links.select(F.col("cl_target_id").alias("parent"), F.col("cl_from").alias("page_id"), kind.alias("kind"))
    categories = targets.where(F.col("lt_namespace") == CATEGORY).groupBy(F.col("lt_title").alias("title")).agg(F.min("lt_id").alias("child"))
    titled = pages.where(F.col("page_namespace") == CATEGORY).select("page_id", title_key(F.col("page_title").cast("string")).alias("title"))
    below = own.where("kind = 'subcat'").join(titled, "page_id").join(categories, "title").select("parent", "child").distinct()
    return below, own.where("kind = 'page'").select("parent", F.col("page_id").alias("child"))


def reachable(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(id, depth) of all nodes at most max_depth steps from the roots (a column id), at their least depth.

    Each step joins the frontier with the edges and takes what is new; each level is written once, so the lineage
    stays short and nothing is written again."""
    visited = frontier = written(roots.select("id", F.lit(0).alias("depth")).distinct(), "level")
    for depth in range(1, max_depth + 1):
        found = frontier.join(edges, F.col("id") == F.col("parent")).select(F.col("child").alias("id")).distinct()
        frontier = written(found.join(visited.select("id"), "id", "left_anti").select("id", F.lit(depth).alias("depth")), "level")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def seeds(categories: DataFrame, members: DataFrame, pages: DataFrame, domain: str, source: str, limit: int | None = None, main_only: bool = True, no_redirects: bool = True) -> DataFrame:
    """(url, title, page_id, namespace, source, depth) of the pages in reachable categories, each at its least
    depth; with a limit the first in order of depth and id. Without categories there are none."""
    at = members.join(categories, F.col("parent") == F.col("id")).groupBy(F.col("child").alias("page_id")).agg(F.min("depth").alias("depth"))
    own = at.join(pages, "page_id")
    if main_only:
        own = own.where(F.col("page_namespace") == MAIN)
    if no_redirects:
        own = own.where(F.coalesce(F.col("page_is_redirect"), F.lit(0)) != 1)
    title = F.col("page_title").cast("string")
    out = own.select(page_url(F.lit(domain), title).alias("url"), title.alias("title"), "page_id", F.col("page_namespace").cast("int").alias("namespace"), F.lit(source).alias("source"), "depth")
    return out if limit is None else out.orderBy("depth", "page_id").limit(limit)


@dataclass(frozen=True)
class Quota:
    """How many seeds of the first and of the second source are taken."""

    first: int
    second: int

    @staticmethod
    def of(n_first: int, n_second: int, most_of_first: int, total: int) -> Quota:
        """The first source fills its share, the second what is left, and the first what is left then."""
        first = min(most_of_first, n_first, total)
        second = min(n_second, total - first)
        return Quota(first + min(n_first - first, total - first - second), second)


def divided(one: DataFrame, two: DataFrame, most_of_first: int, total: int, shuffle_seed: int | None = None) -> DataFrame:
    """The seeds of both sources by quota, in an order that the seed alone decides (or by depth and id)."""
    quota = Quota.of(one.count(), two.count(), most_of_first, total)
    order = [F.xxhash64("url", F.lit(shuffle_seed)), "page_id"] if shuffle_seed is not None else ["depth", "page_id"]
    return one.orderBy(*order).limit(quota.first).unionByName(two.orderBy(*order).limit(quota.second))
