"""Boolean retrieval over postings."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import snippet
from textloom.operators.index import postings_of
from textloom.plans.boolean import evaluate, matches_nothing, parse, terms


def _predicate(tree: Any, flags: dict[str, Column]) -> Column:
    return evaluate(tree, lambda t: flags.get(t, F.lit(False)), lambda a, b: a & b, lambda a, b: a | b, lambda a: ~a)


def search(postings: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """(doc_id) of the documents that match, by one scan of the query's postings and one aggregation: a flag for each
    term, or if there are more than FLAGS the set of terms found, which is no longer than the query.

    Only if documents with none of the terms match as well (a leading NOT, say) all ids are joined."""
    tree = parse(query)
    found = list(terms(tree))
    if not found:
        return docs.select("doc_id") if matches_nothing(tree) else docs.select("doc_id").limit(0)
    hits, flags = _flagged(postings, found)
    if matches_nothing(tree):
        hits = docs.select("doc_id").join(hits, "doc_id", "left")
    return hits.where(_predicate(tree, flags)).select("doc_id")


#: Terms that have a column each.
FLAGS = 64


def _flagged(postings: DataFrame, found: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """The documents that have any of the terms, and for each term whether a document has it."""
    hits = postings.where(F.col("term").isin(found)).groupBy("doc_id")
    if len(found) > FLAGS:
        return hits.agg(F.collect_set("term").alias("_found")), {t: F.coalesce(F.array_contains("_found", t), F.lit(False)) for t in found}
    names = {t: f"_t{i}" for i, t in enumerate(found)}
    return hits.agg(*[F.max(F.col("term") == t).alias(n) for t, n in names.items()]), {t: F.coalesce(F.col(n), F.lit(False)) for t, n in names.items()}


def search_texts(docs: DataFrame, query: str, text_col: str = "clean_text") -> DataFrame:
    """search() without an index: one scan of the texts, of which only tokens that can be the query's terms are kept."""
    return search(postings_of(docs, list(terms(parse(query))), text_col), docs, query)


def search_by_sets(postings: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """As search(), by set operations on the postings of each term: the literal form, to check the other by."""
    everything = docs.select("doc_id").distinct()

    def flag(term: str | None) -> DataFrame:
        return postings.where(F.col("term") == term).select("doc_id") if term is not None else everything.limit(0)

    return evaluate(parse(query), flag, intersection, union, lambda a: difference(everything, a))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.union(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def sorted_sets(a: Column, b: Column) -> dict[str, Column]:
    """The set operations on arrays of ids, sorted: array functions alone keep the order of occurrence."""
    return {"both": F.array_sort(F.array_intersect(a, b)), "either": F.array_sort(F.array_union(a, b)), "first": F.array_sort(F.array_except(a, b))}


def display(hits: DataFrame, docs: DataFrame, n: int = 5) -> DataFrame:
    """(doc_id, source_name, snippet) of the first n hits in id order. Only these n are joined, so they can be
    broadcast; documents without text show an empty snippet."""
    top = hits.orderBy("doc_id").limit(n)
    shown = docs.select("doc_id", "source_name", snippet(F.col("clean_text")).alias("snippet"))
    return shown.join(F.broadcast(top), "doc_id").select("doc_id", "source_name", "snippet").orderBy("doc_id")


def search_many(postings: DataFrame, docs: DataFrame, queries: dict[str, str]) -> DataFrame:
    """(query, doc_id) for several named queries in one scan of the postings."""
    trees = {name: parse(q) for name, q in queries.items()}
    found = list(dict.fromkeys(t for tree in trees.values() for t in terms(tree)))
    hits, flags = _flagged(postings, found) if found else (docs.select("doc_id"), {})
    if found and any(matches_nothing(t) for t in trees.values()):
        hits = docs.select("doc_id").join(hits, "doc_id", "left")
    matched = F.array_compact(F.array(*[F.when(_predicate(tree, flags), F.lit(name)) for name, tree in trees.items()]))
    return hits.select(F.explode(matched).alias("query"), "doc_id")


def all_of(postings: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id) of the documents that have all terms."""
    return reduce(intersection, [postings.where(F.col("term") == w).select("doc_id") for w in words])
