"""Counting, metrics, facets and choice per group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cleaning import percentage


def count_map(df: DataFrame, by: str, group: Sequence[str] = ()) -> DataFrame:
    """Per group, ``counts``: an array of (key, n), most frequent first, then by key. Null keys are left out.

    Counting precedes the collecting, so an array holds one entry for each distinct key only.
    """
    counted = df.filter(F.col(by).isNotNull()).groupBy(*group, F.col(by).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "key")))
    entries = F.transform(ordered, lambda x: F.struct(x["key"].alias("key"), (-x["m"]).alias("n")))
    return counted.groupBy(*group).agg(entries.alias("counts"))


def counts_long(df: DataFrame, columns: Mapping[str, str], group: Sequence[str] = ()) -> DataFrame:
    """The same for several columns at once, one row per (group, metric, key): a single pass and shuffle."""
    entries = F.explode(F.array(*[F.struct(F.lit(metric).alias("metric"), F.col(c).cast("string").alias("key")) for metric, c in columns.items()]))
    return df.select(*group, entries.alias("_e")).select(*group, "_e.metric", "_e.key").filter("key is not null").groupBy(*group, "metric", "key").agg(F.count(F.lit(1)).alias("n"))


def dataset_metrics(df: DataFrame, group: str, name: str, synonym: Column, matched: Column) -> DataFrame:
    """Per data set: rows, synonyms, distinct names, matched rows and their share."""
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("count_usages"),
        F.sum(synonym.cast("long")).alias("count_synonyms"),
        F.countDistinct(name).alias("count_names"),
        F.sum(matched.cast("long")).alias("count_nub"),
    ).withColumn("nub_coverage", percentage(F.col("count_nub"), F.col("count_usages")))


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first in the order. A max over structs would drop ties' columns, a window keeps whole rows."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter("_rn = 1").drop("_rn")


def first_values(df: DataFrame, keys: Sequence[str], order: Column, values: Sequence[str]) -> DataFrame:
    """``latest`` for few columns, by a partial aggregate: hot keys shrink before the shuffle."""
    return df.groupBy(*keys).agg(*[F.min_by(v, order).alias(v) for v in values])


def priority(df: DataFrame, keys: Sequence[str], order: Sequence[Column], mark: str = "is_primary") -> DataFrame:
    """Mark the best row of each group; the rest are redundant."""
    return df.withColumn(mark, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)


def best_with_margin(df: DataFrame, keys: Sequence[str], score: str, tie: Sequence[Column], keep: int = 1) -> DataFrame:
    """The best rows of each group, and by how much each beats the next."""
    w = Window.partitionBy(*keys).orderBy(F.col(score).desc(), *tie)
    ranked = df.withColumn("place", F.row_number().over(w)).withColumn("margin", F.col(score) - F.lead(score).over(w))
    return ranked.filter(F.col("place") <= keep)


def alike_but_apart(df: DataFrame, keys: Sequence[str], score: str, threshold: float, column: str) -> DataFrame:
    """Per group, whether rows within ``threshold`` of the best differ in a column."""
    best = df.withColumn("_best", F.max(score).over(Window.partitionBy(*keys)))
    close = best.filter(F.col("_best") - F.col(score) <= threshold)
    return close.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_close"), F.countDistinct(column).alias("n_values")).withColumn("ambiguous", F.col("n_values") > 1)


def match_summary(df: DataFrame, matched: Column, parsable: Column, relevant: Column, group: Sequence[str] = ()) -> DataFrame:
    """Totals, matches and whole percentages; a percentage of nothing is 100."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    whole = lambda a, b: F.when(b == 0, F.lit(100)).otherwise(F.floor(a * 100 / b)).cast("long")
    out = df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("total"), n(matched).alias("matches"), n(~parsable).alias("unparsable"), n(relevant).alias("relevant"), n(relevant & matched).alias("relevant_matches")
    )
    return out.withColumn("perc_matches", whole(F.col("matches"), F.col("total"))).withColumn("perc_relevant", whole(F.col("relevant_matches"), F.col("relevant")))


def facet_counts(df: DataFrame, facet: str, min_count: int = 1, limit: int | None = None, offset: int = 0) -> DataFrame:
    """(value, n) of a facet, most frequent first; a limit is the caller's page."""
    counted = df.filter(F.col(facet).isNotNull()).groupBy(F.col(facet).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)
    if limit is None:
        return counted
    return counted.orderBy(F.col("n").desc(), "value").offset(offset).limit(limit)


def facets(df: DataFrame, filters: Mapping[str, Column], names: Sequence[str], multi_select: bool = False, min_count: int = 1) -> DataFrame:
    """(facet, value, n) for several facets in one pass.

    With ``multi_select`` a facet ignores its own filter and keeps the others: a row counts for a facet
    if every other filter holds. Else all filters hold for all.
    """
    flags = {k: F.coalesce(c, F.lit(False)) for k, c in filters.items()}
    every = lambda cs: reduce(lambda a, b: a & b, cs, F.lit(True))
    entries = []
    for name in names:
        asked = every([c for k, c in flags.items() if not (multi_select and k == name)])
        entries.append(F.when(asked & F.col(name).isNotNull(), F.struct(F.lit(name).alias("facet"), F.col(name).cast("string").alias("value"))))
    exploded = df.select(F.explode(F.array_compact(F.array(*entries))).alias("_e")).select("_e.facet", "_e.value")
    return exploded.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def grouped_children(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Extension rows of each key as one array of structs, in the columns' order."""
    return df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("items"))


def table_of_contents(df: DataFrame, language: str, topic: str, id_col: str) -> DataFrame:
    return df.groupBy(language, topic).agg(F.sort_array(F.collect_list(id_col)).alias("keys"))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
