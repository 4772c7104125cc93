"""Reads, joins, ordering, paging, set operations and keyed writes on usage-like tables.

Every function takes and returns DataFrames; Catalyst picks the joins. Tables follow the shape
``id, parent, rank, is_synonym, deleted, name...`` but all column names are parameters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import ordinal
from ..sources.tables import materialize

#: Deepest row that a page may reach.
MAX_OFFSET = 100_000


def current(df: DataFrame, deleted: str = "deleted") -> DataFrame:
    """Rows that are not deleted logically."""
    return df.filter(F.col(deleted).isNull())


def roots(df: DataFrame, parent: str = "parent", synonym: str | None = "is_synonym") -> DataFrame:
    """Rows without a parent that are no synonyms."""
    return df.filter(F.col(parent).isNull() & (~F.col(synonym) if synonym else F.lit(True)))


def children(df: DataFrame, key, parent: str = "parent", synonym: str | None = "is_synonym") -> DataFrame:
    """Accepted rows below one parent."""
    return df.filter((F.col(parent) == key) & (~F.col(synonym) if synonym else F.lit(True)))


def synonyms(df: DataFrame, key, parent: str = "parent", synonym: str = "is_synonym") -> DataFrame:
    return df.filter((F.col(parent) == key) & F.col(synonym))


def combinations(df: DataFrame, key, original: str = "basionym", id_col: str = "id") -> DataFrame:
    """Other rows that name this one as their original."""
    return df.filter((F.col(original) == key) & (F.col(id_col) != key))


def until_rank(df: DataFrame, rank: str, rank_col: str = "rank") -> DataFrame:
    """Rows of the rank and above, by the order of ranks."""
    return df.filter(ordinal(F.col(rank_col)) <= ordinal(F.lit(rank)))


def stale(df: DataFrame, before, column: str) -> DataFrame:
    return df.filter(F.col(column) < before)


def key_range(df: DataFrame, start, end, column: str = "id") -> DataFrame:
    return df.filter(F.col(column).between(start, end))


def excluding(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Rows whose value is none of a fixed list; null values go, as in SQL."""
    return df.filter(~F.col(column).isin(*values))


def named(df: DataFrame, name: str, column: str) -> DataFrame:
    """Look-up regardless of case."""
    return df.filter(F.lower(column) == name.lower())


def by_digest(df: DataFrame, text: str, column: str) -> DataFrame:
    """Look-up of long texts by their MD5."""
    return df.filter(F.md5(column) == F.md5(F.lit(text)))


def having_value(df: DataFrame, column: str, value) -> DataFrame:
    return df.filter(F.array_contains(column, value))


def taxonomic_order(rank: Column | str, *names: str) -> list[Column]:
    """Higher ranks first, then names; null ranks last."""
    return [ordinal(F.col(rank) if isinstance(rank, str) else rank).asc(), *[F.col(n).asc_nulls_last() for n in names]]


def page(df: DataFrame, order: Sequence, offset: int, limit: int) -> DataFrame:
    """A page of a total order; deep pages are refused, as they read all rows before them."""
    if offset < 0 or limit < 0 or offset + limit > MAX_OFFSET:
        raise ValueError(f"offset and limit have to lie within {MAX_OFFSET}")
    return df.orderBy(*order).offset(offset).limit(limit)


def page_of(df: DataFrame, order: Sequence, size: int, column: str = "page") -> DataFrame:
    """Number the pages that rows fall on, from 1. The order is found by a range-partitioned sort: counts of
    the sorted partitions give each one's first number, so no single task sees all rows."""
    ordered = materialize(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()))
    counts = ordered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per partition
    numbered = ordered.join(F.broadcast(before), "_part").withColumn("_rn", F.col("_before") + F.col("_seq").bitwiseAND((1 << 33) - 1) + 1)
    return numbered.withColumn(column, F.ceil(F.col("_rn") / size).cast("long")).drop("_part", "_seq", "_before", "_rn")


def with_name(df: DataFrame, names: DataFrame, key: str, name_id: str, name: str, alias: str, how: str = "left") -> DataFrame:
    """Add the name that a key column refers to."""
    side = names.select(F.col(name_id).alias(f"_{alias}"), F.col(name).alias(alias))
    return df.join(side, F.col(key) == F.col(f"_{alias}"), how).drop(f"_{alias}")


def same_name(df: DataFrame, name: str, id_col: str, other: str = "other_id") -> DataFrame:
    """Pairs of different rows of one name."""
    side = df.select(F.col(name).alias("_name"), F.col(id_col).alias(other))
    return df.join(side, F.col(name) == F.col("_name")).filter(F.col(id_col) != F.col(other)).drop("_name")


def homonyms(df: DataFrame, name: str, id_col: str) -> DataFrame:
    """Names that several rows have: the number of ordered pairs and the least id, without making the pairs."""
    counted = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.countDistinct(id_col).alias("_n"), F.min(id_col).alias("least")).filter("_n > 1")
    return counted.select(name, (F.col("_n") * (F.col("_n") - 1)).alias("n_pairs"), "least")


def accepted_of(df: DataFrame, id_col: str = "id", parent: str = "parent", synonym: str = "is_synonym", name: str = "name", among: DataFrame | None = None) -> DataFrame:
    """What a synonym stores as parent is its accepted row: show that as such, and its parent as the parent.

    Accepted rows are looked for in ``among``, if given. Only synonyms are joined: the others, often without a parent, would
    all meet in the task of the null key.
    """
    acc = (df if among is None else among).select(F.col(id_col).alias("_aid"), F.col(parent).alias("_aparent"), F.col(name).alias("accepted"))
    kept = [c for c in df.columns if c != parent]
    linked = F.coalesce(F.col(synonym) & F.col(parent).isNotNull(), F.lit(False))
    types = dict(acc.dtypes)
    own = df.filter(~linked).select(*kept, parent, F.lit(None).cast(types["_aid"]).alias("accepted_id"), F.lit(None).cast(types["accepted"]).alias("accepted"))
    joined = df.filter(linked).join(acc, F.col(parent) == F.col("_aid"), "left")
    return own.unionByName(joined.select(*kept, F.col("_aparent").alias(parent), F.col("_aid").alias("accepted_id"), "accepted"))


def components_for(components: DataFrame, relations: DataFrame, sources: DataFrame, hidden: Sequence, usage: str = "usage_id", source_key: str = "source_key") -> DataFrame:
    """Records of checklist rows seen from the backbone rows they map to, with the source's title.

    ``relations`` is (usage, nub, source), ``sources`` (key, title). Hidden sources are left out.
    """
    rel = relations.filter(~F.col("source").isin(*hidden)) if hidden else relations
    joined = components.join(rel, F.col(usage) == F.col("usage")).join(sources.select(F.col("key").alias("_key"), F.col("title").alias("source_title")), F.col("source") == F.col("_key"), "left")
    return joined.withColumn("source_taxon_key", F.col("usage")).drop("_key", "usage")


def related(df: DataFrame, relations: DataFrame, nub, sources: Sequence | None = None, id_col: str = "id") -> DataFrame:
    """Rows mapped to one backbone row; given sources are alternatives, none means all."""
    rel = relations.filter(F.col("nub") == nub)
    if sources is not None:
        rel = rel.filter(F.col("source").isin(*sources)) if sources else rel.limit(0)
    return df.join(rel.select(F.col("usage").alias(id_col)).distinct(), id_col, "left_semi")


def orphans(names: DataFrame, usages: DataFrame, name_id: str, used: str) -> DataFrame:
    """Names that no row uses."""
    return names.join(usages.select(F.col(used).alias(name_id)), name_id, "left_anti")


def rekey(pairs: DataFrame, keys: str, df: DataFrame, id_col: str, new: str) -> DataFrame:
    """Give rows new keys from (array of old ids, new key) pairs."""
    flat = pairs.select(F.explode(keys).alias("_old"), F.col(new).alias("_new"))
    return df.join(flat, F.col(id_col) == F.col("_old"), "left").withColumn(new, F.col("_new")).drop("_old", "_new")


# --- keyed writes: functions from tables to tables ---------------------------------------------


def upsert(base: DataFrame, changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``changes`` replace those of their key, others are added."""
    return base.join(changes.select(*keys), list(keys), "left_anti").unionByName(changes.select(*base.columns))


def insert_missing(base: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Create-or-get: rows of unknown keys are added once, known keys stay as they are."""
    return base.unionByName(rows.dropDuplicates(list(keys)).join(base.select(*keys), list(keys), "left_anti").select(*base.columns))


def replace_group(base: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Delete and insert by group: the groups in ``rows`` are replaced as a whole."""
    return base.join(rows.select(column).distinct(), column, "left_anti").select(*base.columns).unionByName(rows.select(*base.columns))


def delete_keys(base: DataFrame, keys: DataFrame, id_col: str, backbone_max: int, now: Column, deleted: str = "deleted") -> DataFrame:
    """Backbone rows, up to the greatest backbone key, are marked as deleted; others go."""
    gone = keys.select(F.col(id_col).alias("_gone")).distinct()
    joined = base.join(gone, F.col(id_col) == F.col("_gone"), "left")
    hit = F.col("_gone").isNotNull()
    return joined.filter(~hit | (F.col(id_col) <= backbone_max)).withColumn(deleted, F.when(hit, F.coalesce(F.col(deleted), now)).otherwise(F.col(deleted))).drop("_gone")


def self_keys(df: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """-1 in a key column means the row itself."""
    return df.withColumns({c: F.when(F.col(c) == -1, F.col(id_col)).otherwise(F.col(c)) for c in columns})


def update_keys(df: DataFrame, changes: DataFrame, columns: Sequence[str], id_col: str = "id") -> DataFrame:
    """Non-null values of ``changes`` overwrite columns of the rows of their id."""
    side = changes.select(F.col(id_col).alias("_id"), *[F.col(c).alias(f"_{c}") for c in columns])
    joined = df.join(side, F.col(id_col) == F.col("_id"), "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns})
    return joined.select(*df.columns)


def change_issues(df: DataFrame, column: str, add: Sequence[str] = (), remove: Sequence[str] = (), where: Column | None = None) -> DataFrame:
    """Add and remove values of a set column."""
    base = F.coalesce(F.col(column), F.array().cast("array<string>"))
    new = F.array_except(F.array_union(base, F.array(*map(F.lit, add)).cast("array<string>")), F.array(*map(F.lit, remove)).cast("array<string>"))
    return df.withColumn(column, new if where is None else F.when(where, new).otherwise(F.col(column)))


def next_ids(df: DataFrame, order: Sequence, start: int, column: str = "id") -> DataFrame:
    """Consecutive ids in a given order, numbered partition by partition."""
    paged = page_of(df, order, 1, "_rank")
    return paged.withColumn(column, (F.col("_rank") + start - 1).cast("long")).drop("_rank")
