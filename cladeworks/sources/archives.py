"""Archives of delimited files, source adapters, and exports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cleaning import canonical_or_name, default_status, tab_field
from .tables import ship

#: Columns of a source list: one usage per line, without a header.
SOURCE_COLUMNS = ("key", "parent_key", "original_name_key", "rank", "status", "nom_status", "scientific_name", "published_in")
#: Columns whose presence tells what an archive maps.
MAPPED = {
    "denormed": ("kingdom", "phylum", "class", "order", "family", "genus"), "parent_name": ("parentNameUsage",), "accepted_name": ("acceptedNameUsage",), "original_name": ("originalNameUsage",),
    "parent_id": ("parentNameUsageID",), "accepted_id": ("acceptedNameUsageID",), "original_id": ("originalNameUsageID",),
}


class DuplicateKeys(ValueError):
    pass


def read_tab(spark: SparkSession, path: str, columns: Sequence[str] | None = None, header: bool = False, least: int = 3) -> DataFrame:
    r"""A tab-separated file of strings: empty and ``\N`` are null, and rows with fewer than ``least`` fields are dropped."""
    lines = ship(spark).read.text(path)
    if header:
        first = spark.read.option("sep", "\t").option("header", True).csv(path)
        columns = first.columns
        lines = lines.filter(F.col("value") != "\t".join(columns))
    fields = F.split("value", "\t", -1)
    rows = lines.select(fields.alias("f")).filter(F.size("f") >= least)
    return rows.select(*[tab_field(F.try_element_at("f", F.lit(i + 1))).alias(c) for i, c in enumerate(columns)])


def read_archive(spark: SparkSession, core: str, extensions: Mapping[str, str] | None = None, id_col: str = "taxonID", extension_id: str = "id") -> DataFrame:
    """Star records: core rows with each extension's rows as an array of maps. A repeated core id raises."""
    rows = ship(spark).read.option("sep", "\t").option("header", True).option("quote", "").csv(core)
    rows = rows.select(*[tab_field(F.col(f"`{c}`")).alias(c) for c in rows.columns])
    check_unique(rows, id_col)
    for name, path in (extensions or {}).items():
        ext = spark.read.option("sep", "\t").option("header", True).option("quote", "").csv(path)
        entry = F.map_from_arrays(F.array(*[F.lit(c) for c in ext.columns if c != extension_id]), F.array(*[tab_field(F.col(f"`{c}`")) for c in ext.columns if c != extension_id]))
        grouped = ext.groupBy(F.col(extension_id).alias("_ext")).agg(F.collect_list(entry).alias(name))
        rows = rows.join(grouped, F.col(id_col) == F.col("_ext"), "left").drop("_ext")
    return rows


def check_unique(df: DataFrame, id_col: str) -> None:
    """Raise if an id repeats; only a few offenders come to the driver."""
    repeated = [r[0] for r in df.filter(F.col(id_col).isNotNull()).groupBy(id_col).count().filter("count > 1").select(id_col).limit(5).collect()]
    if repeated:
        raise DuplicateKeys(f"{id_col} repeats: {repeated}")


def mapped(columns: Sequence[str]) -> dict[str, bool]:
    """What the header maps."""
    have = set(columns)
    return {k: bool(have & set(cs)) for k, cs in MAPPED.items()}


def delimiter_of(values: DataFrame, column: str) -> Column:
    """The delimiter of a multi-value field as an expression over that column."""
    c = F.col(column)
    out = F.lit(None).cast("string")
    for d in reversed("|;,"):
        out = F.when(F.size(F.split(c, "\\" + d)) > 1, F.lit(d)).otherwise(out)
    return out


def read_source(spark: SparkSession, path: str) -> DataFrame:
    """A source list in the common eight columns, with its line order as ``seq``."""
    rows = read_tab(spark, path, SOURCE_COLUMNS, least=7)
    return typed_source(rows)


def typed_source(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.col(c).cast("long") for c in ("key", "parent_key", "original_name_key")})


def source_from_store(usage: DataFrame, name: DataFrame, publication: DataFrame | None = None) -> DataFrame:
    """The same eight columns from the store: usage joined with its name and, if given, its publication."""
    n = name.select(F.col("id").alias("_nid"), "scientific_name", "canonical_name")
    out = usage.filter("deleted is null").join(n, F.col("name_fk") == F.col("_nid"))
    published = F.lit(None).cast("string")
    if publication is not None:
        out = out.join(publication.select(F.col("id").alias("_pid"), "citation"), F.col("name_published_in_fk") == F.col("_pid"), "left")
        published = F.col("citation")
    return out.select(
        F.col("id").cast("long").alias("key"), F.col("parent_fk").cast("long").alias("parent_key"), F.col("basionym_fk").cast("long").alias("original_name_key"), "rank",
        default_status(F.col("status"), F.col("is_synonym")).alias("status"), F.concat_ws(",", "nom_status").alias("nom_status"), "scientific_name", published.alias("published_in"),
    )


def source_from_archive(core: DataFrame) -> DataFrame:
    """The eight columns from an archive's core rows."""
    get = lambda c: F.col(c) if c in core.columns else F.lit(None).cast("string")
    return core.select(
        get("taxonID").alias("key"), F.coalesce(get("acceptedNameUsageID"), get("parentNameUsageID")).alias("parent_key"), get("originalNameUsageID").alias("original_name_key"),
        F.upper(get("taxonRank")).alias("rank"), F.coalesce(F.upper(get("taxonomicStatus")), F.when(get("acceptedNameUsageID").isNotNull(), F.lit("SYNONYM")).otherwise("ACCEPTED")).alias("status"),
        get("nomenclaturalStatus").alias("nom_status"), get("scientificName").alias("scientific_name"), get("namePublishedIn").alias("published_in"),
    )


def lookup_table(usage: DataFrame, name: DataFrame, include_deleted: bool = False) -> DataFrame:
    """The look-up rows: one per name, with a map from parent to key where one synonym has several parents."""
    rows = usage if include_deleted else usage.filter("deleted is null")
    n = name.select(F.col("id").alias("_nid"), "scientific_name", "canonical_name", "authorship", "year")
    joined = rows.join(n, F.col("name_fk") == F.col("_nid")).withColumn("canonical", canonical_or_name(F.col("canonical_name"), F.col("scientific_name")))
    group = F.coalesce("pp_synonym_fk", "id")
    return joined.groupBy(group.alias("key")).agg(
        *[F.min_by(c, "id").alias(c) for c in ("canonical", "authorship", "year", "rank", "status")],
        F.map_from_entries(F.sort_array(F.collect_set(F.when(F.col("pp_synonym_fk").isNotNull() & F.col("parent_fk").isNotNull(), F.struct("parent_fk", "id"))))).alias("pro_parte"),
        F.max(F.col("deleted").isNotNull()).alias("deleted"),
    )


# --- exports -----------------------------------------------------------------------------------


def write_tab(df: DataFrame, path: str, header: bool = True) -> None:
    r"""Tab-separated text: tabs and line ends inside values become blanks, null an empty field."""
    fields = [F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"[\t\r\n]+", " "), F.lit("")).alias(c) for c in df.columns]
    df.select(*fields).write.mode("overwrite").option("sep", "\t").option("header", header).option("quote", "").option("escape", "").option("emptyValue", "").csv(path)


def export_archive(core: DataFrame, extensions: Mapping[str, DataFrame], folder: str, constituent: str | None = None, link: tuple[str, str] = ("id", "usage_id")) -> dict[str, str]:
    """Core and extensions as tab files of one folder, rows in key order; constituents as a folder of parts.

    Extension rows without a core row are left out.
    """
    out = {"core": f"{folder}/taxon"}
    write_tab(core.repartitionByRange(link[0]).sortWithinPartitions(link[0]), out["core"])
    for name, rows in extensions.items():
        out[name] = f"{folder}/{name}"
        linked = rows.join(core.select(F.col(link[0]).alias(link[1])).distinct(), link[1], "left_semi")
        write_tab(linked.repartitionByRange(link[1]).sortWithinPartitions(link[1]), out[name])
    if constituent:
        out["constituents"] = f"{folder}/constituents"
        write_tab(core.groupBy(constituent).agg(F.count(F.lit(1)).alias("n")), out["constituents"])
    return out


def export_ranges(df: DataFrame, path: str, key: str = "key", partitions: int | None = None) -> None:
    """Parquet in key ranges: each file holds one range, so readers can skip the others."""
    ranged = df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)
    ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def id_reports(before: DataFrame, after: DataFrame, key: str = "key", deleted: str = "deleted") -> dict[str, DataFrame]:
    """Keys that went, came back, and are new."""
    live_before, live_after = before.filter(~F.col(deleted)), after.filter(~F.col(deleted))
    return {
        "deleted": live_before.join(live_after.select(key), key, "left_anti"),
        "resurrected": live_after.join(before.filter(F.col(deleted)).select(key), key, "left_semi"),
        "created": live_after.join(before.select(key), key, "left_anti"),
    }
