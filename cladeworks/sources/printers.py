"""Trees as text, in several formats. All are DataFrames of lines with the order they belong in."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.tree import paths, render, sibling_key

FORMATS = ("TEXT", "XML", "GML", "DOT", "TAB", "LIST")


def _escaped(c):
    c = F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    return c


def lines(df: DataFrame, fmt: str, id_col: str = "id", parent: str = "parent", name: str = "name", rank: str = "rank", synonym: str | None = None, basionym: str | None = None) -> DataFrame:
    """(sort_path, part, line): ``part`` orders lines of one node, openings before and closings after all below."""
    if fmt == "TEXT":
        return render(df, id_col, parent, name, rank, synonym, basionym).select("sort_path", F.lit(0).alias("part"), "line")
    p = paths(df, id_col, parent, sibling_key(rank, name, name))
    side = df.select(F.col(id_col).alias("id"), F.col(parent).alias("_p"), F.col(name).alias("_n"), F.col(rank).alias("_r"))
    t = p.join(side, "id").withColumn("_id", F.col("id").cast("string")).withColumn("_p", F.col("_p").cast("string"))
    if fmt == "LIST":
        return t.select("sort_path", F.lit(0).alias("part"), F.col("_n").alias("line"))
    if fmt == "TAB":
        row = F.concat_ws("\t", "_id", F.coalesce("_p", F.lit("")), F.coalesce("_r", F.lit("")), "_n")
        return t.select("sort_path", F.lit(0).alias("part"), row.alias("line"))
    if fmt == "XML":
        pad = F.repeat(F.lit(" "), 2 * F.col("depth"))
        tag = F.lower(F.coalesce("_r", F.lit("taxon")))
        opened = t.select("sort_path", F.lit(0).alias("part"), F.concat(pad, F.lit("<"), tag, F.lit(' name="'), _escaped(F.col("_n")), F.lit('">')).alias("line"))
        # a closing line sorts after everything below: its path ends with a key beyond all siblings
        last = F.struct(F.lit(2**31 - 1).alias("o"), F.lit("\U0010ffff").alias("c"), F.lit("\U0010ffff").alias("n"))
        closed = t.select(F.array_append("sort_path", last).alias("sort_path"), F.lit(1).alias("part"), F.concat(pad, F.lit("</"), tag, F.lit(">")).alias("line"))
        return opened.unionByName(closed)
    if fmt not in ("GML", "DOT"):
        raise ValueError(f"unknown format {fmt}")
    gml = fmt == "GML"
    quoted = F.concat(F.lit('"'), F.replace("_n", F.lit('"'), F.lit("'")), F.lit('"'))
    node = F.concat(F.lit("node [ id "), "_id", F.lit(" label "), quoted, F.lit(" ]")) if gml else F.concat(F.lit("n"), "_id", F.lit(" [label="), quoted, F.lit("];"))
    edge = F.concat(F.lit("edge [ source "), "_p", F.lit(" target "), "_id", F.lit(" ]")) if gml else F.concat(F.lit("n"), "_p", F.lit(" -> n"), "_id", F.lit(";"))
    return t.select("sort_path", F.lit(0).alias("part"), node.alias("line")).unionByName(t.filter("_p is not null").select("sort_path", F.lit(1).alias("part"), edge.alias("line")))


def write(df: DataFrame, path: str) -> None:
    """Lines as text files in order: the files' names sort as their contents do."""
    df.orderBy("sort_path", "part").select("line").write.mode("overwrite").text(path)
