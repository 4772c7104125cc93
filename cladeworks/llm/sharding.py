"""Sharding (operator 5) by extendible hashing.

Method. A row's digest gives 60 hash bits. The directory begins with one bucket; a bucket whose rows
exceed the byte limit splits on its next bit, others stay as they are, until every bucket fits. The
sums behind the splits come from one aggregation: bytes per hash, rolled up bit by bit in rounds
that only carry the prefixes of buckets still too large, so no pass over the rows is repeated.

The digest is over the key and the text, so a hot key spreads. Rows that agree in all 60 bits (exact
repeats) cannot be split by more bits. If they alone exceed the limit, they go to numbered overflow
pages of their bucket: repeats are interchangeable, so they are counted before any shuffle and the
copy number decides the page. A single row larger than the limit is a shard of its own, marked
``oversize``.

Defined cases: null text has 0 bytes, null key is the empty string in the digest; empty table gives
an empty result; repeated rows each get a place; only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BITS = 60
#: Bits that a later round of splitting looks at, and that the first one has beyond the expected depth.
STEP = 6
SHARD_BYTES = 64 << 20
#: Copies of one row that a task places.
BLOCK = 100_000


def hash60(id_col: Column, text_col: Column) -> Column:
    """60 bits of the MD5 of key and text, as a non-negative long."""
    digest = F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text_col, F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def bits_of(prefix: Column, depth: Column) -> Column:
    """The prefix as a string of ``depth`` bits; '' for the whole directory."""
    return F.when(depth == 0, F.lit("")).otherwise(F.lpad(F.bin(prefix), depth, F.lit("0")))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """Leaf buckets (depth, prefix, bytes, rows) for per-hash sizes (h, bytes, copies).

    The first round sums at a few bits more than total / limit calls for, which settles an even hash.
    Later rounds refine only the buckets that are still too large. A round keeps the shallowest
    prefix that fits. There are at most ``BITS / STEP`` rounds.
    """
    spark = sizes.sparkSession
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    first = max(0, math.ceil(math.log2(max(1, total / max(1, limit)))))
    live = sizes.select("h", F.col("bytes").alias("b"), F.col("copies").alias("c"), F.lit(0).alias("depth"))
    leaves = None
    depth = 0
    while depth < BITS:
        top = min(BITS, depth + STEP + (first if depth == 0 else 0))
        # sums at the finest level of this round, then rolled up to the levels above it
        fine = live.groupBy(F.shiftright("h", BITS - top).alias("p")).agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
        levels = fine.select(F.explode(F.sequence(F.lit(depth), F.lit(top))).alias("d"), "p", "b", "c").select(
            "d", F.expr(f"shiftright(p, {top} - d)").alias("q"), "b", "c"
        )
        summed = materialize(levels.groupBy("d", "q").agg(F.sum("b").alias("b"), F.sum("c").alias("c")))
        # a prefix is a leaf if it fits (or cannot be split) and its parent does not
        fits = (F.col("b") <= limit) | (F.col("c") == 1) | (F.col("d") == BITS)
        parent = summed.filter(~fits).select((F.col("d") + 1).alias("pd"), F.col("q").alias("pq"))
        root = summed.filter(fits & (F.col("d") == depth)) if depth == 0 else None
        inner = summed.filter(fits & (F.col("d") > depth)).join(
            parent, (F.col("d") == F.col("pd")) & (F.shiftright("q", 1) == F.col("pq")), "left_semi"
        )
        found = inner if root is None else inner.unionByName(root)
        leaves = found if leaves is None else leaves.unionByName(found)
        large = summed.filter(~fits & (F.col("d") == top)).select(F.col("q").alias("lq"))
        if top == BITS or large.isEmpty():
            break
        live = materialize(live.join(large, F.shiftright("h", BITS - top) == F.col("lq"), "left_semi"))
        depth = top
    if leaves is None:
        leaves = spark.createDataFrame([], "d int, q long, b long, c long")
    return leaves.select(F.col("d").alias("depth"), F.col("q").alias("prefix"), F.col("b").alias("bytes"), F.col("c").alias("rows"))


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = SHARD_BYTES) -> DataFrame:
    """One row per input row: id, n_bytes, shard (bit string, with ``#page`` for overflow pages), depth,
    shard_bytes and shard_rows of the bucket, oversize."""
    rows = docs.select(
        docs[id_col].alias(id_col),
        F.coalesce(F.octet_length(docs[text_col]), F.lit(0)).cast("long").alias("n_bytes"),
        hash60(docs[id_col], docs[text_col]).alias("h"),
    )
    counted = materialize(rows.groupBy(id_col, "n_bytes", "h").agg(F.count(F.lit(1)).alias("copies")))
    sizes = counted.groupBy("h").agg(F.sum(F.col("n_bytes") * F.col("copies")).alias("bytes"), F.sum("copies").alias("copies"))
    leaves = materialize(directory(sizes, limit))
    depths = sorted(r.depth for r in leaves.select("depth").distinct().collect()) or [0]  # at most 61 values
    at = F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright("h", BITS - d).alias("q")) for d in depths])
    placed = counted.withColumn("_at", F.explode(at))
    placed = placed.join(leaves, (F.col("_at.d") == F.col("depth")) & (F.col("_at.q") == F.col("prefix")))
    # exact repeats that fill more than one shard: the copy number gives the page
    per_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.lit(1), F.col("n_bytes")))).cast("long")
    overflow = (F.col("depth") == BITS) & (F.col("bytes") > limit) & (F.col("rows") > 1)
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / BLOCK).cast("long"))
    single = placed.filter(F.col("copies") <= BLOCK).withColumn("_block", F.lit(0).cast("long"))
    # a row repeated very often is placed by many tasks
    hot = placed.filter(F.col("copies") > BLOCK).withColumn("_block", F.explode(blocks)).repartition("h", "_block")
    placed = single.unionByName(hot).withColumn(
        "_copy", F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("copies"), (F.col("_block") + 1) * BLOCK) - 1))
    )
    page = F.floor(F.col("_copy") / per_page)
    return placed.select(
        id_col,
        "n_bytes",
        F.when(overflow, F.concat(bits_of(F.col("prefix"), F.col("depth")), F.lit("#"), page.cast("string"))).otherwise(bits_of(F.col("prefix"), F.col("depth"))).alias("shard"),
        F.col("depth").cast("int").alias("depth"),
        F.col("bytes").alias("shard_bytes"),
        F.col("rows").alias("shard_rows"),
        (F.col("n_bytes") > limit).alias("oversize"),
    )
