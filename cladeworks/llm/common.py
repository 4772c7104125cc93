"""Shared plumbing of the corpus operators: Arrow batches, shared storage, table reading."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import materialize, shared_dir, ship

__all__ = ["materialize", "shared_dir", "ship"]

#: Bytes of text handed to a batch function at once; it bounds a worker's memory and never changes a result.
SLICE_BYTES = 2 << 20


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of about ``limit`` text bytes; one longer row is a run of its own."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_pylist()
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


#: glibc's call that returns freed memory to the system; other C libraries do without.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory of this process to the system, that of tables in reference cycles too."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[..., Iterator]) -> Callable[..., Iterator]:
    """Let a task's function give freed memory back when it ends. Workers outlive their tasks, and what an idle one
    keeps counts beside those at work."""

    def kept_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return kept_lean


def arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def text_map(
    df: DataFrame,
    id_col: str,
    text_col: str,
    outputs: str,
    fn: Callable[[list[str | None]], Mapping[str, object]] | None = None,
    carry: Iterable[str] = (),
    start: Callable[[], Callable] | None = None,
) -> DataFrame:
    """One row in, one row out: id (and carried columns) plus the columns that ``fn`` derives from the texts.

    ``start`` builds ``fn`` once per task where it needs tables of its own. Only the columns named
    are read, so other columns of the input can have any names.
    """
    ship(df.sparkSession)
    kept = [id_col, *carry]
    source = df.select(*[df[c].alias(f"_k{i}") for i, c in enumerate(kept)], df[text_col].cast("string").alias("_text"))
    added = T._parse_datatype_string(outputs)
    schema = T.StructType([T.StructField(c, df.schema[c].dataType, True) for c in kept] + list(added.fields))
    kinds = [(f.name, arrow_type(f.dataType)) for f in added.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = start() if start else fn
        for batch in batches:
            for part in slices(batch, "_text"):
                made = f(part.column("_text").to_pylist())
                columns = [part.column(i) for i in range(len(kept))]
                columns += [v if isinstance(v := made[n], pa.Array) else pa.array(v, type=k) for n, k in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *[n for n, _ in kinds]])

    return source.mapInArrow(lean(run), schema)


#: A value is hot if it has more than one in so many of all rows; hence there are at most this many hot values.
HOT_SHARE = 1000


def join_stats(rows: DataFrame, stats: DataFrame, keys: list[str], count: str, salts: int = 64) -> DataFrame:
    """Inner join of many rows to one row per key, where few keys may hold most rows.

    ``stats`` has ``keys``, the number of rows of each key in ``count``, and values. Keys with more than
    1 / ``HOT_SHARE`` of the rows are at most ``HOT_SHARE`` by counting, so they are broadcast; their rows are
    spread by a salt and pass the shuffled join of the other keys.
    """
    total = stats.agg(F.sum(count)).first()[0] or 0
    values = [c for c in stats.columns if c not in keys]
    packed = F.struct(*values)
    is_hot = F.col(count) * HOT_SHARE > total
    hot = stats.filter(is_hot).select(*keys, packed.alias("_hot"))
    cold = stats.filter(~is_hot).select(*keys, packed.alias("_cold"), F.lit(0).alias("_salt"))
    salt = F.when(F.col("_hot").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(*[c for c in rows.columns if c not in keys]), F.lit(salts)).cast("int"))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn("_salt", salt).join(cold, [*keys, "_salt"], "left")
    found = F.coalesce("_hot", "_cold")
    return joined.filter(found.isNotNull()).select(*rows.columns, *[found[c].alias(c) for c in values])


#: Bits of the bitmap by which rows are sifted before a join: 8 MB at the workers, whatever the data.
SIFT_BITS = 1 << 26


class Bitmap:
    """Which of ``SIFT_BITS`` residues occur among longs; says yes too often, never no by mistake."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words

    def has(self, values: np.ndarray) -> np.ndarray:
        p = values.astype(np.int64) & (SIFT_BITS - 1)
        return (self.words[p >> 6] >> (p & 63)) & 1 == 1


def bitmap(wanted: DataFrame, value: Column):
    """A broadcast ``Bitmap`` of a long column. Many values make it let more rows pass, never fewer."""
    ship(wanted.sparkSession)
    p = value.bitwiseAND(SIFT_BITS - 1)
    found = wanted.select(p.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toArrow()
    words = np.zeros(SIFT_BITS // 64, np.int64)
    words[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    return wanted.sparkSession.sparkContext.broadcast(Bitmap(words))


def filter_texts(df: DataFrame, text_col: str, keep: Callable[[list[str | None]], object]) -> DataFrame:
    """The rows whose texts ``keep`` says true for, with all columns. No shuffle."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                yield part.filter(pa.array(keep(part.column(at).to_pylist()), pa.bool_()))

    return df.mapInArrow(lean(run), df.schema)


def replace_texts(df: DataFrame, text_col: str, fn: Callable[[list[str | None]], list[str | None]]) -> DataFrame:
    """The rows with new texts, all other columns as they were. No shuffle."""
    ship(df.sparkSession)
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                columns = list(part.columns)
                columns[at] = pa.array(fn(columns[at].to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    return df.mapInArrow(lean(run), df.schema)
