"""Substring dedup (operator 6) by hashing lines and their sentences.

Method. A text is cut at line ends, and lines after sentence ends. Lines and sentences are normalised
(lower case, single blanks) and hashed to 128 bits, each kind apart. Digests are grouped over all
documents; the occurrence that ranks first, by document and then by place, stays. The others are repeats
and go: a repeated line whatever its length, and sentences inside a line where consecutive repeats
have at least ``RUN_WORDS`` words together, as single short ones are not lines but everyday phrases.
Neighbouring removals form one stretch, reported with its offsets in the original text.

Documents are told apart, and ranked, by id and then by a hash of the text. Rows that share both are
copies of one document: the first copy is treated as above, in the others every unit is a repeat.

Scale. Units of the second pass are sifted by a bitmap of the repeated digests before they are
shuffled. Digests with a large share of all units are found by counting and joined apart
(``join_stats``), so a line that a third of all documents share spreads over tasks. Copies of a row
are counted before the shuffle and expanded after all work, a hot row's by many tasks.

Defined cases: a null text stays null with no units; empty texts stay empty; a null id ranks first;
other columns are not read; an empty table gives an empty result. Offsets are code points, ends
exclusive.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .common import arrow_type, bitmap, join_stats, materialize, slices

RUN_WORDS = 8
#: Words from which a removed stretch counts as a passage.
PASSAGE_WORDS = 50
#: Copies of one row that a task writes.
BLOCK = 100_000
_UNIT = re.compile(r"[^\n]*?[.!?][ \t]+|[^\n]+\n?|\n")
_FOUND = "n_removed int, removed string, n_chars_removed long, n_passages int, text string"


def units_of(text: str) -> list[tuple[int, int]]:
    """The units' spans; together they are the whole text."""
    return [m.span() for m in _UNIT.finditer(text)]


def normalized(unit: str) -> str:
    return " ".join(unit.lower().split())


def digests_of(text: str) -> tuple[list[int], list[int]]:
    """Places and 128-bit digests of all units with words: sentence ``k`` has place 2 k, line ``k`` has 2 k + 1."""
    places, digests, line, number = [], [], [], 0
    for k, (a, b) in enumerate(units_of(text)):
        if unit := normalized(text[a:b]):
            places.append(2 * k)
            digests.append(xxhash.xxh3_128_intdigest(unit.encode()))
            line.append(unit)
        if b == len(text) or text[b - 1] == "\n":
            if line:
                places.append(2 * number + 1)
                digests.append(xxhash.xxh3_128_intdigest(("\n" + " ".join(line)).encode()))
                line = []
            number += 1
    return places, digests


def removed_spans(text: str, repeats: set[int] | None, run_words: int = RUN_WORDS) -> tuple[int, list[tuple[int, int, int]]]:
    """Number of units, and (start, end, words) of the removed stretches. ``repeats`` holds places; None means all.

    Units without words do not break a stretch, but none begins or ends with one.
    """
    spans = units_of(text)
    worded: list[tuple[int, int, int, bool, bool]] = []
    number = 0
    for k, (a, b) in enumerate(spans):
        if n := len(text[a:b].split()):
            worded.append((a, b, n, repeats is None or 2 * k in repeats, repeats is None or 2 * number + 1 in repeats))
        number += text[b - 1] == "\n"
    gone, k = [line for *_, line in worded], 0
    while k < len(worded):
        stop, words = k, 0
        while stop < len(worded) and worded[stop][3]:
            words += worded[stop][2]
            stop += 1
        if stop > k and words >= run_words:
            gone[k:stop] = [True] * (stop - k)
        k = max(stop, k + 1)
    out: list[tuple[int, int, int]] = []
    for k, (a, b, n, *_) in enumerate(worded):
        if gone[k]:
            if k and gone[k - 1]:
                start, _, words = out.pop()
                out.append((start, b, words + n))
            else:
                out.append((a, b, n))
    return len(spans), out


def without(text: str | None, repeats: set[int] | None, run_words: int = RUN_WORDS) -> tuple[int, dict]:
    """Number of units, and the values of ``_FOUND`` for one text."""
    n, spans = removed_spans(text or "", repeats, run_words)
    kept, last = [], 0
    for a, b, _ in spans:
        kept.append((text or "")[last:a])
        last = b
    return n, {
        "n_removed": len(spans), "removed": ",".join([f"{a}:{b}" for a, b, _ in spans]), "n_chars_removed": sum(b - a for a, b, _ in spans),
        "n_passages": sum(w >= PASSAGE_WORDS for *_, w in spans), "text": None if text is None else "".join([*kept, text[last:]]),
    }


def _unit_rows(source: DataFrame, only=None) -> DataFrame:
    """(id, d, place, h1, h2) of each unit with words of (id, d, text) rows; with ``only`` those whose h2 it may hold."""
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("d long, place int, h1 long, h2 long").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                rows, places, digests = [], [], []
                for row, text in enumerate(part.column(2).to_pylist()):
                    p, h = digests_of(text)
                    rows += [row] * len(p)
                    places += p
                    digests += h
                halves = np.frombuffer(b"".join([h.to_bytes(16, "little") for h in digests]), np.int64).reshape(-1, 2)
                keep = np.arange(len(rows)) if only is None else np.flatnonzero(only.value.has(halves[:, 0]))
                at = pa.array(np.array(rows, np.int64)[keep])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(np.array(places, np.int32)[keep]), pa.array(halves[keep, 1]), pa.array(halves[keep, 0])], names=schema.names
                )

    return source.filter("text is not null").mapInArrow(run, schema)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run_words: int = RUN_WORDS) -> DataFrame:
    """One row per input row: id, n_units, n_removed (stretches), removed (``start:end``, comma-joined),
    n_chars_removed, n_passages (stretches of ``PASSAGE_WORDS`` words or more), and the remaining text."""
    ship(docs.sparkSession)
    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].alias("id"), F.xxhash64(text).alias("d"), text.alias("text"))
    place = F.struct("id", "d", "place")
    firsts = materialize(_unit_rows(source).groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"))
    again = join_stats(_unit_rows(source, bitmap(firsts, F.col("h2"))), firsts, ["h1", "h2"], "n").filter(place != F.col("first"))
    per_doc = again.groupBy(F.col("id").alias("_rid"), F.col("d").alias("_rd")).agg(F.collect_set("place").alias("_repeats"))
    distinct = source.groupBy("id", "d").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))
    joined = distinct.join(per_doc, F.col("id").eqNullSafe(F.col("_rid")) & (F.col("d") == F.col("_rd")), "left").select("id", "d", "n", "text", "_repeats")
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string(f"d long, n long, n_units int, first struct<{_FOUND}>, other struct<{_FOUND}>").fields])
    found = arrow_type(schema["first"].dataType)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                units, one, rest = [], [], []
                for x, copies, repeats in zip(part.column(3).to_pylist(), part.column(2).to_pylist(), part.column(4).to_pylist()):
                    n, values = without(x, set(repeats or ()), run_words)
                    units.append(n)
                    one.append(values)
                    rest.append(without(x, None, 0)[1] if copies > 1 else None)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(units, pa.int32()), pa.array(one, found), pa.array(rest, found)], names=schema.names)

    rows = joined.mapInArrow(run, schema)
    zero, last = F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK).cast("long")
    if source.groupBy("id").count().filter(F.col("count") > BLOCK).isEmpty():
        rows = rows.withColumn("_block", zero)
    else:
        # a row repeated very often is written by many tasks
        hot = rows.filter(F.col("n") > BLOCK).withColumn("_block", F.explode(F.sequence(zero, last))).repartition("id", "d", "_block")
        rows = rows.filter(F.col("n") <= BLOCK).withColumn("_block", zero).unionByName(hot)
    copy = F.explode(F.sequence(F.col("_block") * BLOCK, F.least(F.col("n"), (F.col("_block") + 1) * BLOCK) - 1))
    rows = rows.withColumn("_copy", copy).withColumn("_f", F.when(F.col("_copy") == 0, F.col("first")).otherwise(F.col("other")))
    return rows.select(F.col("id").alias(id_col), "n_units", "_f.*")
