"""Benchmark decontamination (operator 1) by spaced-seed hashing.

Method. A seed is a mask over neighbouring words, and the words under its zeros are ignored. The
words under the ones are hashed at each place of the benchmark items and of the documents, and equal
hashes are joined. Around each hit both texts are laid along the same alignment. It counts if
``NEED`` of some ``WINDOW`` consecutive aligned words agree, so up to two words may be substituted.
The family ``MASKS`` misses none: for each two of 13 places one mask lies clear of both (tested).
An item of 7 to 12 words may have one word substituted; its two halves are the seeds, of which one is
clear. An item of ``SHORTEST`` to 6 words has to occur unchanged.

Scale. Up to ``BLOCK_WORDS`` words of items are sent to the workers, and documents are neither shuffled
nor cut. A larger benchmark is joined by shuffles: seeds of documents are sifted by a bitmap of fixed
size, joined to the items' seeds by hash, reduced to different alignments, and each alignment is
verified on the words of its two texts. Results are the same. Seed hits are made and verified in bounded
portions, and pairs that agree in a whole window need no more, so long runs of one word stay cheap.

Defined cases: null and empty texts or items have no words and match nothing; equal rows each report
their matches; text of any length is searched whole; other columns are not read; an empty table on
either side gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .common import arrow_type, bitmap, materialize, slices, text_map
from .words import hashed, mix

MASKS = ("1101111001", "1110010111", "10001110111")
WINDOW, NEED = 13, 11
SHORTEST = 1
BLOCK_WORDS = 500_000
BITMAP_BITS = 22
#: Seed hits that are verified at once; it bounds a worker's memory.
PORTION = 51_200
#: Places of items that share a seed, beyond which documents look at the seed one by one.
MANY = 256


def substitutions(n: int) -> int:
    """Words of an item of fewer than ``WINDOW`` words that may differ."""
    return n * (WINDOW - NEED) // WINDOW


def seeds_of(n: int) -> list[tuple[int, list[int]]]:
    """For items of n words, fewer than ``WINDOW``: seeds as (first word, places from there on)."""
    if not substitutions(n):
        return [(0, list(range(n)))]
    return [(0, list(range((n + 1) // 2))), ((n + 1) // 2, list(range(n // 2)))]


class Seeds:
    """The hashed seeds of items that lie end to end as hashed words."""

    def __init__(self, ids: list, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.ids, self.flat, self.sizes = ids, flat, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.item = np.repeat(np.arange(len(sizes)), sizes)
        self.tables = []
        for on, span, keys, places in seed_rows(flat, sizes):
            order = np.argsort(keys, kind="stable")
            bitmap = np.zeros(1 << BITMAP_BITS, bool)
            bitmap[(keys >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)] = True
            self.tables.append((on, span, keys[order], places[order], bitmap))

    @classmethod
    def of(cls, ids: list, texts: list[str | None]) -> Seeds:
        return cls(ids, *hashed(texts))

    def hits(self, flat: np.ndarray, doc: np.ndarray, full: set[int]):
        """Portions of (place in the documents, place in the items) of all seed hits inside single documents. ``full``
        holds the pairs that need no more, and may grow meanwhile."""
        for on, span, keys, places, bitmap in self.tables:
            n = len(flat) - span + 1
            if n <= 0 or not len(keys):
                continue
            h = mix([flat[i : i + n] for i in on])
            at = np.flatnonzero(bitmap[(h >> np.uint64(64 - BITMAP_BITS)).astype(np.int64)])
            at = at[doc[at] == doc[at + span - 1]]
            low, high = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            count = high - low
            many = np.flatnonzero(count > MANY)
            few = np.flatnonzero((count > 0) & (count <= MANY))
            for first in range(0, len(few), PORTION // MANY):
                part = few[first : first + PORTION // MANY]
                c = count[part]
                step = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
                yield np.repeat(at[part], c), places[np.repeat(low[part], c) + step]
            # a seed that repeats inside items: left out once all items that have it agree as well as they can
            having: dict[int, list[int]] = {}
            for x in many.tolist():
                start, row = int(low[x]), int(doc[at[x]]) * len(self.ids)
                if start not in having:
                    having[start] = np.unique(self.item[places[start : start + count[x]]]).tolist()
                if not all(row + i in full for i in having[start]):
                    for a in range(start, start + int(count[x]), PORTION):
                        q = places[a : min(a + PORTION, start + int(count[x]))]
                        yield np.full(len(q), at[x]), q

    def matches(self, texts: list[str | None]) -> pd.DataFrame:
        """(row, item, agreed): the best window of each pair that passes."""
        flat, sizes = hashed(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        known, full = (np.zeros(0, np.int64), np.zeros(0, np.int64)), set()
        for p, q in self.hits(flat, doc, full):
            pair = doc[p] * len(self.ids) + self.item[q]
            # one hit of each alignment and short stretch is enough: a check reaches beyond it to both sides
            keep = ~pd.DataFrame({"pair": pair, "line": p - q, "stretch": p // (WINDOW // 2)}).duplicated().to_numpy()
            p, q, pair = p[keep], q[keep], pair[keep]
            agreed = agreement(flat, sizes, doc, p, self.flat, self.sizes, self.item, q)
            ok = agreed > 0
            if ok.any():
                best = pd.Series(np.append(known[1], agreed[ok])).groupby(np.append(known[0], pair[ok])).max()
                known = best.index.to_numpy(), best.to_numpy()
                # a pair that agrees in a whole window, or in all of a shorter item, cannot get better
                full.update(known[0][known[1] >= np.minimum(WINDOW, self.sizes[known[0] % len(self.ids)])].tolist())
        return pd.DataFrame({"row": known[0] // max(1, len(self.ids)), "item": known[0] % max(1, len(self.ids)), "agreed": known[1]})


def seed_rows(flat: np.ndarray, sizes: np.ndarray):
    """(places of words in the seed, its span, hashes, places in ``flat``) of all seeds of items."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    starts = np.cumsum(sizes) - sizes
    for mask in MASKS:
        n = len(flat) - len(mask) + 1
        if n > 0:
            on = [i for i, c in enumerate(mask) if c == "1"]
            ok = (item[:n] == item[len(mask) - 1 :]) & (sizes[item[:n]] >= WINDOW)
            yield on, len(mask), mix([flat[i : i + n] for i in on])[ok], np.flatnonzero(ok)
    for length in sorted({int(s) for s in sizes if SHORTEST <= s < WINDOW}):
        for first, on in seeds_of(length):
            at = starts[sizes == length] + first
            yield on, len(on), mix([flat[at + i] for i in on]), at


def agreement(d_flat, d_sizes, d_of, p, i_flat, i_sizes, i_of, q) -> np.ndarray:
    """For hits at places p of documents and q of items: the words that agree in the best window of the alignment
    around the hit, or in all of an item shorter than a window; 0 if they are too few."""
    if not len(p):
        return np.zeros(0, np.int64)
    reach = np.arange(-2 * WINDOW, 2 * WINDOW + 1)
    d_starts, i_starts = np.cumsum(d_sizes) - d_sizes, np.cumsum(i_sizes) - i_sizes
    dp, dq = p[:, None] + reach, q[:, None] + reach
    inside = (dp >= d_starts[d_of[p]][:, None]) & (dp < (d_starts + d_sizes)[d_of[p]][:, None])
    inside &= (dq >= i_starts[i_of[q]][:, None]) & (dq < (i_starts + i_sizes)[i_of[q]][:, None])
    equal = inside & (d_flat[np.clip(dp, 0, len(d_flat) - 1)] == i_flat[np.clip(dq, 0, len(i_flat) - 1)])
    size = i_sizes[i_of[q]]
    sums = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1)
    best = np.where(size < WINDOW, equal.sum(axis=1), (sums[:, WINDOW:] - sums[:, :-WINDOW]).max(axis=1))
    return np.where(best >= np.where(size < WINDOW, size - substitutions(size), NEED), best, 0)


def _sized(items: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """Items as (_item, _text), and a bound on their words."""
    text = F.col(text_col).cast("string")
    sized = items.select(F.col(id_col).alias("_item"), text.alias("_text"))
    return sized, sized.agg(F.sum(F.length("_text") / 2 + 1)).first()[0] or 0


def _words(rows: DataFrame, number: str) -> DataFrame:
    """(number, words) with the hashed words of (number, _text) rows."""
    return text_map(rows, number, "_text", "words array<long>", lambda texts: {"words": _split(*hashed(texts))})


def _split(flat: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(flat.view(np.int64), np.cumsum(sizes)[:-1])


def _joined(source: DataFrame, items: DataFrame) -> DataFrame:
    """(_row, _item, agreed) by shuffled joins, for (_row, _text) and (_item, _text) of any size."""
    items = materialize(items.withColumn("_no", F.monotonically_increasing_id()))
    item_words = materialize(_words(items, "_no"))
    lengths = sorted(r[0] for r in item_words.select(F.size("words").alias("n")).filter(f"n < {WINDOW}").distinct().collect())  # at most WINDOW values
    forms = [(len(m), [i for i, c in enumerate(m) if c == "1"], 0, 0) for m in MASKS]
    forms += [(len(on), on, first, n) for n in lengths if n >= SHORTEST for first, on in seeds_of(n)]

    def item_seeds(batches):
        for batch in batches:
            for no, words in zip(batch.column(0).to_pylist(), batch.column(1)):
                flat = np.asarray(words.values).view(np.uint64)
                for f, (span, on, first, n) in enumerate(forms):
                    if (n == 0 and len(flat) < WINDOW) or (n and len(flat) != n):
                        continue
                    at = np.arange(len(flat) - span + 1) if n == 0 else np.array([first])
                    h = mix([flat[at + i] for i in on] + [np.full(len(at), f + 1, np.uint64)]).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.full(len(at), no)), pa.array(at)], names=["h", "_no", "q"])

    seeds = materialize(item_words.mapInArrow(item_seeds, "h long, _no long, q long"))
    shared = bitmap(seeds, F.col("h"))

    def doc_seeds(texts):
        flat, sizes = hashed(texts)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out: list[list] = [[] for _ in texts]
        for f, (span, on, *_) in enumerate(forms):
            n = len(flat) - span + 1
            if n <= 0:
                continue
            h = mix([flat[i : i + n] for i in on] + [np.full(n, f + 1, np.uint64)]).view(np.int64)
            at = np.flatnonzero(shared.value.has(h))
            at = at[doc[at] == doc[at + span - 1]]
            begin = np.cumsum(sizes) - sizes
            for x, y in zip(at.tolist(), h[at].tolist()):
                out[doc[x]].append({"h": y, "p": x - int(begin[doc[x]])})
        return {"seeds": out}

    found = text_map(source, "_row", "_text", "seeds array<struct<h: long, p: long>>", doc_seeds).select("_row", F.explode("seeds").alias("s"))
    # a hit stands for its alignment and stretch of words; equal ones shrink before the next shuffle
    hits = found.select("_row", "s.h", "s.p").join(seeds, "h").select("_row", "_no", (F.col("p") - F.col("q")).alias("line"), F.floor(F.col("p") / (WINDOW // 2)).alias("stretch"), "p")
    lines = materialize(hits.groupBy("_row", "_no", "line", "stretch").agg(F.min("p").alias("p")))
    doc_words = _words(source.join(lines.select("_row").distinct(), "_row", "left_semi"), "_row").withColumnRenamed("words", "d")
    ready = lines.join(doc_words, "_row").join(item_words.withColumnRenamed("words", "i"), "_no").select("_row", "_no", "p", "line", "d", "i")

    def verify(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                d, i = ([np.asarray(x.values).view(np.uint64) for x in part.column(c)] for c in (4, 5))
                d_sizes, i_sizes = (np.array([len(x) for x in side], np.int64) for side in (d, i))
                number = np.arange(part.num_rows)
                p = part.column(2).to_numpy()
                q = p - part.column(3).to_numpy() + np.cumsum(i_sizes) - i_sizes
                agreed = agreement(np.concatenate(d), d_sizes, np.repeat(number, d_sizes), p + np.cumsum(d_sizes) - d_sizes, np.concatenate(i), i_sizes, np.repeat(number, i_sizes), q)
                ok = pa.array(np.flatnonzero(agreed))
                yield pa.RecordBatch.from_arrays([part.column(0).take(ok), part.column(1).take(ok), pa.array(agreed.astype(np.int32)).take(ok)], names=["_row", "_no", "agreed"])

    best = ready.mapInArrow(verify, "_row long, _no long, agreed int").groupBy("_row", "_no").agg(F.max("agreed").alias("agreed"))
    return best.join(items.select("_no", "_item"), "_no").select("_row", "_item", "agreed")


def find_contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """(id, item id, agreed): pairs of a document and an item that it contains, with the most agreeing
    words in a window of 13 (or in a shorter item). One row for each pair and input row."""
    spark = ship(docs.sparkSession)
    source = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([
        T.StructField(id_col, docs.schema[id_col].dataType), T.StructField(item_id, items.schema[item_id].dataType), T.StructField("agreed", T.IntegerType()),
    ])
    sized, words = _sized(items, item_id, item_text)
    if words > block_words:
        numbered = materialize(source.withColumn("_row", F.monotonically_increasing_id()))
        joined = numbered.select("_row", "_id").join(_joined(numbered.select("_row", "_text"), sized), "_row")
        return joined.select(F.col("_id").alias(id_col), F.col("_item").alias(item_id), "agreed")
    kind = arrow_type(items.schema[item_id].dataType)
    rows = sized.collect()  # bounded by block_words
    shared = spark.sparkContext.broadcast(Seeds.of([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches):
        seeds = shared.value
        for batch in batches:
            for part in slices(batch, "_text"):
                m = seeds.matches(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(m["row"].to_numpy(np.int64))), pa.array([seeds.ids[i] for i in m["item"]], kind), pa.array(m["agreed"].to_numpy(), pa.int32())],
                    names=schema.names,
                )

    return source.mapInArrow(run, schema)


def clean_rows(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns. No shuffle, but for a large benchmark."""
    ship(docs.sparkSession)
    sized, words = _sized(items, item_id, item_text)
    if words > block_words:
        whole = F.struct(*[docs[c] for c in docs.columns]).alias("_all")
        numbered = materialize(docs.select(whole, docs[text_col].cast("string").alias("_text"), F.monotonically_increasing_id().alias("_row")))
        dirty = _joined(numbered.select("_row", "_text"), sized).select("_row").distinct()
        return numbered.join(dirty, "_row", "left_anti").select("_all.*")
    names = docs.columns
    at = names.index(text_col)
    rows = sized.collect()  # bounded by block_words
    shared = docs.sparkSession.sparkContext.broadcast(Seeds.of([r[0] for r in rows], [r[1] for r in rows]))

    def run(batches):
        for batch in batches:
            for part in slices(batch, names[at]):
                keep = np.ones(part.num_rows, bool)
                keep[shared.value.matches(part.column(at).to_pylist())["row"].to_numpy(np.int64)] = False
                yield part.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
