"""Quality classifier (operator 4): importance resampling with hashed n-gram models.

Method. Words and runs of symbols, as written, and their pairs are hashed to ``BUCKETS`` buckets each.
Two generative models are bucket frequencies: of the target, the labelled rows that are good and not
toxic, and of the raw text, all rows. Both are fitted on each half of the rows and weigh the other
half, so that no text vouches for itself. The log importance weight of a text is the log-ratio of its
likelihoods under the two models: the sum over all its features, divided by ``TEMPERATURE`` (1 is the
ratio itself; more flattens the weights). Adding Gumbel noise that depends on the id and the text and
taking the k largest sums draws k rows without replacement in proportion to the weights. ``k`` is
the share of good rows among the labelled ones, of all rows.

The weights are those of whole texts, so evidence grows with length: the draw is close to certain for
long texts that are clearly like or unlike the target, and open for short ones.

Scale. Counts are histograms of fixed size, added up in the tasks first. The target may be fitted on
at most about ``FIT_ROWS`` labelled rows, picked by hash, whose ids are sent to the workers; all
other counts cover every row. The k-th largest key is found by counting key prefixes, so nothing is
sorted globally or collected.

Defined cases: null, empty or blank text: no weight, not kept, and not counted for k; no usable label:
all rows with text are kept; ties at the k-th key are all kept, so equal rows fare alike; rows that
share an id but not the text draw their own noise; labels
without a row and rows without a label are fine; other columns are not read; an empty table gives an
empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .common import materialize, slices
from .words import _BYTES, _ODD, _powers_to

BUCKETS = 1 << 14
TEMPERATURE = 1.0
FIT_ROWS = 200_000
#: Pseudo-counts by which a bucket's ratio is drawn to 1, so that rare features say little.
PRIOR = 1.0
SEED = 11

_CLASS = np.array([0 if c <= 32 else 1 if c >= 128 or chr(c).isalnum() else 2 for c in range(256)], np.uint8)
_KEY_BITS = 16


def bucketed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each token, of each neighbouring pair (-1 at the end of a text), and tokens per text."""
    raws = [(t or "").encode() for t in texts]
    codes = np.frombuffer(b" ".join([*raws, b""]), np.uint8)
    if not len(codes):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    kinds = np.concatenate([np.zeros(1, np.uint8), _CLASS[codes], np.zeros(1, np.uint8)])
    change = kinds[1:] != kinds[:-1]
    starts = np.flatnonzero(change & (kinds[1:] > 0))
    ends = np.flatnonzero(change & (kinds[:-1] > 0))
    power, inverse = _powers_to(len(codes) + 1)
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_BYTES[codes] * power[: len(codes)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= _ODD
    edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)])
    sizes = np.diff(np.searchsorted(starts, edges)).astype(np.int64)
    single = (h >> np.uint64(50)).astype(np.int64)
    pair = np.full(len(h), -1, np.int64)
    if len(h):
        mixed = ((h[:-1] ^ (h[:-1] >> np.uint64(29))) * _ODD ^ h[1:]) * _ODD
        pair[:-1] = (mixed >> np.uint64(50)).astype(np.int64) + BUCKETS
        pair[np.cumsum(sizes)[sizes > 0] - 1] = -1
    return single, pair, sizes


def _fold(h):
    """Which of two halves a row belongs to, from the hash of its id."""
    return F.pmod(F.shiftright(h, 20), F.lit(2))


def _counts(docs: DataFrame, id_col: str, text_col: str, target: np.ndarray) -> np.ndarray:
    """By fold: raw and target frequencies of the 2 * BUCKETS buckets."""
    h = F.xxhash64(docs[id_col])
    source = docs.select(h.alias("h"), docs[text_col].cast("string").alias("_text"), _fold(h).alias("fold"))
    shared = docs.sparkSession.sparkContext.broadcast(target)

    def run(batches):
        total = np.zeros((2, 2, 2 * BUCKETS), np.int64)
        for batch in batches:
            for part in slices(batch, "_text"):
                single, pair, sizes = bucketed(part.column(1).to_pylist())
                good = np.repeat(np.isin(part.column(0).to_numpy(), shared.value), sizes)
                fold = np.repeat(part.column(2).to_numpy(), sizes)
                for f in (0, 1):
                    for rows, of in ((total[f, 0], fold == f), (total[f, 1], good & (fold == f))):
                        rows += np.bincount(single[of], minlength=2 * BUCKETS)
                        p = pair[of]
                        rows += np.bincount(p[p >= 0], minlength=2 * BUCKETS)
        f, at = np.nonzero(total[:, 0])
        yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[f, 0, at]), pa.array(total[f, 1, at])], names=["f", "b", "raw", "target"])

    summed = source.mapInArrow(run, "f int, b int, raw long, target long").groupBy("f", "b").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    out = np.zeros((2, 2, 2 * BUCKETS))
    rows = summed.toPandas()  # at most 4 * BUCKETS rows
    out[rows["f"], 0, rows["b"]] = rows["raw"]
    out[rows["f"], 1, rows["b"]] = rows["target"]
    return out


def log_ratios(counts: np.ndarray) -> np.ndarray:
    """log p_target - log p_raw of each bucket under a prior at equality, for words and pairs apart."""
    out = np.zeros(2 * BUCKETS)
    for half in (slice(0, BUCKETS), slice(BUCKETS, None)):
        raw, target = counts[0, half], counts[1, half]
        expected = raw * (target.sum() / max(1.0, raw.sum()))
        out[half] = np.log((target + PRIOR) / (expected + PRIOR))
    return out


def weigh(texts: list[str | None], ratios: np.ndarray) -> np.ndarray:
    """Log-ratio of the likelihoods of each text: the sum over its features; NaN without features."""
    single, pair, sizes = bucketed(texts)
    values = ratios[single] + np.where(pair >= 0, ratios[pair], 0.0)
    out = np.full(len(sizes), np.nan)
    some = np.flatnonzero(sizes)
    if len(some):
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some])
    return out


def gumbel(seed: Column | int, *of: Column) -> Column:
    """Standard Gumbel noise that depends on the seed and the columns alone."""
    uniform = (F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(uniform))


def _ordered_bits(keys: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = keys.astype(np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits)


def kth_largest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th largest value of a long column, by counting prefixes of 16 bits in four passes; None if k < 1."""
    if k < 1:
        return None
    known, left = None, k
    for shift in (48, 32, 16, 0):
        live = rows if known is None else rows.filter(F.shiftright(column, shift + _KEY_BITS) == known)
        found = live.groupBy(F.shiftright(column, shift).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()  # at most 65536 rows
        for p, n in sorted(((r.p, r.n) for r in found), reverse=True):
            known = p
            if left <= n:
                break
            left -= n
    return known


def classify(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float | None = None,
    fit_rows: int = FIT_ROWS, seed: int = SEED, temperature: float = TEMPERATURE,
) -> DataFrame:
    """id, log_weight, gumbel_key and kept for each input row; see the module's text."""
    ship(docs.sparkSession)
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    marked = labels.filter("quality is not null").select(F.xxhash64(F.col(id_col)).alias("h"), good.alias("good"))
    n_all, n_good = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0))).first()
    chosen = marked.filter("good")
    if n_good > fit_rows:
        chosen = chosen.filter(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < int((1 << 30) * fit_rows / n_good))
    target = np.unique(np.array([r.h for r in chosen.collect()], np.int64))  # about fit_rows at most
    if share is None:
        share = n_good / n_all if n_good else 1.0
    # a row is weighed by the models of the other half, so that no text vouches for itself
    ratios = np.stack([log_ratios(c) for c in _counts(docs, id_col, text_col, target)[::-1]]) if n_good else np.zeros((2, 2 * BUCKETS))
    shared = docs.sparkSession.sparkContext.broadcast(ratios)

    text = docs[text_col].cast("string")
    source = docs.select(docs[id_col].alias("_id"), gumbel(seed, docs[id_col], text).alias("noise"), text.alias("_text"), _fold(F.xxhash64(docs[id_col])).alias("fold"))
    schema = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), *T._parse_datatype_string("log_weight double, gumbel_key double, bits long").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                texts, fold = part.column(2).to_pylist(), part.column(3).to_numpy()
                weight = np.full(len(texts), np.nan)
                for f in (0, 1):
                    if len(at := np.flatnonzero(fold == f)):
                        weight[at] = weigh([texts[i] for i in at], shared.value[f]) / temperature
                key = weight + part.column(1).to_numpy()
                none = np.isnan(weight)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(weight, mask=none), pa.array(key, mask=none), pa.array(_ordered_bits(np.where(none, -np.inf, key)), mask=none)], names=schema.names
                )

    scored = materialize(source.mapInArrow(run, schema))
    usable = scored.filter("bits is not null")
    k = int(np.ceil(share * usable.count()))
    least = kth_largest(usable, "bits", k)
    kept = F.coalesce(F.col("bits") >= F.lit(least), F.lit(False)) if least is not None else F.lit(False)
    return scored.select(F.col("_id").alias(id_col), "log_weight", "gumbel_key", kept.alias("kept"))
