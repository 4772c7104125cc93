"""Language identification (operator 7) with interpolated Kneser-Ney character models.

Method. Letters are lower-cased and everything between them becomes one blank. All training texts
are read; each task counts its character n-grams of the highest order per language, and the counts
are added up. Lower orders count the distinct left continuations of those n-grams. Each order has
one absolute discount D = n1 / (n1 + 2 n2), and the discounted mass goes to the next lower order.
Probabilities are computed as tables, order by order; every counted n-gram stays in the model.

The model holds one table per order: sorted 64-bit hashes of the n-grams, each with the languages that
have it and their log-probabilities, and the same for contexts and back-off weights. A directory of
hash prefixes bounds each look-up. Different n-grams of a slice of text are looked up once.

A text gets the language of the lowest cross-entropy per character. Every tenth training row is left
out of the counts and calibrates: its rows choose for how many characters' worth of evidence the
posterior, the ``score``, is most likely right; and their cross-entropies give, by language and length,
the limit above which at most ``FALSE_REJECTION`` of right texts lie. A text above it is marked in
``rejected``. The pick itself stays, as the caller may want it.

Scale. The rows of the model are counted first. Up to ``MODEL_ROWS`` they are sent to the workers. A
larger model is cut in shards of about that size by the two letters before the predicted one, which all
n-grams and contexts of three letters or more in one prediction share (shorter ones go to every shard).
Each shard is sent in turn and adds its part of every text's sum, so results are the same.

Defined cases: text null or without a letter: ``und``, score 0, rejected. No training rows: ``und``
for all. No calibrating rows: ``CALIBRATION`` characters and no limits. Ties go to the language that
sorts first. Texts of any length are read whole. Language, source and id are never inputs of a
prediction; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .common import materialize, slices, text_map

ORDER = 5
#: n-grams and contexts, by language, of a model or shard that is sent to the workers: some 200 MB.
MODEL_ROWS = 8_000_000
CALIBRATION = 25.0
#: Characters' worth of evidence that calibration chooses from.
EVIDENCE = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 18.0, 25.0, 40.0, 60.0, 100.0, 160.0, 250.0, 400.0, 1000.0, 10_000.0)
FALSE_REJECTION = 0.005
#: Right calibrating rows that a length class of a language needs for a limit of its own.
ENOUGH = 200
_BIN, _BINS, _CLASSES = 0.02, 2000, 24
BLANK = 32
#: Parts texts that are counted end to end; no code point.
BORDER = 0x110000
_M = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=1)
def _fold_table() -> np.ndarray:
    """Code point to lower-case letter, or blank for all that is no letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def folded(text: str | None) -> np.ndarray:
    """Codes of the text with one blank between words and at both ends; empty if it has no letter."""
    if not text:
        return np.empty(0, np.uint32)
    codes = _fold_table()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    keep = codes != BLANK
    if not keep.any():
        return np.empty(0, np.uint32)
    keep[1:] |= codes[:-1] != BLANK
    codes = codes[keep]
    return np.concatenate([codes[:0] if codes[0] == BLANK else [np.uint32(BLANK)], codes, codes[:0] if codes[-1] == BLANK else [np.uint32(BLANK)]]).astype(np.uint32)


def hashes(grams: list[np.ndarray]) -> np.ndarray:
    """Hash of the n-grams whose characters are given column by column."""
    h = np.zeros(len(grams[0]), np.uint64)
    for column in grams:
        h = (h ^ column.astype(np.uint64)) * _M
        h ^= h >> np.uint64(29)
    return h


class HashRows:
    """Values by (64-bit hash, language), with a directory over the top bits of the distinct sorted hashes."""

    def __init__(self, keys: np.ndarray, lang: np.ndarray, values: np.ndarray) -> None:
        order = np.lexsort((lang, keys))
        keys, self.lang, self.values = keys[order], lang[order].astype(np.int32), values[order].astype(np.float32)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
        self.keys, self.at = keys[first], np.append(first, len(keys)).astype(np.int64)
        self.bits = max(1, int(max(1, len(self.keys)) - 1).bit_length())
        self.shift = np.uint64(64 - self.bits)
        edges = np.arange(1 << self.bits, dtype=np.uint64) << self.shift
        self.start = np.append(np.searchsorted(self.keys, edges), len(self.keys)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Index of each wanted hash, or -1."""
        out = np.full(len(wanted), -1, np.int64)
        if not len(self.keys) or not len(wanted):
            return out
        top = (wanted >> self.shift).astype(np.int64)
        at, end = self.start[top], self.start[top + 1]
        last = len(self.keys) - 1
        hit = self.keys[np.minimum(at, last)] == wanted
        hit &= at < end
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (at + 1 < end))
        step = 1
        while len(left):
            here = at[left] + step
            ok = self.keys[here] == wanted[left]
            out[left[ok]] = here[ok]
            step += 1
            left = left[~ok & (here + 1 < end[left])]
        return out

    def entries(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, language, value) of all that is known about the wanted hashes."""
        found = self.find(wanted)
        row = np.flatnonzero(found >= 0)
        low, count = self.at[found[row]], self.at[found[row] + 1] - self.at[found[row]]
        at = np.arange(count.sum()) + np.repeat(low - np.cumsum(count) + count, count)
        return np.repeat(row, count), self.lang[at], self.values[at]


class Scorer:
    """One shard of the model: log-probabilities of the characters that are its own."""

    def __init__(self, languages: list[str], grams: list[HashRows], contexts: list[HashRows], floor: float, shard: int = 0, shards: int = 1) -> None:
        self.languages, self.grams, self.contexts, self.floor, self.shard, self.shards = languages, grams, contexts, floor, shard, shards

    def log_probs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each n-gram of the highest order in ``codes`` the number of its row, or -1 if another shard has it, and
        the rows: the log-probability of the last character in each language. ``codes`` may hold many texts end to
        end; n-grams across a border are the caller's to drop."""
        order = len(self.grams)
        n = len(codes) - order + 1
        if n <= 0:
            return np.empty(0, np.int64), np.zeros((0, len(self.languages)), np.float32)
        number, keys = pd.factorize(hashes([codes[j : j + n] for j in range(order)]))
        first = np.empty(len(keys), np.int64)
        first[number[::-1]] = np.arange(n)[::-1]
        columns = [codes[first + j] for j in range(order)]
        if self.shards > 1:
            own = shard_of(columns[order - 3], columns[order - 2], self.shards) == self.shard
            place = np.where(own, np.cumsum(own) - 1, -1)
            number, columns = place[number], [c[own] for c in columns]
        rows = np.full((len(columns[0]), len(self.languages)), self.floor, np.float32)
        for k in range(1, order + 1):
            tail = columns[order - k :]
            at, lang, value = self.contexts[k - 1].entries(hashes(tail[:-1]) if k > 1 else np.zeros(len(rows), np.uint64))
            rows[at, lang] += value
            at, lang, value = self.grams[k - 1].entries(hashes(tail))
            rows[at, lang] = value
        return number, rows

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood of each text by language, as far as this shard goes, and its number of characters."""
        order = len(self.grams)
        pad = np.full(order - 2, BLANK, np.uint32)
        rows = [np.concatenate([pad, p]) if len(p) else p for p in map(folded, texts)]
        lengths = np.array([len(r) for r in rows], np.int64)
        out, n = np.zeros((len(texts), len(self.languages))), np.maximum(lengths - order + 1, 0)
        if self.languages and lengths.sum():
            number, values = self.log_probs(np.concatenate(rows))
            starts = np.cumsum(lengths) - lengths
            for i in np.flatnonzero(n):
                part = number[starts[i] : starts[i] + n[i]]
                out[i] = values[part if self.shards == 1 else part[part >= 0]].sum(axis=0, dtype=np.float64)
        return out, n


def shard_of(a, b, shards: int):
    """The shard of an n-gram from the two characters before its last, as numbers or as columns."""
    mixed = a * 31 + b
    return F.pmod(mixed, F.lit(shards)) if isinstance(mixed, Column) else mixed.astype(np.int64) % shards


class Decision:
    """Language, score and rejection from log-likelihoods."""

    def __init__(self, languages: list[str], evidence: float = CALIBRATION, limits: np.ndarray | None = None) -> None:
        self.languages, self.evidence = languages, evidence
        self.limits = np.full((len(languages), _CLASSES), np.inf) if limits is None else limits

    def decide(self, sums: np.ndarray, n: np.ndarray) -> dict:
        langs, scores, rejected = np.full(len(n), "und", object), np.zeros(len(n)), np.ones(len(n), bool)
        entropy = np.full(len(n), np.nan)
        some = np.flatnonzero(n) if self.languages else np.empty(0, np.int64)
        if len(some):
            mean = sums[some] / n[some, None]
            best = mean.argmax(axis=1)
            top = mean[np.arange(len(some)), best]
            scores[some] = 1.0 / np.exp((mean - top[:, None]) * np.minimum(self.evidence, n[some])[:, None]).sum(axis=1)
            langs[some], entropy[some] = np.array(self.languages, object)[best], -top
            rejected[some] = -top > self.limits[best, length_class(n[some])]
        return {"lang_pred": langs.tolist(), "score": scores, "rejected": rejected, "cross_entropy": pa.array(entropy, mask=np.isnan(entropy))}


def length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)).astype(np.int64), _CLASSES - 1)


class _Counter:
    """n-gram counts of one task, by language, as packed integers over the letters met so far."""

    FLUSH, HELD = 2_000_000, 1_000_000

    def __init__(self, order: int) -> None:
        self.order, self.bits = order, 63 // order
        self.pad = np.full(order - 2, BLANK, np.uint32)
        self.border = np.full(1, BORDER, np.uint32)
        self.pending: dict[str, list[np.ndarray]] = {}
        self.size = 0
        self.reset()

    def reset(self) -> None:
        self.number = np.full(BORDER + 1, -1, np.int32)
        self.letters = np.empty(0, np.uint32)
        self.counts: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.held = 0

    def add(self, lang: str, codes: np.ndarray) -> None:
        self.pending.setdefault(lang, []).extend([self.pad, codes, self.border])
        self.size += len(codes) + self.order

    def flush(self):
        """Count what is pending; yields batches when the alphabet or the table is full."""
        for lang, rows in self.pending.items():
            codes = np.concatenate(rows)
            # a part with too many letters for the packing is halved until it fits
            parts = [codes]
            while parts:
                part = parts.pop()
                new = np.unique(part[self.number[part] < 0])
                new = new[new != BORDER]
                if len(self.letters) + len(new) > 1 << self.bits:
                    if len(self.letters):
                        yield from self.rows()
                        parts.append(part)
                    else:
                        middle = len(part) // 2
                        parts += [part[: middle + self.order - 1], part[middle:]]
                    continue
                self.number[new] = np.arange(len(self.letters), len(self.letters) + len(new))
                self.letters = np.concatenate([self.letters, new])
                n = len(part) - self.order + 1
                if n <= 0:
                    continue
                dense = self.number[part].astype(np.int64)
                key, ok = np.zeros(n, np.int64), np.ones(n, bool)
                for j in range(self.order):
                    column = dense[j : j + n]
                    ok &= column >= 0
                    key = key << self.bits | column
                self.keep(lang, key[ok], None)
        self.pending.clear()
        self.size = 0
        if self.held > self.HELD:
            yield from self.rows()

    def keep(self, lang: str, keys: np.ndarray, n: np.ndarray | None) -> None:
        at, distinct = pd.factorize(keys)
        known = self.counts.setdefault(lang, [])
        known.append((distinct, np.bincount(at, n, len(distinct)).astype(np.int64)))
        self.held += len(distinct)
        if len(known) >= 8:
            self.held -= sum(len(k) for k, _ in known)
            keys, n = (np.concatenate(x) for x in zip(*known))
            del known[:]
            self.keep(lang, keys, n)

    def rows(self):
        mask = (1 << self.bits) - 1
        for lang, known in self.counts.items():
            keys, n = (np.concatenate(x) for x in zip(*known))
            for a in range(0, len(keys), 50_000):
                k = keys[a : a + 50_000]
                codes = np.stack([self.letters[k >> (self.bits * (self.order - 1 - j)) & mask] for j in range(self.order)], axis=1)
                grams = np.ascontiguousarray(codes.astype(np.uint32)).view(f"<U{self.order}").ravel().tolist()
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(grams, pa.string()), pa.array(n[a : a + 50_000], pa.int64())], names=["lang", "gram", "n"])
        self.reset()


def _count_rows(train: DataFrame, order: int) -> DataFrame:
    """(lang, gram, n): n-grams of the highest order, added up inside each task first."""
    ship(train.sparkSession)

    def run(batches):
        counter = _Counter(order)
        for batch in batches:
            for part in slices(batch, "_text"):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    codes = folded(text)
                    if len(codes):
                        counter.add(lang, codes)
                if counter.size > counter.FLUSH:
                    yield from counter.flush()
        yield from counter.flush()
        yield from counter.rows()

    return train.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _tables(train: DataFrame, order: int) -> tuple[list[str], float, list[DataFrame], list[DataFrame], int]:
    """Languages, log-probability of an unknown character before back-off, and by order the tables (lang, gram, value)
    and (lang, context, value) of log-probabilities and back-off weights; and the rows of all tables."""
    levels = {order: materialize(_count_rows(train, order))}
    for k in range(order - 1, 0, -1):
        levels[k] = materialize(levels[k + 1].groupBy("lang", F.substring("gram", 2, k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
    letters, rows = levels[1].select(F.countDistinct("gram")).first()[0], 0
    floor = -float(np.log(letters + 1.0))
    grams, contexts, languages = [], [], []
    for k in range(1, order + 1):
        of = levels[k].groupBy("lang").agg(F.sum((F.col("n") == 1).cast("long")).alias("n1"), F.sum((F.col("n") == 2).cast("long")).alias("n2"), F.count(F.lit(1)).alias("rows"))
        seen = of.toPandas()  # one row per language
        rows += int(seen["rows"].sum())
        languages = sorted(seen["lang"])
        discount = F.least(F.lit(0.95), F.greatest(F.lit(0.1), F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.5)))
        context = F.substring("gram", 1, k - 1).alias("context")
        sums = levels[k].groupBy("lang", context).agg(F.sum("n").alias("cn"), F.count(F.lit(1)).alias("types")).join(F.broadcast(of.select("lang", discount.alias("d"))), "lang")
        sums = materialize(sums)
        rows += sums.count()
        joined = levels[k].select("lang", "gram", "n", context).join(sums, ["lang", "context"])
        back = F.col("d") * F.col("types") / F.col("cn")
        if k == 1:
            lower = joined.withColumn("low", F.lit(floor))
        else:
            below = grams[-1].select("lang", F.col("gram").alias("tail"), F.col("value").alias("low"))
            lower = joined.withColumn("tail", F.substring("gram", 2, k - 1)).join(below, ["lang", "tail"])
        value = F.log((F.col("n") - F.col("d")) / F.col("cn") + back * F.exp("low"))
        grams.append(materialize(lower.select("lang", "gram", value.alias("value"))))
        contexts.append(sums.select("lang", "context", F.log(back).alias("value")))
    return languages, floor, grams, contexts, rows


class Model:
    """The tables of a model, in as many shards as it takes, and how to decide."""

    def __init__(self, languages: list[str], floor: float, grams: list[DataFrame], contexts: list[DataFrame], shards: int) -> None:
        self.languages, self.floor, self.grams, self.contexts, self.shards = languages, floor, grams, contexts, shards
        self.decision = Decision(languages)
        self._first: Scorer | None = None

    def scorer(self, shard: int = 0) -> Scorer:
        """One shard, gathered: about ``MODEL_ROWS`` rows, or all if there is one."""
        if shard == 0 and self._first is not None:
            return self._first
        number = {lang: i for i, lang in enumerate(self.languages)}

        def rows(table: DataFrame, name: str, width: int, end: int) -> HashRows:
            if self.shards > 1 and end >= 2:
                table = table.filter(shard_of(F.ascii(F.substring(name, end - 1, 1)).cast("long"), F.ascii(F.substring(name, end, 1)).cast("long"), self.shards) == shard)
            got = table.toArrow().to_pandas()
            lang = got["lang"].map(number).to_numpy(np.int64) if len(got) else np.empty(0, np.int64)
            keys = hashes(_codes(got[name], width)) if width else np.zeros(len(got), np.uint64)
            return HashRows(keys, lang, got["value"].to_numpy(np.float64))

        order = range(1, len(self.grams) + 1)
        made = Scorer(self.languages, [rows(self.grams[k - 1], "gram", k, k - 1) for k in order], [rows(self.contexts[k - 1], "context", k - 1, k - 1) for k in order], self.floor, shard, self.shards)
        if shard == 0:
            self._first = made
        return made


def _codes(grams: pd.Series, k: int) -> list[np.ndarray]:
    if not len(grams):
        return [np.empty(0, np.uint32)] * k
    flat = np.frombuffer("".join(grams).encode("utf-32-le"), np.uint32).reshape(-1, k)
    return [flat[:, j] for j in range(k)]


def _sums(rows: DataFrame, model: Model, id_col: str) -> DataFrame:
    """(id, sums, n) for (id, _text) rows: log-likelihoods by language, shard after shard."""
    outputs = "sums array<double>, n long"

    def scored(df: DataFrame, key: str, shard: int) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(model.scorer(shard))

        def run(texts):
            sums, n = shared.value.sums(texts)
            return {"sums": list(sums), "n": n}

        return text_map(df, key, "_text", outputs, run)

    if model.shards == 1:
        return scored(rows, id_col, 0)
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()))
    parts = [materialize(scored(numbered, "_row", shard)) for shard in range(model.shards)]
    total = F.array(*[F.sum(F.col("sums")[i]) for i in range(len(model.languages))])
    added = reduce(DataFrame.unionByName, parts).groupBy("_row").agg(total.alias("sums"), F.max("n").alias("n"))
    return numbered.select("_row", id_col).join(added, "_row").select(id_col, "sums", "n")


def _calibrate(rows: DataFrame, model: Model) -> Decision:
    """Choose the evidence and the limits from (lang, _text) rows that no count has seen. Histograms of fixed size."""
    number = {lang: i for i, lang in enumerate(model.languages)}
    size = len(number)

    def run(batches):
        loss, seen = np.zeros(len(EVIDENCE)), np.zeros((size, _CLASSES, _BINS), np.int64)
        for batch in batches:
            n = batch.column(2).to_numpy(zero_copy_only=False)
            true = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            at = np.flatnonzero((n > 0) & (true >= 0))
            if not len(at):
                continue
            mean = np.asarray(batch.column(1).flatten()).reshape(-1, size)[at] / n[at, None]
            n, true = n[at], true[at]
            best = mean.argmax(axis=1)
            for e, evidence in enumerate(EVIDENCE):
                logits = (mean - mean.max(axis=1)[:, None]) * np.minimum(evidence, n)[:, None]
                loss[e] += (np.log(np.exp(logits).sum(axis=1)) - logits[np.arange(len(n)), true]).sum()
            right = best == true
            bins = np.minimum((-mean[np.arange(len(n)), best] / _BIN).astype(np.int64), _BINS - 1)
            np.add.at(seen, (best[right], length_class(n[right]), bins[right]), 1)
        flat = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.full(len(loss), -1), np.zeros(len(flat), np.int64))), pa.array(np.append(np.arange(len(loss)), flat)), pa.array(np.append(loss, seen.ravel()[flat]))], names=["kind", "at", "v"])

    if not size:
        return Decision(model.languages)
    added = _sums(rows, model, "lang").mapInArrow(run, "kind long, at long, v double").groupBy("kind", "at").agg(F.sum("v").alias("v")).toPandas()
    loss, seen = np.zeros(len(EVIDENCE)), np.zeros(size * _CLASSES * _BINS)
    loss[added["at"][added["kind"] < 0]] = added["v"][added["kind"] < 0]
    seen[added["at"][added["kind"] == 0]] = added["v"][added["kind"] == 0]
    seen = seen.reshape(size, _CLASSES, _BINS)
    if not seen.sum():
        return Decision(model.languages)
    limits = np.full((size, _CLASSES), np.inf)
    for lang in range(size):
        for c in range(_CLASSES):
            for rows_of in (seen[lang, c], seen[lang].sum(axis=0)):
                if rows_of.sum() >= ENOUGH:
                    limits[lang, c] = _BIN * (1 + np.searchsorted(np.cumsum(rows_of), (1 - FALSE_REJECTION) * rows_of.sum()))
                    break
    return Decision(model.languages, EVIDENCE[int(loss.argmin())], limits)


def fit(docs: DataFrame, train_if: Column, text_col: str = "text", lang_col: str = "lang", order: int = ORDER, model_rows: int = MODEL_ROWS) -> Model:
    """Train on all rows where ``train_if`` holds and language and text are not null; a tenth of them calibrates."""
    ship(docs.sparkSession)
    train = docs.filter(train_if & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("_text")
    )
    calibrates = F.pmod(F.xxhash64("_text"), F.lit(10)) == 0
    languages, floor, grams, contexts, rows = _tables(train.filter(~calibrates), order)
    model = Model(languages, floor, grams, contexts, max(1, -(-rows // model_rows)))
    model.decision = _calibrate(train.filter(calibrates), model)
    return model


OUTPUTS = "lang_pred string, score double, rejected boolean, cross_entropy double"


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: lang_pred, score, rejected and cross_entropy from the text alone. With one shard there is no shuffle."""
    decision = docs.sparkSession.sparkContext.broadcast(model.decision)
    if model.shards == 1:
        shared = docs.sparkSession.sparkContext.broadcast(model.scorer())
        return text_map(docs, id_col, text_col, OUTPUTS, lambda texts: decision.value.decide(*shared.value.sums(texts)))
    rows = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"))
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T._parse_datatype_string(OUTPUTS).fields])

    def run(batches):
        for batch in batches:
            sums = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            made = decision.value.decide(sums, batch.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[made[f.name] if isinstance(made[f.name], pa.Array) else pa.array(made[f.name]) for f in schema.fields[1:]]], names=schema.names)

    return _sums(rows, model, "_id").mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training must not see: crc32 of the id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Train on the rows not held out, predict all: id, held_out, lang_pred, score, rejected, cross_entropy."""
    model = fit(docs, ~held_out(id_col), text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(
        id_col, held_out(id_col).alias("held_out"), "lang_pred", "score", "rejected", "cross_entropy"
    )
