"""N-gram Jaccard join (operator 2) with Bayesian candidate pruning.

Method. A text is the set of its word ``SHINGLE``-grams. Texts with equal words are one class from the
start and only their representative goes on, so copies are never paired. ``HASHES`` MinHash values
are cut into bands of ``ROWS``; texts that agree in a band are candidates. A candidate's MinHash
values are then compared ``BATCH`` at a time. With m of n equal, the similarity has the posterior
Beta(m + 1, n - m + 1), and once the probability of reaching the threshold is below ``TOLERANCE`` the
pair is dropped. The rest is verified exactly on the sets. Verified links are joined to groups.

Large buckets. In a bucket of up to ``PAIR_LIMIT`` texts all pairs are candidates that are joined to their
texts. In a larger one all pairs are candidates as well, but they are never rows: the texts are dealt to
blocks, each two blocks meet in one task, and that task compares, prunes and verifies all pairs between
them. It gives one row for each text that has a link there: the number of its links and one text of its
group. So that a pair counts once, it belongs to the first band where both are in one large bucket, and
only if there is none to the small buckets. Blocks are bounded by texts and by shingles. The time of a
large bucket grows with the square of its texts, as the number of links itself may.

Skew. Exact copies are counted before any shuffle. Hot classes and buckets are found by counting and
spread by salts; the members of a large group are split by the adaptive join.

Result: one row for each input row with its group (``class_id``, the least id in it), the
representative of its text (``text_id``), ``n_copies`` (rows with equal words) and ``n_links``
(different texts that it was verified against with success).

Identity. Texts are told apart by 128 bits of their words and numbered; ids only name the result. Rows
that share an id but not the text are different texts, and each of them keeps its own group.

Defined cases: a row whose text is null or has no words is alone in its class; a null id is alone as
well, with a null class; texts with less than ``SHINGLE`` words are one shingle; equal rows share a
class; an empty table gives an empty result; only the id and the text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.tables import ship
from .common import arrow_type, bitmap, join_stats, lean, materialize, slices
from .words import hashed, mix

THRESHOLD = 0.5
SHINGLE = 3
HASHES = 96
ROWS = 3
BATCH = 8
TOLERANCE = 1e-3
PAIR_LIMIT = 32
#: Texts and shingles in a block of a large bucket, on average; they bound a task's memory and never change a result.
BLOCK = 1024
BLOCK_SHINGLES = 1_000_000
#: Shingles that a verifying task remembers before it starts afresh: 16 MB; it only costs time.
CACHED_SHINGLES = 2_000_000

_rng = np.random.Generator(np.random.PCG64(2024))
_A = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64)


def shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts end to end, and their number for each text."""
    flat, sizes = hashed(texts)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    n = len(flat) - SHINGLE + 1
    counts = np.where(sizes >= SHINGLE, sizes - SHINGLE + 1, (sizes > 0).astype(np.int64))
    full = np.flatnonzero(doc[: max(0, n)] == doc[SHINGLE - 1 :]) if n > 0 else np.empty(0, np.int64)
    out = np.empty(int(counts.sum()), np.uint64)
    starts = np.cumsum(counts) - counts
    word_starts = np.cumsum(sizes) - sizes
    if len(full):
        out[starts[doc[full]] + full - word_starts[doc[full]]] = mix([flat[full + j] for j in range(SHINGLE)])
    for i in np.flatnonzero((sizes > 0) & (sizes < SHINGLE)):
        out[starts[i]] = mix([flat[word_starts[i] + j : word_starts[i] + j + 1] for j in range(sizes[i])])[0]
    return out, counts


def signatures(flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, one row for each text; rows of texts without shingles hold zeros."""
    out = np.zeros((len(counts), HASHES), np.int32)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        for k in range(HASHES):
            h = flat * _A[k]
            h += _B[k]
            h >>= np.uint64(32)
            out[some, k] = np.minimum.reduceat(h, starts).astype(np.uint32).view(np.int32)
    return out


def text_keys(flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for the sequence of shingles, hence of words."""
    keys = []
    place = np.arange(len(flat), dtype=np.uint64) - np.repeat((np.cumsum(counts) - counts).astype(np.uint64), counts)
    for salt in (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E6C63D0876A9A35)):
        h = mix([flat, place * salt + salt])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h, dtype=np.uint64)])
        ends = np.cumsum(counts)
        keys.append((sums[ends] - sums[ends - counts]).view(np.int64))
    return keys[0], keys[1]


def needed_matches(threshold: float, tolerance: float = TOLERANCE) -> np.ndarray:
    """For n compared values, the least number of equal ones with P(similarity >= threshold) >= tolerance."""
    grid = (np.arange(20_000) + 0.5) / 20_000
    out = []
    for n in range(0, HASHES + 1):
        for m in range(n + 1):
            log = m * np.log(grid) + (n - m) * np.log1p(-grid)
            weight = np.exp(log - log.max())
            if weight[grid >= threshold].sum() >= tolerance * weight.sum():
                out.append(m)
                break
        else:
            out.append(n + 1)
    return np.array(out)


def surviving(a: np.ndarray, b: np.ndarray, needed: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices stay candidates, comparing ``BATCH`` values more at each step."""
    live = np.arange(len(a))
    equal = np.zeros(len(a), np.int64)
    for start in range(0, HASHES, BATCH):
        stop = min(HASHES, start + BATCH)
        equal[live] += (a[live, start:stop] == b[live, start:stop]).sum(axis=1)
        live = live[equal[live] >= needed[stop]]
    out = np.zeros(len(a), bool)
    out[live] = True
    return out


def _described(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2, sig, size) of the rows that have words and an id; size is the number of shingles."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("_text")).filter("id is not null and _text is not null")
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("k1 long, k2 long, sig array<int>, size long").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = shingles(part.column(1).to_pylist())
                sig = signatures(flat, counts)
                k1, k2 = text_keys(flat, counts)
                some = np.flatnonzero(counts)
                values = pa.FixedSizeListArray.from_arrays(pa.array(sig[some].ravel()), HASHES).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(k1[some]), pa.array(k2[some]), values, pa.array(counts[some], pa.int64())], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, k1, k2) of the rows that have words and an id; the texts stay where they are."""
    source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("_text")).filter("id is not null and _text is not null")
    schema = T.StructType([source.schema["id"], *T._parse_datatype_string("k1 long, k2 long").fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                flat, counts = shingles(part.column(1).to_pylist())
                k1, k2 = text_keys(flat, counts)
                some = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(some)), pa.array(k1[some]), pa.array(k2[some])], names=schema.names)

    return source.mapInArrow(lean(run), schema)


def keyed_rows(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """The rows with words and an id, all their columns in ``row``, by (k1, k2) of their texts.

    Rows whose k1 is not in ``wanted`` are mostly sifted out by a bitmap of fixed size; the caller's join decides.
    """
    shared = bitmap(wanted, F.col("k1"))
    at, source = docs.columns.index(text_col), docs.filter(docs[id_col].isNotNull() & docs[text_col].isNotNull())
    schema = T.StructType([*T._parse_datatype_string("k1 long, k2 long").fields, T.StructField("row", T.StructType(docs.schema.fields))])
    fields = list(arrow_type(schema["row"].dataType))

    def run(batches):
        for batch in batches:
            for part in slices(batch, batch.schema.names[at]):
                flat, counts = shingles(part.column(at).cast(pa.string()).to_pylist())
                k1, k2 = text_keys(flat, counts)
                some = np.flatnonzero((counts > 0) & shared.value.has(k1))
                row = pa.StructArray.from_arrays([c.cast(f.type) for c, f in zip(part.take(pa.array(some)).columns, fields)], fields=fields)
                yield pa.RecordBatch.from_arrays([pa.array(k1[some]), pa.array(k2[some]), row], names=schema.names)

    return source.mapInArrow(lean(run), schema)


class _Texts:
    """Looks up texts by the numbers of their classes."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, classes: DataFrame) -> None:
        self.source = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
        self.classes = classes.select(F.col("uid").alias("id"), "k1", "k2")

    def of(self, named: DataFrame) -> DataFrame:
        """(id, _text) of the classes in ``named``. Copies of a text shrink to one before the shuffle."""
        wanted = materialize(self.classes.join(named.select("id"), "id", "left_semi"))
        rows = keyed_rows(self.source, "id", "text", wanted)
        one = rows.groupBy("k1", "k2").agg(F.first("row.text").alias("_text"))
        return materialize(one.join(wanted, ["k1", "k2"]).select("id", "_text"))


def _attach(pairs: DataFrame, table: DataFrame, key: str, value: str, named: str) -> DataFrame:
    """Add ``value`` of ``table`` (by id) for the id in ``key``. Where an id has many pairs, the adaptive skew
    join splits them over tasks and sends its one row to each."""
    return pairs.join(table.select(F.col("id").alias("_id"), F.col(value).alias(named)), F.col(key) == F.col("_id")).drop("_id")


def _candidates(members: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """From (band, key, id) rows: all pairs (a, b) of small buckets, and (band, key, id) of large ones, if any."""
    sizes = materialize(members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    shared = materialize(join_stats(members, sizes, ["key"], "n"))
    small = shared.filter(F.col("n") <= PAIR_LIMIT).groupBy("key").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    at = F.posexplode("ids").alias("i", "a")
    pairs = small.select("ids", at).select("a", F.explode(F.slice("ids", F.col("i") + 2, F.lit(PAIR_LIMIT))).alias("b"))
    large = shared.filter(F.col("n") > PAIR_LIMIT).select("band", "key", "id")
    return pairs, None if large.isEmpty() else large


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One number for each band of each signature; equal where the bands are."""
    columns = sig[:, :HASHES].astype(np.int64).view(np.uint64)
    return np.stack([mix([columns[:, b + j] for j in range(ROWS)]) for b in range(0, HASHES, ROWS)], axis=1)


def large_bands(sig: np.ndarray) -> np.ndarray:
    """Which bands of each text are large buckets, from the bits behind its signature."""
    return (sig[:, HASHES, None] >> np.arange(HASHES // ROWS, dtype=np.int32)) & 1 == 1


def block_links(band: int, sig: np.ndarray, texts: list[str], side: np.ndarray | None, needed: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Number of links of each text, and the place of one text of its group, from all pairs of a large bucket's block.

    With ``side`` only pairs of a False and a True text are asked. Pairs that an earlier large bucket has are left to it.
    """
    keys, large = band_keys(sig), large_bands(sig)
    pairs: dict[int, np.ndarray] = {}
    others = None if side is None else np.flatnonzero(side)
    for i in range(len(sig)) if side is None else np.flatnonzero(~side):
        js = np.arange(i + 1, len(sig)) if others is None else others
        js = js[~((keys[js, :band] == keys[i, :band]) & large[i, :band]).any(axis=1)]
        js = js[surviving(np.broadcast_to(sig[i, :HASHES], (len(js), HASHES)), sig[js, :HASHES], needed)]
        if len(js):
            pairs[i] = js
    links, group = np.zeros(len(sig), np.int64), np.arange(len(sig))
    if not pairs:
        return links, group
    some = np.unique(np.concatenate([np.fromiter(pairs, np.int64), *pairs.values()]))
    flat, counts = shingles([texts[i] for i in some])
    names, flat = np.unique(flat, return_inverse=True)
    sets = [np.unique(x) for x in np.split(flat, np.cumsum(counts)[:-1])]
    size = np.zeros(len(sig), np.int64)
    size[some] = [len(x) for x in sets]
    of = dict(zip(some.tolist(), sets))
    mark = np.zeros(len(names), bool)
    for i, js in pairs.items():
        js = js[np.minimum(size[i], size[js]) >= threshold * np.maximum(size[i], size[js])]
        mark[of[i]] = True
        both = np.fromiter((np.count_nonzero(mark[of[j]]) for j in js.tolist()), np.int64, len(js))
        mark[of[i]] = False
        js = js[both >= threshold * (size[i] + size[js] - both)]
        links[i] += len(js)
        links[js] += 1
        met = np.unique(np.append(group[js], group[i]))
        if len(met) > 1:
            group[np.isin(group, met)] = met[0]
    return links, group


def _block_links(large: DataFrame, reps: DataFrame, texts_of: _Texts, threshold: float) -> DataFrame:
    """(id, other, n): n links of the text in one task of a large bucket, and one text of its group there."""
    named = large.select("id").distinct()
    texts = materialize(texts_of.of(named).join(reps, "id"))
    sized = large.join(texts.select("id", "size"), "id")
    blocks = materialize(
        sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    )
    dealt = join_stats(large, blocks, ["key"], "n").withColumn("at", F.pmod(F.xxhash64("key", "id"), F.col("blocks")).cast("int"))
    tasks = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("band", "key", "at", F.least("at", "with").alias("lo"), F.greatest("at", "with").alias("hi"), "id")
    needed = needed_matches(threshold)
    schema = T._parse_datatype_string("id long, other long, n long")

    def run(table: pa.Table) -> pa.Table:
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sig = np.asarray(table.column("sig").combine_chunks().flatten()).reshape(-1, HASHES + 1)
        side = None if lo == hi else table.column("at").to_numpy() == hi
        links, group = block_links(table.column("band")[0].as_py(), sig, table.column("_text").to_pylist(), side, needed, threshold)
        some = np.flatnonzero(links)
        ids = table.column("id").combine_chunks()
        return pa.table([ids.take(pa.array(some)), ids.take(pa.array(group[some])), pa.array(links[some])], names=schema.names)

    ready = tasks.join(texts.select("id", "sig", "_text"), "id")
    return materialize(ready.groupBy("key", "lo", "hi").applyInArrow(run, schema))


def _verified(pairs: DataFrame, reps: DataFrame, texts_of: _Texts, threshold: float) -> DataFrame:
    """The distinct pairs (a, b) whose sets reach the threshold, without those that share a large bucket."""
    kind = arrow_type(pairs.schema["a"].dataType)
    with_sigs = _attach(_attach(pairs, reps, "a", "sig", "sa"), reps, "b", "sig", "sb")
    needed = needed_matches(threshold)
    schema = T.StructType([pairs.schema["a"], pairs.schema["b"]])

    def matrix(column) -> np.ndarray:
        return np.asarray(column.flatten()).reshape(-1, HASHES + 1)

    def prune(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = matrix(batch.column(2)), matrix(batch.column(3))
                keep = surviving(x[:, :HASHES], y[:, :HASHES], needed)
                some = np.flatnonzero(keep & (x[:, HASHES] & y[:, HASHES] != 0))
                keep[some] = ~((band_keys(x[some]) == band_keys(y[some])) & large_bands(x[some])).any(axis=1)
                keep = pa.array(keep)
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    left = materialize(with_sigs.select("a", "b", "sa", "sb").mapInArrow(lean(prune), schema))
    named = materialize(left.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = texts_of.of(named)
    with_texts = _attach(_attach(left, texts, "a", "_text", "ta"), texts, "b", "_text", "tb")

    def verify(batches):
        cache: dict[object, np.ndarray] = {}
        held = 0
        for batch in batches:
            for part in slices(batch, "tb"):
                ids_a, ids_b = part.column(0).to_pylist(), part.column(1).to_pylist()
                fresh = {}
                for column, ids in ((part.column(2), ids_a), (part.column(3), ids_b)):
                    for i, x in zip(ids, column.to_pylist()):
                        if i not in cache:
                            fresh[i] = x
                if held > CACHED_SHINGLES:
                    cache.clear()
                    held = 0
                    fresh = dict(zip(ids_a, part.column(2).to_pylist())) | dict(zip(ids_b, part.column(3).to_pylist()))
                flat, counts = shingles(list(fresh.values()))
                held += len(flat)
                for i, rows in zip(fresh, np.split(flat, np.cumsum(counts)[:-1])):
                    cache[i] = np.unique(rows)
                good_a, good_b = [], []
                for a, b in zip(ids_a, ids_b):
                    x, y = cache[a], cache[b]
                    both = len(np.intersect1d(x, y, assume_unique=True)) if min(len(x), len(y)) >= threshold * max(len(x), len(y)) else 0
                    if both >= threshold * (len(x) + len(y) - both):
                        good_a.append(a)
                        good_b.append(b)
                yield pa.RecordBatch.from_arrays([pa.array(good_a, kind), pa.array(good_b, kind)], names=["a", "b"])

    return materialize(with_texts.select("a", "b", "ta", "tb").mapInArrow(lean(verify), schema))


def components(links: DataFrame) -> DataFrame:
    """(id, root): the least id of each connected group of the links (a, b). Labels and their labels' labels
    are lowered until nothing changes, in about log(diameter) rounds."""
    both = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(links.select(F.col("b").alias("src"), F.col("a").alias("dst"))).distinct())
    labels = materialize(both.groupBy(F.col("src").alias("id")).agg(F.least("src", F.min("dst")).alias("root")))
    while True:
        # a hub's links and a large group's labels are split by the adaptive skew join, and shrink in the map-side minimum
        of = labels.select(F.col("id").alias("dst"), "root")
        near = both.join(of, "dst").groupBy(F.col("src").alias("id")).agg(F.min("root").alias("low"))
        up = labels.select(F.col("id").alias("root"), F.col("root").alias("up"))
        jumped = labels.join(up, "root").join(near, "id")
        new = materialize(jumped.select("id", F.col("root").alias("was"), F.least("root", "low", "up").alias("root")))
        labels = new.select("id", "root")
        if new.filter("was <> root").isEmpty():
            return labels


def text_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each different text that has words and an id: k1, k2, text_id, n_copies, class_id, n_links, and
    ``leads`` for the one text of each group that has the least (text_id, k1, k2)."""
    ship(docs.sparkSession)
    described = _described(docs, id_col, text_col)
    classes = materialize(
        described.groupBy("k1", "k2").agg(F.min(F.struct("id", "sig", "size")).alias("r"), F.count(F.lit(1)).alias("n_copies"))
        .select("k1", "k2", F.col("r.id").alias("id"), F.col("r.sig").alias("sig"), F.col("r.size").alias("size"), "n_copies", F.monotonically_increasing_id().alias("uid"))
    )
    reps = classes.select(F.col("uid").alias("id"), "sig", "size")
    n_bands = HASHES // ROWS
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.col("sig")[b * ROWS + j] for j in range(ROWS)]) for b in range(n_bands)])
    members = reps.select(F.posexplode(bands).alias("band", "key"), "id")
    texts_of = _Texts(docs, id_col, text_col, classes)

    pairs, large = _candidates(members)
    bits = F.lit(0) if large is None else F.coalesce("large", F.lit(0))
    if large is not None:
        reps = reps.join(large.groupBy("id").agg(F.bit_or(F.expr("shiftleft(1, band)")).alias("large")), "id", "left")
    reps = reps.select("id", F.concat("sig", F.array(bits)).alias("sig"), "size")
    if large is not None:
        reps = materialize(reps)
    links = _verified(materialize(pairs.distinct()), reps, texts_of, threshold)
    counts = links.select(F.col("a").alias("id"), F.lit(1).cast("long").alias("n")).unionByName(links.select(F.col("b").alias("id"), F.lit(1).cast("long").alias("n")))
    if large is not None:
        blocks = _block_links(large, reps, texts_of, threshold)
        counts = counts.unionByName(blocks.select("id", "n"))
        links = links.unionByName(blocks.select(F.col("id").alias("a"), F.col("other").alias("b")).filter("a <> b"))
    named = classes.select("uid", F.col("id").alias("text_id"), "k1", "k2", "n_copies")
    roots = materialize(components(links).select(F.col("id").alias("uid"), "root").join(named.select("uid", "text_id", "k1", "k2"), "uid"))
    first = F.min(F.struct("text_id", "k1", "k2", "uid"))
    groups = materialize(roots.groupBy("root").agg(first.alias("first"), F.count(F.lit(1)).alias("n")))
    grouped = join_stats(roots.select("uid", "root"), groups, ["root"], "n").select("uid", "first").join(counts.groupBy(F.col("id").alias("uid")).agg(F.sum("n").alias("n_links")), "uid")
    return named.join(grouped, "uid", "left").select(
        "k1", "k2", "text_id", "n_copies", F.coalesce("first.text_id", "text_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.coalesce(F.col("first.uid") == F.col("uid"), F.lit(True)).alias("leads"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """id, class_id, text_id, n_copies, n_links for each input row; see the module's text."""
    per_text = materialize(text_groups(docs, id_col, text_col, threshold).drop("leads"))
    placed = join_stats(_keyed(docs, id_col, text_col), per_text, ["k1", "k2"], "n_copies")
    lone = docs.filter(_alone(docs, id_col, text_col)).select(docs[id_col].alias("id"))
    return placed.select(F.col("id").alias(id_col), "class_id", "text_id", "n_copies", "n_links").unionByName(
        lone.select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.col("id").alias("text_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"))
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each group, with all its columns: of the group's leading text the row with the least id.

    Rows without an id or without words are in no group, and all of them stay. Of rows that share the id and
    the words one stays: that with the least text, then with the least hash of the other columns.
    """
    leaders = materialize(text_groups(docs, id_col, text_col, threshold).filter("leads").select("k1", "k2"))
    rows = keyed_rows(docs, id_col, text_col, leaders)
    plain = [f"row.`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString() and f.dataType.simpleString() != "variant"]
    order = F.struct(F.col(f"row.`{id_col}`"), F.col(f"row.`{text_col}`"), F.xxhash64(*plain))
    one = rows.groupBy("k1", "k2").agg(F.min_by("row", order).alias("row")).join(leaders, ["k1", "k2"], "left_semi")
    return one.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns]).unionByName(docs.filter(_alone(docs, id_col, text_col)))


def _alone(docs: DataFrame, id_col: str, text_col: str):
    """Rows without an id, or without any word by the same rule as ``words``."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs[id_col].isNull() | ~text.rlike(r"[A-Za-z0-9]|[^\x00-\x7F]")
