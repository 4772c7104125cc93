"""Operators 1, 2, 4, 5, 6 and 7, and the pipeline, against plain versions and with their defined cases."""

import gc
import itertools
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cladeworks.llm import bpe, common, decontamination, language_id, near_duplicates, quality_classifier, queries, sharding, substring_dedup
from cladeworks.llm import words as word_hashes
from cladeworks.llm.common import SLICE_BYTES
from cladeworks.llm.words import hashed, words


def oracle(sql, **tables):
    con = duckdb.connect()
    for name, frame in tables.items():
        con.register(name, frame)
    return con.sql(sql).df()


def same(got: pd.DataFrame, want: pd.DataFrame):
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(x) for x in r) for r in df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False))
    assert rows(got) == rows(want)


def prose(r, n):
    return " ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randrange(2, 8))) for _ in range(n))


def test_word_hashes():
    r = random.Random(1)
    texts = [None, "", "  ", "Foo, bar-BAZ é", *["".join(r.choice("ab ,é\n") for _ in range(60)) for _ in range(50)]]
    flat, sizes = hashed(texts)
    assert sizes.tolist() == [len(words(t)) for t in texts]
    seen = defaultdict(set)
    for w, h in zip(itertools.chain.from_iterable(words(t) for t in texts), flat.tolist()):
        seen[w].add(h)
    assert all(len(v) == 1 for v in seen.values()) and len({next(iter(v)) for v in seen.values()}) == len(seen)


# --- 1 ---

def held_at_most(run) -> int:
    """Most bytes that numpy and Python hold at once while ``run`` runs, beyond those held before."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_word_hashes_do_not_depend_on_stretches(monkeypatch):
    r = random.Random(3)
    texts = [prose(r, 400), None, "x" * 70, " ", "é" * 40 + " end", prose(r, 3), "last"]
    whole = hashed(texts)
    for stretch in (1, 7, 64, 65):
        monkeypatch.setattr(word_hashes, "STRETCH", stretch)
        for got, want in zip(hashed(texts), whole):
            assert got.tolist() == want.tolist()


def test_shingling_a_slice_holds_little_memory(monkeypatch):
    r = random.Random(4)
    text = prose(r, 800)
    texts = [text] * (SLICE_BYTES // len(text) + 1)
    monkeypatch.setattr(word_hashes, "_powers", [np.ones(1, np.uint64), np.ones(1, np.uint64)])
    assert held_at_most(lambda: near_duplicates.shingles(texts)) < 25 * SLICE_BYTES
    assert max(map(len, word_hashes._powers)) <= 1 << 18


def test_tasks_give_freed_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    assert list(common.lean(lambda batches: iter(batches))([1, 2])) == [1, 2] and calls == [1]


def test_tokenizing_leaves_no_tables_behind():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe.codec.cache_clear()
    texts = ["Zwölf Boxkämpfer jagen", None, "", "the quick brown fox"]
    task = common.lean(lambda batches: map(bpe.digester(path), batches))
    made = list(task([texts]))
    alive = sum(isinstance(x, bpe.TreeBPE) for x in gc.get_objects())
    assert alive == 0 and bpe.codec.cache_info().currsize == 0
    assert made == [bpe.digests(texts, path)]


def test_seed_family_is_lossless():
    for a, b in itertools.combinations(range(13), 2):
        assert any(all(o + i not in (a, b) for i, c in enumerate(m) if c == "1") for m in decontamination.MASKS for o in range(14 - len(m)))


def plain_contamination(doc, item):
    a, b = words(doc), words(item)
    if len(b) < 13:
        agreed = max([sum(0 <= j + line < len(a) and a[j + line] == b[j] for j in range(len(b))) for line in range(-len(b), len(a))] or [0])
        return agreed if b and agreed >= len(b) - len(b) * 2 // 13 else 0
    best = 0
    for line in range(-len(b), len(a)):
        e = [False] * 12 + [0 <= j + line < len(a) and a[j + line] == b[j] for j in range(len(b))] + [False] * 12
        best = max([best, *(sum(e[j : j + 13]) for j in range(len(e) - 12))])
    return best if best >= 11 else 0


def contaminated(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [" ".join(r.choice(vocabulary) for _ in range(r.randrange(3, 30))) for _ in range(8)] + [None, "", "w1", "w2 w3 w4 w5 w6 w7 w8"]
    docs = []
    for _ in range(60):
        copy = [r.choice(vocabulary) if r.random() < 0.12 else w for w in r.choice(items[:8]).split()]
        docs.append(" ".join([r.choice(vocabulary) for _ in range(r.randrange(25))] + copy[r.randrange(3) :] + [r.choice(vocabulary) for _ in range(r.randrange(9))]))
    docs += [None, "", docs[0]]
    return docs, items, spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


@pytest.mark.parametrize("block", [decontamination.BLOCK_WORDS, 40])
def test_contamination(spark, block):
    docs, items, d, i = contaminated(spark)
    got = {(r.doc_id, r.item_id): r.agreed for r in decontamination.find_contamination(d, i, block_words=block).collect()}
    want = {(a, b): n for a, x in enumerate(docs) for b, y in enumerate(items) if x and y and (n := plain_contamination(x, y))}
    assert got == want and want
    if block > 40:
        same(decontamination.find_contamination(d, i).toPandas(), oracle(queries.DECONTAMINATION_SQL, documents=d.toPandas(), benchmark=i.toPandas()))
        assert {r.doc_id for r in decontamination.clean_rows(d, i).collect()} == set(range(len(docs))) - {a for a, _ in want}


def test_contamination_by_neighbouring_pieces_of_one_passage():
    r = random.Random(51)
    for _ in range(20):
        passage = [prose(r, 1) + str(i) for i in range(200)]
        cuts = sorted({0, 200, *[r.randrange(200) for _ in range(14)]})
        items = [" ".join(passage[a:b]) for a, b in zip(cuts, cuts[1:])]
        text = " ".join(w if r.random() < 0.95 else "x" for w in passage)
        got = {(int(a), int(b)): int(c) for a, b, c in decontamination.Seeds.of(list(range(len(items))), items).matches([text, ""]).to_numpy()}
        assert got == {(0, i): n for i, item in enumerate(items) if (n := plain_contamination(text, item))}


def test_contamination_by_runs_of_one_word(spark):
    seeds = decontamination.Seeds.of([1, 2], ["la " * 3000, "la " * 1500 + "lo " * 40])
    got = seeds.matches(["la " * 200_000, "no", "la " * 12 + "x"])
    assert sorted(map(tuple, got.to_numpy().tolist())) == [(0, 0, 13), (0, 1, 13), (2, 0, 12), (2, 1, 12)]


def test_contamination_of_ties_and_clashing_names(spark):
    d = spark.createDataFrame([(1, "x " * 20, 5), (1, "x " * 20, 5), (1, "a b c d e f g h i j k l m", 6), (None, "y a b c q e f g h i j k l m", 7)], "_row long, _text string, _item int")
    i = spark.createDataFrame([("p", "a b c d e f g h i j k l m"), ("q", "a b c d e f g h i j k l m"), (None, "x " * 20)], "agreed_id string, words string")
    for block in (decontamination.BLOCK_WORDS, 1):
        got = decontamination.find_contamination(d, i, "_row", "_text", "agreed_id", "words", block).collect()
        assert Counter((r._row, r.agreed_id, r.agreed) for r in got) == Counter({(1, None, 13): 2, (1, "p", 13): 1, (1, "q", 13): 1, (None, "p", 12): 1, (None, "q", 12): 1})
        assert decontamination.clean_rows(d, i, "_row", "_text", "agreed_id", "words", block).count() == 0
        assert decontamination.clean_rows(d, i.limit(0), "_row", "_text", "agreed_id", "words", block).columns == d.columns


def test_contamination_empty(spark, docs, empty):
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontamination.find_contamination(empty, items).count() == 0 and decontamination.find_contamination(docs, items.limit(0)).count() == 0


# --- 2 ---


def plain_groups(rows):
    sets = {}
    for i, text in rows:
        w = words(text)
        sets[i] = (tuple(w), frozenset(tuple(w[j : j + 3]) for j in range(max(1, len(w) - 2))) if w else frozenset())
    reps = {}
    for i in sorted(sets):
        reps.setdefault(sets[i][0] or ("", i), i)
    ids = sorted(reps.values())
    links = [(a, b) for a, b in itertools.combinations(ids, 2) if (u := sets[a][1] | sets[b][1]) and len(sets[a][1] & sets[b][1]) >= near_duplicates.THRESHOLD * len(u)]
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    degree = Counter(itertools.chain.from_iterable(links))
    rep = {i: reps[sets[i][0] or ("", i)] for i in sets}
    return {i: (find(rep[i]), rep[i], degree[rep[i]]) for i in sets}


@pytest.mark.parametrize("limit", [32, 3])
def test_near_duplicates(spark, monkeypatch, limit):
    monkeypatch.setattr(near_duplicates, "PAIR_LIMIT", limit)
    r = random.Random(6)
    rows, seeds = [], [prose(r, n).split() for n in (30, 60, 120, 12)]
    for i in range(60):
        w = list(r.choice(seeds))
        for _ in range(r.randrange(4)):
            w[r.randrange(len(w))] = prose(r, 1)
        rows.append((i, " ".join(w)))
    rows += [(60, rows[3][1]), (61, rows[3][1].upper()), (62, None), (63, ""), (64, "!!"), (65, "one"), (66, "one"), (67, "one two")]
    got = {x.doc_id: (x.class_id, x.text_id, x.n_links) for x in near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = plain_groups(rows)
    assert {k: v[:2] for k, v in got.items()} == {k: v[:2] for k, v in want.items()}
    if limit == 32:
        assert got == want


def reached_links(texts):
    """By brute force, all pairs that share a band, outlive the pruning and reach the threshold."""
    flat, counts = near_duplicates.shingles(texts)
    sig, needed = near_duplicates.signatures(flat, counts), near_duplicates.needed_matches(near_duplicates.THRESHOLD)
    bands = sig.reshape(len(texts), -1, near_duplicates.ROWS)
    sets = [set(x.tolist()) for x in np.split(flat, np.cumsum(counts)[:-1])]
    links = []
    for i in range(len(texts)):
        js = np.flatnonzero((bands[i + 1 :] == bands[i]).all(axis=2).any(axis=1)) + i + 1
        for j in js[near_duplicates.surviving(np.broadcast_to(sig[i], (len(js), sig.shape[1])), sig[js], needed)]:
            if (both := len(sets[i] & sets[j])) >= near_duplicates.THRESHOLD * (len(sets[i]) + len(sets[j]) - both):
                links.append((i, int(j)))
    return links


def test_near_duplicates_of_a_star(spark):
    r = random.Random(61)
    seed = prose(r, 120).split()
    texts = [" ".join(seed)]
    for _ in range(1000):
        w = list(seed)
        for place in r.sample(range(0, 120, 2), 12):
            w[place] = prose(r, 1) + "q"
        texts.append(" ".join(w))
    links = reached_links(texts)
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(a == 0 for a, _ in links) > 900
    assert {got[b].class_id for a, b in links if a == 0} == {0}


def test_near_duplicates_that_share_a_passage(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "PAIR_LIMIT", 8)
    r = random.Random(62)
    passage, texts = prose(r, 60), []
    for _ in range(600):
        own = prose(r, 60).split()
        for _ in range(2):
            w = list(own)
            for place in r.sample(range(0, 60, 4), 6):
                w[place] = prose(r, 1) + "q"
            texts.append(passage + " " + " ".join(w))
    links = reached_links(texts)
    got = {x.doc_id: x for x in near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {(a, b) for a, b in links if got[a].class_id != got[b].class_id} == set()


def test_near_duplicates_at_the_threshold_beside_a_shared_passage(spark):
    """Recall of pairs just above the threshold, which share a passage with many texts below it."""
    r = random.Random(65)
    passage = prose(r, 60) + " z"
    fresh = lambda n: " ".join(prose(r, 1) + str(r.randrange(10**9)) for _ in range(n))
    texts = [f"{passage} {fresh(40)}" for _ in range(1500)]
    for i in range(200):
        shared = fresh(10)
        texts += [f"{passage} {shared} {fresh(33 - i % 5)}" for _ in range(2)]
    sets = [set(x.tolist()) for x in np.split(*(lambda f, c: (f, np.cumsum(c)[:-1]))(*near_duplicates.shingles(texts)))]
    alike = lambda i, j: len(sets[i] & sets[j]) / len(sets[i] | sets[j])
    pairs = [(i, i + 1) for i in range(1500, 1900, 2)]
    assert all(0.5 <= alike(i, j) <= 0.56 for i, j in pairs) and max(alike(0, j) for j in range(1, 1900)) < 0.5
    got = {x.doc_id: x.class_id for x in near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    found = sum(got[i] == got[j] for i, j in pairs)
    assert found >= 196, found
    assert all(got[i] == i for i in range(1500))


def test_near_duplicates_count_all_links(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "BLOCK", 100, raising=False)
    r = random.Random(63)
    seed, texts = prose(r, 80).split(), []
    for _ in range(400):
        w = list(seed)
        w[r.randrange(80)] = prose(r, 1) + "q"
        texts.append(" ".join(w))
    texts = list(dict.fromkeys(texts))
    degree = Counter(itertools.chain.from_iterable(reached_links(texts)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {x.doc_id: x.n_links for x in got} == {i: degree[i] for i in range(len(texts))}


def test_near_duplicates_defined_cases(spark, docs, empty):
    rows = near_duplicates.near_duplicates(docs).collect()
    assert len(rows) == docs.count() and {r.class_id for r in rows if r.doc_id in (1, 8)} == {1} and {r.n_copies for r in rows if r.doc_id == 1} == {2}
    assert near_duplicates.near_duplicates(empty).count() == 0
    kept = near_duplicates.keep_one(docs)
    assert kept.columns == docs.columns and near_duplicates.keep_one(empty).count() == 0
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 4, 6, 7, 9, 10, 11]


def test_rows_that_share_an_id_are_different_texts(spark):
    r = random.Random(64)
    a, b, c = (prose(r, 60) for _ in range(3))
    near = " ".join([*a.split()[:57], "x", "y", "z"])
    rows = [(7, a, "p"), (7, b, "q"), (7, b, "q"), (8, near, "r"), (9, c, "s"), (9, near, "t"), (None, a, "u"), (None, a, "u")]
    d = spark.createDataFrame(rows, "id long, k1 string, text string").select("id", F.col("k1").alias("text"), F.col("text").alias("k1"))
    got = sorted((x.id, x.class_id, x.n_copies, x.n_links) for x in near_duplicates.near_duplicates(d, "id").collect() if x.id)
    assert got == [(7, 7, 1, 1), (7, 7, 2, 0), (7, 7, 2, 0), (8, 7, 2, 1), (9, 7, 2, 1), (9, 9, 1, 0)]
    kept = sorted((x.id or 0, x.k1) for x in near_duplicates.keep_one(d, "id").collect())
    assert kept == [(0, "u"), (0, "u"), (7, "p"), (7, "q"), (9, "s")]


def test_pruning_keeps_what_may_reach_the_threshold():
    needed = near_duplicates.needed_matches(0.5)
    assert needed[0] == 0 and (np.diff(needed) >= 0).all() and 20 < needed[96] < 48


# --- 4 ---


def test_classifier(spark, docs, empty):
    r = random.Random(7)
    good = [(i, prose(r, 80)) for i in range(300)]
    bad = [(i, " ".join(w + r.choice(["###", "$$$", "%%%"]) for w in prose(r, 80).split())) for i in range(300, 400)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300), 0) for i in range(0, 400, 2)], "doc_id long, quality int, toxic int")
    kept = {x.doc_id: x.kept for x in quality_classifier.classify(d, labels).collect()}
    assert sum(kept[i] for i in range(300)) >= 295 and sum(kept[i] for i in range(300, 400)) <= 5
    assert sum(kept.values()) == 300
    assert kept == {x.doc_id: x.kept for x in quality_classifier.classify(d.repartition(7), labels).collect()}
    rows = {x.doc_id: x for x in quality_classifier.classify(docs, labels.limit(0)).collect()}
    assert rows[1].kept and rows[2].log_weight is None and not rows[2].kept and not rows[4].kept
    assert quality_classifier.classify(empty, labels).count() == 0


def test_draws_follow_the_importance_weights(spark):
    """Inclusion frequencies over seeds against drawing row after row without replacement, by brute force."""
    r = random.Random(71)
    rows = [(i, prose(r, r.randrange(1, 9)) + (" ### $$" if i % 3 == 0 else "")) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    scored = quality_classifier.classify(d, labels).select("doc_id", "log_weight", "gumbel_key", "kept").toPandas().set_index("doc_id").sort_index()
    ratio = quality_classifier.weigh([rows[5][1] + " " + rows[7][1]], np.linspace(-1, 1, 2 * quality_classifier.BUCKETS))[0]
    single, pair, _ = quality_classifier.bucketed([rows[5][1] + " " + rows[7][1]])
    assert ratio == pytest.approx(sum(np.linspace(-1, 1, 2 * quality_classifier.BUCKETS)[b] for b in [*single, *pair] if b >= 0))
    few = scored.log_weight.iloc[:12].to_numpy()
    k, runs = 4, 4000
    seeds = spark.range(runs).withColumnRenamed("id", "seed")
    weighted = spark.createDataFrame([(i, float(w)) for i, w in enumerate(few)], "i long, w double")
    keys = seeds.crossJoin(weighted).select("seed", "i", (F.col("w") + quality_classifier.gumbel(F.col("seed"), F.col("i"))).alias("key")).toPandas()
    top = keys.sort_values("key", ascending=False).groupby("seed").head(k)
    got = top.groupby("i").size().reindex(range(12), fill_value=0).to_numpy() / runs
    rng, want = np.random.default_rng(5), np.zeros(12)
    for _ in range(runs):
        want[rng.choice(12, k, replace=False, p=np.exp(few) / np.exp(few).sum())] += 1
    assert np.abs(got - want / runs).max() < 0.04
    assert scored.kept.sum() == int(np.ceil(60 * labels.filter("quality = 1").count() / 30)) == len(scored.nlargest(int(scored.kept.sum()), "gumbel_key").query("kept"))
    by_weight = set(scored.nlargest(int(scored.kept.sum()), "log_weight").index)
    assert by_weight != set(scored[scored.kept].index)


def test_classifier_noise_of_rows_that_share_an_id(spark):
    d = spark.createDataFrame([(1, "a b"), (1, "a b"), (1, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    noise = [x.gumbel_key - x.log_weight for x in quality_classifier.classify(d, labels).collect()]
    assert sorted(Counter(round(x, 9) for x in noise).values()) == [1, 2]


def test_kth_largest(spark):
    values = [5, -3, 5, 2**40, -(2**50), 0, 7, 7, 7]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for k in range(1, len(values) + 1):
        assert quality_classifier.kth_largest(rows, "v", k) == sorted(values, reverse=True)[k - 1]


# --- 5 ---


@pytest.mark.parametrize("limit", [300, 2000, 10**9])
def test_sharding(spark, limit):
    r = random.Random(8)
    d = spark.createDataFrame([(i, prose(r, r.randrange(40))) for i in range(150)] + [(150, None), (151, "x" * 5000)], "doc_id long, text string")
    got = sharding.shard(d, limit=limit).toPandas()
    same(got, oracle(queries.sharding_sql(limit), documents=d.toPandas()))
    sums = got.groupby("shard").n_bytes.agg(["sum", "count"])
    assert ((sums["sum"] <= limit) | (sums["count"] == 1)).all()


def test_sharding_repeats(spark, docs, empty):
    d = spark.createDataFrame([(1, "abcdefghij")] * 25 + [(2, "y")], "doc_id long, text string")
    got = sharding.shard(d, limit=40).toPandas()
    assert len(got) == 26 and (got.groupby("shard").n_bytes.sum() <= 40).all() and (got["shard"].str.contains("#").sum() == 25)
    assert sharding.shard(docs).count() == docs.count() and sharding.shard(empty).count() == 0


# --- 6 ---


def test_substring_dedup(spark, docs, empty):
    r = random.Random(9)
    passages = [". ".join(prose(r, 9).capitalize() for _ in range(4)) + "." for _ in range(3)]
    rows = []
    for i in range(40):
        parts = [prose(r, 12).capitalize() + ".", r.choice(passages), prose(r, 5), "Short one."]
        r.shuffle(parts)
        rows.append((i, r.choice([" ", "\n"]).join(parts)))
    d = spark.createDataFrame(rows + [(40, None), (41, ""), (42, rows[0][1])], "doc_id long, text string")
    got = substring_dedup.substring_dedup(d).toPandas()
    same(got, oracle(queries.SUBSTRING_SQL, documents=d.toPandas()))
    texts = dict(rows)
    for x in got.itertuples():
        if x.doc_id in texts:
            spans = [tuple(map(int, s.split(":"))) for s in x.removed.split(",") if s]
            rest, last = "", 0
            for a, b in spans:
                rest, last = rest + texts[x.doc_id][last:a], b
            assert rest + texts[x.doc_id][last:] == x.text
    assert got.set_index("doc_id").text[42] == ""
    assert (got.n_passages > 0).any() and (got.n_removed > got.n_passages).any()
    assert substring_dedup.substring_dedup(docs).count() == docs.count() and substring_dedup.substring_dedup(empty).count() == 0


def test_substring_dedup_of_rows_that_share_an_id(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "BLOCK", 2)
    r = random.Random(91)
    same, own, other = (prose(r, 20) for _ in range(3))
    rows = [(1, same), (5, same), (5, own), (7, other), (7, other), (7, other), (7, other), (None, "short\n" + own), (None, "short\n" + own), (None, "new"), (9, None), (9, None), (9, "Short")]
    d = spark.createDataFrame(rows, "_id long, _text string")
    got = sorted(((x._id or 0), x.text, x.removed) for x in substring_dedup.substring_dedup(d, "_id", "_text").collect() if x.text is not None)
    whole = lambda t: f"0:{len(t)}"
    n = len(own)
    want = [(0, "", whole("short\n" + own)), (0, "short\n" + own, ""), (0, "new", ""), (1, same, ""), (5, "", whole(same)), (5, "", whole(own)), *[(7, "", whole(other))] * 3, (7, other, ""), (9, "", "0:5")]
    assert got == sorted(want) and n


# --- 7 ---


def test_language_model(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = language_id.identify(d).join(d.select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.95 and got.score.between(0, 1).all()
    assert got[got.lang == got.lang_pred].rejected.mean() < 0.03
    model = language_id.fit(d, ~language_id.held_out())
    scorer = model.scorer()
    letters = sorted({int(c) for r in d.select("text").collect() for c in np.unique(language_id.folded(r.text))})
    for start in ("that", "qxzq", " der"):
        context = np.array([ord(c) for c in start], np.uint32)
        p = np.exp(np.stack([scorer.log_probs(np.append(context, np.uint32(c)))[1][0] for c in letters])).sum(axis=0)
        assert p == pytest.approx(np.ones(4), abs=0.02)
    sharded = language_id.fit(d, ~language_id.held_out(), model_rows=20_000)
    assert model.shards == 1 < 3 < sharded.shards
    one, many = ({r.doc_id: r for r in language_id.predict(d, m).collect()} for m in (model, sharded))
    assert all(one[i].lang_pred == r.lang_pred and one[i].rejected == r.rejected and one[i].score == pytest.approx(r.score) for i, r in many.items()) and len(one) == len(many)
    rows = {x.doc_id: x for x in language_id.predict(docs, model).collect()}
    assert {rows[i].lang_pred for i in (2, 3, 4, 9)} == {"und"} and rows[2].score == 0 and rows[7].lang_pred == "de"
    assert language_id.identify(empty).count() == 0
    assert {x.lang_pred for x in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_language_model_equals_plain_kneser_ney(spark):
    r = random.Random(72)
    rows = [(i, prose(r, 12) if i % 2 else prose(r, 9).replace("e", "ø"), "ab"[i % 2]) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(d, F.lit(True), order=3)
    used = {x.text for x in d.filter(F.pmod(F.xxhash64("text"), F.lit(10)) != 0).collect()}
    counts: dict = {k: {lang: Counter() for lang in "ab"} for k in (1, 2, 3)}
    for _, text, lang in rows:
        if text in used:
            padded = " " + "".join(map(chr, language_id.folded(text)))
            counts[3][lang].update(padded[i : i + 3] for i in range(len(padded) - 2))
    for k in (2, 1):
        for lang in "ab":
            counts[k][lang] = Counter(g[1:] for g in counts[k + 1][lang])
    letters = len(set(counts[1]["a"]) | set(counts[1]["b"]))

    def p(gram, lang):
        if not gram:
            return 1 / (letters + 1)
        of = counts[len(gram)][lang]
        n1, n2 = (sum(v == n for v in of.values()) for n in (1, 2))
        discount = min(0.95, max(0.1, n1 / (n1 + 2 * n2) if n1 else 0.5))
        same = [v for g, v in of.items() if g[:-1] == gram[:-1]]
        if not same:
            return p(gram[1:], lang)
        return max(0, of[gram] - discount) / sum(same) + discount * len(same) / sum(same) * p(gram[1:], lang)

    for text in ("teh ø", "zzz", "het"):
        codes = np.concatenate([[np.uint32(32)], language_id.folded(text)])
        number, values = model.scorer().log_probs(codes)
        chars = "".join(map(chr, codes))
        for i in range(len(chars) - 2):
            for j, lang in enumerate("ab"):
                assert values[number[i], j] == pytest.approx(np.log(p(chars[i : i + 3], lang)), abs=1e-4)


def test_language_counting_with_large_alphabets():
    counter = language_id._Counter(5)
    r = random.Random(10)
    codes = np.array([r.randrange(0x4E00, 0x9000) for _ in range(30_000)], np.uint32)
    counter.add("zh", codes)
    got = Counter()
    for batch in [*counter.flush(), *counter.rows()]:
        for g, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            got[g] += n
    text = "   " + "".join(map(chr, codes))
    assert got == Counter(text[i : i + 5] for i in range(len(text) - 4))


# --- pipeline ---


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from cladeworks.llm.bpe import digests
    from cladeworks.llm.pii import redact, trained
    from cladeworks.llm.quality_rules import judge

    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r.ids_sha256 for r in corpus_pipeline.run(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [x for x, k in zip(rows, judge([t for _, t in rows])["kept"]) if k]
    groups = plain_groups(kept)
    kept = [x for x in kept if groups[x[0]][0] == x[0]]
    dirty = set(decontamination.Seeds.of(list(range(len(items))), items).matches([t for _, t in kept])["row"])
    kept = [(i, redact(t, trained())) for n, (i, t) in enumerate(kept) if n not in dirty]
    want = dict(zip([i for i, _ in kept], digests([t for _, t in kept], corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER))["ids_sha256"]))
    assert got == want and 0 < len(got) < len(rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).count() == 0
    odd = spark.createDataFrame([(None, "x " * 60, "en", "s", 1), (1, None, None, None, None), (1, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf).columns == odd.columns and stage(spark, odd, sf).count() <= 3
