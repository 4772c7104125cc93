"""The service's reads on a small store, and event-driven stages."""

import json

import pytest
from pyspark.sql import functions as F

from cladeworks.api import Store
from cladeworks.operators import relational
from cladeworks.streaming import imports


@pytest.fixture(scope="module")
def store(spark):
    t = spark.createDataFrame
    return Store(
        {
            "usage": t(
                [
                    (1, "backbone", 1, "KINGDOM", None, False, "ACCEPTED", None, None, None, []), (2, "backbone", 2, "GENUS", 1, False, "ACCEPTED", None, None, None, []),
                    (3, "backbone", 3, "SPECIES", 2, False, "ACCEPTED", None, None, None, []), (4, "backbone", 4, "SPECIES", 3, True, "SYNONYM", None, None, None, []),
                    (5, "list", 3, "SPECIES", None, False, "ACCEPTED", None, None, "t5", ["BACKBONE_MATCH_NONE"]), (6, "red list", 3, "SPECIES", None, False, "ACCEPTED", None, None, "r6", []),
                    (7, "list", 5, "SPECIES", None, False, "ACCEPTED", None, "2020", "t7", []), (8, "backbone", 6, "SPECIES", 2, False, "ACCEPTED", 3, None, None, []),
                ],
                "id long, dataset string, name_id long, rank string, parent long, is_synonym boolean, status string, basionym long, deleted string, taxon_id string, issues array<string>",
            ),
            "name": t([(1, "Animalia", "Animalia"), (2, "Puma", "Puma"), (3, "Puma concolor (L.)", "Puma concolor"), (4, "Felis concolor L.", "Felis concolor"), (5, "Gone", "Gone"), (6, "Puma nova", "Puma nova")], "id long, scientific_name string, canonical_name string"),
            "nub_rel": t([(5, 3, "list"), (6, 3, "red list")], "usage long, nub long, source string"),
            "dataset": t([("list", "A list"), ("red list", "Red")], "key string, title string"),
            "distribution": t([(1, 6, "VULNERABLE")], "id long, usage_id long, threat_status string"),
            "vernacular": t([(1, 3, "Cougar", "en", False), (2, 3, "Puma", "en", True), (3, 5, "Silberlöwe", "de", None)], "id long, usage_id long, name string, language string, preferred boolean"),
            "description": t([(1, 3, "en", "biology"), (2, 3, "en", "biology"), (3, 3, "de", "habitat")], "id long, usage_id long, language string, type string"),
            "dataset_metrics": t([("list", "2020", 1), ("list", "2021", 2)], "dataset string, created string, n long"),
            "verbatim": t([(5, '{"a": 1}')], "usage_id long, json string"),
        }
    )


def ids(df, column="id"):
    return [r[column] for r in df.collect()]


def test_reads(store):
    syn = store.get(4).first()
    assert (syn.accepted_id, syn.accepted, syn.parent) == (3, "Puma concolor (L.)", 2)
    assert ids(store.root("backbone")) == [1] and ids(store.children(2)) == [3, 8] and ids(store.synonyms(3)) == [4] and ids(store.parents(3)) == [1, 2]
    assert ids(store.combinations(3)) == [8] and sorted(ids(store.related(3))) == [5, 6] and ids(store.related(3, ["list"])) == [5] and ids(store.related(3, [])) == []
    assert store.count().first().n == 7 and store.max_key("list").first().id == 7 and store.key_of("list", "t5").first().id == 5 and ids(store.without_match("list")) == [5]
    assert sorted(ids(store.by_canonical("puma CONCOLOR"))) == [3, 5, 6] and ids(store.list("list")) == [5] and ids(store.children_until_rank(1, "GENUS")) == [2]
    assert {r.usage_id: r.name for r in store.vernacular_in("en").collect()} == {3: "Puma"} and store.red_list_category(3).first().category == "VULNERABLE" and store.red_list_category(8).first().category == "NOT_EVALUATED"
    assert store.dataset_metrics("list").first().n == 2 and store.verbatim(5).first().created == "2021" and store.name(3).first().parsed.specific_epithet == "concolor"
    assert {(r.language, r.type): r["keys"] for r in store.toc(3).collect()} == {("en", "biology"): [1, 2], ("de", "habitat"): [3]}
    assert {r.source_title for r in store.all_extension("vernacular", 3).collect()} == {None, "A list"}
    assert {r.id: r.n_children for r in store.top_levels(("KINGDOM", "GENUS")).collect()} == {1: 1, 2: 2} and store.sitemap(2).agg(F.max("page")).first()[0] == 3
    with pytest.raises(ValueError):
        store.list(offset=10**6)


def test_list(store):
    shown = [(r.id, r.parent, r.accepted_id, r.accepted, r.scientific_name) for r in store.list("backbone", offset=2, limit=2).collect()]
    assert shown == [(3, 2, None, None, "Puma concolor (L.)"), (4, 2, 3, "Puma concolor (L.)", "Felis concolor L.")]
    assert ids(store.list()) == [1, 2, 3, 4, 5, 6, 8] and ids(store.list(taxon_id="t5")) == [5] and ids(store.list("list", "t7")) == [] and ids(store.list(offset=6)) == [8]


def test_rows_without_parents_meet_in_no_task(spark):
    rows = spark.range(0, 1000, 1, 4).select("id", F.when(F.col("id") < 3, F.col("id") + 1).alias("parent"), (F.col("id") < 2).alias("is_synonym"), F.col("id").cast("string").alias("name"))
    found = relational.accepted_of(rows)
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        sizes = [r["count"] for r in relational.accepted_of(rows).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert sum(sizes) == 1000 and max(sizes) <= 260
    assert {r.id: (r.parent, r.accepted_id, r.accepted) for r in found.filter("id < 4").collect()} == {0: (2, 1, "1"), 1: (3, 2, "2"), 2: (3, None, None), 3: (None, None, None)}


def test_search_and_match(store):
    assert ids(store.search({"dataset": ["backbone"]}, "puma"))[0] == 2
    assert {(r.facet, r.value): r.n for r in store.facets({"RANK": ["SPECIES"]}, ["rank"], multi_select=True).collect()}[("rank", "KINGDOM")] == 1
    assert ids(store.suggest("pu"))[0] == 2
    rel, summary = store.rematch("list")
    assert [(r.usage, r.nub) for r in rel.collect()] == [(5, 3)] and summary.first().perc_matches == 100
    totals, counts = store.compute_metrics()
    assert {r.dataset: r.count_usages for r in totals.collect()} == {"backbone": 5, "list": 1, "red list": 1} and counts.filter("metric = 'issue'").first().n == 1


def test_events(spark, tmp_path):
    folder = tmp_path / "events"
    folder.mkdir()
    rows = [{"dataset": "a", "stage": "normalize", "attempt": 1, "ts": "2024-01-01T00:00:00Z"}] * 2 + [{"dataset": "b", "stage": "analyze", "attempt": 1, "ts": "2024-01-01T00:01:00Z"}]
    (folder / "1.json").write_text("\n".join(map(json.dumps, rows)))
    seen = []
    handlers = {s: (lambda df, s=s: seen.extend((s, r.dataset) for r in df.collect())) for s in ("analyze", "normalize")}
    imports.dispatch(imports.events(spark, str(folder)), handlers, str(tmp_path / "cp")).awaitTermination()
    assert seen == [("normalize", "a"), ("analyze", "b")]
    out = str(tmp_path / "store")
    for n in (1, 2):
        imports.replace_datasets(spark.createDataFrame([("a", n), ("b", n)][: 3 - n], "dataset string, v int"), out)
    assert {(r.dataset, r.v) for r in spark.read.parquet(out).collect()} == {("a", 2), ("b", 1)}
