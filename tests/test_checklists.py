"""Normalization, trees, exact and fuzzy matching, and the backbone build on small inline checklists."""

from pyspark.sql import functions as F

from cladeworks.functions import names
from cladeworks.operators import backbone, matching, normalize, relational, search, tree
from cladeworks.plans import checklists, taxonomy
from cladeworks.sources import archives, printers, tables

USAGES = [
    (1, None, "KINGDOM", "Animalia", False), (2, 1, "FAMILY", "Sciuridae", False), (3, 2, "GENUS", "Sciurus", False), (4, 3, "SPECIES", "Sciurus vulgaris", False),
    (5, 3, "SPECIES", "Sciurus carolinensis", False), (6, 4, "SUBSPECIES", "Sciurus vulgaris alpinus", False), (7, 4, "SPECIES", "Sciurus europaeus", True),
]


def usages(spark):
    return spark.createDataFrame(USAGES, "id long, parent long, rank string, name string, is_synonym boolean")


def test_metrics(spark):
    m = {r.id: r for r in tree.metrics(usages(spark), synonym="is_synonym").collect()}
    assert (m[1].num_descendants, m[1].num_children, m[1].num_f, m[1].num_g, m[1].num_s) == (5, 1, 1, 1, 2)
    assert (m[4].num_descendants, m[4].num_synonyms) == (1, 1) and 7 not in m


def test_text_tree(spark):
    lines = printers.lines(usages(spark), "TEXT", synonym="is_synonym").orderBy("sort_path", "part").select("line")
    assert [r.line for r in lines.collect()] == [
        "Animalia [kingdom]", "  Sciuridae [family]", "    Sciurus [genus]", "      Sciurus carolinensis [species]", "      Sciurus vulgaris [species]", "        *Sciurus europaeus [species]", "        Sciurus vulgaris alpinus [subspecies]",
    ]
    xml = [r.line for r in printers.lines(usages(spark), "XML").orderBy("sort_path", "part").select("line").collect()]
    assert xml[0] == '<kingdom name="Animalia">' and xml[-1] == "</kingdom>" and len(xml) == 14
    for fmt in ("GML", "DOT", "TAB", "LIST"):
        assert printers.lines(usages(spark), fmt).count() >= 7


def test_cycles_and_chains(spark):
    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e"), ("e", "d"), ("f", "f")], "id string, accepted string")
    got = {r.id: (r.terminal, r.in_cycle) for r in tree.terminals(links).collect()}
    assert got["a"] == ("c", False) and got["b"] == ("c", False) and got["d"] == ("d", True) and got["e"] == ("d", True) and got["f"] == ("f", True)
    loop = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 1)], "id long, parent long")
    assert tree.ancestors(loop).filter("id = 4").count() == 3
    checks = {(r.check, r.id) for r in tree.problems(loop.withColumn("rank", F.lit(None).cast("string"))).collect()}
    assert {("cycle", 1), ("cycle", 2), ("cycle", 3)} <= checks


def test_links_are_joined_by_shuffles(spark, monkeypatch):
    # chains of four, cycles of three with a lower and a higher tail, a self loop; strings order differently from numbers
    k = F.col("id") % 10
    to = F.when(k < 3, F.col("id") + 1).when(k == 4, F.col("id") + 1).when(k == 5, F.col("id") + 1).when(k == 6, F.col("id") + 1).when(k == 7, F.col("id") - 2).when(k == 8, F.col("id") - 1).when(k == 9, F.col("id"))
    links = spark.range(2000).select("id", to.alias("accepted"))
    plans = []

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return tables.materialize(df)

    monkeypatch.setattr(tree, "materialize", kept)
    want = {0: (3, 3, False, False), 1: (3, 2, False, False), 2: (3, 1, False, False), 4: (5, None, False, True), 5: (5, None, True, True), 6: (5, None, True, True), 7: (5, None, True, True), 8: (5, None, False, True), 9: (9, None, True, True)}
    got = {r.id: tuple(r)[1:] for r in tree.terminals(links).collect()}
    assert got == {i: (i - i % 10 + want[i % 10][0], *want[i % 10][1:]) for i in range(2000) if i % 10 != 3}
    assert not any("Broadcast" in p for p in plans) and len(plans) <= 6  # not one round for each power of two up to 2000
    ring = spark.range(1000).select(F.col("id").cast("string").alias("id"), ((F.col("id") + 1) % 1000).cast("string").alias("accepted"))
    assert {tuple(r)[1:] for r in tree.terminals(ring).collect()} == {("0", None, True, True)}


def test_ancestor_sums(spark):
    # chains, a self loop, cycles of two and three with tails, two of them into one entrance
    up = {1: None, 2: 1, 3: 2, 4: 3, 5: 99, 6: 6, 7: 6, 10: 11, 11: 10, 12: 10, 13: 12, 14: 13, 20: 21, 21: 22, 22: 20, 23: 22, 24: 22, 25: 24, 9: 25}
    rows = spark.createDataFrame(list(up.items()), "id long, parent long")
    want = {r.id: (r.n, r.depth, r.total) for r in tree.ancestors(rows).groupBy("id").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.sum("ancestor").alias("total")).collect()}
    assert {r.id: (r.n, r.depth, r.total) for r in tree.ancestor_sums(rows, F.col("_parent")).collect()} == want


def test_deep_ancestors_make_no_pairs(spark, tmp_path):
    spark.range(400).withColumnRenamed("id", "s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    before = len(tables._written)
    got = {(r.id, r.n, r.depth, r.total) for r in taxonomy.q_deep_ancestors(spark, str(tmp_path)).collect()}
    assert got == {(k, k - 1, k - 1, k * (k - 1) // 2) for k in range(2, 400)}
    rows = sum(spark.read.option("recursiveFileLookup", "true").parquet(p).count() for p in tables._written[before:])
    assert rows < 400 * 20  # the closure has 79,401 pairs


def test_traversals(spark):
    edges = tree.relations(usages(spark))
    start = usages(spark).filter("id = 4")
    walk = lambda name: {r.id for r in tree.traverse(edges, start, name).collect()}
    assert walk("PARENTS") == {3, 2, 1} and walk("CHILDREN") == {6} and walk("SYNONYMS") == {7} and walk("TREE") == {4, 6, 7} and walk("PARENT") == {3}
    assert {r.id for r in tree.traverse(edges, start, "LINNEAN_PARENTS", ranks=usages(spark)).collect()} == {1, 2, 3}


def test_normalize(spark):
    core = spark.createDataFrame(
        [
            ("1", None, None, None, "Abies", "genus", None, "Plantae", "Pinaceae"),
            ("2", None, "Abies", None, "Abies alba Mill.", "species", "accepted", None, None),
            ("3", None, None, "2", "Pinus picea L.", "species", "synonym", None, None),
            ("4", None, None, "3", "Abies pectinata", "species", "synonym", None, None),
            ("5", "4", None, None, "Abies alba minor", "nonsense", None, None, None),
            ("6", None, None, "nobody", "Abies nil", "species", "synonym", None, None),
        ],
        "taxonID string, parentNameUsageID string, parentNameUsage string, acceptedNameUsageID string, scientificName string, taxonRank string, taxonomicStatus string, kingdom string, family string",
    )
    out = normalize.normalize(core)
    u = {r.id: r for r in out["usages"].collect()}
    assert u["2"].parent == "1" and u["3"].accepted == "2" and u["4"].accepted == "2" and u["5"].parent == "2"
    assert "RANK_INVALID" in u["5"].issues and "ACCEPTED_NAME_USAGE_ID_INVALID" in u["6"].issues and u["6"].accepted == "nobody" and u["nobody"].status == "DOUBTFUL"
    higher = {r.scientific_name: r for r in u.values() if r.origin == "DENORMED_CLASSIFICATION"}
    assert set(higher) == {"Plantae", "Pinaceae"} and u["1"].parent == higher["Pinaceae"].id and higher["Pinaceae"].parent == higher["Plantae"].id


def test_normalize_relations(spark):
    """One branch for each given field: ids never fall through to names, unknown things become doubtful rows, cycles are cut."""
    columns = "taxonID scientificName taxonRank taxonomicStatus parentNameUsageID parentNameUsage acceptedNameUsageID acceptedNameUsage originalNameUsageID originalNameUsage kingdom genus".split()
    given = [
        {"taxonID": "1", "scientificName": "Abies"}, {"taxonID": "2", "scientificName": "Abies alba", "parentNameUsageID": "1"}, {"taxonID": "3", "scientificName": "Abies beta", "parentNameUsageID": "999", "parentNameUsage": "Abies", "kingdom": "Plantae"},
        {"taxonID": "4", "scientificName": "Abies gamma", "taxonomicStatus": "synonym", "taxonRank": "species"}, {"taxonID": "5", "scientificName": "Abies delta", "acceptedNameUsageID": "888", "acceptedNameUsage": "Abies alba", "kingdom": "Plantae"},
        {"taxonID": "6", "scientificName": "Picea x", "parentNameUsage": "Picea"}, {"taxonID": "7", "scientificName": "Pinus"}, {"taxonID": "8", "scientificName": "Pinus"}, {"taxonID": "9", "scientificName": "Pinus y", "parentNameUsage": "Pinus"},
        {"taxonID": "10", "scientificName": "Larix a", "acceptedNameUsageID": "11"}, {"taxonID": "11", "scientificName": "Larix b", "acceptedNameUsageID": "12"}, {"taxonID": "12", "scientificName": "Larix c", "acceptedNameUsageID": "11"},
        {"taxonID": "13", "scientificName": "Larix d", "acceptedNameUsageID": "14"}, {"taxonID": "14", "scientificName": "Larix e", "acceptedNameUsageID": "2"}, {"taxonID": "15", "scientificName": "Larix f", "parentNameUsageID": "14"},
        {"taxonID": "16", "scientificName": "Thuja", "acceptedNameUsageID": "2|7|777"}, {"taxonID": "17", "scientificName": "Thuja z", "acceptedNameUsage": "Quercus robur", "originalNameUsage": "Pinus"}, {"taxonID": "18", "scientificName": "Self", "parentNameUsageID": "18", "acceptedNameUsageID": "18"},
    ]
    core = spark.createDataFrame([tuple(r.get(c) for c in columns) for r in given], ", ".join(f"{c} string" for c in columns))
    out = normalize.normalize(core)
    u = {r.id: r for r in out["usages"].collect()}
    names = {i: u[u[i].parent].scientific_name if u[i].parent else None for i in u}
    assert {i: names[i] for i in map(str, range(1, 19))} == {
        "1": None, "2": "Abies", "3": "Plantae", "4": "incertae sedis", "5": "Abies alba", "6": "Picea", "7": None, "8": None, "9": "Pinus", "10": "incertae sedis", "11": "incertae sedis", "12": "incertae sedis",
        "13": "Abies alba", "14": "Abies alba", "15": "Abies alba", "16": "Abies alba", "17": "Quercus robur", "18": None,
    }
    assert {i: sorted(u[i].issues) for i in u if u[i].issues} == {
        "3": ["PARENT_NAME_USAGE_ID_INVALID"], "4": ["ACCEPTED_NAME_MISSING"], "5": ["ACCEPTED_NAME_USAGE_ID_INVALID"], "9": ["PARENT_NAME_NOT_UNIQUE"], "10": ["CHAINED_SYNOYM"], "11": ["CHAINED_SYNOYM", "PARENT_CYCLE"], "12": ["CHAINED_SYNOYM"],
        "13": ["CHAINED_SYNOYM"], "16": ["ACCEPTED_NAME_USAGE_ID_INVALID"], "17": ["ORIGINAL_NAME_NOT_UNIQUE"],
    }
    assert {u[i].origin for i in u if i.startswith("verbatim")} == {"VERBATIM_PARENT", "VERBATIM_ACCEPTED"} and u["888"].status == "DOUBTFUL" and names["888"] == "Plantae"
    assert {i for i in u if u[i].is_synonym} == {"4", "5", "10", "11", "12", "13", "14", "16", "17"} and all("SYNONYM" in u[i].status for i in u if u[i].is_synonym)
    assert [(r.synonym, r.accepted) for r in out["pro_parte"].collect()] == [("16", "7")]


def test_long_chains_and_deep_trees(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 301)] + [(1000, 1001), (1001, 1002), (1002, 1001)], "id long, accepted long")
    got = {r.id: (r.terminal, r.steps, r.in_cycle, r.endless) for r in tree.terminals(links).collect()}
    assert all(got[i] == (301, 301 - i, False, False) for i in range(1, 301))
    assert got[1000] == (1001, None, False, True) and got[1001] == got[1002] == (1001, None, True, True)
    deep = spark.createDataFrame([(i, i - 1 if i else None, "SPECIES") for i in range(131)] + [(500, 501, "SPECIES"), (501, 500, "SPECIES"), (502, 501, "GENUS")], "id long, parent long, rank string")
    assert tree.ancestors(deep).count() == 131 * 130 // 2 + 4
    m = {r.id: (r.num_descendants, r.num_children, r.num_s) for r in tree.metrics(deep.filter("id < 12 or id >= 500"), counted={"SPECIES": "s"}).collect()}
    assert all(m[i] == (11 - i, int(i < 11), 11 - i) for i in range(12)) and m[501] == (2, 2, 1) and m[502] == (0, 0, 0)


def test_sorted_trees(spark):
    edges = tree.relations(usages(spark), pro_parte=spark.createDataFrame([(7, 5)], "synonym long, accepted long"))
    keys = usages(spark).select("id", tree.sibling_key("rank", "name", "name").alias("key"))
    walk = lambda name: [r.id for r in tree.sorted_tree(edges, usages(spark).filter("id = 3"), name, keys).orderBy("sort_path").collect()]
    assert walk("SORTED_TREE") == [3, 5, 7, 4, 7, 6] and walk("SORTED_TREE_WITHOUT_PRO_PARTE") == [3, 5, 4, 7, 6] and walk("SORTED_ACCEPTED_TREE") == [3, 5, 4, 6]
    shown = tree.traverse(edges, usages(spark).filter("id = 2"), "TREE", ranks=usages(spark), lowest="SPECIES")
    assert {r.id for r in shown.collect()} == {2, 3, 4, 5, 7}
    asked = spark.createDataFrame([(6, 2), (7, 3), (7, 5), (1, 2)], "id long, search long")
    assert {(r.id, r.search) for r in tree.exists_in_classification(asked, usages(spark)).collect() if r.found} == {(6, 2), (7, 3)}
    assert {(r.id, r.search) for r in tree.exists_in_classification(asked, usages(spark), True).collect() if r.found} == {(6, 2), (7, 3), (1, 2)}


def test_lookup_and_match(spark):
    taxa = spark.createDataFrame(
        [
            (1, "Abies alba", "SPECIES", "ACCEPTED", "Mill.", "1768", "PLANTAE", "Plantae", "Pinaceae", False),
            (2, "Abies alba", "SPECIES", "SYNONYM", "Muench", None, "PLANTAE", "Plantae", "Pinaceae", False),
            (3, "Abies", "GENUS", "ACCEPTED", "Mill.", None, "PLANTAE", "Plantae", "Pinaceae", False),
            (4, "Oenanthe aquatica", "SPECIES", "ACCEPTED", "L.", None, "PLANTAE", "Plantae", "Apiaceae", False),
            (5, "Oenanthe oenanthe", "SPECIES", "ACCEPTED", "L.", "1758", "ANIMALIA", "Animalia", "Muscicapidae", False),
        ],
        "key long, canonical string, rank string, status string, authorship string, year string, kingdom string, kname string, family string, deleted boolean",
    )
    q = spark.createDataFrame(
        [(1, "Abies albus", "SPECIES", "PLANTAE", "Miller", None, "ACCEPTED"), (2, "Abies alba", "SPECIES", "PLANTAE", "Muench", None, None), (3, "Abies alba", "GENUS", "PLANTAE", None, None, None), (4, "Nothing here", "SPECIES", None, None, None, None)],
        "qid long, canonical string, rank string, kingdom string, authorship string, year string, status string",
    )
    assert {r.qid: r.key for r in matching.exact_lookup(q, taxa).collect()} == {1: 1, 2: 2}
    side = taxa.withColumn("kingdom", F.col("kname"))
    asked = spark.createDataFrame([(1, "Oenanthe aqvatica", "SPECIES"), (2, "Abies omnino", "SPECIES"), (3, "Xyz abc", "SPECIES"), (4, "Oenanthe oenanthe", "SPECIES")], "qid long, canonical string, rank string")
    got = {r.qid: (r.key, r.match_type) for r in matching.match(asked, side).collect()}
    assert got[1] == (4, "FUZZY") and got[2] == (3, "HIGHERRANK") and got[3] == (None, "NONE") and got[4] == (5, "EXACT")


def test_match_rules(spark):
    taxa = spark.createDataFrame(
        [
            (1, "Abies alba", "SPECIES", "ACCEPTED", "Mill.", "Pinaceae"), (2, "Abies", "GENUS", "ACCEPTED", "Mill.", "Pinaceae"), (3, "Picea abies", "SPECIES", "ACCEPTED", "Karst.", "Pinaceae"),
            (4, "Ables albus", "SPECIES", "ACCEPTED", None, "Carabidae"), (5, "Ranunculus auricomus", "SPECIES", "ACCEPTED", "L.", "Ranunculaceae"), (6, "Ranunculus", "GENUS", "ACCEPTED", None, "Ranunculaceae"), (7, "Bufo", "GENUS", "ACCEPTED", None, "Bufonidae"),
            (8, "Pufo marinus", "SPECIES", "ACCEPTED", None, "Pufonidae"), (9, "Bufo marinus minor", "SUBSPECIES", "ACCEPTED", None, "Bufonidae"),
        ],
        "key long, canonical string, rank string, status string, authorship string, family string",
    )
    asked = spark.createDataFrame(
        [
            (1, "ABIES ALBA", None, None, None, None), (2, "abies alva", None, None, None, None), (3, "whatever", None, None, None, 3), (4, "whatever", None, None, None, 99), (5, "Ranunculus auricomus", "SPECIES_AGGREGATE", None, None, None),
            (6, "Abies alba minor", None, None, None, None), (7, "Abies alba", "SPECIES", "Miller", "Pinaceae", None), (8, "Abies alba", "SPECIES", "Zzz", "Pinaceae", None), (9, "Picea abiez", "SPECIES", None, None, None), (10, "Abies nova", "SPECIES", None, "Pinaceae", None),
        ],
        "qid long, canonical string, rank string, authorship string, family string, usage_key long",
    )
    got = {r.qid: (r.key, r.match_type, r.confidence) for r in matching.match(asked, taxa).collect()}
    assert {i: g[:2] for i, g in got.items()} == {
        1: (1, "EXACT"), 2: (None, "NONE"), 3: (3, "EXACT"), 4: (None, "NONE"), 5: (6, "HIGHERRANK"), 6: (1, "HIGHERRANK"), 7: (1, "EXACT"), 8: (1, "EXACT"), 9: (3, "FUZZY"), 10: (2, "HIGHERRANK"),
    }
    assert got[7][2] > got[8][2]
    toad = spark.createDataFrame([(1, "Bufo marinus", "SPECIES", "Bufonidae"), (2, "Bufo marinus", "SPECIES", "Pufonidae")], "qid long, canonical string, rank string, family string")
    near = taxa.filter("key in (7, 8)").withColumn("canonical", F.when(F.col("key") == 8, "Buffo marinus").otherwise(F.col("canonical")))
    assert {r.qid: (r.key, r.match_type) for r in matching.match(toad, near).collect()} == {1: (7, "HIGHERRANK"), 2: (8, "FUZZY")}


def test_fuzzy_blocking_is_complete(spark):
    from random import Random

    from cladeworks.functions.similarity import block_edits

    r = Random(4)
    names = list({"a" + "".join(r.choice("abc") for _ in range(r.randint(1, 14))) for _ in range(120)})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = {(x.query, x.name): x.edits for x in matching.fuzzy_pairs(df.withColumnRenamed("name", "query"), df, "query", "name").collect()}
    want = {(a, b): e for a in names for b in names if (e := block_edits(a, b, 1)) <= (2 if len(a) > 10 else 1)}
    assert got == want


def source(spark, rows):
    return archives.typed_source(spark.createDataFrame([tuple(None if x == "" else x for x in r) for r in rows], ", ".join(f"{c} string" for c in archives.SOURCE_COLUMNS)))


def test_backbone(spark):
    first = source(spark, [
        ("1", "", "", "KINGDOM", "ACCEPTED", "", "Plantae", ""), ("2", "1", "", "FAMILY", "ACCEPTED", "", "Pinaceae", ""), ("3", "2", "", "GENUS", "ACCEPTED", "", "Abies Mill.", ""),
        ("4", "3", "", "SPECIES", "ACCEPTED", "", "Abies alba Mill.", ""), ("5", "4", "", "SPECIES", "SYNONYM", "", "Pinus picea L.", ""),
    ])
    second = source(spark, [
        ("1", "", "", "KINGDOM", "ACCEPTED", "", "Plantae", ""), ("2", "1", "", "FAMILY", "ACCEPTED", "", "Pinaceae Lindl.", ""), ("3", "2", "", "TRIBE", "ACCEPTED", "", "Abieteae", ""), ("4", "3", "", "GENUS", "ACCEPTED", "", "Abies", ""),
        ("5", "4", "", "SPECIES", "ACCEPTED", "", "Abies alba", ""), ("6", "4", "", "SPECIES", "ACCEPTED", "", "Abies nigra Foo ex Bar", ""), ("7", "2", "", "SPECIES", "ACCEPTED", "", "Cedrus libani A.Rich.", ""),
        ("8", "5", "", "SUBSPECIES", "ACCEPTED", "", "Abies alba subsp. minor Hort.", ""), ("9", "4", "", "SPECIES", "ACCEPTED", "", "Abies sp.", ""),
    ])
    rows = {r.name: r for r in backbone.build(spark, [first, second]).collect()}
    assert rows["Pinaceae Lindl."].parent == rows["Plantae"].id and rows["Abies Mill."].parent == rows["Pinaceae Lindl."].id
    assert rows["Abies alba Mill."].source == 1 and "Abies alba" not in rows and "Abies sp." not in rows and "Abieteae" not in rows
    assert rows["Pinus picea L."].is_synonym and rows["Pinus picea L."].parent == rows["Abies alba Mill."].id
    assert rows["Cedrus"].origin == "IMPLICIT_NAME" and rows["Cedrus libani A.Rich."].parent == rows["Cedrus"].id and rows["Cedrus"].parent == rows["Pinaceae Lindl."].id
    assert rows["Abies nigra Foo"].status == "SYNONYM" and rows["Abies alba alba"].origin == "AUTONYM"


def number_tables(spark, folder):
    """Suppliers of one nation whose numbers, spelled in letters, differ by doubled letters or an ending only."""
    tables = {
        "region": ([(0, "AFRICA")], "r_regionkey int, r_name string"), "nation": ([(0, "NATION_0", 0)], "n_nationkey int, n_name string, n_regionkey int"),
        "supplier": ([(k, f"Supplier#{k:09d}", 0) for k in (6, 10, 36, 75, 98, 775)], "s_suppkey long, s_name string, s_nationkey int"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_backbone_of_numbers(spark, tmp_path):
    built = checklists.q_backbone_build(spark, number_tables(spark, tmp_path)).collect()
    species = [r.name for r in built if r.rank == "SPECIES"]
    assert sorted(species) == sorted(f"Nationa supplier{str(k).zfill(9).translate(str.maketrans('0123456789', 'abdefgilno'))} Mill., 1768" for k in (6, 10, 36, 75, 98, 775))
    folded = {names.normalized(" ".join(n.split()[:2])) for n in species}
    assert len(folded) < len(species) and {r.parent_name for r in built if r.rank == "SPECIES"} == {"Nationa"}


def test_stable_ids_of_numbers(spark, tmp_path):
    got = {(r.rank, r.reissued): (r.n, r.in_range) for r in checklists.q_stable_ids(spark, number_tables(spark, tmp_path)).collect()}
    assert got == {("KINGDOM", False): (9, True), ("FAMILY", False): (1, True), ("GENUS", True): (1, True), ("SPECIES", False): (6, True)}


def test_basionyms_and_ids(spark):
    base = source(spark, [
        ("1", "", "", "KINGDOM", "ACCEPTED", "", "Animalia", ""), ("2", "1", "", "FAMILY", "ACCEPTED", "", "Felidae", ""), ("3", "2", "", "GENUS", "ACCEPTED", "", "Puma", ""), ("4", "2", "", "GENUS", "ACCEPTED", "", "Felis", ""),
        ("5", "3", "", "SPECIES", "ACCEPTED", "", "Puma concolor (Linnaeus, 1771)", ""), ("6", "4", "", "SPECIES", "ACCEPTED", "", "Felis concolor Linnaeus, 1771", ""),
    ])
    built = backbone.build(spark, [base])
    rows = {r.name: r for r in built.collect()}
    a, b = rows["Puma concolor (Linnaeus, 1771)"], rows["Felis concolor Linnaeus, 1771"]
    assert a.is_synonym != b.is_synonym and "HOMOTYPIC_SYNONYM" in (a.status, b.status)
    ids = {r.id: (r.stable, r.reissued) for r in backbone.stable_ids(built, built.withColumn("id", F.col("id") + 500).filter("rank = 'GENUS'"), 9000).collect()}
    assert ids[rows["Puma"].id] == (rows["Puma"].id + 500, True) and ids[a.id][0] >= 9000 and len({s for s, _ in ids.values()}) == len(ids)
    wrong = backbone.check_assertions(built, spark.createDataFrame([(-1, "Puma concolor", "SPECIES", "ANIMALIA"), (-1, "Panthera leo", None, None)], "key long, name string, rank string, kingdom string"))
    assert [r.name for r in wrong.collect()] == ["Panthera leo"]


def test_archive_round_trip(spark, tmp_path):
    (tmp_path / "core.txt").write_text("taxonID\tscientificName\tkingdom\n1\tAbies\tPlantae\n2\tPicea\t\\N\n")
    (tmp_path / "ext.txt").write_text("id\tname\n1\tfir\n1\tSapin\n")
    rows = {r.taxonID: r for r in archives.read_archive(spark, str(tmp_path / "core.txt"), {"vernacular": str(tmp_path / "ext.txt")}).collect()}
    assert rows["2"].kingdom is None and [x["name"] for x in rows["1"].vernacular] == ["fir", "Sapin"] and archives.mapped(["kingdom"])["denormed"]
    out = archives.export_archive(usages(spark), {"names": spark.createDataFrame([(4, "x\ty"), (99, "gone")], "usage_id long, name string")}, str(tmp_path / "out"))
    assert spark.read.option("sep", "\t").option("header", True).csv(out["names"]).collect()[0].name == "x y" and spark.read.option("sep", "\t").option("header", True).csv(out["core"]).count() == 7
    archives.export_ranges(usages(spark), str(tmp_path / "ranges"), "id", 2)
    assert spark.read.parquet(str(tmp_path / "ranges")).count() == 7
    search.swap_index(usages(spark), str(tmp_path), "index")
    assert search.open_index(spark, str(tmp_path), "index").count() == 7


def test_writes(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "b", None), (30, "c", None)], "id long, v string, deleted string")
    out = {r.id: r.deleted for r in relational.delete_keys(df, df.filter("id > 1"), "id", 10, F.lit("now")).collect()}
    assert out == {1: None, 2: "now"}
    assert [r.id for r in relational.next_ids(df.drop("id"), ["v"], 100).orderBy("v").collect()] == [100, 101, 102]


def test_higher_names_and_doubtful_subtrees(spark):
    q = spark.createDataFrame([(1, "metazoa"), (2, "incertae"), (3, "Plantae"), (4, None)], "qid long, kingdom string")
    syn = spark.createDataFrame([("KINGDOM", "Metazoa", "Animalia")], "rank string, name string, accepted string")
    got = {r.qid: r.kingdom for r in matching.tidy_higher(q, syn, ["INCERTAE"]).collect()}
    assert got == {1: "Animalia", 2: None, 3: "Plantae", 4: None}
    rows = usages(spark).select("id", "parent", "rank", "name", F.col("name").alias("canonical"), "is_synonym", F.lit("ACCEPTED").alias("status"), F.lit("ANIMALIA").alias("kingdom"), F.array().cast("array<string>").alias("issues"))
    heads = spark.createDataFrame([("Sciurus vulgaris", "ANIMALIA")], "name string, kingdom string")
    doubtful = {r.id for r in backbone.doubt_subtrees(rows, heads).filter("status = 'DOUBTFUL'").collect()}
    assert doubtful == {4, 6}
