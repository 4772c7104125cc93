"""Golden values of the scalar functions; expressions are held against their Python twins."""

import pytest
from pyspark.sql import functions as F

from cladeworks.functions import authors, cleaning, names, ranks, similarity


@pytest.mark.parametrize(
    "query,ref,score",
    [
        ("FAMILY", "FAMILY", 6), ("SPECIES", "SPECIES", 6), ("GENUS", "SUBGENUS", -1), ("SPECIES", "SPECIES_AGGREGATE", 2), ("UNRANKED", "UNRANKED", 6), ("UNRANKED", None, -1),
        ("FAMILY", "UNRANKED", 0), ("SPECIES", "UNRANKED", 0), ("SUBSPECIES", "VARIETY", -9), ("SUBSPECIES", "INFRASPECIFIC_NAME", 2), ("GENUS", "CLASS", -35), ("GENUS", "FAMILY", -35),
        ("FAMILY", "KINGDOM", -28),
    ],
)
def test_rank_similarity(query, ref, score):
    assert ranks.rank_similarity(query, ref) == score


def test_rank_order():
    assert len(ranks.RANKS) == len(set(ranks.RANKS)) == 75
    assert ranks.RANKS[0] == "DOMAIN" and ranks.RANKS[-1] == "UNRANKED"
    assert ranks.ORDINAL["SUPERFAMILY"] < ranks.ORDINAL["FAMILY"] < ranks.ORDINAL["GENUS"] < ranks.ORDINAL["SPECIES"]
    assert ranks.linnean_base("SUBFAMILY") == "FAMILY" and ranks.next_higher_linnean("GENUS") == "FAMILY" and ranks.next_lower_linnean("GENUS") == "SPECIES"


def test_expressions_equal_twins(spark):
    pairs = [(a, b) for a in [None, "GENUS", "SUBSPECIES", "VARIETY", "INFRASPECIFIC_NAME", "UNRANKED", "SPECIES"] for b in [None, "GENUS", "SPECIES", "FORM", "SECTION", "INFRAGENERIC_NAME"]]
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", ranks.rank_match(F.col("a"), F.col("b")).alias("m"), ranks.rank_score(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.m == ranks.ranks_match(r.a, r.b) and r.s == ranks.rank_similarity(r.a, r.b), r
    kingdoms = [None, *ranks.KINGDOMS]
    df = spark.createDataFrame([(a, b) for a in kingdoms for b in kingdoms], "a string, b string")
    for r in df.select("a", "b", ranks.kingdom_match(F.col("a"), F.col("b")).alias("m"), ranks.kingdom_score(F.col("a"), F.col("b")).alias("s")).collect():
        assert r.m == ranks.kingdoms_match(r.a, r.b) and r.s == ranks.kingdom_similarity(r.a, r.b), r


@pytest.mark.parametrize(
    "a,b,score",
    [
        ("A", "×A", 100), ("Ausbus", "×Ausbus", 100), ("Aus", "×Ausausaus", 0), ("abcdefg", "amcdefg", 80), ("abcdefg", "abcdeg", 80), ("abcdefg", "zyxvwu", 0), ("abcdefg", "amncdefg", 0),
        ("Aka abcdefg", "Aka aabbccddeeffgg", 100), ("äöüæøåœđł", "aouaeoaoedl", 100), ("xAus", "Aus", 100), ("× Aus", "Aus", 100), ("Abies alba", "Abies albus", 100), ("Abies alba", "Abies olba", 5),
        ("Abies alba", "Abies alta", 95), ("Abies ama", "Abies amum", 100), ("Linaria pedunculata", "Linaria pedinculata", 95), ("Linaria pedunculata", "Lunaria pedunculata", 90),
        ("Linaria pedunculata", "Linariya pedonculata", 85), ("Linaria pedunculata vulgaris", "Lunaria pedunculata vulgaris", 93.33), ("Oreina elegans", "Orfelia elegans", 5), ("scotti", "wattsi", 0),
    ],
)
def test_name_similarity(a, b, score):
    assert similarity.name_similarity(a, b) == pytest.approx(score, abs=0.01)


def test_confidence(spark):
    want = {-10000: 0, 0: 0, 1: 1, 50: 50, 80: 80, 85: 85, 90: 88, 92: 89, 95: 91, 98: 92, 100: 93, 105: 95, 110: 96, 115: 97, 120: 99, 175: 100}
    got = spark.createDataFrame([(x,) for x in want], "s int").select("s", similarity.normalize_confidence(F.col("s")).alias("n")).collect()
    assert {r.s: r.n for r in got} == want


def test_edits_expression_equals_twin(spark):
    pairs = [("abcdef", "abcxef"), ("a", "b"), ("same", "same"), ("abcdefghijkl", "bacdefghijlk"), ("kitten", "sitting")]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.levenshtein("a", "b").alias("d"))
    for r in df.select("a", "b", "d", similarity.edits_col(F.col("d"), F.col("a"), F.col("b")).alias("s")).collect():
        assert r.s == similarity.edits_to_similarity(r.d, r.a, r.b)
    assert similarity.block_edits("abcdef", "abdcef") == 1 and similarity.costly_edits("abc", "axc") == 2
    assert similarity.longest_common_substring("xabcy", "zabcq") == "abc"
    assert similarity.jaro_winkler("martha", "martha") == 100


@pytest.mark.parametrize("name", ["Abies alba", "Abiies", "Abies alpinus", "×Aus bus", "Abyes albus", "Rhythmus rhopalus", "Äbies süß", "", "A bus", "Foo scottii-barei", "Lepidothrix  isidorei"])
def test_normalizing(spark, name):
    got = spark.createDataFrame([(name,)], "n string").select(names.normalize_name(F.col("n")).alias("a"), names.normalize_name(F.col("n"), whole=True).alias("b"), names.normalize_name(F.col("n"), stemming=False).alias("c")).first()
    assert (got.a, got.b, got.c) == (names.normalized(name), names.normalized(name, whole=True), names.normalized(name, stemming=False))


def test_normalizing_values():
    assert names.normalized("Abiies") == "Abiies" and names.normalized("Abiies", whole=True) == "Abies"
    assert names.normalized("Abyes albus") == "Abyes alba"
    assert names.normalized("Abies olba olbus") == "Abies olba olba"


@pytest.mark.parametrize(
    "name,want",
    [
        ("Abies alba Mill., 1768", {"genus_or_above": "Abies", "specific_epithet": "alba", "authorship": "Mill.", "year": "1768"}),
        ("Puma concolor (Linnaeus, 1771)", {"specific_epithet": "concolor", "bracket_authorship": "Linnaeus", "bracket_year": "1771", "authorship": None}),
        ("Poa annua subsp. supina (Schrad.) Link", {"infra_specific_epithet": "supina", "rank_marker": "SUBSPECIES", "bracket_authorship": "Schrad.", "authorship": "Link"}),
        ("Sciurus (Neosciurus) carolinensis", {"infra_generic": "Neosciurus", "specific_epithet": "carolinensis"}),
        ("Pinaceae", {"genus_or_above": "Pinaceae", "canonical_name": "Pinaceae", "type": "SCIENTIFIC"}),
        ("Abies × alba", {"notho": True, "specific_epithet": "alba"}),
        ("Abies alba × Picea abies", {"type": "HYBRID"}), ("Tobacco mosaic virus", {"type": "VIRUS"}), ("BOLD:AAA1234", {"type": "OTU"}), ("Abies sp.", {"type": "INFORMAL", "genus_or_above": "Abies"}),
        ("", {"type": "NO_NAME"}), ("Incertae sedis", {"type": "PLACEHOLDER"}), ("Abies alba van der Berg", {"specific_epithet": "alba", "infra_specific_epithet": None, "authorship": "van der Berg"}),
    ],
)
def test_parsing(name, want):
    got = names.parse(name)
    assert {k: got[k] for k in want} == want


@pytest.mark.parametrize(
    "a,ya,b,yb,want",
    [
        ("L.", None, "Linnaeus", None, "EQUAL"), ("Mill.", "1768", "Miller", "1768", "EQUAL"), ("Smith", None, "Jones", None, "DIFFERENT"), (None, None, "Jones", None, "UNKNOWN"),
        ("A. Smith", None, "B. Smith", None, "DIFFERENT"), ("Müller", None, "Mueller", None, "EQUAL"), ("Smith & Jones", None, "Jones", None, "EQUAL"), (None, "1900", "Jones", "1901", "EQUAL"),
        (None, "1900", None, "1905", "DIFFERENT"), ("Foo ex Bar", None, "Bar", None, "EQUAL"),
    ],
)
def test_author_comparison(spark, a, ya, b, yb, want):
    assert authors.compare(a, ya, b, yb) == want


def test_author_expressions(spark):
    rows = ["Müller & Smith in Foo", "L. f.", "(Schrad.) Link", None, "", "Foo ex Bar, Baz", "Boer : Fr."]
    got = spark.createDataFrame([(x,) for x in rows], "a string").select("a", authors.normalize_author(F.col("a")).alias("n")).collect()
    assert [r.n for r in got] == [authors.author(x) for x in rows]
    assert authors.compare_years("18?9", "1879") == "EQUAL" and authors.compare_years("1879", "1881") == "DIFFERENT"
    assert [authors.both(x, y) for x, y in [("EQUAL", "UNKNOWN"), ("UNKNOWN", "UNKNOWN"), ("EQUAL", "DIFFERENT")]] == ["EQUAL", "UNKNOWN", "DIFFERENT"]


def test_cleaning(spark):
    df = spark.createDataFrame([(r"\N",), (" a \t b ",), ("null",), ("",), (None,), ("x",)], "v string")
    assert [r[0] for r in df.select(cleaning.clean(F.col("v"))).collect()] == [None, "a b", None, None, None, "x"]
    df = spark.createDataFrame([("a|b|c",), ("a;b",), ("abc",), (None,), ("[x,y]",)], "v string")
    assert [r[0] for r in df.select(cleaning.split_values(F.col("v"))).collect()][:4] == [["a", "b", "c"], ["a", "b"], ["abc"], []]
    one = spark.range(1)
    lit = lambda x: F.lit(x).cast("string")
    got = one.select(
        cleaning.full_authorship(lit("L."), lit("1753"), lit(None), lit("1750")), cleaning.full_authorship(lit(None), lit(None), lit("Mill."), lit("1768")),
        cleaning.mime_type(lit("http://x.org/a.JPG?x=1")), cleaning.expand_genus(lit("A. alba"), lit("Abies nigra")), cleaning.citation(lit("L."), lit("Systema"), lit("1758"), lit("Holmiae")),
        cleaning.nfc(lit("é")), cleaning.strip_html(lit("<b>a</b> c")),
    ).first()
    assert list(got) == ["L., 1753 (1750)", " (Mill., 1768)", "image/jpeg", "Abies alba", "L. (1758): Systema. Holmiae", "é", "a c"]
