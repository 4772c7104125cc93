"""Ranks, their order and relations, and kingdoms. The order of ``RANKS`` is the taxonomic order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (stem, prefixes in order); an empty prefix is the stem itself.
_LADDER = (
    ("DOMAIN", ("",)), ("KINGDOM", ("SUPER", "", "SUB", "INFRA")), ("PHYLUM", ("SUPER", "", "SUB", "INFRA")), ("CLASS", ("SUPER", "", "SUB", "INFRA", "PARV")),
    ("LEGION", ("SUPER", "", "SUB", "INFRA")), ("COHORT", ("SUPER", "", "SUB", "INFRA")), ("ORDER", ("MAGN", "SUPER", "GRAND", "", "SUB", "INFRA", "PARV")),
    ("FAMILY", ("SUPER", "", "SUB", "INFRA")), ("TRIBE", ("SUPER", "", "SUB", "INFRA")),
)


def _spell(stem: str, prefix: str) -> str:
    return "MAGNORDER" if prefix == "MAGN" else prefix + stem


_UPPER = [_spell(stem, p) for stem, prefixes in _LADDER for p in prefixes]
_GENERIC = ["SUPRAGENERIC_NAME", "GENUS", *(p + "GENUS" for p in ("SUB", "INFRA")), *(p + s for s in ("SECTION", "SERIES") for p in ("", "SUB")), "INFRAGENERIC_NAME"]
_SPECIFIC = ["SPECIES_AGGREGATE", "SPECIES", "INFRASPECIFIC_NAME"]
_BELOW = "grex subspecies cultivar_group convariety infrasubspecific_name proles race natio aberration morph variety subvariety form subform".upper().split()
_MICROBIAL = [f"{x}VAR" for x in ("PATHO", "BIO", "CHEMO", "MORPHO", "PHAGO", "SERO")] + ["CHEMOFORM", "FORMA_SPECIALIS"]
RANKS: list[str] = [*_UPPER, *_GENERIC, *_SPECIFIC, *_BELOW, *_MICROBIAL, "CULTIVAR", "STRAIN", "OTHER", "UNRANKED"]
ORDINAL = {r: i for i, r in enumerate(RANKS)}
LINNEAN = ["KINGDOM", "PHYLUM", "CLASS", "ORDER", "FAMILY", "GENUS", "SPECIES"]
#: The ranks that a metrics row counts.
COUNTED = {"PHYLUM": "p", "CLASS": "c", "ORDER": "o", "FAMILY": "f", "GENUS": "g", "SUBGENUS": "sg", "SPECIES": "s"}
UNKNOWN = {"OTHER", "UNRANKED"}
CULTIVATED = {"CULTIVAR", "CULTIVAR_GROUP", "CONVARIETY", "GREX"}
UNCOMPARABLE = {"SUPRAGENERIC_NAME", "INFRAGENERIC_NAME", "INFRASPECIFIC_NAME", "INFRASUBSPECIFIC_NAME", *UNKNOWN}


def suprageneric(r: str) -> bool:
    return ORDINAL[r] <= ORDINAL["SUPRAGENERIC_NAME"]


def infrageneric(r: str) -> bool:
    return ORDINAL["SUBGENUS"] <= ORDINAL[r] <= ORDINAL["INFRAGENERIC_NAME"]


def supraspecific(r: str) -> bool:
    return ORDINAL[r] < ORDINAL["SPECIES_AGGREGATE"]


def species_or_below(r: str) -> bool:
    return r not in UNKNOWN and ORDINAL[r] >= ORDINAL["SPECIES_AGGREGATE"]


def infraspecific(r: str) -> bool:
    return r not in UNKNOWN and ORDINAL[r] >= ORDINAL["INFRASPECIFIC_NAME"]


def infrasubspecific(r: str) -> bool:
    return r not in UNKNOWN and ORDINAL[r] > ORDINAL["SUBSPECIES"]


def linnean_base(r: str) -> str | None:
    """The Linnean rank a rank belongs to: the next one at or above it, species included."""
    if r in UNKNOWN:
        return None
    above = [x for x in LINNEAN if ORDINAL[x] <= ORDINAL[r]]
    stem = next((s for s, prefixes in _LADDER if s in LINNEAN and r in {_spell(s, p) for p in prefixes}), None)
    return stem or (above[-1] if above else None)


def next_higher_linnean(r: str) -> str | None:
    return next((x for x in reversed(LINNEAN) if ORDINAL[x] < ORDINAL[r]), None)


def next_lower_linnean(r: str) -> str | None:
    return next((x for x in LINNEAN if ORDINAL[x] > ORDINAL[r]), None)


def ranks_match(a: str | None, b: str | None) -> bool:
    """Unknown ranks match all; an unspecific infraspecific rank matches its whole group; else only equal ranks."""
    if a is None or b is None or a in UNKNOWN or b in UNKNOWN or a == b:
        return True
    for general, member in (("INFRASPECIFIC_NAME", infraspecific), ("INFRASUBSPECIFIC_NAME", infrasubspecific), ("INFRAGENERIC_NAME", infrageneric)):
        if (a == general and member(b)) or (b == general and member(a)):
            return True
    return False


def rank_similarity(query: str | None, ref: str | None) -> int:
    """How well two ranks go together, -35 to 6."""
    if ref is None:
        return -1 if query is not None else 0
    score = -7 if ref in CULTIVATED or ref == "STRAIN" else 0
    score -= 3 * (ref in UNCOMPARABLE)
    if query is not None:
        pairs = ((query, ref), (ref, query))
        general = (("INFRASPECIFIC_NAME", infraspecific), ("INFRASUBSPECIFIC_NAME", infrasubspecific), ("INFRAGENERIC_NAME", infrageneric))
        specific = lambda x: x in ("SPECIES", "SPECIES_AGGREGATE")
        if query == ref:
            score += 10
        elif any(x == g and member(y) for x, y in pairs for g, member in general):
            score += 5
        elif {query, ref} == {"INFRAGENERIC_NAME", "GENUS"}:
            score += 4
        elif query in UNKNOWN or ref in UNKNOWN:
            score = 0
        elif {query, ref} == {"SPECIES", "SPECIES_AGGREGATE"}:
            score += 2
        elif any((specific(x) and infraspecific(y)) or (supraspecific(x) and species_or_below(y)) for x, y in pairs):
            score -= 30
        elif suprageneric(query) != suprageneric(ref):
            score -= 35
        else:
            score -= abs(ORDINAL[query] - ORDINAL[ref])
    return max(-35, min(6, score))


KINGDOMS = ["INCERTAE_SEDIS", "ANIMALIA", "ARCHAEA", "BACTERIA", "CHROMISTA", "FUNGI", "PLANTAE", "PROTOZOA", "VIRUSES"]
VAGUE = {"ARCHAEA", "BACTERIA", "CHROMISTA", "FUNGI", "PROTOZOA"}
#: Kingdoms that a kingdom may be taken for when names are looked up.
_EUKARYOTES = ("ANIMALIA", "FUNGI", "PLANTAE")
_EXPANDED = {k: {k} for k in KINGDOMS[1:]}
for _k in ("PROTOZOA", "CHROMISTA"):
    _EXPANDED[_k].update(_EUKARYOTES)
_EXPANDED["ARCHAEA"].add("BACTERIA")


def kingdoms_match(a: str | None, b: str | None) -> bool:
    """Whether two kingdoms may be one; unknown and INCERTAE_SEDIS may be any."""
    if a is None or b is None or "INCERTAE_SEDIS" in (a, b):
        return True
    return bool(_EXPANDED[a] & _EXPANDED[b])


def kingdom_similarity(a: str | None, b: str | None) -> int:
    """-10 to 10, 0 if one is unknown."""
    if a is None or b is None:
        return 0
    if "INCERTAE_SEDIS" in (a, b):
        return 7
    return 10 if a == b else 8 if a in VAGUE and b in VAGUE else -10


def rank_dim(spark: SparkSession) -> DataFrame:
    """One row for each rank: a table of fixed size, fit to be broadcast."""
    rows = [
        (r, i, r in LINNEAN, suprageneric(r), infrageneric(r), species_or_below(r), infraspecific(r), r in UNCOMPARABLE, linnean_base(r), next_higher_linnean(r), next_lower_linnean(r))
        for r, i in ORDINAL.items()
    ]
    return spark.createDataFrame(
        rows,
        "rank string, ordinal int, is_linnean boolean, is_suprageneric boolean, is_infrageneric boolean, is_species_or_below boolean, "
        "is_infraspecific boolean, is_uncomparable boolean, linnean_base string, next_higher string, next_lower string",
    )


def rank_pairs(spark: SparkSession) -> DataFrame:
    """(a, b, matches, similarity) of all known ranks: 5,625 rows at most."""
    return spark.createDataFrame([(a, b, ranks_match(a, b), rank_similarity(a, b)) for a in RANKS for b in RANKS], "a string, b string, matches boolean, similarity int")


def symmetric_pairs(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """A compatibility table from unordered pairs: each with its mirror, and each value with itself."""
    both = {(a, b) for a, b in pairs} | {(b, a) for a, b in pairs} | {(x, x) for p in pairs for x in p}
    return spark.createDataFrame(sorted(both), "a string, b string")


def lookup(column: Column, table: dict[str, object], default: Column | None = None) -> Column:
    """A small fixed table as an expression, so that no join is needed."""
    whole = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(whole[column], default) if default is not None else whole[column]


def ordinal(column: Column) -> Column:
    """The place of a rank in the order; null and unknown spellings come last."""
    return lookup(column, ORDINAL, F.lit(2**31 - 1))


def group_infraspecific(column: Column) -> Column:
    """Ranks below species become one."""
    return F.when(ordinal(column) <= ORDINAL["SPECIES"], column).when(column.isNotNull(), F.lit("INFRASPECIFIC_NAME"))


def rank_match(a: Column, b: Column) -> Column:
    """``ranks_match`` as an expression."""
    members = lambda test: [r for r in RANKS if test(r)]
    cases = [a.isNull(), b.isNull(), a.isin(*UNKNOWN), b.isin(*UNKNOWN), a == b]
    for general, test in (("INFRASPECIFIC_NAME", infraspecific), ("INFRASUBSPECIFIC_NAME", infrasubspecific), ("INFRAGENERIC_NAME", infrageneric)):
        cases += [(a == general) & b.isin(*members(test)), (b == general) & a.isin(*members(test))]
    return reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in cases])


def kingdom_match(a: Column, b: Column) -> Column:
    """``kingdoms_match`` as an expression."""
    expand = lambda c: lookup(c, {k: sorted(v) for k, v in _EXPANDED.items()})
    open_end = a.isNull() | b.isNull() | (a == "INCERTAE_SEDIS") | (b == "INCERTAE_SEDIS")
    return F.coalesce(open_end, F.lit(False)) | F.coalesce(F.arrays_overlap(expand(a), expand(b)), F.lit(False))


def kingdom_score(a: Column, b: Column) -> Column:
    """``kingdom_similarity`` as an expression."""
    return (
        F.when(a.isNull() | b.isNull(), 0).when((a == "INCERTAE_SEDIS") | (b == "INCERTAE_SEDIS"), 7).when(a == b, 10).when(a.isin(*VAGUE) & b.isin(*VAGUE), 8).otherwise(-10)
    )


def rank_score(query: Column, ref: Column) -> Column:
    """``rank_similarity`` as a lookup in a fixed table of pairs, one letter for each pair in a single literal."""
    table = "".join(chr(rank_similarity(a, b) + _SHIFT) for a in RANKS for b in RANKS)
    alone = "".join(chr(rank_similarity(None, r) + _SHIFT) for r in RANKS)
    place = {r: i for i, r in enumerate(RANKS)}
    i, j = lookup(query, place), lookup(ref, place)
    read = lambda letters, at: F.ascii(F.substring(F.lit(letters), at + 1, F.lit(1))) - _SHIFT
    return F.when(ref.isNull(), F.when(query.isNull(), 0).otherwise(-1)).when(query.isNull(), read(alone, j)).otherwise(read(table, i * len(RANKS) + j))


#: Makes all similarities printable letters.
_SHIFT = 70
