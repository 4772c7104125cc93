"""Building one backbone taxonomy from prioritized sources.

Sources are merged one after the other, best first. Within a source all rows of one depth are handled
together, so a source needs as many rounds as it has levels, whatever its size. Every step is a function
from tables to tables.

A backbone row: id, parent, rank, name, canonical, authorship, year, status, is_synonym, kingdom,
source, source_key, origin, issues.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.authors import EQUAL, DIFFERENT, compare_col
from ..functions.names import match_key, parse_name, stem_epithet
from ..functions.ranks import KINGDOMS, LINNEAN, ORDINAL, kingdom_match, ordinal, rank_match
from ..sources.tables import Levels, materialize
from .aggregates import priority
from .relational import next_ids
from .tree import contract, paths

SCHEMA = (
    "id long, parent long, rank string, name string, canonical string, authorship string, year string, status string, is_synonym boolean, kingdom string, "
    "source int, source_key long, origin string, issues array<string>"
)
#: Ranks that the backbone knows.
ALLOWED_RANKS = (*LINNEAN, "SUBSPECIES", "VARIETY", "FORM", "INFRASPECIFIC_NAME", "UNRANKED")
_IGNORED_TYPES = ("PLACEHOLDER", "NO_NAME", "INFORMAL", "HYBRID", "UNPARSED")
_SYNONYMS = ("SYNONYM", "HOMOTYPIC_SYNONYM", "HETEROTYPIC_SYNONYM", "PROPARTE_SYNONYM", "MISAPPLIED")


def seed(spark: SparkSession) -> DataFrame:
    """The kingdoms, with ids from 0 in their fixed order."""
    rows = [(i, None, "KINGDOM", k.capitalize().replace("_", " "), k.capitalize().replace("_", " "), None, None, "ACCEPTED", False, k, 0, None, "SEED", []) for i, k in enumerate(KINGDOMS)]
    return spark.createDataFrame(rows, SCHEMA)


def parsed_source(rows: DataFrame) -> DataFrame:
    """Source rows (eight columns) with the atoms of their names."""
    parsed = rows.withColumn("p", parse_name(F.col("scientific_name")))
    atoms = ("canonical_name", "type", "authorship", "year", "bracket_authorship", "bracket_year", "genus_or_above", "specific_epithet", "infra_specific_epithet", "parsed", "rank_marker")
    return parsed.select(*rows.columns, *[F.col(f"p.{a}").alias(a) for a in atoms])


def rejection(blacklist: Sequence[str] = (), allowed: Sequence[str] = ALLOWED_RANKS, above: str | None = None) -> Column:
    """Why a source row cannot enter the backbone, or null."""
    name = F.lower(F.coalesce("canonical_name", "scientific_name"))
    epithets = F.coalesce(F.col("infra_specific_epithet"), F.col("specific_epithet"))
    words = F.size(F.split(F.coalesce("canonical_name", F.lit("")), " "))
    too_high = ordinal(F.col("rank")) < ORDINAL[above] if above else F.lit(False)
    return (
        F.when(F.col("status") == "MISAPPLIED", "misapplied")
        .when(F.col("type").isin(*_IGNORED_TYPES), "name type")
        .when(~F.col("parsed") & ~F.col("type").isin("VIRUS", "OTU"), "unparsed")
        .when(name.isin(*[b.lower() for b in blacklist]) if blacklist else F.lit(False), "blacklisted")
        .when(F.col("scientific_name").rlike(r"(?i)\b(sensu|auct)\b"), "sensu")
        .when(F.lower(epithets) == "null", "null epithet")
        .when(~F.coalesce("rank", F.lit("UNRANKED")).isin(*allowed), "rank")
        .when(too_high, "rank above source's scope")
        .when((F.col("rank") == "SPECIES") & (words < 2) & F.col("parsed"), "indetermined")
        .when((ordinal(F.col("rank")) > ORDINAL["SPECIES"]) & (F.col("rank") != "UNRANKED") & (words < 3) & F.col("parsed"), "indetermined")
        .when((ordinal(F.col("rank")) < ORDINAL["SPECIES"]) & (words > 1), "rank mismatch")
    )


def usable(parsed: DataFrame, **rules) -> DataFrame:
    """Source rows that may enter; what hangs below a rejected row moves up to the next one that may."""
    flagged = parsed.withColumn("_why", rejection(**rules))
    return contract(flagged, F.col("_why").isNull(), "key", "parent_key").drop("_why")


def _lookup_side(rows: DataFrame, name_key: Callable[[Column], Column]) -> DataFrame:
    """What a source row is compared with, by the key of its name."""
    return rows.select(
        name_key(F.coalesce("canonical", "name")).alias("_k"), "id", F.col("parent").alias("b_parent"), F.col("rank").alias("b_rank"), F.col("kingdom").alias("b_kingdom"), F.col("authorship").alias("b_author"),
        F.col("year").alias("b_year"), F.col("is_synonym").alias("b_syn"), F.col("status").alias("b_status"), F.col("source").alias("b_source"),
    )


def _candidates(level: DataFrame, known: DataFrame, number: int) -> DataFrame:
    """(key, id): the row of the backbone that a source row is.

    Names above genus that the backbone has once are taken whatever their kingdom; of several, the one under the same
    parent. Else kingdoms must not contradict and authors must not differ. An accepted name without author
    is none of several synonyms with authors that come from the same source. The best one is equal in author and
    rank, under the same parent, of the same kind and not doubtful.
    """
    pairs = level.join(known, "_k").filter(rank_match(F.col("rank"), F.col("b_rank")))
    pairs = pairs.withColumn("_a", compare_col(F.col("authorship"), F.col("year"), F.col("b_author"), F.col("b_year")))
    sibling = F.col("nub_parent").eqNullSafe(F.col("b_parent"))
    high = ordinal(F.col("rank")) < ORDINAL["GENUS"]
    of = Window.partitionBy("key")
    pairs = pairs.withColumn("_same_rank", F.coalesce(F.max(F.col("rank") == F.col("b_rank")).over(of), F.lit(False))).filter(~(F.col("_same_rank") & (F.col("rank") != F.col("b_rank"))) | F.col("rank").isNull())
    pairs = pairs.withColumn("_n", F.count(F.lit(1)).over(of))
    fits = F.when(high, (F.col("_n") == 1) | sibling).otherwise(kingdom_match(F.col("kingdom"), F.col("b_kingdom")) & (F.col("_a") != DIFFERENT))
    pairs = pairs.filter(fits)
    foreign = ~F.col("is_synonym") & F.col("authorship").isNull() & F.col("b_syn") & F.col("b_author").isNotNull() & (F.col("b_source") == number)
    pairs = pairs.withColumn("_all_foreign", F.min(F.coalesce(foreign, F.lit(False))).over(of)).filter("not _all_foreign")
    order = F.struct(
        (F.col("_a") != EQUAL).cast("int").alias("a"), (~F.col("rank").eqNullSafe(F.col("b_rank"))).cast("int").alias("b"), (~sibling).cast("int").alias("c"),
        (F.col("is_synonym") != F.col("b_syn")).cast("int").alias("d"), (F.col("b_status") == "DOUBTFUL").cast("int").alias("e"), "id",
    )
    return pairs.groupBy("key").agg(F.min_by("id", order).alias("id"))


def add_source(backbone: DataFrame, rows: DataFrame, number: int, next_id: int, name_key: Callable[[Column], Column] = match_key) -> tuple[DataFrame, int]:
    """Merge one source of usable, parsed rows. Known rows gain what they lack, new ones hang on their parent's row.

    Levels are placed from the top down. A level is compared with the rows of the backbone whose names the source has,
    found once, and with the rows that the levels above made; the backbone itself is rewritten once, at the end.
    Names of one ``name_key`` are one name: by default spelling variants are.
    """
    spark = backbone.sparkSession
    tree = materialize(paths(rows, "key", "parent_key", F.struct(ordinal(F.col("rank")).alias("o"), F.col("scientific_name").alias("n"))).select(F.col("id").alias("_key"), "depth", "sort_path"))
    work = materialize(rows.join(tree, F.col("key") == F.col("_key")).drop("_key").withColumn("_k", name_key(F.coalesce("canonical_name", "scientific_name"))))
    deepest = work.agg(F.max("depth")).first()[0]
    old = materialize(_lookup_side(backbone, name_key).join(work.select("_k"), "_k", "left_semi"))
    placed, added, gained = Levels(spark), Levels(spark), Levels(spark)
    for depth in range((deepest if deepest is not None else -1) + 1):
        level = work.filter(F.col("depth") == depth).withColumn("is_synonym", F.coalesce(F.col("status").isin(*_SYNONYMS), F.lit(False)))
        if not placed.n:
            level = level.withColumns({"nub_parent": F.lit(None).cast("long"), "kingdom": F.when(F.col("rank") == "KINGDOM", F.upper(F.replace("canonical_name", F.lit(" "), F.lit("_"))))})
        else:
            up = placed.all().select(F.col("key").alias("_pk"), F.col("nub").alias("nub_parent"), "kingdom")
            level = level.join(up, F.col("parent_key") == F.col("_pk"), "left").drop("_pk")
        level = materialize(level)
        side = old.unionByName(_lookup_side(added.all(), name_key)) if added.n else old
        best = _candidates(level, side, number).select("key", F.col("id").alias("_found"))
        known = materialize(level.join(best, "key", "left"))
        # equal names within one level become one row, made from the first
        fresh = known.filter("_found is null").withColumn("_same", F.concat_ws("\x01", "_k", "rank", F.coalesce("authorship", F.lit("")), F.col("nub_parent").cast("string")))
        heads = fresh.groupBy("_same").agg(F.min_by("key", F.struct("sort_path", "key")).alias("key"))
        made = materialize(next_ids(fresh.join(heads.select("key"), "key", "left_semi"), ["sort_path", "key"], next_id, "_new"))
        next_id += made.count()
        new_rows = added.add(made.select(
            F.col("_new").alias("id"), F.col("nub_parent").alias("parent"), "rank", F.col("scientific_name").alias("name"), F.coalesce("canonical_name", "scientific_name").alias("canonical"), "authorship", "year",
            F.when(F.col("is_synonym"), F.col("status")).when(F.col("nub_parent").isNull() & (F.col("rank") != "KINGDOM"), "DOUBTFUL").otherwise(F.coalesce("status", F.lit("ACCEPTED"))).alias("status"),
            "is_synonym", F.coalesce("kingdom", F.lit("INCERTAE_SEDIS")).alias("kingdom"), F.lit(number).alias("source"), F.col("key").alias("source_key"), F.lit("SOURCE").alias("origin"), F.array().cast("array<string>").alias("issues"),
        ))
        gained.add(known.filter("_found is not null").select(F.col("_found").alias("_id"), "authorship", "year", "scientific_name", "depth", "sort_path"))
        joined = fresh.select("key", "_same").join(made.select("_same", "_new"), "_same").select("key", F.col("_new").alias("nub"))
        ids = joined.unionByName(known.filter("_found is not null").select("key", F.col("_found").alias("nub")))
        # what hangs below a synonym hangs on its accepted row
        at = side.select("id", F.col("b_parent").alias("parent"), F.col("b_syn").alias("is_synonym"), "b_kingdom").unionByName(new_rows.select("id", "parent", "is_synonym", F.col("kingdom").alias("b_kingdom")))
        at = at.select(F.col("id").alias("_id"), F.when(F.col("is_synonym"), F.coalesce("parent", "id")).otherwise(F.col("id")).alias("_acc"), F.col("b_kingdom").alias("_kingdom")).distinct()
        placed.add(ids.join(at, F.col("nub") == F.col("_id")).select("key", F.col("_acc").alias("nub"), F.col("_kingdom").alias("kingdom")))
    if not placed.n:
        return backbone, next_id
    first = F.struct("depth", "sort_path")
    gains = gained.all().groupBy("_id").agg(*[F.min_by(c, F.when(F.col("authorship").isNotNull(), first)).alias(f"_{c}") for c in ("authorship", "year", "scientific_name")])
    merged = backbone.unionByName(added.all().select(*backbone.columns)).join(gains, F.col("id") == F.col("_id"), "left")
    bare = F.col("authorship").isNull() & F.col("_authorship").isNotNull()
    out = merged.withColumns({"name": F.when(bare, F.col("_scientific_name")).otherwise(F.col("name")), "year": F.when(bare, F.col("_year")).otherwise(F.col("year")), "authorship": F.coalesce("authorship", "_authorship")})
    return materialize(out.select(*backbone.columns)), next_id


def implicit_parents(backbone: DataFrame, next_id: int) -> tuple[DataFrame, int]:
    """Accepted species whose parent is above genus get their genus, and infraspecific names their species."""
    for rank, parts, child in (("GENUS", 1, "SPECIES"), ("SPECIES", 2, None)):
        words = F.split("canonical", " ")
        below = (F.col("rank") == child) if child else (ordinal(F.col("rank")) > ORDINAL["SPECIES"]) & (F.col("rank") != "UNRANKED")
        up = backbone.select(F.col("id").alias("_pid"), F.col("rank").alias("_prank"))
        orphan = backbone.filter(below & ~F.col("is_synonym") & (F.size(words) > parts)).join(up, F.col("parent") == F.col("_pid"), "left").filter(F.coalesce(F.col("_prank") != rank, F.lit(True)))
        orphan = orphan.select("id", "parent", "kingdom", F.array_join(F.slice(words, 1, parts), " ").alias("_name"))
        known = backbone.filter((F.col("rank") == rank) & ~F.col("is_synonym")).select(F.col("canonical").alias("_name"), F.col("kingdom").alias("kingdom"), F.col("id").alias("_known")).groupBy("_name", "kingdom").agg(F.min("_known").alias("_known"))
        asked = materialize(orphan.join(known, ["_name", "kingdom"], "left"))
        made = next_ids(asked.filter("_known is null").groupBy("_name", "kingdom").agg(F.min("parent").alias("parent")), ["_name", "kingdom"], next_id, "_new")
        made = materialize(made)
        next_id += made.count()
        rows = made.select(
            F.col("_new").alias("id"), "parent", F.lit(rank).alias("rank"), F.col("_name").alias("name"), F.col("_name").alias("canonical"), F.lit(None).cast("string").alias("authorship"), F.lit(None).cast("string").alias("year"),
            F.lit("DOUBTFUL").alias("status"), F.lit(False).alias("is_synonym"), "kingdom", F.lit(None).cast("int").alias("source"), F.lit(None).cast("long").alias("source_key"), F.lit("IMPLICIT_NAME").alias("origin"), F.array().cast("array<string>").alias("issues"),
        )
        target = asked.join(made.select("_name", "kingdom", "_new"), ["_name", "kingdom"], "left").select(F.col("id").alias("_cid"), F.coalesce("_known", "_new").alias("_to"))
        moved = backbone.join(target, F.col("id") == F.col("_cid"), "left").withColumn("parent", F.coalesce("_to", "parent")).select(*backbone.columns)
        backbone = materialize(moved.unionByName(rows))
    return backbone, next_id


def with_family(backbone: DataFrame) -> DataFrame:
    """Each row's family, by walking up."""
    from .tree import ancestors, first_with_rank

    closure = ancestors(backbone, include_self=True)
    return backbone.join(first_with_rank(closure, backbone, "FAMILY").select("id", F.col("found").alias("family")), "id", "left")


def basionym_groups(backbone: DataFrame) -> DataFrame:
    """(id, basionym): recombinations and the original they come from, within a family.

    Names of one stemmed epithet whose bracket author is the original's author. Groups by family and epithet
    are small, and the comparison is not transitive, so pairs of a recombination and an original are compared.
    """
    parsed = materialize(with_family(backbone).withColumn("p", parse_name(F.col("name"))))
    epithet = F.coalesce("p.infra_specific_epithet", "p.specific_epithet")
    named = parsed.filter(epithet.isNotNull()).select(
        "id", "family", stem_epithet(epithet).alias("stem"), F.col("p.authorship").alias("author"), F.col("p.year").alias("y"), F.col("p.bracket_authorship").alias("bauthor"), F.col("p.bracket_year").alias("by")
    )
    original = named.filter("bauthor is null and author is not null").select("family", "stem", F.col("id").alias("basionym"), F.col("author").alias("o_author"), F.col("y").alias("o_year"))
    pairs = named.filter("bauthor is not null").join(original, ["family", "stem"]).filter(F.col("id") != F.col("basionym"))
    same = pairs.withColumn("_e", compare_col(F.col("bauthor"), F.col("by"), F.col("o_author"), F.col("o_year"))).filter(F.col("_e") == EQUAL)
    # two originals for one recombination: it stays without
    return same.groupBy("id").agg(F.min("basionym").alias("basionym"), F.countDistinct("basionym").alias("n")).filter("n = 1").drop("n")


def consolidate(backbone: DataFrame, groups: DataFrame) -> DataFrame:
    """One accepted row for each homotypic group: the best source's, others become its homotypic synonyms."""
    members = groups.select("id", F.col("basionym").alias("g")).unionByName(groups.select(F.col("basionym").alias("id"), F.col("basionym").alias("g"))).distinct()
    joined = backbone.join(members, "id").filter(~F.col("is_synonym"))
    primary = priority(joined, ["g"], [(F.col("status") == "DOUBTFUL").cast("int"), F.coalesce("source", F.lit(2**31 - 1)), "id"], "_primary")
    heads = primary.filter("_primary").select("g", F.col("id").alias("_acc"))
    losers = materialize(primary.filter("not _primary").select(F.col("id").alias("_lid"), "g").join(heads, "g").groupBy("_lid").agg(F.min("_acc").alias("_acc")))
    out = backbone.join(losers, F.col("id") == F.col("_lid"), "left")
    lost = F.col("_lid").isNotNull()
    out = out.withColumns({"parent": F.coalesce("_acc", "parent"), "is_synonym": F.col("is_synonym") | lost, "status": F.when(lost, "HOMOTYPIC_SYNONYM").otherwise(F.col("status"))}).select(*backbone.columns)
    moves = losers.select(F.col("_lid").alias("_old"), F.col("_acc").alias("_to"))
    return out.join(moves, F.col("parent") == F.col("_old"), "left").withColumn("parent", F.coalesce("_to", "parent")).select(*backbone.columns)


def ex_author_synonyms(backbone: DataFrame, next_id: int) -> tuple[DataFrame, int]:
    """``A. alba Foo ex Bar`` also goes as ``A. alba Foo``: a synonym for each such name that does not exist yet."""
    first = F.regexp_extract("authorship", r"^(.+?) ex ", 1)
    asked = backbone.filter(F.coalesce(first, F.lit("")) != "").select(F.col("id").alias("_acc"), F.col("parent").alias("_p"), F.col("is_synonym").alias("_s"), "canonical", "rank", "kingdom", first.alias("authorship"))
    asked = asked.withColumn("name", F.concat_ws(" ", "canonical", "authorship")).join(backbone.select("name"), "name", "left_anti")
    made = materialize(next_ids(asked, ["name", "_acc"], next_id, "id"))
    rows = made.select(
        "id", F.when(F.col("_s"), F.col("_p")).otherwise(F.col("_acc")).alias("parent"), "rank", "name", "canonical", "authorship", F.lit(None).cast("string").alias("year"), F.lit("SYNONYM").alias("status"), F.lit(True).alias("is_synonym"),
        "kingdom", F.lit(None).cast("int").alias("source"), F.lit(None).cast("long").alias("source_key"), F.lit("EX_AUTHOR_SYNONYM").alias("origin"), F.array().cast("array<string>").alias("issues"),
    )
    return backbone.unionByName(rows), next_id + made.count()


def autonyms(backbone: DataFrame, next_id: int) -> tuple[DataFrame, int]:
    """A species with accepted infraspecific rows has the autonym of their rank; lone autonyms go."""
    infra = backbone.filter((ordinal(F.col("rank")) > ORDINAL["SPECIES"]) & (F.col("rank") != "UNRANKED") & ~F.col("is_synonym"))
    words = F.split("canonical", " ")
    is_auto = (F.size(words) == 3) & (F.element_at(words, 2) == F.try_element_at(words, F.lit(3)))
    flagged = infra.withColumn("_auto", is_auto)
    sizes = flagged.groupBy("parent", "rank").agg(F.sum((~F.col("_auto")).cast("int")).alias("others"), F.sum(F.col("_auto").cast("int")).alias("autos"))
    lone = flagged.filter("_auto").join(sizes.filter("others = 0"), ["parent", "rank"], "left_semi").select("id")
    kept = backbone.join(lone, "id", "left_anti").select(*backbone.columns)
    species = backbone.filter((F.col("rank") == "SPECIES") & (F.size(words) == 2)).select(F.col("id").alias("parent"), F.concat_ws(" ", "canonical", F.element_at(words, 2)).alias("canonical"), "kingdom")
    asked = sizes.filter("others > 0 and autos = 0").join(species, "parent").select("parent", "rank", "canonical", "kingdom")
    made = materialize(next_ids(asked, ["canonical", "rank", "parent"], next_id, "id"))
    rows = made.select(
        "id", "parent", "rank", F.col("canonical").alias("name"), "canonical", F.lit(None).cast("string").alias("authorship"), F.lit(None).cast("string").alias("year"), F.lit("ACCEPTED").alias("status"), F.lit(False).alias("is_synonym"), "kingdom",
        F.lit(None).cast("int").alias("source"), F.lit(None).cast("long").alias("source_key"), F.lit("AUTONYM").alias("origin"), F.array().cast("array<string>").alias("issues"),
    )
    return kept.unionByName(rows), next_id + made.count()


def _common_start(a, b) -> Column:
    """Length of the start that two strings share."""
    a, b = F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))
    places = F.filter(F.sequence(F.lit(0), F.least(F.length(a), F.length(b))), lambda i: F.substring(a, F.lit(1), i) == F.substring(b, F.lit(1), i))
    return F.array_max(places)


def flagged(backbone: DataFrame) -> DataFrame:
    """Issues: names that contradict their parent, empty genera, accepted duplicates, similar names, names older
    than their genus. Duplicates after the best one become doubtful, and so do names that contradict their parent.

    Of duplicates the better source's is best; of one source's the one whose name begins most like its parent's.
    """
    up = backbone.select(F.col("id").alias("_pid"), F.col("canonical").alias("_pname"), F.col("rank").alias("_prank"), F.col("year").alias("_pyear"))
    species_below = backbone.filter((ordinal(F.col("rank")) >= ORDINAL["SPECIES"]) & ~F.col("is_synonym")).groupBy(F.col("parent").alias("_gid")).agg(F.count(F.lit(1)).alias("_n"))
    out = backbone.join(up, F.col("parent") == F.col("_pid"), "left").join(species_below, F.col("id") == F.col("_gid"), "left")
    live = ~F.col("is_synonym")
    out = out.withColumn("_key", match_key(F.col("canonical")))
    # groups may be large, so their best row is found by an aggregate and joined
    fit = F.struct((F.col("status") == "DOUBTFUL").cast("int").alias("a"), F.coalesce("source", F.lit(2**31 - 1)).alias("b"), (-_common_start("canonical", "_pname")).alias("c"), "id")
    heads = out.filter(live & F.col("rank").isNotNull()).groupBy(F.col("rank").alias("_hrank"), F.col("canonical").alias("_hname")).agg(F.min_by("id", fit).alias("_head"))
    likes = out.filter("rank is not null and kingdom is not null").groupBy(F.col("_key").alias("_lkey"), F.col("rank").alias("_lrank"), F.col("kingdom").alias("_lkingdom"), F.col("is_synonym").alias("_lsyn")).agg(F.min_by("canonical", "id").alias("_first"))
    out = out.join(heads, (F.col("rank") == F.col("_hrank")) & (F.col("canonical") == F.col("_hname")), "left")
    out = out.join(likes, (F.col("_key") == F.col("_lkey")) & (F.col("rank") == F.col("_lrank")) & (F.col("kingdom") == F.col("_lkingdom")) & (F.col("is_synonym") == F.col("_lsyn")), "left")
    out = out.withColumn("_dup", live & F.coalesce(F.col("_head") != F.col("id"), F.lit(False)))
    starts = F.col("canonical").startswith(F.concat(F.col("_pname"), F.lit(" ")))
    mismatch = F.coalesce(live & F.col("_prank").isin("GENUS", "SPECIES") & (ordinal(F.col("rank")) >= ORDINAL["SPECIES"]) & ~starts, F.lit(False))
    years = lambda c: F.regexp_extract(c, "[0-9]{4}", 0)
    issues = F.array_compact(
        F.array(
            F.when(mismatch, F.lit("NAME_PARENT_MISMATCH")),
            F.when(live & (F.col("rank") == "GENUS") & F.col("_n").isNull(), F.lit("NO_SPECIES")),
            F.when(F.col("_dup"), F.lit("DUPLICATE_ACCEPTED")),
            F.when(live & (F.col("_first") != F.col("canonical")), F.lit("SIMILAR_NAME")),
            F.when((F.col("_prank") == "GENUS") & (years(F.col("year")) != "") & (years(F.col("_pyear")) != "") & (years(F.col("year")) < years(F.col("_pyear"))), F.lit("PUBLISHED_BEFORE_GENUS")),
        )
    )
    return out.withColumns({"issues": F.array_union("issues", issues), "status": F.when(F.col("_dup") | mismatch, "DOUBTFUL").otherwise(F.col("status"))}).select(*backbone.columns)


def without_empty_implicit(backbone: DataFrame) -> DataFrame:
    """Genera that were only made for their species go once nothing hangs on them."""
    used = backbone.filter("parent is not null").select(F.col("parent").alias("id"))
    made = (F.col("origin") == "IMPLICIT_NAME") & (F.col("rank") == "GENUS")
    return backbone.filter(~made).unionByName(backbone.filter(made).join(used, "id", "left_semi").select(*backbone.columns))


def doubt_subtrees(backbone: DataFrame, heads: DataFrame, issue: str = "HOMONYM") -> DataFrame:
    """Rows that are excluded homonyms, (name, kingdom) in ``heads``, and all accepted rows below them become doubtful."""
    from .tree import descendants

    top = backbone.join(heads.select(F.col("name").alias("canonical"), "kingdom"), ["canonical", "kingdom"], "left_semi").select("id")
    below = descendants(backbone, top, include_self=True).select(F.col("id").alias("_did")).distinct()
    out = backbone.join(below, F.col("id") == F.col("_did"), "left")
    hit = F.col("_did").isNotNull() & ~F.col("is_synonym")
    return out.withColumns({"status": F.when(hit, "DOUBTFUL").otherwise(F.col("status")), "issues": F.when(hit, F.array_union("issues", F.array(F.lit(issue)))).otherwise(F.col("issues"))}).select(*backbone.columns)


def stable_ids(backbone: DataFrame, previous: DataFrame, start: int, name_key: Callable[[Column], Column] = match_key) -> DataFrame:
    """(id, stable, reissued): ids of the previous backbone for names that it had, new ones for others. ``name_key`` is
    the one of the build.

    A previous id is given once: to an exact name first, then to accepted rows, then to the lowest id.
    """
    old = previous.select(name_key(F.col("canonical")).alias("_k"), F.col("rank").alias("_rank"), F.col("kingdom").alias("_kingdom"), F.col("name").alias("_oname"), F.col("id").alias("old"))
    pairs = backbone.withColumn("_k", name_key(F.col("canonical"))).join(old, "_k").filter(rank_match(F.col("rank"), F.col("_rank")) & kingdom_match(F.col("kingdom"), F.col("_kingdom")))
    order = [(F.col("name") != F.col("_oname")).cast("int"), F.col("is_synonym").cast("int"), "id", "old"]
    mine = Window.partitionBy("id").orderBy(*order)
    his = Window.partitionBy("old").orderBy(*order)
    given = pairs.withColumn("_r", F.row_number().over(mine)).filter("_r = 1").withColumn("_q", F.row_number().over(his)).filter("_q = 1").select("id", F.col("old").alias("stable"), F.lit(True).alias("reissued"))
    given = materialize(given)
    rest = next_ids(backbone.join(given, "id", "left_anti").select("id"), ["id"], start, "stable").withColumn("reissued", F.lit(False))
    return given.unionByName(rest.select("id", "stable", "reissued"))


def check_assertions(backbone: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected rows (key, name prefix, rank, kingdom) that the backbone does not bear out; null values are not
    compared, and key -1 or null means any row."""
    e = expected.withColumnsRenamed({c: f"e_{c}" for c in expected.columns})
    first = F.substring_index("e_name", " ", 1)
    b = backbone.select("id", "name", "rank", "kingdom", F.substring_index("name", " ", 1).alias("_w"))
    hit = e.join(b, first == F.col("_w"), "left").withColumn(
        "_ok",
        F.coalesce(
            F.col("name").startswith(F.col("e_name")) & F.coalesce(F.col("rank") == F.col("e_rank"), F.col("e_rank").isNull()) & F.coalesce(F.col("kingdom") == F.col("e_kingdom"), F.col("e_kingdom").isNull())
            & ((F.coalesce("e_key", F.lit(-1)) == -1) | (F.col("id") == F.col("e_key"))),
            F.lit(False),
        ),
    )
    return hit.groupBy(*e.columns).agg(F.max("_ok").alias("ok")).filter("not ok").select(*[F.col(f"e_{c}").alias(c) for c in expected.columns])


def build(spark: SparkSession, sources: Sequence[DataFrame], homonyms: DataFrame | None = None, name_key: Callable[[Column], Column] = match_key, **rules) -> DataFrame:
    """The whole build over sources of eight columns, best first. ``homonyms`` (name, kingdom) are excluded ones, whose
    subtrees become doubtful. ``name_key`` is as in ``add_source``."""
    backbone, next_id = materialize(seed(spark)), len(KINGDOMS)
    for i, rows in enumerate(sources, 1):
        parsed = materialize(parsed_source(rows))
        backbone, next_id = add_source(backbone, materialize(usable(parsed, **rules)), i, next_id, name_key)
    backbone, next_id = implicit_parents(backbone, next_id)
    backbone = materialize(consolidate(backbone, materialize(basionym_groups(backbone))))
    backbone, next_id = ex_author_synonyms(backbone, next_id)
    backbone, next_id = autonyms(backbone, next_id)
    backbone = materialize(flagged(without_empty_implicit(backbone)))
    return backbone if homonyms is None else materialize(doubt_subtrees(backbone, homonyms))
