"""Checklist normalization: archive rows become usages with resolved relations and issues."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.cleaning import clean, first_parsable, media_type, mime_type, page_as_reference, split_values
from ..functions.names import parse_name
from ..functions.ranks import ORDINAL
from ..sources.tables import materialize
from .tree import flatten_synonyms, from_ranks, metrics, parents_to_accepted

STATUS = {k: k for k in ("ACCEPTED", "DOUBTFUL", "SYNONYM", "MISAPPLIED")} | {"VALID": "ACCEPTED", "HOMOTYPICSYNONYM": "HOMOTYPIC_SYNONYM", "HETEROTYPICSYNONYM": "HETEROTYPIC_SYNONYM", "PROPARTESYNONYM": "PROPARTE_SYNONYM", "INVALID": "SYNONYM"}
RANK = {r.replace("_", ""): r for r in ORDINAL} | {"SP": "SPECIES", "SSP": "SUBSPECIES", "SUBSP": "SUBSPECIES", "VAR": "VARIETY", "GEN": "GENUS", "FAM": "FAMILY", "ORD": "ORDER", "REGNUM": "KINGDOM", "F": "FORM", "FORMA": "FORM"}
CLASSIFICATION = ("kingdom", "phylum", "class", "order", "family", "genus", "subgenus")


def _get(df: DataFrame, name: str) -> Column:
    return clean(F.col(f"`{name}`")) if name in df.columns else F.lit(None).cast("string")


def usages(core: DataFrame) -> DataFrame:
    """Rank, status and name of each row, and issues where a value does not parse."""
    rank, bad_rank = first_parsable(RANK, _get(core, "taxonRank"), _get(core, "verbatimTaxonRank"))
    status, bad_status = first_parsable(STATUS, _get(core, "taxonomicStatus"))
    author, name = _get(core, "scientificNameAuthorship"), _get(core, "scientificName")
    full = F.when(author.isNotNull() & (F.position(author, name) == 0), F.concat_ws(" ", name, author)).otherwise(name)
    atoms = F.concat_ws(" ", _get(core, "genus"), _get(core, "specificEpithet"), _get(core, "infraspecificEpithet"))
    full = F.coalesce(full, F.nullif(F.concat_ws(" ", F.nullif(atoms, F.lit("")), author), F.lit("")))
    base = core.select(
        _get(core, "taxonID").alias("id"), full.alias("scientific_name"), rank.alias("rank"), status.alias("status"), _get(core, "parentNameUsageID").alias("parent_id"), _get(core, "parentNameUsage").alias("parent_name"),
        _get(core, "acceptedNameUsageID").alias("accepted_ids"), _get(core, "acceptedNameUsage").alias("accepted_name"), _get(core, "originalNameUsageID").alias("original_id"), _get(core, "originalNameUsage").alias("original_name"),
        *[_get(core, c).alias(c) for c in CLASSIFICATION],
        F.array_compact(F.array(F.when(bad_rank, F.lit("RANK_INVALID")), F.when(bad_status, F.lit("TAXONOMIC_STATUS_INVALID")), F.when(full.isNull(), F.lit("SCIENTIFIC_NAME_MISSING")))).alias("issues"),
    )
    parsed = base.withColumn("p", parse_name(F.col("scientific_name")))
    unparsed = F.when(~F.col("p.parsed") & F.col("p.type").isin("UNPARSED", "NO_NAME"), F.array(F.lit("UNPARSABLE"))).otherwise(F.array().cast("array<string>"))
    return parsed.select(*base.columns, F.col("p.canonical_name").alias("canonical_name"), F.col("p.type").alias("name_type"), unparsed.alias("_u")).withColumn("issues", F.array_union("issues", "_u")).drop("_u")


#: Relations to other rows: the columns, the issues of an unknown id and of a name that several rows have, the origin of
#: rows made for unknown names, and whether a name that several rows have makes one as well.
RELATIONS = {
    "accepted": ("accepted_id", "accepted_name", "ACCEPTED_NAME_USAGE_ID_INVALID", "ACCEPTED_NAME_NOT_UNIQUE", "VERBATIM_ACCEPTED", True),
    "parent": ("parent_id", "parent_name", "PARENT_NAME_USAGE_ID_INVALID", "PARENT_NAME_NOT_UNIQUE", "VERBATIM_PARENT", True),
    "basionym": ("original_id", "original_name", "ORIGINAL_NAME_USAGE_ID_INVALID", "ORIGINAL_NAME_NOT_UNIQUE", "VERBATIM_BASIONYM", False),
}
PLACEHOLDER = "incertae sedis"
SYNONYMS = ("SYNONYM", "HOMOTYPIC_SYNONYM", "HETEROTYPIC_SYNONYM", "PROPARTE_SYNONYM", "MISAPPLIED")


def resolve(df: DataFrame, relation: str) -> DataFrame:
    """One relation: by the id where one is given, else by full name, else by canonical name. A row never refers to itself.

    Adds the relation's column, issues, and ``<relation>_made``: the name of a row that has to be made because no row,
    or more than one, has the given name.
    """
    ids, name, bad_id, unclear_name, _, make_unclear = RELATIONS[relation]
    known = df.select(F.col("id").alias("_kid"))
    by_id = F.when(F.col(ids) != F.col("id"), F.col("_kid"))
    lost = F.col(ids).isNotNull() & ~F.col(ids).eqNullSafe(F.col("id")) & F.col("_kid").isNull()
    result = df.join(known, F.col(ids) == F.col("_kid"), "left")
    for i, column in enumerate(("scientific_name", "canonical_name")):
        counted = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias(f"_n{i}")).agg(F.min("id").alias(f"_m{i}"), F.count(F.lit(1)).alias(f"_c{i}"))
        result = result.join(counted, F.col(name) == F.col(f"_n{i}"), "left").fillna(0, [f"_c{i}"])
    named = F.col(ids).isNull() & F.col(name).isNotNull() & ~F.col(name).eqNullSafe(F.col("scientific_name"))
    second = named & (F.col("_c0") == 0) & ~F.col(name).eqNullSafe(F.col("canonical_name"))
    unclear = named & ((F.col("_c0") > 1) | (second & (F.col("_c1") > 1)))
    by_name = F.when(named & (F.col("_c0") == 1), F.col("_m0")).when(second & (F.col("_c1") == 1), F.col("_m1"))
    none = (second if relation == "accepted" else named) & (F.col("_c0") == 0) & (~second | (F.col("_c1") == 0))
    made = F.when(none | (unclear if make_unclear else F.lit(False)), F.col(name))
    target = F.coalesce(by_id, by_name)
    flags = F.array_compact(F.array(F.when(lost, F.lit(bad_id)), F.when(unclear, F.lit(unclear_name))))
    return result.select(*df.columns, F.when(target != F.col("id"), target).alias(relation), made.alias(f"{relation}_made"), F.array_union("issues", flags).alias("_i")).drop("issues").withColumnRenamed("_i", "issues")


def _made_id(name: Column) -> Column:
    return F.when(name.isNotNull(), F.concat(F.lit("verbatim:"), F.xxhash64(name).cast("string")))


def placeholders(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with all links set, and the doubtful rows made for them.

    Unknown names are made once each. An unknown accepted id is made once, under that id, with the accepted name given,
    the rank and the classification of its first synonym. A synonym of which nothing is known gets an accepted
    row of its own rank and classification.
    """
    doubtful, none = F.lit("DOUBTFUL").alias("status"), F.lit(None).cast("string")
    lost_id = F.array_contains("issues", "ACCEPTED_NAME_USAGE_ID_INVALID") & F.col("accepted").isNull() & (F.col("accepted_id") != F.col("id"))
    orphan = F.col("status").isin(*SYNONYMS) & F.col("accepted").isNull() & F.col("accepted_made").isNull() & ~F.coalesce(lost_id, F.lit(False))
    own = F.concat(F.lit("missing:"), F.col("id"))
    flagged = df.withColumns({"_lost": F.coalesce(lost_id, F.lit(False)), "_orphan": F.coalesce(orphan, F.lit(False))})
    first = F.min_by(F.struct(F.coalesce("accepted_name", F.lit(PLACEHOLDER)).alias("scientific_name"), "rank", *CLASSIFICATION), "id").alias("m")
    lost = flagged.filter("_lost").groupBy(F.col("accepted_id").alias("id")).agg(first).select("id", "m.*", doubtful, F.lit("MISSING_ACCEPTED").alias("origin"))
    alone = flagged.filter("_orphan").select(own.alias("id"), F.lit(PLACEHOLDER).alias("scientific_name"), "rank", *CLASSIFICATION, doubtful, F.lit("MISSING_ACCEPTED").alias("origin"))
    named = None
    for place, (relation, (*_, origin, _)) in enumerate(RELATIONS.items()):
        higher = [F.col(c) if relation == "accepted" else none.alias(c) for c in CLASSIFICATION]
        part = flagged.filter(F.col(f"{relation}_made").isNotNull()).select(F.col(f"{relation}_made").alias("scientific_name"), "id", F.lit(place).alias("place"), F.lit(origin).alias("origin"), *higher)
        named = part if named is None else named.unionByName(part)
    named = named.groupBy("scientific_name").agg(F.min_by(F.struct("origin", *CLASSIFICATION), F.struct("place", "id")).alias("m")).select(_made_id(F.col("scientific_name")).alias("id"), "scientific_name", none.alias("rank"), "m.*", doubtful)
    made = lost.unionByName(alone).unionByName(named)
    links = {r: F.coalesce(F.col(r), _made_id(F.col(f"{r}_made"))) for r in ("parent", "basionym")}
    links["accepted"] = F.coalesce(F.col("accepted"), F.when(F.col("_lost"), F.col("accepted_id")), _made_id(F.col("accepted_made")), F.when(F.col("_orphan"), own))
    links["issues"] = F.when(F.col("_orphan"), F.array_union("issues", F.array(F.lit("ACCEPTED_NAME_MISSING")))).otherwise(F.col("issues"))
    out = flagged.withColumns({r: F.when(F.col(f"{r}_made").isNotNull() | (F.lit(r == "accepted")), c).otherwise(F.col(r)) if r in RELATIONS else c for r, c in links.items()})
    return out.drop("_lost", "_orphan"), made


def pro_parte(df: DataFrame, ids: str = "accepted_ids") -> DataFrame:
    """(synonym, accepted) for the second and further accepted ids of a row."""
    values = split_values(F.col(ids))
    return df.filter(F.col(ids).isNotNull() & ~F.col(ids).isin("")).select(F.col("id").alias("synonym"), F.posexplode(values).alias("place", "accepted")).filter("place > 0").drop("place")


def normalize(core: DataFrame) -> dict[str, DataFrame]:
    """A whole checklist: usages with parents, accepted and original rows; pro-parte links; metrics.

    Steps: parse values; resolve relations, making doubtful rows for what is named or needed but not there; build missing
    higher taxa from classification columns; cut synonym cycles and flatten chains; move children of synonyms.
    """
    u = materialize(usages(core))
    links = pro_parte(u)
    known = u.select(F.col("id").alias("accepted"))
    unknown = links.join(known, "accepted", "left_anti").select(F.col("synonym").alias("id")).distinct().withColumn("_bad", F.lit(True))
    links = materialize(links.join(known, "accepted", "left_semi").select("synonym", "accepted"))
    u = u.withColumn("accepted_id", F.element_at(F.concat(split_values(F.col("accepted_ids")), F.array(F.lit(None).cast("string"))), 1))
    for relation in RELATIONS:
        u = materialize(resolve(u, relation))
    u = u.join(unknown, "id", "left").withColumn("issues", F.when(F.col("_bad"), F.array_union("issues", F.array(F.lit("ACCEPTED_NAME_USAGE_ID_INVALID")))).otherwise(F.col("issues"))).drop("_bad")
    u, made = placeholders(u)
    u = materialize(u.unionByName(made, allowMissingColumns=True))
    nodes, leaves = from_ranks(u.filter("parent is null and accepted is null"), [c for c in CLASSIFICATION if c != "subgenus"], "id")
    text = lambda c: F.concat(F.lit("class:"), F.col(c).cast("string"))
    higher = nodes.select(text("id").alias("id"), F.when(F.col("parent").isNotNull(), text("parent")).alias("parent"), "rank", F.col("name").alias("scientific_name"), F.col("name").alias("canonical_name"), F.lit("ACCEPTED").alias("status"), F.lit("DENORMED_CLASSIFICATION").alias("origin"))
    placed = leaves.filter("parent is not null").select(F.col("id").alias("_lid"), text("parent").alias("_lp"))
    u = u.join(placed, F.col("id") == F.col("_lid"), "left").withColumn("parent", F.coalesce("parent", "_lp")).drop("_lid", "_lp")
    u = u.unionByName(higher, allowMissingColumns=True).withColumn("origin", F.coalesce("origin", F.lit("SOURCE"))).withColumn("issues", F.coalesce("issues", F.array().cast("array<string>")))
    u = materialize(flatten_synonyms(materialize(u)))
    at_cut = F.concat(F.lit("cycle:"), F.col("cut"))
    flags = F.array_compact(F.array(F.when(F.col("was_chained"), F.lit("CHAINED_SYNOYM")), F.when(F.col("id") == F.col("cut"), F.lit("PARENT_CYCLE"))))
    cuts = u.filter("id = cut").select(at_cut.alias("id"), F.lit(PLACEHOLDER).alias("scientific_name"), F.lit("DOUBTFUL").alias("status"), F.lit("MISSING_ACCEPTED").alias("origin"), F.array().cast("array<string>").alias("issues"))
    u = u.withColumns({"issues": F.array_union("issues", flags), "accepted": F.coalesce("accepted", at_cut)}).drop("was_chained", "cut").unionByName(cuts, allowMissingColumns=True)
    u = parents_to_accepted(u)
    synonym = F.col("accepted").isNotNull()
    u = u.withColumn("is_synonym", synonym).withColumn("status", F.when(synonym & ~F.coalesce(F.col("status").isin(*SYNONYMS), F.lit(False)), F.lit("SYNONYM")).otherwise(F.coalesce("status", F.lit("ACCEPTED"))))
    u = u.withColumn("parent", F.when(F.col("is_synonym"), F.col("accepted")).otherwise(F.col("parent")))
    u = materialize(u)
    return {"usages": u, "pro_parte": links, "metrics": metrics(u.withColumn("rank", F.coalesce("rank", F.lit("UNRANKED"))), synonym="is_synonym")}


#: Columns of each extension, and how a field is parsed.
EXTENSIONS: dict[str, Sequence[str]] = {
    "vernacular": ("vernacularName", "language", "countryCode", "isPreferredName", "sex", "lifeStage"), "types": ("scientificName", "typeStatus", "typeDesignatedBy", "taxonRank"),
    "profile": ("isMarine", "isTerrestrial", "isExtinct", "habitat", "livingPeriod", "ageInDays"), "references": ("bibliographicCitation", "creator", "title", "date", "source"),
    "media": ("identifier", "references", "type", "format", "title", "license"), "identifiers": ("identifier", "title", "format"), "distribution": ("locality", "country", "occurrenceStatus", "threatStatus", "establishmentMeans"),
    "description": ("description", "type", "language", "license"),
}


def extension(rows: DataFrame, kind: str, id_col: str = "id", rename: Mapping[str, str] | None = None, order: str | None = None) -> DataFrame:
    """One extension's rows, cleaned: empty records are dropped, booleans, types and media are interpreted.

    Of a row's media with one address the first stays, by ``order`` if given and then by the other fields.
    """
    fields = {c: _get(rows, c) for c in EXTENSIONS[kind]}
    place = F.col(order) if order else F.lit(0)
    out = rows.select(F.col(id_col).alias("usage_id"), *[v.alias(c) for c, v in fields.items()], place.alias("_place"))
    for c in ("isMarine", "isTerrestrial", "isExtinct", "isPreferredName"):
        if c in fields:
            out = out.withColumn(c, F.when(F.lower(c).isin("true", "t", "yes", "y", "1"), True).when(F.lower(c).isin("false", "f", "no", "n", "0"), False))
    if kind == "media":
        mime = mime_type(F.coalesce("identifier", F.lit("")), F.col("format"))
        identifier, reference = page_as_reference(mime, F.col("identifier"), F.col("references"))
        out = out.withColumns({"format": mime, "type": F.coalesce(media_type(mime), F.col("type")), "identifier": identifier, "references": reference})
        first = F.coalesce("identifier", "references")
        out = out.filter(first.isNotNull()).groupBy("usage_id", first.alias("_url")).agg(F.min(F.struct("_place", *fields)).alias("m")).select("usage_id", "m.*")
    if kind == "references":
        from ..functions.cleaning import citation

        out = out.withColumn("bibliographicCitation", F.coalesce("bibliographicCitation", citation(F.col("creator"), F.col("title"), F.col("date"), F.col("source"))))
    filled = F.coalesce(*[F.col(c).cast("string") for c in fields if c in out.columns])
    return out.drop("_place").filter(filled.isNotNull()).withColumnsRenamed(dict(rename or {}))
