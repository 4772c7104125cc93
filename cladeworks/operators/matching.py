"""Name matching: exact look-up, fuzzy candidates, scoring, disambiguation, and summaries.

All operators take a batch of queries and a backbone as DataFrames, and join on blocking keys; no
operator compares every query with every name.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.authors import compare, compare_col
from ..functions.names import match_key
from ..functions.ranks import LINNEAN, kingdom_match, kingdom_score, lookup, ordinal, rank_match, rank_score
from ..functions.similarity import block_edits, classification_similarity, name_similarity_col, normalize_confidence, pair_udf
from ..sources.tables import materialize

HIGHER = [r.lower() for r in LINNEAN[:-1]]
STATUS_SCORE = {"ACCEPTED": 1, "SYNONYM": 0, "DOUBTFUL": -5}
MIN_CONFIDENCE, MIN_HIGHER_CONFIDENCE = 80, 90
#: Candidates that go on to the scoring of one query.
MAX_CANDIDATES = 50
_STRICT_TYPES = ("OTU", "VIRUS", "HYBRID")


def allowed_edits(name: Column) -> Column:
    """Two edits for names of more than ten letters, else one; none for less than two letters."""
    return F.when(F.length(name) < 2, -1).when(F.length(name) > 10, 2).otherwise(1)


def _keys(text: Column, edits: Column, probe: bool) -> Column:
    """Blocking keys for a number of edits. An edit, a swap of neighbours included, spoils two of 2k + 1 segments at
    most, so two names within k edits share one of them, moved by k places at most."""
    parts = 2 * edits + 1

    def entry(j: Column) -> Column:
        # j counts segments, and for probes also differences in length and shifts, all from -k to k
        i = F.pmod(j, parts)
        shift = F.pmod(F.floor(j / parts), parts).cast("int") - edits if probe else F.lit(0)
        length = F.length(text) + (F.floor(j / (parts * parts)).cast("int") - edits if probe else F.lit(0))
        start = F.floor(i * length / parts).cast("int")
        size = F.floor((i + 1) * length / parts).cast("int") - start
        at = start + shift + 1
        fits = (length > 0) & (at >= 1) & (at + size - 1 <= F.length(text))
        return F.when(fits, F.concat_ws("\x01", F.substring(text, 1, 1), edits.cast("string"), length.cast("string"), i.cast("string"), F.substring(text, at, size)))

    return F.array_distinct(F.array_compact(F.transform(F.sequence(F.lit(0), (parts * parts * parts if probe else parts) - 1), entry)))


def fuzzy_pairs(queries: DataFrame, names: DataFrame, query_key: str, name_key: str) -> DataFrame:
    """(query_key, name_key, edits) of distinct keys with the same first letter within the allowed edits.

    Both sides are reduced to distinct keys before blocking; hot segments are split by the adaptive join. The JVM's
    plain distance settles most pairs; only those between one and two times the allowed edits may hide swaps.
    """
    q = queries.select(F.col(query_key).alias("q")).filter("q is not null").distinct().withColumn("k", allowed_edits(F.col("q"))).filter("k > 0")
    n = names.select(F.col(name_key).alias("n")).filter("n is not null and length(n) > 0").distinct().withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    left = q.select("q", "k", F.explode(_keys(F.col("q"), F.col("k"), True)).alias("key"))
    right = n.select("n", F.explode(_keys(F.col("n"), F.col("k"), False)).alias("key"))
    letters = lambda c: F.array_join(F.array_sort(F.split(c, "")), "")
    near = left.join(right, "key").withColumn("plain", F.levenshtein("q", "n")).filter(F.col("plain") <= 2 * F.col("k")).select("q", "k", "n", "plain").distinct()
    # a swap keeps the letters: e plain edits within k hide e - k swaps at least, so other edits are 2 k - e at most, and
    # each of them changes two letters of the sorted ones at most
    near = near.filter((F.col("plain") <= F.col("k")) | (F.levenshtein(letters("q"), letters("n")) <= 2 * (2 * F.col("k") - F.col("plain"))))
    near = materialize(near.withColumn("sure", (F.col("plain") <= 1) | ((F.col("plain") <= F.col("k")) & (letters("q") != letters("n")))))
    swapped = pair_udf(lambda x, y: block_edits(x, y, 1), "int")(F.col("q"), F.col("n"))
    sure = near.filter("sure").select("q", "n", F.col("plain").alias("edits"))
    maybe = near.filter("not sure").select("q", "n", "k", swapped.alias("edits")).filter("edits <= k").select("q", "n", "edits")
    return sure.unionByName(maybe).select(F.col("q").alias(query_key), F.col("n").alias(name_key), "edits")


def candidates(queries: DataFrame, backbone: DataFrame, fuzzy: bool = True, limit: int = MAX_CANDIDATES) -> DataFrame:
    """Queries with backbone rows of equal (or near) keys, at most ``limit`` each: nearest first, then least key.

    ``queries`` has qid and canonical; ``backbone`` key and canonical.
    """
    q = queries.withColumn("qkey", match_key(F.col("canonical")))
    b = backbone.withColumn("bkey", match_key(F.col("canonical")))
    side = b.select("bkey", F.struct(*backbone.columns).alias("usage"))
    if fuzzy:
        pairs = fuzzy_pairs(q, b, "qkey", "bkey")
        same = q.select("qkey").filter("length(qkey) > 0").distinct().select("qkey", F.col("qkey").alias("bkey"), F.lit(0).alias("edits"))
        pairs = pairs.filter("edits > 0").unionByName(same)
    else:
        pairs = q.select("qkey").filter("length(qkey) > 0").distinct().select("qkey", F.col("qkey").alias("bkey"), F.lit(0).alias("edits"))
    joined = q.join(pairs, "qkey").join(side, "bkey")
    if "rank" in queries.columns and "rank" in backbone.columns:
        # an aggregate that is spelled like taxa of other ranks leaves these, and all merely similar names, to higher matches
        other = (F.col("rank") == "SPECIES_AGGREGATE") & (F.col("edits") == 0) & ~F.col("usage.rank").eqNullSafe("SPECIES_AGGREGATE")
        joined = joined.withColumn("_other", F.coalesce(other, F.lit(False)))
        joined = joined.withColumn("_any", F.max("_other").over(Window.partitionBy("qid"))).filter(~F.col("_other") & ~(F.col("_any") & (F.col("edits") > 0))).drop("_other", "_any")
    place = F.row_number().over(Window.partitionBy("qid").orderBy("edits", "usage.key"))
    return joined.withColumn("_place", place).filter(F.col("_place") <= limit).drop("_place", "qkey", "bkey")


def _name_score(name: Column, kind: Column, ref: Column, similarity: Column) -> Column:
    straight = 100 + F.when(kind.isin(*_STRICT_TYPES), 20).when(F.locate(" ", name) > 0, 10).otherwise(0)
    genus = F.substring_index(ref, " ", 1)
    binomial = F.when(F.locate(" ", ref) > 1, F.when(name.startswith(genus), 5).otherwise(-10)).otherwise(0)
    fuzzy = F.floor(similarity).cast("int") - 5 - F.when(kind == "OTU", 50).otherwise(0) + binomial
    return F.when(F.lower(name) == F.lower(ref), straight).otherwise(fuzzy)


_AUTHORS = ("authorship", "year", "bracket_authorship", "bracket_year")


def _compared(*atoms: Column) -> Column:
    """Equality of recombination authors, of original authors, and across where one side has no original author."""

    def one(x: tuple) -> tuple[str, str, str]:
        a, ya, ba, bya, c, yc, bc, byc = x
        crossed = compare(ba, bya, c, yc) if ba is not None else compare(a, ya, bc, byc) if bc is not None else "UNKNOWN"
        return compare(a, ya, c, yc), compare(ba, bya, bc, byc), crossed

    @F.pandas_udf("recomb string, bracket string, crossed string")
    def run(packed: pd.DataFrame) -> pd.DataFrame:
        known: dict[tuple, tuple[str, str, str]] = {}
        rows = [tuple(None if pd.isna(v) else v for v in x) for x in packed.itertuples(index=False)]
        return pd.DataFrame([known[x] if x in known else known.setdefault(x, one(x)) for x in rows], columns=["recomb", "bracket", "crossed"])

    return run(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(atoms)]))


def _author_score(e: Column) -> Column:
    points = lambda x, k: F.when(x == "EQUAL", 2 * k).when(x == "DIFFERENT", -3 * k).otherwise(0)
    bracket, crossed = e["bracket"], e["crossed"]
    final = F.when(bracket == "UNKNOWN", crossed).otherwise(bracket)
    shift = F.when(bracket == "UNKNOWN", F.when(crossed == "EQUAL", -1).when(crossed == "DIFFERENT", 1).otherwise(0)).otherwise(0)
    return points(e["recomb"], 3) + points(final, 1) + shift


def _worse(score: Column, factor: int) -> Column:
    return F.when(score < 0, score * factor).otherwise(score)


def score(cands: DataFrame, mode: str = "FUZZY") -> DataFrame:
    """Add the parts of the score and their sum ``raw``.

    Query columns: canonical, type, rank, the authorship atoms and the higher names; backbone rows in
    ``usage`` have the same and status. A missing column counts as null.
    """
    usage = [f.name for f in cands.schema["usage"].dataType.fields]
    wanted = ["type", "rank", *_AUTHORS, *HIGHER]
    authored = mode != "HIGHER" and any(c in cands.columns for c in _AUTHORS) and any(c in usage for c in _AUTHORS)
    df = cands.withColumns({c: F.lit(None).cast("string") for c in wanted if c not in cands.columns})
    df = df.withColumns({f"u_{c}": F.col(f"usage.{c}") if c in usage else F.lit(None).cast("string") for c in ["canonical", "status", *wanted]})
    similar = F.lit(100.0)
    if mode == "FUZZY":
        # the Python functions run once for a row: their results are columns of a written table
        df = df.withColumn("_similar", name_similarity_col(F.col("canonical"), F.col("u_canonical")))
        similar = F.col("_similar")
    if authored:
        df = df.withColumn("_e", _compared(*[F.col(c).cast("string") for c in (*_AUTHORS, *[f"u_{c}" for c in _AUTHORS])]))
    if mode == "FUZZY" or authored:
        df = materialize(df)
    author = _author_score(F.col("_e")) if authored else F.lit(0)
    parts = {"name_score": _name_score(F.col("canonical"), F.col("type") if mode != "HIGHER" else F.lit(None).cast("string"), F.col("u_canonical"), similar)}
    sides = {c: F.col(c) for c in HIGHER}, {c: F.col(f"u_{c}") for c in HIGHER}
    rank = rank_score(F.col("rank"), F.col("u_rank"))
    if mode == "STRICT":
        parts["author_score"] = _worse(author * 4, 8)
        parts["classification_score"] = _worse(kingdom_score(F.upper("kingdom"), F.upper("u_kingdom")), 10)
        parts["rank_score"] = _worse(rank, 10)
    else:
        parts["author_score"] = _worse(author * 2, 2) if mode == "FUZZY" else F.lit(0)
        parts["classification_score"] = classification_similarity(*sides)
        parts["rank_score"] = rank if mode == "FUZZY" else rank * 2
    parts["status_score"] = F.coalesce(lookup(F.col("u_status"), STATUS_SCORE), F.lit(0))
    indet = F.col("canonical").endswith(" indet") & (F.col("edits") > 0)
    parts["indet_score"] = F.when(indet, -25).otherwise(0) if mode == "FUZZY" else F.lit(0)
    df = df.withColumns(parts)
    total = F.col("name_score")
    for p in list(parts)[1:]:
        total = total + F.col(p)
    return df.withColumn("raw", total.cast("int")).drop("_similar", "_e", *[f"u_{c}" for c in ["canonical", "status", *wanted]])


def exclude(scored: DataFrame, keys: Sequence) -> DataFrame:
    """Candidates that are an excluded row or below one lose all confidence. ``usage.higher_keys`` lists those above."""
    banned = F.array(*[F.lit(k) for k in keys])
    return scored.withColumn("raw", F.when(F.array_contains(banned, F.col("usage.key")) | F.arrays_overlap(F.col("usage.higher_keys"), banned), 0).otherwise(F.col("raw")))


def pick(scored: DataFrame, mode: str = "FUZZY") -> DataFrame:
    """One row per query: key, match_type, confidence, note.

    Equal best rows of one classification: the least key. Else the lowest higher taxon they share, else no match.
    """
    usage = [f.name for f in scored.schema["usage"].dataType.fields]
    higher = [c for c in HIGHER if c in usage]
    order = Window.partitionBy("qid").orderBy(F.col("raw").desc(), F.col("usage.canonical"), F.col("usage.key"))
    group = Window.partitionBy("qid")
    placed = scored.withColumn("_place", F.row_number().over(order)).withColumn("_best", F.max("raw").over(group))
    cls = F.col("usage.class") if "class" in usage else F.lit(None).cast("string")
    near = F.col("_best") - F.col("raw") <= 1
    placed = placed.withColumn("_span", F.size(F.collect_set(F.when(near, F.coalesce(cls, F.lit("")))).over(group)) > 1)
    placed = placed.withColumn("_in", F.when(F.col("_span"), near).otherwise(F.col("raw") == F.col("_best")))
    path = F.concat_ws("\x01", *[F.coalesce(F.col(f"usage.{c}"), F.lit("")) for c in higher]) if higher else F.lit("")
    keys = [f"{c}_key" for c in higher if f"{c}_key" in usage]
    agg = placed.groupBy("qid").agg(
        F.max("raw").alias("best"),
        F.max(F.when(F.col("_place") == 2, F.col("raw"))).alias("second"),
        F.sum(F.col("_in").cast("int")).alias("n_best"),
        F.size(F.collect_set(F.when(F.col("_in"), path))).alias("n_paths"),
        F.min(F.when(F.col("_in"), F.col("usage.key"))).alias("least"),
        F.max(F.when(F.col("_place") == 1, F.col("usage.key"))).alias("first"),
        F.max(F.when(F.col("_place") == 1, F.col("edits"))).alias("edits"),
        F.count(F.lit(1)).alias("n"),
        *[F.when(F.size(F.collect_set(F.when(F.col("_in"), F.coalesce(F.col(f"usage.{k}").cast("string"), F.lit("?"))))) == 1, F.max(F.when(F.col("_in"), F.col(f"usage.{k}")))).alias(f"_s_{k}") for k in keys],
    )
    common = F.coalesce(*[F.col(f"_s_{k}") for k in reversed(keys)]) if keys else F.lit(None).cast("long")
    tie = F.col("n_best") > 1
    step = F.when(F.col("n") == 1, 5).otherwise(F.least(F.lit(5), F.floor((F.col("best") - F.col("second")) / 2)))
    confidence = normalize_confidence((F.col("best") + step).cast("int"))
    enough = confidence >= (MIN_HIGHER_CONFIDENCE if mode == "HIGHER" else MIN_CONFIDENCE)
    apart = tie & (F.col("n_paths") > 1)
    key = F.when(apart, common).when(tie, F.col("least")).otherwise(F.col("first"))
    good = enough & key.isNotNull()
    kind = F.when(~good, "NONE").when(apart | F.lit(mode == "HIGHER"), "HIGHERRANK").when(F.col("edits") > 0, "FUZZY").otherwise("EXACT")
    note = F.when(apart & common.isNull(), "equal matches without a common taxon").when(~enough, "too little confidence").when(apart, "lowest common taxon").when(tie, "equal matches of one classification")
    return agg.select("qid", F.when(good, key).alias("key"), kind.alias("match_type"), F.when(good, confidence).otherwise(99).cast("int").alias("confidence"), note.alias("note"))


def _one_case(name: Column) -> Column:
    """Names in capitals or small letters only are not parsed and not matched fuzzily."""
    return (name == F.lower(name)) | (name == F.upper(name))


def match(queries: DataFrame, backbone: DataFrame, mode: str = "FUZZY", climb: bool = True) -> DataFrame:
    """Match a batch: qid, key, match_type, confidence, note.

    A given ``usage_key`` decides alone. Names in one case only, and those whose ``type`` cannot be parsed, are matched
    strictly. A fuzzy species of another genus gives way to the genus asked for, if the families differ. Rows
    without a match climb: the species of a trinomial, the genus, then the higher names from the lowest up.
    """
    if "usage_key" in queries.columns:
        keyed = queries.filter("usage_key is not null").select("qid", F.col("usage_key").alias("key"))
        known = backbone.select("key", F.lit(True).alias("_known"))
        given = keyed.join(known, "key", "left").select("qid", F.when(F.col("_known"), F.col("key")).alias("key"), F.when(F.col("_known"), "EXACT").otherwise("NONE").alias("match_type"), F.lit(100).alias("confidence"), F.when(F.col("_known"), "the key decides, names are ignored").alias("note"))
        return given.unionByName(match(queries.filter("usage_key is null").drop("usage_key"), backbone, mode, climb))
    backbone = materialize(backbone)
    plain = F.coalesce(_one_case(F.col("canonical")), F.lit(False))
    if "type" in queries.columns:
        plain = plain | F.coalesce(F.col("type").isin(*_STRICT_TYPES), F.lit(False))
    queries = materialize(queries.withColumn("_strict", plain if mode == "FUZZY" else F.lit(mode == "STRICT")))
    strict = queries.filter("_strict").drop("_strict")
    if "rank" in queries.columns:
        strict = strict.withColumn("rank", F.coalesce("rank", F.when(_one_case(F.col("canonical")), "UNRANKED")))
    loose = queries.filter("not _strict").drop("_strict")
    queries = queries.drop("_strict")
    scored = materialize(score(candidates(loose, backbone, True), "FUZZY")) if mode == "FUZZY" else None
    found = materialize(pick(score(candidates(strict, backbone, False), "STRICT"), "STRICT"))
    if scored is not None:
        first = pick(scored, "FUZZY")
        found = materialize(found.unionByName(_prefer_genus(first, loose, backbone) if "rank" in [f.name for f in scored.schema["usage"].dataType.fields] else first))
    out = queries.select("qid").join(found, "qid", "left").fillna({"match_type": "NONE", "confidence": 100})
    if not climb or mode == "STRICT":
        return out
    given = [c for c in reversed(HIGHER) if c in queries.columns]
    word = lambda n: F.substring_index("canonical", " ", n)
    blanks = F.length("canonical") - F.length(F.replace("canonical", F.lit(" "), F.lit("")))
    ask = lambda cond, name, rank, fuzzy: F.when(cond, F.struct(name.alias("canonical"), rank.cast("string").alias("rank"), F.lit(fuzzy).alias("fuzzy")))
    steps = [ask((blanks > 1) & ~_one_case(F.col("canonical")), word(2), F.lit("SPECIES"), True), ask((blanks > 0) & ~_one_case(F.col("canonical")), word(1), F.lit(None), False)]
    # below the genus only names above it help further
    steps += [ask((F.trim(c) != "") & ((blanks == 0) | _one_case(F.col("canonical")) | F.lit(c != "genus")), F.trim(c), F.lit(c.upper()), False) for c in given]
    missing = queries.join(out.filter("match_type = 'NONE'").select("qid"), "qid", "left_semi")
    asked = materialize(missing.select("qid", F.posexplode(F.array_compact(F.array(*steps))).alias("step", "ask"), *given))
    ladder = asked.select(F.struct("qid", "step").alias("qid"), F.col("ask.canonical").alias("canonical"), F.col("ask.rank").alias("rank"), F.col("ask.fuzzy").alias("fuzzy"), *given)
    climbed = pick(score(candidates(ladder.filter("not fuzzy").drop("fuzzy"), backbone, False), "HIGHER"), "HIGHER")
    species = ladder.filter("fuzzy").drop("fuzzy")
    if not species.isEmpty():
        climbed = climbed.unionByName(pick(score(candidates(species, backbone, True), "FUZZY"), "FUZZY").withColumn("match_type", F.when(F.col("match_type") != "NONE", "HIGHERRANK").otherwise("NONE")))
    best = climbed.filter("match_type <> 'NONE'").groupBy(F.col("qid.qid").alias("qid")).agg(F.min_by(F.struct("key", "match_type", "confidence", "note"), F.col("qid.step")).alias("up"))
    return out.join(best, "qid", "left").select(
        "qid", *[F.coalesce(F.col(f"up.{c}"), F.col(c)).alias(c) for c in ("key", "match_type", "confidence", "note")]
    )


def _prefer_genus(found: DataFrame, queries: DataFrame, backbone: DataFrame) -> DataFrame:
    """Fuzzy matches of species or below whose genus is another one, and whose first higher name above the genus that
    both sides know differs, give way to the genus of the query if the backbone has it."""
    above = [c for c in reversed(HIGHER) if c not in ("genus", "species", "subgenus") and c in queries.columns and c in backbone.columns]
    if not above:
        return found
    fuzzy = found.filter("match_type = 'FUZZY'").select("qid", "key").join(queries, "qid")
    side = backbone.select("key", F.col("canonical").alias("_c"), F.col("rank").alias("_r"), *[F.col(c).alias(f"_u_{c}") for c in above])
    differ = F.coalesce(*[F.when(F.col(c).isNotNull() & F.col(f"_u_{c}").isNotNull(), F.col(c) != F.col(f"_u_{c}")) for c in above], F.lit(False))
    low = ordinal(F.col("_r")) >= ordinal(F.lit("SPECIES"))
    genus = F.substring_index("canonical", " ", 1)
    apart = fuzzy.join(side, "key").filter(low & differ & ~F.startswith(F.col("_c"), F.concat(genus, F.lit(" "))))
    asked = materialize(apart.select("qid", genus.alias("canonical"), F.lit("GENUS").alias("rank"), *[c for c in HIGHER if c in queries.columns]))
    if asked.isEmpty():
        return found
    genera = backbone.filter("rank = 'GENUS'")
    better = pick(score(candidates(asked, genera, False), "HIGHER"), "HIGHER").filter("match_type <> 'NONE'").select("qid", F.struct("key", "match_type", "confidence", "note").alias("up"))
    return found.join(better, "qid", "left").select("qid", *[F.when(F.col("up").isNotNull(), F.col(f"up.{c}")).otherwise(F.col(c)).alias(c) for c in ("key", "match_type", "confidence", "note")])


def exact_lookup(queries: DataFrame, usages: DataFrame) -> DataFrame:
    """(qid, key): the one usage that a name stands for.

    Equal normalized names of compatible rank and kingdom, whose authors do not differ, are hits. Equal
    authors beat unknown ones; a query without author then prefers usages without. Of several hits: the one
    equal in name, author and year; the one not deleted; the one of equal status, current ones first; the
    least key.
    """
    q = queries.withColumn("_k", match_key(F.col("canonical"))).filter("length(_k) > 0")
    u = usages.select(match_key(F.col("canonical")).alias("_k"), F.struct(*usages.columns).alias("u"))
    hits = q.join(u, "_k").filter(rank_match(F.col("rank"), F.col("u.rank")) & kingdom_match(F.col("kingdom"), F.col("u.kingdom")))
    hits = hits.withColumn("_a", compare_col(F.col("authorship"), F.col("year"), F.col("u.authorship"), F.col("u.year"))).filter("_a <> 'DIFFERENT'")
    w = Window.partitionBy("qid")
    bare = F.col("authorship").isNull() & F.col("year").isNull()
    plain = F.col("u.authorship").isNull() & F.col("u.year").isNull()
    hits = hits.withColumn("_tier", F.when(F.col("_a") == "EQUAL", 0).when(bare & plain, 1).otherwise(2)).withColumn("_top", F.min("_tier").over(w)).filter("_tier = _top")
    same = (F.col("canonical") == F.col("u.canonical")) & F.col("authorship").eqNullSafe(F.col("u.authorship")) & F.col("year").eqNullSafe(F.col("u.year"))
    live = ~F.coalesce(F.col("u.deleted"), F.lit(False))
    open_end = F.col("rank").eqNullSafe("UNRANKED") | F.col("kingdom").eqNullSafe("INCERTAE_SEDIS")
    status = ~open_end & F.coalesce(F.col("status") == F.col("u.status"), F.lit(False))
    number = lambda c: F.sum(c.cast("int")).over(w)
    hits = hits.withColumns({"_same": same, "_live": live, "_fit": status}).withColumns({"_n_same": number(F.col("_same")), "_n_live": number(F.col("_live"))})
    place = (
        F.when((F.col("_n_same") == 1) & F.col("_same"), 0).when((F.col("_n_live") == 1) & F.col("_live"), 1).when(F.col("_fit") & F.col("_live"), 2).when(F.col("_fit"), 3).otherwise(4)
    )
    return hits.groupBy("qid").agg(F.min_by("u.key", F.struct(place.alias("p"), F.col("u.key"))).alias("key"))


def tidy_higher(queries: DataFrame, synonyms: DataFrame, blacklist: Sequence[str] = (), ranks: Sequence[str] = tuple(HIGHER)) -> DataFrame:
    """Higher names of queries in their accepted spelling: ``synonyms`` is (rank, name, accepted), names compared in
    upper case with only letters. Blacklisted names become null."""
    norm = lambda c: F.nullif(F.trim(F.upper(F.regexp_replace(c, r"[^\p{L}]+", " "))), F.lit(""))
    banned = [b.upper() for b in blacklist]
    out = queries
    for r in (r for r in ranks if r in queries.columns):
        side = synonyms.filter(F.lower("rank") == r).select(norm(F.col("name")).alias("_n"), F.col("accepted").alias("_a")).dropDuplicates(["_n"])
        joined = out.join(side, norm(F.col(r)) == F.col("_n"), "left")
        value = F.coalesce("_a", r)
        out = joined.withColumn(r, F.when(norm(value).isin(*banned), F.lit(None)).otherwise(value) if banned else value).drop("_n", "_a")
    return out


def inherit(closure: DataFrame, matched: DataFrame, value: str) -> DataFrame:
    """(id, value): what the nearest matched ancestor says; ``closure`` is (id, ancestor, depth)."""
    known = matched.filter(F.col(value).isNotNull()).select(F.col("id").alias("ancestor"), value)
    return closure.join(known, "ancestor").groupBy("id").agg(F.min_by(value, "depth").alias(value))


def warn_if_poor(summary: DataFrame) -> DataFrame:
    """Whether a data set matches so badly that somebody should look: under 25 % of more than 25 relevant rows."""
    return summary.withColumn("poor", (F.col("perc_relevant") < 25) & (F.col("relevant") > 25))


def mismatches(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Queries whose match is not the expected key; a missing match differs from any key."""
    return expected.select("qid", F.col("key").alias("expected")).join(found.select("qid", "key"), "qid", "left").filter(~F.col("key").eqNullSafe(F.col("expected")))
