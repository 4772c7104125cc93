"""Search: filters, full text in tiers, suggestions and highlighting. Facets are in ``aggregates``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranks import ordinal

DEFAULT_LIMIT, MAX_LIMIT = 20, 100
#: Fields of a full-text query and their weights.
WEIGHTS = {"description": 0.1, "vernacular": 1.0, "canonical": 1.0, "scientific": 1.0, "species": 1.0, "subgenus": 1.0, "family": 1.0}
PHRASE_WEIGHTS = {"description": 2.0, "vernacular": 20.0, "scientific": 100.0, "canonical": 50.0}


def parameter_name(name: str) -> str:
    """Names of parameters and values compare in upper case without punctuation."""
    return name.upper().translate(str.maketrans("", "", "._- "))


def condition(df: DataFrame, column: str, values: Sequence[str]) -> Column:
    """Alternatives for one column: plain values, or ranges ``low,high`` with ``*`` as an open end. Array columns match by any element."""
    kind = dict(df.dtypes)[column]
    plain, tests = [], []
    for v in values:
        low, comma, high = v.partition(",")
        if comma and not kind.startswith(("string", "array")):
            bounds = [F.col(column) >= F.lit(low).cast(kind)] * (low != "*") + [F.col(column) <= F.lit(high).cast(kind)] * (high != "*")
            tests.append(reduce(lambda a, b: a & b, bounds, F.col(column).isNotNull()))
        else:
            plain.append(v)
    if plain:
        typed = [F.lit(v).cast(kind[6:-1] if kind.startswith("array") else kind) for v in plain]
        tests.append(F.arrays_overlap(F.col(column), F.array(*typed)) if kind.startswith("array") else F.col(column).isin(*typed))
    return reduce(lambda a, b: a | b, tests, F.lit(False)) if tests else F.lit(True)


def filters(df: DataFrame, params: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Conditions by column; unknown parameters raise. They are ANDed by ``search`` and by the facets."""
    known = {parameter_name(c): c for c in df.columns}
    out = {}
    for name, values in params.items():
        if parameter_name(name) not in known:
            raise ValueError(f"unknown parameter {name}")
        column = known[parameter_name(name)]
        out[column] = condition(df, column, list(values))
    return out


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def relevance(query: str, fields: Mapping[str, str], rank: str | None = None, status: str | None = None, synonym: str | None = None) -> tuple[Column, Column]:
    """(hit, score) of a full-text query over columns by role.

    All words have to be in one field; a phrase has to occur as it stands. Scores keep the tiers: phrase
    prefixes of names first, then fields by weight, nearness to the rank asked for (species for phrases,
    genus for words), and accepted names before synonyms.
    """
    asked = " ".join(query.lower().split())
    phrase = " " in asked
    hits, points = [], []
    for role, column in fields.items():
        text = F.coalesce(F.lower(F.col(column).cast("string")), F.lit(""))
        has = F.contains(F.concat(F.lit(" "), F.concat_ws(" ", words(text)), F.lit(" ")), F.lit(f" {asked} "))
        hits.append(has)
        points.append(F.when(has, WEIGHTS.get(role, 1.0)).otherwise(0.0))
        if role in PHRASE_WEIGHTS:
            points.append(F.when(text.startswith(asked), PHRASE_WEIGHTS[role]).otherwise(0.0))
    score = reduce(lambda a, b: a + b, points)
    if rank:
        away = ordinal(F.col(rank)) - ordinal(F.lit("SPECIES" if phrase else "GENUS"))
        beyond = F.greatest(F.lit(0.0), F.abs(away.cast("double")) - 1)
        score = score + 250 * F.coalesce(F.exp(beyond * beyond * F.lit(-1.6094379124341003)), F.lit(0.0))
    if status:
        score = score + F.when(F.col(status) == "ACCEPTED", 50.0).otherwise(0.0)
    if synonym:
        score = score + F.when(~F.col(synonym), 50.0).otherwise(0.0)
    return reduce(lambda a, b: a | b, hits), score


def search(df: DataFrame, params: Mapping[str, Sequence[str]], query: str | None = None, fields: Mapping[str, str] | None = None, key: str = "key", **boosts) -> DataFrame:
    """All hits with ``score``; the caller pages them by score, or by key without a query."""
    found = df.filter(reduce(lambda a, b: a & b, filters(df, params).values(), F.lit(True)))
    if not query:
        return found.withColumn("score", F.lit(0.0))
    hit, score = relevance(query, fields or {}, **boosts)
    return found.filter(hit).withColumn("score", score)


def page(found: DataFrame, offset: int, limit: int, key: str = "key") -> DataFrame:
    if limit < 0 or limit > MAX_LIMIT:
        limit = DEFAULT_LIMIT
    return found.orderBy(F.col("score").desc(), key).offset(offset).limit(limit)


def suggestions(df: DataFrame, prefix: str, column: str, rank: str | None = None, key: str = "key") -> DataFrame:
    """Rows with a word that begins with each word asked for, and their score: the whole name's start counts most."""
    asked = [w for w in prefix.lower().split() if w]
    begins = lambda start: F.exists(words(F.col(column)), lambda w: w.startswith(start))
    has = reduce(lambda a, b: a & b, map(begins, asked), F.lit(True))
    score = F.when(F.lower(column).startswith(" ".join(asked)), 100.0).otherwise(10.0)
    if rank:
        score = score + F.when(F.col(rank) == ("SPECIES" if len(asked) > 1 else "GENUS"), 50.0).otherwise(0.0)
    return df.filter(has).withColumn("score", score)


def highlight(text: Column, query: str, tag: str = "em") -> Column:
    """The text, encoded for HTML, with the words of the query marked."""
    encoded = F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    from re import escape

    pattern = "|".join(escape(w) for w in query.split())
    return F.regexp_replace(encoded, rf"(?i)(?<![\p{{L}}\p{{N}}])({pattern})(?![\p{{L}}\p{{N}}])", f"<{tag}>$1</{tag}>")


def documents(usages: DataFrame, extensions: Mapping[str, DataFrame], key: str = "key", usage: str = "usage_id") -> DataFrame:
    """Search documents: rows with each extension's records as an array column of its name."""
    out = usages
    for name, rows in extensions.items():
        fields = [c for c in rows.columns if c != usage]
        grouped = rows.groupBy(F.col(usage).alias("_u")).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(grouped, F.col(key) == F.col("_u"), "left").drop("_u")
    return out


def swap_index(df: DataFrame, folder: str, alias: str) -> str:
    """Write a new version beside the old one, then point the alias file at it: readers see one or the other."""
    import uuid

    spark = df.sparkSession
    target = f"{folder}/{alias}-{uuid.uuid4().hex}"
    df.write.parquet(target)
    hadoop = spark._jvm.org.apache.hadoop
    fs = hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    stream = fs.create(hadoop.fs.Path(f"{folder}/{alias}.tmp"), True)
    stream.write(bytearray(target.encode()))
    stream.close()
    # one rename that replaces: a reader finds the old target or the new one, never none
    files = hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    modes = spark._sc._gateway.new_array(hadoop.fs.Options.Rename, 1)
    modes[0] = getattr(hadoop.fs.Options.Rename, "OVERWRITE")
    files.rename(fs.makeQualified(hadoop.fs.Path(f"{folder}/{alias}.tmp")), fs.makeQualified(hadoop.fs.Path(f"{folder}/{alias}.current")), modes)
    return target


def open_index(spark, folder: str, alias: str) -> DataFrame:
    target = spark.read.text(f"{folder}/{alias}.current", wholetext=True).first()[0]
    return spark.read.parquet(target)
