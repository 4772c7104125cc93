"""One method per read of the service, on a store of tables. Each returns a DataFrame; nothing is served over HTTP.

Tables (all optional but ``usage`` and ``name``): usage(id, dataset, name_id, rank, parent, is_synonym, status, basionym,
deleted, taxon_id, issues, num_descendants), name(id, scientific_name, canonical_name), nub_rel(usage, nub, source),
dataset(key, title), metrics(id, ...), verbatim(usage_id, json), dataset_metrics(dataset, created, ...), and extension
tables keyed by usage_id: vernacular, description, distribution, identifier, reference, media, profile, typification.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.names import parse_name
from .functions.ranks import LINNEAN, ORDINAL
from .operators import aggregates as A
from .operators import matching, relational, search, tree
from .sources.tables import materialize

#: Sources whose records the backbone does not show.
HIDDEN: tuple[str, ...] = ()
EXTENSIONS = ("vernacular", "description", "distribution", "identifier", "reference", "media", "profile", "typification")


class Store:
    def __init__(self, tables: Mapping[str, DataFrame], backbone: str = "backbone", red_list: str = "red list", hidden: Sequence[str] = HIDDEN) -> None:
        self.tables, self.backbone, self.red_list, self.hidden = dict(tables), backbone, red_list, tuple(hidden)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def usages(self) -> DataFrame:
        """Current rows with their names; a synonym shows its accepted row and that row's parent."""
        return relational.accepted_of(self._raw(), name="scientific_name")

    def _raw(self, keys: DataFrame | None = None) -> DataFrame:
        """Current rows with their names: all, or those of at most a page of ids."""
        u = relational.current(self["usage"])
        if keys is not None:
            u = F.broadcast(u.join(F.broadcast(keys.select("id")), "id", "left_semi"))
        return u.join(self["name"].select(F.col("id").alias("name_id"), "scientific_name", "canonical_name"), "name_id")

    def get(self, key) -> DataFrame:
        return self.usages().filter(F.col("id") == key)

    def list(self, dataset: str | None = None, taxon_id: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        """A page by id. It is found from the ids of rows with a name; only its rows get names and accepted rows."""
        u = relational.current(self["usage"])
        u = u.filter(F.col("dataset") == dataset) if dataset else u
        u = u.filter(F.col("taxon_id") == taxon_id) if taxon_id else u
        named = u.select("id", "name_id").join(self["name"].select(F.col("id").alias("name_id")).hint("merge"), "name_id", "left_semi")
        rows = materialize(self._raw(relational.page(named, ["id"], offset, limit)))
        accepted = self._raw(rows.filter("is_synonym").select(F.col("parent").alias("id")).distinct())
        return relational.accepted_of(rows, name="scientific_name", among=accepted).orderBy("id")

    def key_of(self, dataset: str, taxon_id: str) -> DataFrame:
        return self._raw().filter((F.col("dataset") == dataset) & (F.col("taxon_id") == taxon_id)).agg(F.min("id").alias("id"))

    def count(self, dataset: str | None = None) -> DataFrame:
        u = relational.current(self["usage"])
        return (u.filter(F.col("dataset") == dataset) if dataset else u).agg(F.count(F.lit(1)).alias("n"))

    def max_key(self, dataset: str) -> DataFrame:
        return self["usage"].filter(F.col("dataset") == dataset).agg(F.max("id").alias("id"))

    def by_canonical(self, name: str, datasets: Sequence[str] = ()) -> DataFrame:
        found = relational.named(self.usages(), name, "canonical_name")
        return found.filter(F.col("dataset").isin(*datasets)) if datasets else found

    def root(self, dataset: str, offset: int = 0, limit: int = 20) -> DataFrame:
        return relational.page(relational.roots(self._raw().filter(F.col("dataset") == dataset)), relational.taxonomic_order("rank", "scientific_name", "id"), offset, limit)

    def children(self, key, offset: int = 0, limit: int = 20) -> DataFrame:
        return relational.page(self.all_children(key), relational.taxonomic_order("rank", "scientific_name", "id"), offset, limit)

    def all_children(self, key) -> DataFrame:
        return relational.children(self._raw(), key)

    def children_until_rank(self, key, rank: str) -> DataFrame:
        return relational.until_rank(self.all_children(key), rank)

    def synonyms(self, key, offset: int = 0, limit: int = 20) -> DataFrame:
        return relational.page(relational.synonyms(self._raw(), key), ["scientific_name", "id"], offset, limit)

    def parents(self, key) -> DataFrame:
        """The classification from the top down."""
        up = tree.ancestors(self._raw(), start=self._raw().filter(F.col("id") == key))
        return self._raw().join(up.select(F.col("ancestor").alias("id"), "depth"), "id").orderBy(F.col("depth").desc())

    def combinations(self, key) -> DataFrame:
        return relational.combinations(self._raw(), key)

    def related(self, nub, datasets: Sequence[str] | None = None) -> DataFrame:
        return relational.related(self._raw(), self["nub_rel"], nub, datasets)

    def top_levels(self, ranks: Sequence[str] = ("KINGDOM", "PHYLUM", "CLASS", "ORDER")) -> DataFrame:
        """The backbone down to a rank, with the number of children each has."""
        u = relational.current(self["usage"]).filter((F.col("dataset") == self.backbone) & ~F.col("is_synonym"))
        counts = u.groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("n_children"))
        shown = relational.until_rank(self._raw().filter((F.col("dataset") == self.backbone) & ~F.col("is_synonym")), ranks[-1]).filter(F.col("rank").isin(*ranks))
        return shown.join(counts, "id", "left").fillna({"n_children": 0})

    def metrics(self, key) -> DataFrame:
        return self["metrics"].filter(F.col("id") == key)

    def name(self, key) -> DataFrame:
        return self._raw().filter(F.col("id") == key).select("scientific_name", parse_name(F.col("scientific_name")).alias("parsed"))

    def verbatim(self, key) -> DataFrame:
        """The stored record, with the time of the latest import of its data set."""
        latest = A.latest(self["dataset_metrics"], ["dataset"], [F.col("created").desc()]).select("dataset", "created")
        row = self["verbatim"].filter(F.col("usage_id") == key).join(self["usage"].select(F.col("id").alias("usage_id"), "dataset"), "usage_id")
        return row.join(latest, "dataset", "left")

    def extension(self, kind: str, key, offset: int = 0, limit: int = 20, order: Sequence[str] = ("id",)) -> DataFrame:
        """Records of a checklist row; those of a backbone row come from all the rows mapped to it."""
        if kind not in EXTENSIONS:
            raise ValueError(f"unknown extension {kind}")
        return relational.page(self.all_extension(kind, key), list(order), offset, limit)

    def all_extension(self, kind: str, key) -> DataFrame:
        own = self[kind].filter(F.col("usage_id") == key)
        if "nub_rel" not in self.tables or "dataset" not in self.tables:
            return own
        mapped = relational.components_for(self[kind], self["nub_rel"].filter(F.col("nub") == key), self["dataset"], self.hidden)
        return own.unionByName(mapped.drop("nub", "source"), allowMissingColumns=True)

    def extension_range(self, kind: str, start, end) -> DataFrame:
        return relational.key_range(self[kind], start, end, "usage_id")

    def toc(self, key) -> DataFrame:
        return A.table_of_contents(self.all_extension("description", key), "language", "type", "id")

    def vernacular_in(self, language: str, keys: DataFrame | None = None) -> DataFrame:
        """One name per row in a two-letter language: preferred ones first, then the least id."""
        v = self["vernacular"].filter(F.col("language") == language.lower()[:2])
        v = v.join(keys.select(F.col("id").alias("usage_id")), "usage_id", "left_semi") if keys is not None else v
        order = F.struct(F.coalesce(~F.col("preferred"), F.lit(True)).alias("p"), "id")
        return v.groupBy("usage_id").agg(F.min_by("name", order).alias("name"))

    def red_list_category(self, nub) -> DataFrame:
        """The threat status of the red list's row mapped to a backbone row; a synonym takes its accepted row's status.

        No status: NOT_EVALUATED for a mapped row, or for a species of a true kingdom; else no row.
        """
        rel = self["nub_rel"].filter((F.col("nub") == nub) & (F.col("source") == self.red_list))
        u = self["usage"].select(F.col("id").alias("usage"), F.when(F.col("is_synonym"), F.col("parent")).otherwise(F.col("id")).alias("_acc"), "taxon_id")
        status = self["distribution"].filter("threat_status is not null").groupBy(F.col("usage_id").alias("_acc")).agg(F.min_by("threat_status", "id").alias("threat_status"))
        mapped = rel.join(u, "usage").join(status, "_acc", "left").select(F.lit(nub).alias("key"), "taxon_id", F.coalesce("threat_status", F.lit("NOT_EVALUATED")).alias("category"))
        own = relational.current(self["usage"]).filter((F.col("id") == nub) & (F.col("dataset") == self.backbone) & (F.col("rank") == "SPECIES"))
        default = own.select(F.lit(nub).alias("key"), F.lit(None).cast("string").alias("taxon_id"), F.lit("NOT_EVALUATED").alias("category")).join(mapped.select("key"), "key", "left_anti")
        return mapped.unionByName(default)

    def without_match(self, dataset: str) -> DataFrame:
        return relational.having_value(relational.current(self["usage"]).filter(F.col("dataset") == dataset), "issues", "BACKBONE_MATCH_NONE").select("id")

    def search(self, params: Mapping[str, Sequence[str]], query: str | None = None, offset: int = 0, limit: int = 20) -> DataFrame:
        found = search.search(self._raw(), params, query, {"canonical": "canonical_name", "scientific": "scientific_name"}, "id", rank="rank", status="status", synonym="is_synonym")
        return search.page(found, offset, limit, "id")

    def facets(self, params: Mapping[str, Sequence[str]], names: Sequence[str], multi_select: bool = False, min_count: int = 1) -> DataFrame:
        rows = self._raw()
        return A.facets(rows, search.filters(rows, params), names, multi_select, min_count)

    def suggest(self, prefix: str, dataset: str | None = None, limit: int = 20) -> DataFrame:
        rows = self._raw().filter(F.col("dataset") == (dataset or self.backbone))
        return search.page(search.suggestions(rows, prefix, "canonical_name", "rank", "id"), 0, limit, "id")

    def _described(self, rows: DataFrame) -> DataFrame:
        """Rows with the atoms of their authors, and names and ids of the rows above them by rank."""
        ranks = [r.lower() for r in LINNEAN[:-1]]
        everything = self._raw()
        higher = tree.classification(tree.ancestors(everything, include_self=True, start=rows.select("id")), everything, LINNEAN[:-1])
        names = everything.select("id", "canonical_name")
        for r in ranks:
            higher = higher.join(names.select(F.col("id").alias(f"{r}_id"), F.col("canonical_name").alias(r)), f"{r}_id", "left")
        higher = higher.select("id", *ranks, *[F.col(f"{r}_id").alias(f"{r}_key") for r in ranks])
        parsed = rows.withColumn("_p", parse_name(F.col("scientific_name")))
        atoms = [F.col(f"_p.{c}").alias(c) for c in ("authorship", "year", "bracket_authorship", "bracket_year")]
        return parsed.select("id", F.col("canonical_name").alias("canonical"), "rank", "status", *atoms).join(higher, "id", "left")

    def match(self, queries: DataFrame, mode: str = "FUZZY") -> DataFrame:
        """Match a batch of names against the backbone. Ancestors are found for backbone rows only."""
        rows = self._described(self._raw().filter(F.col("dataset") == self.backbone)).withColumnRenamed("id", "key")
        return matching.match(queries, rows, mode)

    def rematch(self, dataset: str) -> tuple[DataFrame, DataFrame]:
        """(relations, summary): match a data set's rows, their authors and higher names helping; unmatched rows are in the summary."""
        rows = self._raw().filter(F.col("dataset") == dataset)
        asked = self._described(rows).withColumnRenamed("id", "qid").drop("status", *[f"{r.lower()}_key" for r in LINNEAN[:-1]])
        found = self.match(asked)
        joined = rows.join(found.withColumnRenamed("qid", "id"), "id", "left")
        rel = joined.filter(F.col("match_type").isin("EXACT", "FUZZY")).select(F.col("id").alias("usage"), F.col("key").alias("nub"), F.lit(dataset).alias("source"))
        relevant = F.col("rank").isin("GENUS", *[r for r in ORDINAL if ORDINAL["SPECIES"] <= ORDINAL[r] < ORDINAL["OTHER"]])
        summary = matching.warn_if_poor(A.match_summary(joined, F.col("match_type").isin("EXACT", "FUZZY"), F.col("canonical_name").isNotNull(), F.coalesce(relevant, F.lit(False))))
        return rel, summary

    def dataset_metrics(self, dataset: str) -> DataFrame:
        """The latest stored row of a data set."""
        return A.latest(self["dataset_metrics"].filter(F.col("dataset") == dataset), ["dataset"], [F.col("created").desc()])

    def compute_metrics(self) -> tuple[DataFrame, DataFrame]:
        """(totals, counts): metrics of all data sets at once, totals in a row each and counts by metric and key."""
        rows = self._raw()
        nub = self["nub_rel"].select(F.col("usage").alias("id"), "nub").dropDuplicates(["id"])
        joined = rows.join(nub, "id", "left")
        totals = A.dataset_metrics(joined, "dataset", "name_id", F.col("is_synonym"), F.col("nub").isNotNull())
        counts = A.counts_long(joined, {c: c for c in ("rank", "status", "origin", "kingdom", "constituent") if c in joined.columns}, ["dataset"])
        issues = joined.select("dataset", F.lit("issue").alias("metric"), F.explode("issues").alias("key")).groupBy("dataset", "metric", "key").agg(F.count(F.lit(1)).alias("n"))
        counts = counts.unionByName(issues)
        of = rows.select(F.col("id").alias("usage_id"), "dataset")
        for kind in (k for k in EXTENSIONS if k in self.tables):
            records = self[kind].join(of, "usage_id")
            counts = counts.unionByName(records.groupBy("dataset").agg(F.lit("extension").alias("metric"), F.lit(kind).alias("key"), F.count(F.lit(1)).alias("n")))
            if kind == "vernacular":
                counts = counts.unionByName(A.counts_long(records, {"vernacular_language": "language"}, ["dataset"]))
        return totals, counts

    def sitemap(self, size: int = 50_000) -> DataFrame:
        return relational.page_of(relational.current(self["usage"]).filter(F.col("dataset") == self.backbone).select("id"), ["id"], size)
