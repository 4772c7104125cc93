"""Scalar functions, matching and search on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import authors as AU
from ..functions import cleaning as C
from ..functions import names as N
from ..functions import ranks as RK
from ..functions import similarity as SIM
from ..operators import matching as M
from ..operators import search as S
from ..operators import tree as T
from ..sources.tables import read_table as _t
from .hierarchy import _CLOSURE, tree


def q_norm_name(spark, d):
    """Part names as binomials: the first word stays, the second is normalized."""
    p = _t(spark, d, "part")
    name = F.concat(F.initcap(F.element_at(F.split("p_name", " "), 1)), F.lit("us "), F.element_at(F.split("p_name", " "), 2), F.lit("ythus"))
    return p.select("p_partkey", N.normalize_name(name).alias("normed"), N.match_key(name).alias("match_key"), N.stem_epithet(name).alias("stem"))


def q_clean_nulls(spark, d):
    p = _t(spark, d, "part")
    dirty = F.when(F.col("p_size") % 5 == 0, F.lit(r"\N")).when(F.col("p_size") % 5 == 1, F.lit("null")).when(F.col("p_size") % 5 == 2, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), F.lit(" \t\n ")), F.lit(" ")))
    return p.select("p_partkey", C.clean(dirty).alias("value"))


def q_canonical_fallback(spark, d):
    """The text as name, or the source where there is none."""
    docs = _t(spark, d, "documents")
    word = F.when(F.col("doc_id") % 4 == 0, F.lit(" ")).otherwise(F.col("text"))
    return docs.select("doc_id", F.md5(C.canonical_or_name(word, F.col("source"))).alias("name"))


def q_html_strip(spark, d):
    p = _t(spark, d, "pages")
    return p.select("page_id", F.md5(C.strip_html(F.col("html"))).alias("digest"), F.length(C.strip_html(F.col("html"))).alias("n"))


def q_json_verbatim(spark, d):
    e = _t(spark, d, "events")
    return e.groupBy("event_type").agg(F.sum(C.verbatim_field(F.col("props"), "k").cast("long")).alias("total"), F.count(C.verbatim_field(F.col("props"), "missing")).alias("n_missing"))


def q_media_type(spark, d):
    kinds = F.element_at(F.array(*[F.lit(x) for x in (".jpg", ".MP3", ".html", "", ".mov?x=1", ".tiff")]), (F.col("page_id") % 6 + 1).cast("int"))
    url = F.concat(F.lit("http://a.example/x"), F.col("page_id"), kinds)
    mime = C.mime_type(url)
    identifier, reference = C.page_as_reference(mime, url, F.lit(None).cast("string"))
    return _t(spark, d, "pages").select("page_id", mime.alias("mime"), C.media_type(mime).alias("media"), identifier.isNull().alias("is_page"), reference.isNotNull().alias("has_reference"))


def q_split_values(spark, d):
    """Parts' fields joined by one delimiter or another fall apart again."""
    sep = F.element_at(F.array(*[F.lit(x) for x in ("|", ";", ",", "~")]), (F.col("p_size") % 4 + 1).cast("int"))
    value = F.concat_ws("", F.replace("p_name", F.lit(" "), F.lit("_")), sep, F.col("p_brand"), sep, F.col("p_type"))
    return _t(spark, d, "part").select("p_partkey", F.concat_ws("/", C.split_values(value)).alias("value"), F.size(C.split_values(value)).cast("long").alias("n"))


def q_authorship(spark, d):
    s = _t(spark, d, "supplier")
    when = lambda k, x: F.when(F.col("s_suppkey") % k != 0, x)
    year = F.lpad((F.col("s_nationkey") + 1750).cast("string"), 4, F.lit("0"))
    return s.select("s_suppkey", C.full_authorship(when(2, F.col("s_name")), when(3, year), when(5, F.lit("L.")), when(7, F.lit("1753"))).alias("authorship"))


def q_citation(spark, d):
    s = _t(spark, d, "supplier")
    when = lambda k, x: F.when(F.col("s_suppkey") % k != 0, x)
    return s.select("s_suppkey", C.citation(when(2, F.col("s_name")), when(3, F.lit("Systema naturae")), when(5, F.lit(" 1758 ")), when(7, F.lit("Holmiae"))).alias("citation"))


def q_authors_years(spark, d):
    """Years of orders against a fixed one, and the three-valued and."""
    o = _t(spark, d, "orders")
    years = AU.compare_years_col(F.date_format("o_orderdate", "yyyy"), F.lit("c. 1997"))
    other = F.when(F.col("o_orderkey") % 3 == 0, F.lit("UNKNOWN")).when(F.col("o_orderkey") % 3 == 1, F.lit("EQUAL")).otherwise(F.lit("DIFFERENT"))
    return o.groupBy(years.alias("years"), AU.both_col(years, other).alias("both")).agg(F.count(F.lit(1)).alias("n"))


def q_normalize_author(spark, d):
    s = _t(spark, d, "supplier")
    word = F.initcap(F.translate(F.regexp_replace("s_name", "#", ""), "0123456789", "bcdfghklmn"))
    raw = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("Müller ex "), word, F.lit(" & Mill. in Foo"))).otherwise(F.concat(word, F.lit(" et Linné")))
    return s.select("s_suppkey", AU.normalize_author(raw).alias("author"))


def q_edge_ngrams(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.explode(C.edge_ngrams(F.col("n_name"), 5)).alias("gram"))
    return n.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))


def q_tagged_names(spark, d):
    return _t(spark, d, "documents").groupBy(C.tagged_name(F.col("lang"), F.col("source")).alias("tag")).agg(F.count(F.lit(1)).alias("n"))


def q_expand_genus(spark, d):
    p = _t(spark, d, "part")
    short = F.concat(F.upper(F.substring("p_name", 1, 1)), F.lit(". alba"))
    return p.select("p_partkey", C.expand_genus(short, F.initcap("p_name")).alias("name"))


def q_confidence(spark, d):
    p = _t(spark, d, "part").select((F.col("p_size") * 4).alias("raw")).distinct()
    return p.select("raw", SIM.normalize_confidence(F.col("raw")).cast("long").alias("confidence"))


def q_edit_similarity(spark, d):
    """Similarity of part names to one name from their edits."""
    p = _t(spark, d, "part").select("p_name").distinct()
    return p.select("p_name", SIM.edits_col(F.levenshtein("p_name", F.lit("red widget")), F.col("p_name"), F.lit("red widget")).alias("similarity"))


def q_rank_functions(spark, d):
    """Part sizes as ranks: their order, grouping below species, and base rank."""
    rank = F.element_at(F.array(*[F.lit(r) for r in ("FAMILY", "SUBFAMILY", "SPECIES", "VARIETY", "FORM")]), (F.col("p_size") % 5 + 1).cast("int"))
    base = {r: RK.linnean_base(r) for r in ("FAMILY", "SUBFAMILY", "SPECIES", "VARIETY", "FORM")}
    return _t(spark, d, "part").groupBy(rank.alias("rank"), RK.group_infraspecific(rank).alias("grouped"), RK.lookup(rank, base).alias("base")).agg(F.count(F.lit(1)).alias("n"))


def q_kingdoms(spark, d):
    ks = RK.KINGDOMS
    pick = lambda c: F.element_at(F.array(*[F.lit(k) for k in ks]), (c % 9 + 1).cast("int"))
    a, b = pick(F.col("p_partkey")), pick(F.col("p_size"))
    return _t(spark, d, "part").groupBy(a.alias("a"), b.alias("b")).agg(F.max(RK.kingdom_match(a, b).cast("int")).alias("matches"), F.max(RK.kingdom_score(a, b)).alias("score"))


def q_fuzzy_pairs(spark, d):
    """Names of nations and parts: pairs within two edits (one if short), a swap counting once."""
    n = _t(spark, d, "nation").select(F.lower("n_name").alias("name")).unionByName(_t(spark, d, "part").select(F.lower("p_name").alias("name")))
    return M.fuzzy_pairs(n.withColumnRenamed("name", "query"), n, "query", "name").filter("query <> name")


def _backbone(spark, d):
    n, r = _t(spark, d, "nation"), _t(spark, d, "region")
    taxa = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("long").alias("key"), F.col("n_name").alias("canonical"), F.lit("GENUS").alias("rank"), F.lit("ACCEPTED").alias("status"), F.col("r_name").alias("class"),
        (F.col("r_regionkey") + 1000).cast("long").alias("class_key"), F.lit(None).cast("string").alias("authorship"), F.lit(None).cast("string").alias("year"), F.lit("ANIMALIA").alias("kingdom"), F.lit(False).alias("deleted"),
    )
    regions = r.select((F.col("r_regionkey") + 1000).cast("long").alias("key"), F.col("r_name").alias("canonical"), F.lit("CLASS").alias("rank"), F.lit("ACCEPTED").alias("status"), F.col("r_name").alias("class"),
        (F.col("r_regionkey") + 1000).cast("long").alias("class_key"), F.lit(None).cast("string").alias("authorship"), F.lit(None).cast("string").alias("year"), F.lit("ANIMALIA").alias("kingdom"), F.lit(False).alias("deleted"))
    return taxa.unionByName(regions)


def q_exact_lookup(spark, d):
    """Suppliers look their nation up by a name in lower case."""
    s = _t(spark, d, "supplier")
    q = s.select(F.col("s_suppkey").alias("qid"), F.lower(F.concat(F.lit("Nation_"), (F.col("s_nationkey") + 3).cast("string"))).alias("canonical"), F.lit("GENUS").alias("rank"), F.lit("ANIMALIA").alias("kingdom"),
        F.lit(None).cast("string").alias("authorship"), F.lit(None).cast("string").alias("year"), F.lit("ACCEPTED").alias("status"))
    return M.exact_lookup(q, _backbone(spark, d))


def q_match_climb(spark, d):
    """Unknown names climb to the class that is given with them."""
    s = _t(spark, d, "supplier").join(_t(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    q = s.select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 2 == 0, F.col("n_name")).otherwise(F.lit("Zzyzx")).alias("canonical"), F.when(F.col("s_suppkey") % 2 == 0, "GENUS").otherwise("SPECIES").alias("rank"), F.col("r_name").alias("class"))
    return M.match(q, _backbone(spark, d)).select("qid", "key", "match_type")


def q_inherited_value(spark, d):
    """Orders take the value of the nearest ancestor that has one: customers in debt, else their region."""
    t = tree(spark, d)
    debt = _t(spark, d, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("id"), F.lit("debt").alias("value"))
    known = debt.unionByName(t.filter("rank = 'KINGDOM'").select("id", F.col("name").alias("value")))
    return M.inherit(T.ancestors(t, start=t.filter("rank = 'SPECIES'")), known, "value").groupBy("value").agg(F.count(F.lit(1)).alias("n"))


def q_search_text(spark, d):
    """Documents with a word, and their score by field."""
    hit, score = S.relevance("token", {"description": "text", "canonical": "source"})
    return _t(spark, d, "documents").filter(hit).select("doc_id", score.alias("score"))


def q_search_filtered(spark, d):
    docs = _t(spark, d, "documents")
    return S.search(docs, {"LANG": ["de", "fr"], "n-chars": ["1000,*"]}, key="doc_id").select("doc_id", "lang", "n_chars")


def q_suggest(spark, d):
    p = _t(spark, d, "part").withColumn("rank", F.when(F.col("p_size") > 25, "SPECIES").otherwise("GENUS"))
    return S.suggestions(p, "re wi", "p_name", "rank", "p_partkey").select("p_partkey", "p_name", "score")


def q_highlight(spark, d):
    return _t(spark, d, "part").select("p_partkey", S.highlight(F.concat("p_name", F.lit(" <b>")), "red ring").alias("marked"))


def q_search_documents(spark, d):
    """Search documents of orders with their line items embedded."""
    lines = _t(spark, d, "lineitem").select(F.col("l_orderkey").alias("usage_id"), "l_linenumber", "l_partkey")
    out = S.documents(_t(spark, d, "orders").select(F.col("o_orderkey").alias("key"), "o_orderstatus"), {"lines": lines})
    return out.select("key", "o_orderstatus", F.coalesce(F.concat_ws(",", F.transform("lines", lambda x: x["l_partkey"].cast("string"))), F.lit("")).alias("parts"))


QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}


def _undouble(x: str) -> str:
    for c in "abcdefghijklmnopqrstuvwxyz":
        x = f"regexp_replace({x}, '{c}{{2,}}', '{c}', 'g')"
    return x


_EPITHET = "(split_part(p_name, ' ', 2) || 'ythus')"
_NORMED = rf"regexp_replace(regexp_replace(regexp_replace(regexp_replace({_undouble(_EPITHET)}, '(on|um|us|a)$', 'a'), '(\w)[jyi]+', '\1i', 'g'), 'ei$', 'i'), '([tr])h', '\1', 'g')"
_GENUS = "(upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || 'us')"
_KINGDOM = "(['INCERTAE_SEDIS', 'ANIMALIA', 'ARCHAEA', 'BACTERIA', 'CHROMISTA', 'FUNGI', 'PLANTAE', 'PROTOZOA', 'VIRUSES'])"
_DOC_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
SQL = {
    "q_norm_name": f"SELECT p_partkey, {_GENUS} || ' ' || {_NORMED} AS normed, lower({_GENUS} || ' ' || {_NORMED}) AS match_key, {_GENUS} || ' ' || split_part(p_name, ' ', 2) || 'ytha' AS stem FROM part",
    "q_clean_nulls": "SELECT p_partkey, CASE WHEN p_size % 5 < 3 THEN NULL ELSE p_name END AS value FROM part",
    "q_canonical_fallback": "SELECT doc_id, md5(CASE WHEN doc_id % 4 = 0 THEN source ELSE coalesce(nullif(trim(text), ''), source) END) AS name FROM documents",
    "q_html_strip": """SELECT page_id, md5(t) AS digest, length(t)::INTEGER AS n FROM (
      SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '[ \\t\\n\\f\\r\\x0B]+', ' ', 'g')) AS t FROM pages)""",
    "q_json_verbatim": "SELECT event_type, sum((props->>'$.k')::BIGINT)::BIGINT AS total, 0::BIGINT AS n_missing FROM events GROUP BY 1",
    "q_media_type": """SELECT page_id, (['image/jpeg', 'audio/mpeg', 'text/html', NULL, 'video/quicktime', 'image/tiff'])[page_id % 6 + 1] AS mime,
      (['STILL_IMAGE', 'SOUND', NULL, NULL, 'MOVING_IMAGE', 'STILL_IMAGE'])[page_id % 6 + 1] AS media, page_id % 6 = 2 AS is_page, page_id % 6 = 2 AS has_reference FROM pages""",
    "q_split_values": """SELECT p_partkey, CASE WHEN p_size % 4 = 3 THEN replace(p_name, ' ', '_') || '~' || p_brand || '~' || p_type ELSE replace(p_name, ' ', '_') || '/' || p_brand || '/' || p_type END AS value,
      CASE WHEN p_size % 4 = 3 THEN 1 ELSE 3 END::BIGINT AS n FROM part""",
    "q_authorship": """SELECT s_suppkey, coalesce(a, '') || coalesce(', ' || y, '') || CASE WHEN b IS NOT NULL OR c IS NOT NULL THEN ' (' || concat_ws(', ', b, c) || ')' ELSE '' END AS authorship FROM (
      SELECT s_suppkey, CASE WHEN s_suppkey % 2 <> 0 THEN s_name END AS a, CASE WHEN s_suppkey % 3 <> 0 THEN (s_nationkey + 1750)::VARCHAR END AS y,
        CASE WHEN s_suppkey % 5 <> 0 THEN 'L.' END AS b, CASE WHEN s_suppkey % 7 <> 0 THEN '1753' END AS c FROM supplier)""",
    "q_citation": """SELECT s_suppkey, nullif(concat_ws('. ', nullif(concat_ws(': ', nullif(concat_ws(' ', a, y), ''), t), ''), p), '') AS citation FROM (
      SELECT s_suppkey, CASE WHEN s_suppkey % 2 <> 0 THEN s_name END AS a, CASE WHEN s_suppkey % 3 <> 0 THEN 'Systema naturae' END AS t,
        CASE WHEN s_suppkey % 5 <> 0 THEN '(1758)' END AS y, CASE WHEN s_suppkey % 7 <> 0 THEN 'Holmiae' END AS p FROM supplier)""",
    "q_authors_years": """SELECT years, CASE WHEN years = 'DIFFERENT' OR o = 2 THEN 'DIFFERENT' ELSE 'EQUAL' END AS both, count(*)::BIGINT AS n FROM (
      SELECT CASE WHEN abs(year(o_orderdate) - 1997) <= 1 THEN 'EQUAL' ELSE 'DIFFERENT' END AS years, o_orderkey % 3 AS o FROM orders) GROUP BY ALL""",
    "q_normalize_author": "SELECT s_suppkey, w || CASE WHEN s_suppkey % 2 = 0 THEN ',mill' ELSE ',linne' END AS author FROM (SELECT s_suppkey, translate(lower(replace(s_name, '#', '')), '0123456789', 'bcdfghklmn') AS w FROM supplier)",
    "q_edge_ngrams": """SELECT gram, count(*)::BIGINT AS n FROM (SELECT substr(w, 1, k::INTEGER) AS gram FROM (SELECT unnest(string_split(lower(n_name), '_')) AS w FROM nation), range(1, 6) t(k) WHERE k <= length(w)) GROUP BY 1""",
    "q_tagged_names": "SELECT coalesce(lang, '') || '_@_' || source AS tag, count(*)::BIGINT AS n FROM documents GROUP BY 1",
    "q_expand_genus": "SELECT p_partkey, upper(p_name[1]) || substr(split_part(p_name, ' ', 1), 2) || ' alba' AS name FROM part",
    "q_confidence": "SELECT DISTINCT p_size * 4 AS raw, greatest(0, least(100, CASE WHEN p_size * 4 <= 80 THEN p_size * 4 ELSE round(75.8 + 26 * (log10((p_size * 4 - 70) * 1.5) - 1)) END))::BIGINT AS confidence FROM part",
    "q_edit_similarity": """SELECT DISTINCT p_name, CASE WHEN e = 0 THEN 100 WHEN e > k OR pow(e, 1.4) / k > 1 THEN 0 ELSE floor(100 * (1 - pow(e, 1.4) / k) + 0.5) END::DOUBLE AS similarity
      FROM (SELECT p_name, levenshtein(p_name, 'red widget') AS e, least(10, length(p_name)) AS k FROM part)""",
    "q_rank_functions": """SELECT r AS rank, CASE WHEN i > 2 THEN 'INFRASPECIFIC_NAME' ELSE r END AS grouped, CASE WHEN i < 2 THEN 'FAMILY' ELSE 'SPECIES' END AS base, count(*)::BIGINT AS n
      FROM (SELECT p_size % 5 AS i, (['FAMILY', 'SUBFAMILY', 'SPECIES', 'VARIETY', 'FORM'])[p_size % 5 + 1] AS r FROM part) GROUP BY ALL""",
    "q_kingdoms": f"""WITH k AS (SELECT DISTINCT {_KINGDOM}[p_partkey % 9 + 1] AS a, {_KINGDOM}[p_size % 9 + 1] AS b FROM part)
      SELECT a, b, (a = b OR 'INCERTAE_SEDIS' IN (a, b) OR (a IN ('CHROMISTA', 'PROTOZOA') AND b IN ('ANIMALIA', 'FUNGI', 'PLANTAE', 'CHROMISTA', 'PROTOZOA'))
        OR (b IN ('CHROMISTA', 'PROTOZOA') AND a IN ('ANIMALIA', 'FUNGI', 'PLANTAE')) OR (a IN ('ARCHAEA', 'BACTERIA') AND b IN ('ARCHAEA', 'BACTERIA')))::INTEGER AS matches,
        CASE WHEN 'INCERTAE_SEDIS' IN (a, b) THEN 7 WHEN a = b THEN 10 WHEN a IN ('ARCHAEA', 'BACTERIA', 'CHROMISTA', 'FUNGI', 'PROTOZOA') AND b IN ('ARCHAEA', 'BACTERIA', 'CHROMISTA', 'FUNGI', 'PROTOZOA') THEN 8 ELSE -10 END AS score FROM k""",
    "q_fuzzy_pairs": """WITH m AS (SELECT lower(n_name) AS name FROM nation UNION SELECT lower(p_name) FROM part)
      SELECT a.name AS query, b.name, damerau_levenshtein(a.name, b.name)::INTEGER AS edits FROM m a JOIN m b ON a.name[1] = b.name[1] AND a.name <> b.name
      WHERE damerau_levenshtein(a.name, b.name) <= CASE WHEN length(a.name) > 10 THEN 2 ELSE 1 END""",
    "q_exact_lookup": "SELECT s_suppkey AS qid, n_nationkey::BIGINT AS key FROM supplier JOIN nation ON n_name = 'NATION_' || (s_nationkey + 3)",
    "q_match_climb": "SELECT s_suppkey AS qid, CASE WHEN s_suppkey % 2 = 0 THEN n_nationkey ELSE n_regionkey + 1000 END::BIGINT AS key, CASE WHEN s_suppkey % 2 = 0 THEN 'EXACT' ELSE 'HIGHERRANK' END AS match_type FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "q_inherited_value": _CLOSURE + """, v AS (SELECT 'c' || c_custkey AS id, 'debt' AS value FROM customer WHERE c_acctbal < 0 UNION ALL SELECT id, name FROM tree WHERE rank = 'KINGDOM')
      SELECT value, count(*)::BIGINT AS n FROM (SELECT u.id, arg_min(v.value, u.depth) AS value FROM up u JOIN v ON v.id = u.ancestor WHERE u.id LIKE 'o%' GROUP BY u.id) GROUP BY 1""",
    "q_search_text": f"SELECT doc_id, 0.1 + CASE WHEN starts_with(lower(text), 'token') THEN 2 ELSE 0 END AS score FROM documents WHERE list_contains({_DOC_WORDS}, 'token')",
    "q_search_filtered": "SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('de', 'fr') AND n_chars >= 1000",
    "q_suggest": """SELECT p_partkey, p_name, 10.0 + CASE WHEN p_size > 25 THEN 50 ELSE 0 END AS score FROM part
      WHERE (p_name LIKE 're%' OR p_name LIKE '% re%') AND (p_name LIKE 'wi%' OR p_name LIKE '% wi%')""",
    "q_highlight": r"SELECT p_partkey, regexp_replace(p_name, '\b(red|ring)\b', '<em>\1</em>', 'g') || ' &lt;b&gt;' AS marked FROM part",
    "q_search_documents": """SELECT o_orderkey AS key, o_orderstatus, coalesce((SELECT string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey) FROM lineitem WHERE l_orderkey = o_orderkey), '') AS parts FROM orders""",
}
