"""Queries over the driver tables that exercise each operator, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeledger.functions import identifiers as ids
from citeledger.functions.names import people
from citeledger.functions.text import fold
from citeledger.operators import relations as rel
from citeledger.operators.compare import consultations
from citeledger.operators.resolve import latest_notices, merged_notices, resolve, routed
from citeledger.plans import derived
from citeledger.plans.audit import AuditOptions, Registries, audit
from citeledger.scratch import keep, load
from citeledger.suggest import suggested_fields

Spark = SparkSession


def fold_names(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", fold(F.concat_ws(" & ", "p_name", "p_brand")).alias("folded"))


def fold_documents(spark: Spark, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", F.md5(fold(F.col("text"))).alias("folded"))


def doi_keys(spark: Spark, d: str) -> DataFrame:
    text = F.concat(F.lit("see (https://doi.org/10.1234/P("), F.col("p_partkey"), F.lit(")), or doi:10.5555/Q."), F.col("p_size"), F.lit("."))
    return load(spark, d, "part").select("p_partkey", F.array_join(ids.extract_dois(text), " ").alias("dois"))


def parsed_fields(spark: Spark, d: str) -> DataFrame:
    page = F.concat(F.when(F.col("p_size") > 25, "e00").otherwise("00"), F.col("p_partkey"), F.lit("--"), F.col("p_size"))
    return load(spark, d, "part").select(
        "p_partkey", ids.parse_year(F.concat(F.lit("in "), F.lit(1950) + F.col("p_size"), F.lit("-05"))).alias("year"),
        ids.first_page(page).alias("page"), ids.is_article_number(F.concat(F.lit("e"), F.col("p_partkey"))).alias("article"),
        ids.normalize_kind(F.when(F.col("p_size") > 25, "Journal Article").otherwise(F.col("p_type"))).alias("kind"),
    )


def isbn_keys(spark: Spark, d: str) -> DataFrame:
    raw = F.concat(F.lpad(F.col("p_partkey").cast("string"), 9, "0"), F.lit("-"), F.col("p_size") % 10)
    return load(spark, d, "part").select("p_partkey", F.coalesce(ids.normalize_isbn13(raw), F.lit("")).alias("isbn13"))


def _registries(spark: Spark, d: str) -> dict[str, DataFrame]:
    return {"crossref": derived.registry(spark, d), "datacite": derived.second(spark, d), "pubmed": derived.medical(spark, d)}


def resolution(spark: Spark, d: str) -> DataFrame:
    found = resolve(routed(derived.stored(spark, d)), _registries(spark, d))
    present = F.transform("records", lambda r: r["source"])
    found = found.withColumn("consulted", consultations(present, F.col("asked"), F.array().cast("array<string>")))
    states = {n: F.col("consulted")[n] for n in ("crossref", "datacite", "pubmed")}
    return found.select(
        "pos", "route", "lookup", F.coalesce("primary.source", F.lit("")).alias("main"), F.coalesce("corroborator.source", F.lit("")).alias("second"),
        *(c.alias(n) for n, c in states.items()),
    )


def _audited(spark: Spark, d: str) -> DataFrame:
    # results are a table: what reads them doesn't judge again
    return keep(audit(derived.stored(spark, d), Registries(_registries(spark, d))).select("pos", "key", "kind", "verdict", "issues", "suppressed"), "audited")


def issues(spark: Spark, d: str) -> DataFrame:
    every = F.explode(F.concat("issues", "suppressed")).alias("i")
    return _audited(spark, d).select("pos", every).select("pos", "i.field", "i.kind", "i.severity")


def verdicts(spark: Spark, d: str) -> DataFrame:
    return _audited(spark, d).select("pos", "verdict")


def verdict_counts(spark: Spark, d: str) -> DataFrame:
    return _audited(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


def errors_by_field(spark: Spark, d: str) -> DataFrame:
    found = _audited(spark, d).select(F.explode("issues").alias("i")).where("i.severity = 'error'")
    return found.groupBy(F.col("i.field").alias("field")).agg(F.count("*").alias("n"))


RULES = [("part1*", "container", "*", "spelt so by the publisher"), ("*", "year", "mismatch", "checked by hand")]


def suppression(spark: Spark, d: str) -> DataFrame:
    out = audit(derived.stored(spark, d), Registries(_registries(spark, d)), AuditOptions(rules=tuple(RULES)))
    return out.select("pos", "verdict", F.size("issues").cast("long").alias("left"), F.array_join(F.transform("suppressed", lambda i: i["kind"]), " ").alias("moved"))


def richest_per_customer(spark: Spark, d: str) -> DataFrame:
    best = rel.richest(load(spark, d, "orders"), "o_custkey", F.col("o_totalprice"), "o_orderkey")
    return best.select("o_custkey", "o_orderkey", "first_pos")


def latest_with_tombstones(spark: Spark, d: str) -> DataFrame:
    e = load(spark, d, "events")
    nature = F.when(F.col("event_type") == "purchase", "Retraction").when(F.col("event_type") == "error", "Reinstatement").when(F.col("event_type") == "view", "").otherwise("correction")
    rows = e.select(F.concat(F.lit("10."), "user_id").alias("doi"), F.col("event_id").alias("seq"), nature.alias("nature"), F.lit("").alias("notice_doi"), F.col("ts").alias("at"))
    return latest_notices(rows).select("doi", "kind", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))


def notices_merged(spark: Spark, d: str) -> DataFrame:
    o = load(spark, d, "orders")

    def side(status: str, kind: str, source: str) -> DataFrame:
        by = o.where(F.col("o_orderstatus") == status).groupBy(F.concat(F.lit("10."), "o_custkey").alias("doi")).agg(F.min("o_orderkey").cast("string").alias("notice_doi"))
        return by.withColumns({"kind": F.lit(kind), "source": F.lit(source)})

    return merged_notices(side("F", "correction", "retraction-watch"), side("O", "retraction", "pubmed"))


def duplicate_texts(spark: Spark, d: str) -> DataFrame:
    found = rel.duplicates(load(spark, d, "documents"), F.md5("text"), "doc_id")
    return found.select("value", F.array_join(F.col("members").cast("array<string>"), " ").alias("members"), "n")


def fuzzy_titles(spark: Spark, d: str) -> DataFrame:
    """Pairs of distinct folded part and type names that are 95 % alike."""
    names = load(spark, d, "part").select(fold(F.concat_ws(" ", "p_name", "p_type")).alias("title_key")).distinct()
    return rel.fuzzy_duplicates(names.select(F.col("title_key").alias("key"), "title_key"))


def cited_keys(spark: Spark, d: str) -> DataFrame:
    c = load(spark, d, "conversations").withColumn("body", F.concat(F.lit("as ["), F.lit("@key"), F.col("conv_id"), F.lit("; @fig-x] and @"), F.col("role"), F.lit(". "), "text"))
    index = rel.citekey_index(rel.citekeys(c, "body"), ["conv_id", "turn"])
    return index.select("citekey", F.size("locators").cast("long").alias("n"), F.col("locators")[0]["conv_id"].alias("first_conv"))


def geography(spark: Spark, d: str) -> DataFrame:
    """Everything below each region, through nations to suppliers."""
    n = load(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    s = load(spark, d, "supplier").select(F.concat(F.lit("n"), "s_nationkey").alias("parent"), F.concat(F.lit("s"), "s_suppkey").alias("child"))
    roots = load(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node"))
    return rel.descendants(n.union(s), roots)


def pivoted_parts(spark: Spark, d: str) -> DataFrame:
    facts = load(spark, d, "part").select("p_partkey", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in ("p_name", "p_brand", "p_type")))).alias("f"))
    out = rel.pivoted(facts.select("p_partkey", "f.name", "f.value"), "p_partkey", "name", "value")
    return out.select("p_partkey", *(F.col("attributes")[c].alias(c) for c in ("p_name", "p_brand", "p_type")))


def ordered_lines(spark: Spark, d: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey")))
    out = load(spark, d, "lineitem").groupBy("l_orderkey").agg(rows.alias("rows"))
    return out.select("l_orderkey", F.array_join(F.transform("rows", lambda r: r["l_partkey"].cast("string")), " ").alias("parts"))


def parsed_bylines(spark: Spark, d: str) -> DataFrame:
    raw = F.concat(F.element_at(F.split("p_name", " "), 1), F.lit(", A. and B. van "), F.element_at(F.split("p_name", " "), -1), F.lit(" & "), F.col("p_brand"), F.lit(" Group"))
    named = load(spark, d, "part").select("p_partkey", people(F.concat(raw, F.lit(", X"))).alias("p"))
    return named.select("p_partkey", F.size("p").cast("long").alias("n"), F.col("p")[1]["family"].alias("second"), F.col("p")[0]["given"].alias("given"))


def suggestions(spark: Spark, d: str) -> DataFrame:
    return suggested_fields(_audited(spark, d)).select("pos", "field", "value")


def queries() -> dict:
    every = (
        fold_names, fold_documents, doi_keys, parsed_fields, isbn_keys, resolution, issues, verdicts, verdict_counts, errors_by_field,
        suppression, richest_per_customer, latest_with_tombstones, notices_merged, duplicate_texts, fuzzy_titles,
        cited_keys, geography, pivoted_parts, ordered_lines, parsed_bylines, suggestions,
    )
    return {q.__name__: q for q in every}


_ISSUES = """
SELECT p_partkey AS pos, x.field, x.kind, x.severity FROM part, (VALUES
  (3, 'title', 'cosmetic', 'info'), (5, 'title', 'registry-artifact', 'info'), (7, 'year', 'alternate-date', 'info'),
  (11, 'volume', 'missing', 'warning'), (13, 'year', 'mismatch', 'error'), (17, 'authors', 'count', 'warning'),
  (19, 'doi', 'unresolved', 'error'), (31, 'status', 'retracted', 'error'), (37, 'container', 'mismatch', 'error'),
  (43, 'container', 'disputed', 'info')
) AS x(size, field, kind, severity) WHERE p_size = x.size"""
_VERDICT = """CASE p_size WHEN 3 THEN 'COSMETIC' WHEN 5 THEN 'REGISTRY-ARTIFACT' WHEN 11 THEN 'INCOMPLETE' WHEN 13 THEN 'FIELD-MISMATCH'
  WHEN 17 THEN 'INCOMPLETE' WHEN 19 THEN 'BAD-ID' WHEN 31 THEN 'RETRACTED' WHEN 37 THEN 'FIELD-MISMATCH' WHEN 43 THEN 'DISPUTED' ELSE 'OK' END"""
_FOLD = "trim(regexp_replace(strip_accents(lower(replace({0}, '&', ' and '))), '[^a-z0-9]+', ' ', 'g'))"


def oracle_sql() -> dict[str, str]:
    first = "p_size = 37 AND p_partkey::VARCHAR LIKE '1%' OR p_size = 43 AND p_partkey::VARCHAR LIKE '1%'"
    return {
        "fold_names": f"SELECT p_partkey, {_FOLD.format(chr(40) + 'p_name || chr(32) || chr(38) || chr(32) || p_brand' + chr(41))} AS folded FROM part",
        "doi_keys": "SELECT p_partkey, '10.1234/p(' || p_partkey || ') 10.5555/q.' || p_size AS dois FROM part",
        "parsed_fields": """SELECT p_partkey, (1950 + p_size)::INT AS year, CASE WHEN p_size > 25 THEN 'e' ELSE '' END || p_partkey AS page,
            len(p_partkey::VARCHAR) >= 3 AS article, CASE WHEN p_size > 25 THEN 'article' ELSE 'other' END AS kind FROM part""",
        "isbn_keys": """WITH r AS (SELECT p_partkey, p_size, lpad(p_partkey::VARCHAR, 9, '0') AS b FROM part),
            k AS (SELECT *, list_sum([(11 - i) * b[i - 0]::INT FOR i IN range(1, 10)]) AS t10,
                  38 + list_sum([CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END * b[i]::INT FOR i IN range(1, 10)]) AS t13 FROM r)
            SELECT p_partkey, CASE WHEN (t10 + p_size % 10) % 11 = 0 THEN '978' || b || ((10 - t13 % 10) % 10)::INT ELSE '' END AS isbn13 FROM k""",
        "resolution": """SELECT p_partkey AS pos, 'doi' AS route, '10.1234/part.' || p_partkey AS lookup,
            CASE WHEN p_size = 19 THEN '' WHEN p_size = 23 THEN 'datacite' ELSE 'crossref' END AS main,
            CASE WHEN p_size > 40 THEN 'pubmed' ELSE '' END AS second, 'answered' AS crossref,
            CASE WHEN p_size IN (19, 23) THEN 'answered' ELSE 'not-asked' END AS datacite, 'answered' AS pubmed FROM part""",
        "issues": _ISSUES,
        "verdicts": f"SELECT p_partkey AS pos, {_VERDICT} AS verdict FROM part",
        "verdict_counts": f"SELECT {_VERDICT} AS verdict, count(*) AS n FROM part GROUP BY 1",
        "errors_by_field": f"SELECT field, count(*) AS n FROM ({_ISSUES}) WHERE severity = 'error' GROUP BY field",
        "suppression": f"""SELECT p_partkey AS pos,
            CASE WHEN p_size = 13 OR {first} THEN 'ADJUDICATED' ELSE {_VERDICT} END AS verdict,
            (CASE WHEN p_size IN (3, 7, 11, 17, 19, 31) OR p_size IN (37, 43) AND NOT ({first}) THEN 1 ELSE 0 END)::BIGINT AS "left",
            CASE WHEN p_size = 5 THEN 'registry-artifact' WHEN p_size = 13 THEN 'suppressed:mismatch'
                 WHEN p_size = 37 AND ({first}) THEN 'suppressed:mismatch' WHEN p_size = 43 AND ({first}) THEN 'suppressed:disputed' ELSE '' END AS moved
            FROM part""",
        "richest_per_customer": """SELECT o_custkey, o_orderkey, first_pos FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey) AS first_pos,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS nth FROM orders) WHERE nth = 1""",
        "latest_with_tombstones": """SELECT '10.' || user_id AS doi, CASE event_type WHEN 'purchase' THEN 'retraction' WHEN 'view' THEN 'retraction' ELSE 'correction' END AS kind,
            strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS nth FROM events)
            WHERE nth = 1 AND event_type <> 'error'""",
        "notices_merged": """WITH a AS (SELECT '10.' || o_custkey AS doi, min(o_orderkey)::VARCHAR AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1),
            b AS (SELECT '10.' || o_custkey AS doi, min(o_orderkey)::VARCHAR AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
            SELECT coalesce(a.doi, b.doi) AS doi, CASE WHEN b.doi IS NULL THEN 'correction' ELSE 'retraction' END AS kind, coalesce(a.n, b.n) AS notice_doi,
            CASE WHEN b.doi IS NULL THEN 'retraction-watch' WHEN a.doi IS NULL THEN 'pubmed' ELSE 'pubmed,retraction-watch' END AS source
            FROM a FULL JOIN b ON a.doi = b.doi""",
        "duplicate_texts": "SELECT md5(text) AS value, array_to_string(list_slice(list(doc_id ORDER BY doc_id), 1, 20), ' ') AS members, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1",
        "cited_keys": """WITH k AS (SELECT 'key' || conv_id AS citekey, conv_id FROM conversations UNION ALL SELECT role, conv_id FROM conversations)
            SELECT citekey, count(*) AS n, min(conv_id) AS first_conv FROM k GROUP BY citekey""",
        "geography": """WITH RECURSIVE e AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
            UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier),
            t AS (SELECT 'r' || r_regionkey AS root, 'r' || r_regionkey AS node, 0 AS depth FROM region
            UNION ALL SELECT root, child, depth + 1 FROM t JOIN e ON node = parent) SELECT root, node, depth FROM t""",
        "pivoted_parts": "SELECT p_partkey, p_name, p_brand, p_type FROM part",
        "ordered_lines": "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parts FROM lineitem GROUP BY l_orderkey",
        "suggestions": "SELECT p_partkey AS pos, 'volume' AS field, p_size::VARCHAR AS value FROM part WHERE p_size = 11",
    }
