"""Resolution: references meet registry rows through left, anti and full outer joins.

Registries are DataFrames of records keyed by ``key`` (normalised DOI or ISBN-13), one row a
key.  Lookups run on distinct keys, so a key that many references share is looked up once and
skew stays on the side that AQE can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeledger.functions.identifiers import normalize_doi, normalize_isbn13, strongest_identifier
from citeledger.schema import NOTICE_RANK, RECORD_FIELDS, RECORD_STRUCT


def routed(refs: DataFrame, search: bool = True) -> DataFrame:
    """refs with lookup key, identifier and route: doi, isbn, malformed-isbn, search or none."""
    doi, isbn = F.coalesce("doi", F.lit("")), F.coalesce("isbn", F.lit(""))
    keyed = refs.withColumns({"doi_key": F.nullif(normalize_doi(F.col("doi")), F.lit("")), "isbn_key": normalize_isbn13(F.col("isbn"))})
    route = (
        F.when(doi != "", "doi").when((isbn != "") & F.col("isbn_key").isNotNull(), "isbn").when(isbn != "", "malformed-isbn")
        .otherwise("search" if search else "none")
    )
    return keyed.withColumns(
        {
            "route": route,
            "lookup": F.when(doi != "", F.col("doi_key")).otherwise(F.col("isbn_key")),
            "identifier": strongest_identifier(F.col("doi"), F.col("pmid"), F.col("arxiv"), F.col("isbn")),
        }
    ).drop("doi_key", "isbn_key")


def record_of(registry: DataFrame) -> Column:
    """The columns of a registry row as one record; those it lacks are null."""
    return F.struct(*((F.col(n) if n in registry.columns else F.lit(None)).cast(kind).alias(n) for n, kind in RECORD_FIELDS))


def lookup_keys(refs: DataFrame, route: str) -> DataFrame:
    """(key): the distinct keys of routed references of one route."""
    return refs.where((F.col("route") == route) & F.col("lookup").isNotNull()).select(F.col("lookup").alias("key")).distinct()


def with_roles(rows: DataFrame) -> DataFrame:
    """rows with primary and corroborator taken from records.

    The first or else the second registry leads, corroborated by the medical index; that leads
    alone where neither has the work, and after it any other source, in order of names.
    """
    of = lambda name: F.get(F.filter("records", lambda r: r["source"] == name), F.lit(0))
    main = F.coalesce(of("crossref"), of("datacite"))
    least = F.get(F.array_sort(F.transform("records", lambda r: r["source"])), F.lit(0))
    other = F.get(F.filter("records", lambda r: r["source"] == least), F.lit(0))
    return rows.withColumns({"primary": F.coalesce(main, of("pubmed"), other), "corroborator": F.when(main.isNotNull(), of("pubmed"))})


def resolve(refs: DataFrame, registries: dict[str, DataFrame], unreachable: list[str] = (), notices: bool = False) -> DataFrame:
    """Routed refs with records, primary, corroborator and asked.

    The second registry is asked only for what the first lacks, and only where the first
    answered; the medical index for every DOI; books for ISBNs.  ``notices``: notice tables are
    asked too.  A registry that is unreachable, or not given, has no records.
    """
    up = {n: r for n, r in registries.items() if n not in unreachable}
    dois, isbns = lookup_keys(refs, "doi"), lookup_keys(refs, "isbn")
    found = []
    if "crossref" in up:
        found.append(dois.join(up["crossref"], "key"))
    if "datacite" in up and "crossref" not in unreachable:
        left = dois.join(up["crossref"].select("key"), "key", "left_anti") if "crossref" in up else dois
        found.append(left.join(up["datacite"], "key"))
    if "pubmed" in up:
        found.append(dois.join(up["pubmed"], "key"))
    if "openlibrary" in up:
        found.append(isbns.join(up["openlibrary"], "key"))
    empty = F.array().cast("array<string>")
    none = F.array().cast(f"array<{RECORD_STRUCT}>")
    if found:
        every = found[0].select("key", record_of(found[0]).alias("record"))
        for part in found[1:]:
            every = every.unionByName(part.select("key", record_of(part).alias("record")))
        # a handful of registries: a record of each at most
        by_key = every.groupBy(F.col("key").alias("lookup")).agg(F.collect_list("record").alias("records"))
        joined = refs.join(by_key, "lookup", "left").withColumn("records", F.coalesce("records", none))
    else:
        joined = refs.withColumn("records", none)
    held = F.exists("records", lambda r: r["source"] == "crossref")
    asked = F.when(F.col("lookup").isNull(), empty).when(
        F.col("route") == "doi",
        F.array_compact(
            F.array(
                F.lit("crossref"),
                F.when(~held & F.lit("crossref" not in unreachable), "datacite"),
                F.lit("pubmed" if "pubmed" in registries or notices else None),
                F.lit("retraction-watch" if notices else None),
            )
        ),
    ).when((F.col("route") == "isbn") & F.lit("openlibrary" in registries), F.array(F.lit("openlibrary"))).otherwise(empty)
    return with_roles(joined.withColumn("asked", asked))


def bridged(dois: DataFrame, ids: DataFrame, records: DataFrame) -> DataFrame:
    """Records by DOI through a bridge: dois(key) - ids(key, pmid) - records(pmid, ...)."""
    return dois.join(ids, "key").join(records, "pmid")


def latest_notices(rows: DataFrame) -> DataFrame:
    """(doi, kind, notice_doi, at): the latest of rows (seq, doi, nature, notice_doi, at) a DOI.

    Unknown natures are left out before recency counts, a blank one is a retraction, undated
    rows come first in time, of equal times the first row stays; a reinstatement that is the
    latest removes the DOI.
    """
    nature = F.trim(F.lower(F.coalesce("nature", F.lit(""))))
    kind = (
        F.when(nature == "", "retraction").when(nature.isin("retraction", "correction", "reinstatement"), nature)
        .when(nature == "expression of concern", "expression-of-concern")
    )
    last = F.row_number().over(Window.partitionBy("doi").orderBy(F.col("at").desc_nulls_last(), "seq"))
    return (
        rows.withColumn("kind", kind).where("kind is not null and startswith(doi, '10.')")
        .withColumn("nth", last).where("nth = 1 and kind <> 'reinstatement'").select("doi", "kind", "notice_doi", "at")
    )


def merged_notices(left: DataFrame, right: DataFrame) -> DataFrame:
    """Full outer join of two notice tables (doi, kind, notice_doi, source): the worse kind wins."""
    ranks = F.array(*(F.lit(k) for k in NOTICE_RANK))
    rank = lambda c: F.when(c.isNull(), 99).otherwise(F.coalesce(F.nullif(F.array_position(ranks, c), F.lit(0)), F.lit(98)))
    a, b = left.alias("a"), right.alias("b")
    return a.join(b, F.col("a.doi") == F.col("b.doi"), "full").select(
        F.coalesce("a.doi", "b.doi").alias("doi"),
        F.when(rank(F.col("a.kind")) <= rank(F.col("b.kind")), F.col("a.kind")).otherwise(F.col("b.kind")).alias("kind"),
        F.coalesce("a.notice_doi", "b.notice_doi").alias("notice_doi"),
        F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array("a.source", "b.source")))), ",").alias("source"),
    )


def with_notices(resolved: DataFrame, notices: DataFrame, key: str = "lookup") -> DataFrame:
    """resolved with notices (doi, kind, source) in the records of references that have some.

    A notice of the medical index marks its record, or adds a bare one; one of the notice table
    adds a record of that source.  Keys without records gain none.
    """
    n = notices.select(F.col("doi").alias("n_doi"), F.col("kind").alias("n_kind"), F.split("source", ",").alias("n_sources"))
    mark = lambda r: r.withField("retracted", F.lit(True)).withField("retraction_kind", F.col("n_kind"))
    given = {"doi": F.col("n_doi"), "identifier": F.col("n_doi"), "retracted": F.lit(True), "retraction_kind": F.col("n_kind")}
    bare = lambda source: F.struct(
        *((F.lit(source) if n == "source" else given.get(n, F.lit(None))).cast(kind).alias(n) for n, kind in RECORD_FIELDS)
    )
    medical = F.array_contains("n_sources", "pubmed")
    marked = F.transform("records", lambda r: F.when(medical & (r["source"] == "pubmed"), mark(r)).otherwise(r))
    lacks = ~F.exists("records", lambda r: r["source"] == "pubmed")
    more = F.array_compact(
        F.array(F.when(medical & lacks, bare("pubmed")), F.when(F.array_contains("n_sources", "retraction-watch"), bare("retraction-watch")))
    )
    hit = F.col("n_doi").isNotNull() & (F.size("records") > 0)
    joined = resolved.join(n, F.col(key) == F.col("n_doi"), "left")
    out = joined.withColumn("records", F.when(hit, F.concat(marked, more)).otherwise(F.col("records"))).drop("n_doi", "n_kind", "n_sources")
    return with_roles(out)


def wanted_notices(index: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of a notice index (doi, ...) whose DOI is a wanted key."""
    return index.join(keys.select(F.col("key").alias("doi")).distinct(), "doi", "left_semi")
