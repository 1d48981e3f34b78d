"""The audit of references against registries, as one plan."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeledger.functions.identifiers import normalize_kind
from citeledger.operators.compare import Thresholds, compared, issue, verdict
from citeledger.operators.relations import suppressed_by
from citeledger.operators.resolve import resolve, routed, with_notices, with_roles
from citeledger.operators.search import confirmed
from citeledger.schema import ISSUE, RECORD_STRUCT


@dataclass(frozen=True)
class AuditOptions:
    """What an audit asks and how it judges."""

    corroborate: bool = True
    search_unidentified: bool = True
    retraction_check: bool = True
    use_isbn: bool = True
    limits: Thresholds = field(default_factory=Thresholds)
    rules: tuple[tuple[str, str, str, str], ...] = ()


@dataclass
class Registries:
    """The tables of an audit: records by key, notices, and search candidates (ref, nth, rank, record, failed).

    ``unreachable`` names the registries that could not be asked at all; ``searched`` the
    sources that were asked for candidates.
    """

    records: dict[str, DataFrame] = field(default_factory=dict)
    notices: DataFrame | None = None
    candidates: DataFrame | None = None
    unreachable: tuple[str, ...] = ()
    searched: tuple[str, ...] = ("crossref", "europepmc", "openalex")


def _searched(refs: DataFrame, registries: Registries, options: AuditOptions, notices: DataFrame | None) -> DataFrame:
    """References without identifier, with the record that was confirmed for them."""
    best = confirmed(refs, registries.candidates, options.limits).select(
        F.col("ref").alias("pos"), F.col("record").alias("best"), "explanation", F.col("failed").alias("failed")
    )
    none = F.array().cast(f"array<{RECORD_STRUCT}>")
    books = normalize_kind(F.col("kind")).isin("book", "chapter") & F.lit(options.use_isbn)
    sources = F.array(*map(F.lit, registries.searched))
    asked = F.when(books, F.concat(sources, F.array(F.lit("openlibrary")))).otherwise(sources)
    out = refs.join(best, "pos", "left").withColumn("asked", asked)
    # only where every source failed is the reference unchecked; else the rest has answered
    all_down = F.size(F.array_except("asked", "failed")) == 0
    out = out.withColumns(
        {
            "records": F.when(F.col("best").isNotNull(), F.array("best")).otherwise(none),
            "explanation": F.when(all_down, None).otherwise(F.col("explanation")),
            "failed": F.when(all_down, F.col("failed")).otherwise(F.when(F.col("best").isNotNull(), F.col("failed")).otherwise(F.array().cast("array<string>"))),
            "found_doi": F.nullif("best.doi", F.lit("")),
        }
    )
    if notices is None:
        return with_roles(out.drop("best"))
    told = F.array(F.lit("pubmed"), F.lit("retraction-watch"))
    out = out.withColumn("asked", F.when(F.col("found_doi").isNotNull(), F.array_union("asked", told)).otherwise(F.col("asked")))
    return with_notices(out.drop("best"), notices, "found_doi")


def audit(refs: DataFrame, registries: Registries, options: AuditOptions = AuditOptions()) -> DataFrame:
    """refs with route, records, issues, suppressed, consulted, title_similarity and verdict.

    One row a reference, in no order.
    """
    records = {
        name: table for name, table in registries.records.items()
        if not (name == "pubmed" and not options.corroborate) and not (name == "openlibrary" and not options.use_isbn)
    }
    notices = registries.notices if options.retraction_check else None
    down = list(registries.unreachable)
    way = routed(refs, options.search_unidentified and registries.candidates is not None)
    known = resolve(way.where("route <> 'search'"), records, down, notices is not None)
    if notices is not None:
        known = with_notices(known, notices)
    none = F.array().cast("array<string>")
    extra = {"failed": none, "explanation": F.lit(None).cast("string"), "found_doi": F.lit(None).cast("string")}
    every = known.withColumns(extra)
    if options.search_unidentified and registries.candidates is not None:
        every = every.unionByName(_searched(way.where("route = 'search'"), registries, options, notices))
    out = compared(every, down, options.limits)
    proposed = F.when(
        F.col("found_doi").isNotNull(),
        F.array(issue("doi", "proposed", "warning", None, F.col("found_doi"), F.col("primary.source"), F.concat(F.lit("the entry has no DOI; "), "explanation"))),
    ).otherwise(F.array().cast(f"array<{ISSUE}>"))
    out = out.withColumn("issues", F.concat(proposed, "issues"))
    again = verdict(F.col("issues"), F.col("suppressed"), F.lit(True))
    out = out.withColumn("verdict", F.when(F.col("found_doi").isNotNull() & (F.col("verdict") != "RETRACTED"), again).otherwise(F.col("verdict")))
    return suppressed_by(out, list(options.rules)).drop("failed", "explanation", "found_doi")
