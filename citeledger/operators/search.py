"""References without identifier: candidates of several sources, and the one that is surely meant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeledger.functions.identifiers import kind_of, normalize_doi
from citeledger.functions.names import byline_diff
from citeledger.functions.text import clean, fold, fold_each, similarity
from citeledger.operators.compare import Thresholds, compatible


def candidate_union(sources: list[DataFrame]) -> DataFrame:
    """Candidates (ref, nth, record, failed) of all sources in order, a DOI once a reference.

    Those without DOI all stay.  A row without record says that the source ``failed``.
    """
    every = None
    for rank, source in enumerate(sources):
        part = source.withColumn("rank", F.lit(rank))
        every = part if every is None else every.unionByName(part)
    keyed = every.withColumn("doi", F.nullif(normalize_doi(F.col("record.doi")), F.lit("")))
    once = F.row_number().over(Window.partitionBy("ref", "doi").orderBy("rank", "nth"))
    known = keyed.where("doi is not null").withColumn("k", once).where("k = 1").drop("k")
    return known.unionByName(keyed.where("doi is null"))


def _label() -> Column:
    title = F.concat(F.lit("'"), F.col("record.title"), F.lit("'"))
    return F.coalesce(F.nullif("record.doi", F.lit("")), F.when(F.coalesce("record.title", F.lit("")) != "", title), F.lit("a candidate"))


def scored_candidates(refs: DataFrame, candidates: DataFrame, limits: Thresholds = Thresholds()) -> DataFrame:
    """candidates of refs (pos, title, kind, year, authors) with score and why each is rejected, if it is.

    A title below the limit gives no reason.  The kind must be compatible, the candidate must
    have an author or a year, the first authors must agree and a year must lie within one.
    """
    mine = refs.select(
        F.col("pos").alias("ref"), F.col("title").alias("r_title"), F.col("year").alias("r_year"), F.slice("authors", 1, 1).alias("r_first"),
        fold(F.col("title")).alias("r_key"), kind_of(fold(F.col("kind"))).alias("r_kind"),
    )
    pairs = candidates.where("record is not null").join(mine, "ref").withColumn(
        "c_keys", fold_each(F.array(F.coalesce("record.title", F.lit("")), F.coalesce("record.kind", F.lit(""))))
    )
    pairs = pairs.withColumns({"c_key": F.get("c_keys", F.lit(0)), "c_kind": kind_of(F.get("c_keys", F.lit(1)))})
    # the ratio can't reach the limit where lengths differ too much
    short, long = (f(F.length("r_key"), F.length("c_key")) for f in (F.least, F.greatest))
    near = pairs.where((F.col("r_key") != "") & (2 * short >= limits.confirm * (short + long)))
    scored = near.withColumn("score", similarity(F.col("r_title"), F.col("record.title"), F.col("r_key"), F.col("c_key")))
    scored = scored.where(F.col("score") >= limits.confirm).withColumn("diff", byline_diff(F.col("r_first"), F.slice("record.authors", 1, 1)))
    years = F.transform(F.coalesce("record.years", F.array().cast("array<struct<slot:string,year:int>>")), lambda y: y["year"])
    someone = F.coalesce(F.size("record.authors"), F.lit(0)) > 0
    away = F.col("r_year").isNotNull() & (F.size(years) > 0) & ~F.exists(years, lambda y: F.abs(y - F.col("r_year")) <= 1)
    why = (
        F.when(~compatible(F.col("r_kind"), F.col("c_kind")), F.concat(F.lit("type "), "c_kind", F.lit(" != "), "r_kind"))
        .when(~someone & (F.size(years) == 0), "the title alone agrees, and neither author nor year backs it")
        .when(someone & (F.size("r_first") > 0) & (F.size("diff.mismatches") > 0), "first author disagrees")
        .when(away, F.concat(F.lit("year "), F.col("r_year").cast("string"), F.lit(" not among "), F.array_join(F.array_sort(years).cast("array<string>"), ", ")))
    )
    return scored.withColumn("rejection", F.concat(_label(), F.lit(": "), why)).drop("diff", "c_keys")


def confirmed(refs: DataFrame, candidates: DataFrame, limits: Thresholds = Thresholds(), shown: int = 3) -> DataFrame:
    """(ref, record, score, explanation, failed) of each reference: its best candidate, or null and why.

    Of equal scores the first wins; the first ``shown`` rejections are named.  ``failed``: the
    sources that could not be reached for it.
    """
    scored = scored_candidates(refs, candidates, limits)
    order = F.struct(F.col("rank").alias("rank"), F.col("nth").alias("nth"))
    good = scored.where("rejection is null")
    best = good.groupBy("ref").agg(
        F.min_by(F.struct("record", "score"), F.struct((-F.col("score")).alias("s"), F.col("rank"), F.col("nth"))).alias("best")
    )
    said = (
        scored.where("rejection is not null")
        .withColumn("k", F.row_number().over(Window.partitionBy("ref").orderBy("rank", "nth"))).where(F.col("k") <= shown)
        .groupBy("ref").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "rejection"))), lambda r: r["rejection"]), "; ").alias("said"))
    )
    down = candidates.where("failed is not null").groupBy("ref").agg(F.array_sort(F.collect_set("failed")).alias("failed"))
    found = F.format_string("title %.2f with author and year corroboration", F.col("best.score"))
    return (
        refs.select(F.col("pos").alias("ref")).join(best, "ref", "left").join(said, "ref", "left").join(down, "ref", "left")
        .select(
            "ref", "best.record", "best.score",
            F.when(F.col("best").isNotNull(), found).otherwise(F.coalesce("said", F.lit("no candidate above the title threshold"))).alias("explanation"),
            F.coalesce("failed", F.array().cast("array<string>")).alias("failed"),
        )
    )


def search_terms(refs: DataFrame) -> DataFrame:
    """(ref, title, surname, container, year, kind): what the sources are searched by, as display text."""
    first = F.get("authors", F.lit(0))
    surname = F.coalesce(F.nullif(first["literal"], F.lit("")), first["family"])
    return refs.select(
        F.col("pos").alias("ref"), clean(F.col("title")).alias("title"), clean(surname).alias("surname"), clean(F.col("container")).alias("container"),
        "year", kind_of(fold(F.col("kind"))).alias("kind"),
    )
