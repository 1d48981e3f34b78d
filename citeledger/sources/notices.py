"""The CSV export of retraction notices, as a scan, and notices in records of the medical index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.functions.identifiers import extract_dois, normalize_doi, parse_year
from citeledger.functions.text import clean, fold
from citeledger.operators.compare import preferred_year
from citeledger.operators.resolve import latest_notices

COLUMNS = ["Record ID", "RetractionDate", "RetractionDOI", "OriginalPaperDOI", "RetractionNature"]


def notice_date(value: Column) -> Column:
    """Timestamp of month/day/year with hours and minutes, on the clock of 24 hours or of 12 with seconds."""
    text = F.trim(value)
    return F.coalesce(F.try_to_timestamp(text, F.lit("M/d/yyyy H:m")), F.try_to_timestamp(text, F.lit("M/d/yyyy h:m:s a")))


def read_notices(spark: SparkSession, path: str) -> DataFrame:
    """The export's rows as text columns, with ``seq``, their order; quoted fields may span lines."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return rows.withColumn("seq", F.monotonically_increasing_id())


def notice_rows(export: DataFrame) -> DataFrame:
    """(seq, doi, nature, notice_doi, at) of export rows (seq and ``COLUMNS``), those without an original DOI left out."""
    dois = export.select(
        "seq", normalize_doi(F.col("OriginalPaperDOI")).alias("doi"), fold(F.col("RetractionNature")).alias("nature"),
        normalize_doi(F.col("RetractionDOI")).alias("notice"), notice_date(F.col("RetractionDate")).alias("at"),
    )
    # the export says "unavailable" where there is no DOI
    return dois.where(F.col("doi").startswith("10.")).select(
        "seq", "doi", "nature", F.when(F.col("notice").startswith("10."), F.col("notice")).alias("notice_doi"), "at"
    )


def notice_index(export: DataFrame) -> DataFrame:
    """(doi, kind, notice_doi, date, source): the notice in force for each DOI."""
    return latest_notices(notice_rows(export)).select(
        "doi", "kind", "notice_doi", F.date_format("at", "yyyy-MM-dd").alias("date"), F.lit("retraction-watch").alias("source")
    )


def medical_notices(records: DataFrame) -> DataFrame:
    """(doi, kind, notice_doi, date, source) of records of the medical index (key, retracted, years, concerns).

    A record marked as retracted is one; else the first cross-reference to an expression of
    concern, with the first DOI and year in it.
    """
    citation = clean(F.get("concerns", F.lit(0)))
    years = preferred_year(F.col("years")).cast("string")
    retracted = F.coalesce("retracted", F.lit(False))
    return records.withColumn("citation", citation).where(retracted | (F.col("citation") != "")).select(
        F.col("key").alias("doi"), F.when(retracted, "retraction").otherwise("expression-of-concern").alias("kind"),
        F.when(~retracted, F.get(extract_dois(F.col("citation")), F.lit(0))).alias("notice_doi"),
        F.when(retracted, years).otherwise(parse_year(F.col("citation")).cast("string")).alias("date"), F.lit("pubmed").alias("source"),
    )
