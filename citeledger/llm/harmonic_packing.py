"""Harmonic packing of documents into sequences of fixed capacity.

A document's length is its number of words.  Class k holds the lengths in
(capacity / (k + 1), capacity / k], the last class, ``classes``, all shorter ones: any k
documents of class k fit a bin.  So a bin of class k takes exactly k documents, and workers
fill their bins without knowing of each other: rows go to one of ``buckets`` by the digest
of doc_id, and within a bucket and class consecutive doc_ids share a bin.  The number of
buckets follows the number of rows, so that a bucket stays small and part-filled last bins
(at most one for each class and bucket) stay rare.

Defined cases: a document longer than the capacity is cut into pieces of the capacity, each
filling a bin of class 1, and a rest that is packed like a document.  One without words, or
with null text, is in no bin (piece 0, class 0, null bin).  A null doc_id counts as a value
of its own; repeated rows are packed each.  Ties in doc_id are broken by length, equal rows
are interchangeable.  An empty table gives an empty result.  Other columns are not read.

``sequences`` gives the bins themselves, one row each with the texts of its pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeledger.scratch import load

CAPACITY, CLASSES, BUCKET_ROWS, SEPARATOR = 2048, 64, 20_000, "\n\n"
_WORDS = r"[^ \t\n\r\f]+"


def _placed(docs: DataFrame, capacity: int, classes: int, bucket_rows: int, *carried: Column) -> DataFrame:
    """The pieces with their class, bucket, place and number of bin."""
    if capacity < 1 or not 1 <= classes <= capacity:
        raise ValueError("classes must lie between 1 and the capacity")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_WORDS)).cast("long").alias("words"), *carried,
    )
    buckets = max(1, -(-docs.count() // bucket_rows))
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bucket = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % buckets
    pieces = (
        sized.withColumn("bucket", bucket)
        .withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.ceil((F.col("words") - 1) / capacity) - 1).cast("long"))))
        .withColumn("n_words", F.least(F.lit(capacity).cast("long"), F.col("words") - F.col("piece") * capacity))
        .withColumn(
            "class",
            F.when(F.col("n_words") == 0, 0).otherwise(F.least(F.lit(classes), F.expr(f"int({capacity} div greatest(n_words, 1))"))).cast("long"),
        )
    )
    place = F.row_number().over(
        Window.partitionBy("bucket", "class").orderBy(F.col("doc_id").asc_nulls_first(), "words", "piece")
    )
    number = F.expr("(place - 1) div greatest(class, 1)")
    return pieces.withColumn("place", place.cast("long")).withColumn("number", number)


def pack(
    docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, bucket_rows: int = BUCKET_ROWS
) -> DataFrame:
    """(doc_id, piece, n_words, class, bin): one row for each piece of each document.

    A bin is named class-bucket-number; its pieces add up to ``capacity`` words at most.
    """
    return _placed(docs, capacity, classes, bucket_rows).select(
        "doc_id", "piece", "n_words", "class",
        F.when(F.col("class") > 0, F.concat_ws("-", "class", "bucket", "number")).alias("bin"),
    )


def sequences(
    docs: DataFrame, capacity: int = CAPACITY, classes: int = CLASSES, bucket_rows: int = BUCKET_ROWS, separator: str = SEPARATOR
) -> DataFrame:
    """(bin, class, n_words, doc_ids, text): the bins, each with its pieces' texts in order of their places.

    A text that is not cut stays as it is; of one that is cut, the pieces are its words with a
    blank between.  Bins are filled where ``pack`` places them: text moves once.
    """
    placed = _placed(docs, capacity, classes, bucket_rows, F.col("text").alias("body")).where("class > 0")
    words = F.slice(F.regexp_extract_all("body", F.lit(_WORDS), F.lit(0)), (F.col("piece") * capacity + 1).cast("int"), F.lit(capacity))
    body = F.when(F.col("words") <= capacity, F.col("body")).otherwise(F.array_join(words, " "))
    # a bin holds at most ``classes`` pieces and ``capacity`` words
    filled = placed.groupBy("bucket", "class", "number").agg(
        F.sum("n_words").alias("n_words"), F.array_sort(F.collect_list(F.struct("place", "doc_id", body.alias("body")))).alias("held")
    )
    return filled.select(
        F.concat_ws("-", "class", "bucket", "number").alias("bin"), "class", "n_words", F.transform("held", lambda h: h["doc_id"]).alias("doc_ids"),
        F.array_join(F.transform("held", lambda h: h["body"]), separator).alias("text"),
    )


def op9_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(load(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::BIGINT AS words,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT % greatest(1, (count(*) OVER () + {BUCKET_ROWS - 1}) // {BUCKET_ROWS}) AS bucket
  FROM documents
),
p AS (
  SELECT *, unnest(range(greatest(1, (words + {CAPACITY - 1}) // {CAPACITY})))::BIGINT AS piece FROM d
),
s AS (SELECT *, least({CAPACITY}, words - piece * {CAPACITY}) AS n_words FROM p),
c AS (SELECT *, CASE WHEN n_words = 0 THEN 0 ELSE least({CLASSES}, {CAPACITY} // n_words) END AS class FROM s),
n AS (
  SELECT *, row_number() OVER (PARTITION BY bucket, class ORDER BY doc_id NULLS FIRST, words, piece) AS place FROM c
)
SELECT doc_id, piece, n_words, class::BIGINT AS class,
       CASE WHEN class > 0 THEN class || '-' || bucket || '-' || ((place - 1) // class) END AS bin
FROM n
"""
