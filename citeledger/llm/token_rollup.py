"""Token totals by source, language and tokenizer version, maintained by signed deltas.

A batch is rows (op, source, lang, tokenizer, tokens, old_tokens): "insert" adds a document and
its tokens, "delete" takes both away, "revise" replaces old_tokens by tokens.  ``commit`` sums a
batch to one signed row a key and writes it under its name; the write's success marker is the
commit.  A name that is committed is left alone, one that broke off is written anew, so any
batch may be sent again.  ``totals`` adds up what is committed; ``compact`` folds it into one
snapshot that remembers the names it holds.  Totals are additive: the order of batches is free.

Tokens are counted by byte-level BPE: a tokenizer version is the name of a vocabulary file in
``folder`` (token and rank a line), read by the driver and sent to the workers, some MB whatever
the corpus.  Where the folder lacks one of those files, op7 fails and names it; counts by
``PATTERNS`` are a query of their own.

Defined cases: null source, lang or tokenizer is a key value of its own; null counts are 0 tokens;
rows of an unknown or null op are refused when the batch is committed.  Repeated rows count
each.  Keys whose documents are all gone are left out.  An empty batch commits nothing but its
name; totals of no batches are empty.  Other columns are not read.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.scratch import keep, load, shared_folder

KEYS = ["source", "lang", "tokenizer"]
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"
FOLDER = "/opt/tokenizers"
VOCABULARIES = ("byte_bpe_50k", "byte_bpe_multi_50k")
#: How a text is parted before pairs of bytes are merged.
PARTS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Tokenizer versions that need no vocabulary: name -> pattern of a token.
PATTERNS = {"blanks-1": r"[^ \t\n\r\f]+", "pieces-1": r"[A-Za-z]+|[0-9]|[^\x00-\x7f]+|[!-/:-@\[-`{-~]"}


class Rollup:
    """The committed batches below a folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path

    def _files(self, path: str):
        return self._paths(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _there(self, path: str) -> bool:
        return self._files(path).exists(self._paths(f"{path}/_SUCCESS"))

    def _named(self, kind: str) -> list[str]:
        root = self._paths(f"{self.folder}/{kind}")
        files = self._files(self.folder)
        if not files.exists(root):
            return []
        names = sorted(s.getPath().getName() for s in files.listStatus(root))
        return [n for n in names if self._there(f"{self.folder}/{kind}/{n}")]

    def committed(self) -> set[str]:
        held = {r["batch"] for r in self._snapshot_names().collect()} if self._named("snapshots") else set()
        return held | set(self._named("batches"))

    def _snapshot_names(self) -> DataFrame:
        return self.spark.read.schema("batch string").parquet(f"{self.folder}/names/{self._named('snapshots')[-1]}")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Whether the batch was new; one that is committed changes nothing."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"not a batch name: {batch}")
        if batch in self.committed():
            return False
        sign = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0)
        sign = F.when(sign.isNull(), F.raise_error(F.concat(F.lit("no such op: "), F.coalesce("op", F.lit("null"))))).otherwise(sign)
        tokens, old = (F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) for c in ("tokens", "old_tokens"))
        signed = changes.select(
            *KEYS, sign.cast("long").alias("docs"), F.when(F.col("op") == "revise", tokens - old).otherwise(sign * tokens).alias("tokens")
        )
        signed.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.mode("overwrite").parquet(
            f"{self.folder}/batches/{batch}"
        )
        return True

    def _sums(self) -> DataFrame:
        paths = [f"{self.folder}/batches/{n}" for n in self._named("batches")]
        if snapshots := self._named("snapshots"):
            held = {r["batch"] for r in self._snapshot_names().collect()}
            paths = [p for p in paths if p.rpartition("/")[2] not in held] + [f"{self.folder}/snapshots/{snapshots[-1]}"]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*paths).groupBy(*KEYS).agg(
            F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")
        )

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) of what is there."""
        return self._sums().where("docs <> 0 or tokens <> 0")

    def compact(self) -> None:
        """One snapshot instead of the batches so far; the names are written before it counts."""
        names = sorted(self.committed())
        nth = f"{len(self._named('snapshots')):09d}-{uuid.uuid4().hex}"
        self.spark.createDataFrame([(n,) for n in names], "batch string").write.parquet(f"{self.folder}/names/{nth}")
        self._sums().write.parquet(f"{self.folder}/snapshots/{nth}")


def vocabularies(folder: str = FOLDER, names: tuple[str, ...] = VOCABULARIES) -> dict[str, bytes]:
    """The vocabulary files by version; empty unless all are there."""
    files = {n: Path(folder) / f"{n}.tiktoken" for n in names}
    return {n: f.read_bytes() for n, f in files.items()} if all(f.is_file() for f in files.values()) else {}


def encoder(name: str, ranks: bytes):
    """The byte-level BPE of a vocabulary file's content."""
    import tiktoken

    merged = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(None, ranks.split(b"\n")))}
    return tiktoken.Encoding(name, pat_str=PARTS, mergeable_ranks=merged, special_tokens={})


def _keyed(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.md5(F.coalesce("text", F.lit(""))).alias("copy")]


def counted_by_patterns(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, copy, one column for each of ``PATTERNS``): token counts of every row."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(*_keyed(docs), *(F.regexp_count(text, F.lit(p)).cast("long").alias(n) for n, p in PATTERNS.items()))


def counted(docs: DataFrame, versions: dict[str, bytes]) -> DataFrame:
    """(doc_id, source, lang, copy, one column for each version): token counts of every row."""
    held = docs.sparkSession.sparkContext.broadcast(versions)
    names = ["doc_id", "source", "lang", "copy", *versions]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = [encoder(n, ranks) for n, ranks in held.value.items()]
        for batch in batches:
            texts = batch.column(4).to_pylist()
            columns = [pa.array([len(e.encode_ordinary(t)) if t else 0 for t in texts], pa.int64()) for e in encoders]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=names)

    kinds = ", ".join(f"`{n}` long" for n in versions)
    rows = docs.select(*_keyed(docs), F.col("text").cast("string").alias("body"))
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("source", "lang")})
    return rows.mapInArrow(count, f"doc_id long, source string, lang string, copy string, {kinds}")


def rolled_up(facts: DataFrame, first: str, second: str) -> DataFrame:
    """Totals of facts after four batches, one of them sent twice.

    All documents come in under both versions with the first one's counts; those that the second
    version counts otherwise are revised; of documents with one text all but the least doc_id go,
    which is to take all out and the least ones in again.
    """
    spark = facts.sparkSession
    rollup = Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    none = F.lit(None).cast("long").alias("old_tokens")

    def of(rows: DataFrame, op: str, name: str, tokens: str, old=none) -> DataFrame:
        return rows.select(F.lit(op).alias("op"), "source", "lang", F.lit(name).alias("tokenizer"), F.col(f"`{tokens}`").alias("tokens"), old)

    loaded = of(facts, "insert", first, first).union(of(facts, "insert", second, first))
    rollup.commit("load", loaded)
    changed = facts.where(F.col(f"`{first}`") != F.col(f"`{second}`"))
    rollup.commit("recount", of(changed, "revise", second, second, F.col(f"`{first}`").alias("old_tokens")))
    # no row of a text that many documents share waits for the others: a partial minimum
    least = facts.groupBy("copy").agg(F.min(F.struct("doc_id", "source", "lang", F.col(f"`{first}`"), F.col(f"`{second}`"))).alias("d")).select("d.*")
    both = lambda rows, op: of(rows, op, first, first).union(of(rows, op, second, second))
    rollup.commit("copies", both(facts, "delete").union(both(least, "insert")))
    rollup.commit("load", loaded)
    rollup.compact()
    return rollup.totals()


def op7_token_rollup(spark: SparkSession, sf_dir: str, folder: str = FOLDER) -> DataFrame:
    versions = vocabularies(folder)
    if not versions:
        gone = [f"{n}.tiktoken" for n in VOCABULARIES if not (Path(folder) / f"{n}.tiktoken").is_file()]
        raise FileNotFoundError(f"{folder} lacks the vocabularies {', '.join(gone)}; token_rollup_by_patterns needs none")
    return rolled_up(keep(counted(load(spark, sf_dir, "documents"), versions), "token-counts"), *versions)


def token_rollup_by_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same batches with the versions that SQL can count by."""
    return rolled_up(keep(counted_by_patterns(load(spark, sf_dir, "documents")), "token-counts"), *PATTERNS)


def _sql_count(pattern: str) -> str:
    return f"len(regexp_extract_all(coalesce(text, ''), '{pattern}'))::BIGINT"


SQL = f"""
WITH n AS (
  SELECT source, lang, {", ".join(f'{_sql_count(p)} AS "{n}"' for n, p in PATTERNS.items())},
         row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id NULLS FIRST, source, lang) AS nth
  FROM documents
)
{" UNION ALL ".join(f'''SELECT source, lang, '{n}' AS tokenizer, count(*)::BIGINT AS docs, sum("{n}")::BIGINT AS tokens
FROM n WHERE nth = 1 GROUP BY source, lang''' for n in PATTERNS)}
"""
