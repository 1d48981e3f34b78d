"""Benchmark decontamination with an FM-index for each training shard.

A test phrase is ``n`` consecutive words of a benchmark item (the whole item where it has
fewer, but ``least`` at least).  Each worker builds, shard by shard, an FM-index over the
words of its documents: suffix array by prefix doubling, BWT, wavelet matrix with rank
counts, sampled suffix positions.  All phrases are searched backward through the ranks at
once, hits are located by LF steps to a sampled position, and overlapping hits in a document
merge into removal spans.

The alphabet of an index is that of the phrases.  Any other word, and any run of phrase
words too short to hold a phrase, becomes a separator: no phrase holds one, so the search
finds the same hits in a far smaller index.

Defined cases: null ids or texts, empty texts and empty tables have no hits; items of fewer
than ``least`` words are not searched for.  Repeated rows of a document count once, equal
items count as the one with the least id.  Only doc_id, text and item_id are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeledger.llm.words import SQL_WORDS, WordHasher, words_of
from citeledger.scratch import load

PHRASE_WORDS, LEAST_WORDS = 8, 5
#: Words of an index; a shard that has more gets several. Bounds memory, not the result.
INDEX_WORDS = 400_000
SAMPLE_EVERY = 16
#: Benchmark words that are sent to the workers at once; a larger benchmark takes several scans.
BENCHMARK_WORDS = 4_000_000


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends are smaller than any symbol."""
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_symbols = symbols[order]
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], (sorted_symbols[1:] != sorted_symbols[:-1]).astype(np.int64)]))
    width = 1
    while n and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], (sorted_key[1:] != sorted_key[:-1]).astype(np.int64)]))
        width *= 2
    return order


class WaveletMatrix:
    """Ranks and values of a sequence by the bits of its symbols."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        at = symbols
        starts = np.arange(1 << self.bits)
        begin = np.zeros(1 << self.bits, np.int64)
        for level in reversed(range(self.bits)):
            bit = (at >> level) & 1
            ones = np.concatenate([[0], np.cumsum(bit)]).astype(np.int32)
            zeros = len(at) - int(ones[-1])
            self.ones.append(ones)
            self.zeros.append(zeros)
            high = (starts >> level) & 1
            begin = np.where(high == 1, zeros + ones[begin], begin - ones[begin])
            at = np.concatenate([at[bit == 0], at[bit == 1]])
        self.begin = begin

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before position at."""
        for i, level in enumerate(reversed(range(self.bits))):
            ones = self.ones[i][at]
            at = np.where((symbol >> level) & 1 == 1, self.zeros[i] + ones, at - ones)
        return at - self.begin[symbol]

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbols at the positions."""
        symbol = np.zeros(len(at), np.int64)
        for i in range(self.bits):
            ones = self.ones[i][at]
            bit = self.ones[i][at + 1] - ones
            symbol = symbol * 2 + bit
            at = np.where(bit == 1, self.zeros[i] + ones, at - ones)
        return symbol


class FMIndex:
    """Backward search over symbols 1..n_symbols - 1, in which 0 separates runs."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        n = len(symbols)
        breaks = np.flatnonzero(symbols == 0)
        distinct = symbols + len(breaks)  # every separator gets its own, smaller symbol
        distinct[breaks] = np.arange(len(breaks))
        order = suffix_array(distinct)
        last = symbols[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(last, n_symbols)
        # an LF step from a run's first word would meet a separator: run starts are sampled too
        sampled = (order % SAMPLE_EVERY == 0) | (last == 0)
        self.samples = np.where(sampled, order, -1)
        self.size = n

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [lo, hi) of the suffixes that begin with each phrase (right-aligned rows)."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size)
        width = phrases.shape[1]
        for back in range(width):
            live = np.flatnonzero((lengths > back) & (lo < hi))
            if not len(live):
                continue
            symbol = phrases[live, width - 1 - back]
            lo[live] = self.before[symbol] + self.wavelet.rank(symbol, lo[live])
            hi[live] = self.before[symbol] + self.wavelet.rank(symbol, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of the rows."""
        found, steps = np.full(len(rows), -1), np.zeros(len(rows), np.int64)
        rows = rows.copy()
        live = np.arange(len(rows))
        while len(live):
            sample = self.samples[rows[live]]
            found[live[sample >= 0]] = sample[sample >= 0] + steps[live[sample >= 0]]
            live = live[sample < 0]
            symbol = self.wavelet.access(rows[live])
            rows[live] = self.before[symbol] + self.wavelet.rank(symbol, rows[live])
            steps[live] += 1
        return found


class Phrases:
    """The distinct phrases of some benchmark items, over their own alphabet 1..len(words)."""

    def __init__(self, items: list[tuple[int, str]], n: int, least: int):
        grams: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            words = words_of(text)
            if len(words) >= n:
                for i in range(len(words) - n + 1):
                    grams.setdefault(tuple(words[i : i + n]), set()).add(item)
            elif len(words) >= least:
                grams.setdefault(tuple(words), set()).add(item)
        vocabulary = sorted({w for g in grams for w in g})
        hashes = WordHasher()([0], [b" ".join(vocabulary)]).hashes if vocabulary else np.zeros(0, np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        symbol = {w: i + 1 for i, w in enumerate(vocabulary)}
        self.lengths = np.array([len(g) for g in grams], np.int64)
        self.rows = np.zeros((len(grams), max(self.lengths, default=1)), np.int64)
        for i, g in enumerate(grams):
            self.rows[i, -len(g) :] = [symbol[w] for w in g]
        self.items = [sorted(v) for v in grams.values()]
        self.shortest = int(min(self.lengths, default=1))
        self.n_symbols = len(vocabulary) + 1

    def symbols(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, self.order[at] + 1, 0)


def _searcher(phrases: Phrases):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def found() -> Iterator[pa.RecordBatch]:
            text, ids, digests, places = (np.concatenate(x) for x in zip(*held, strict=True))
            index = FMIndex(text, phrases.n_symbols)
            lo, hi = index.ranges(phrases.rows, phrases.lengths)
            which = np.repeat(np.arange(len(lo)), hi - lo)
            if not len(which):
                return
            offsets = np.arange(len(which)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
            at = index.locate(lo[which] + offsets)
            of = [phrases.items[p] for p in which]
            times = np.array([len(x) for x in of])
            again = np.repeat(np.arange(len(which)), times)
            start = places[at[again]]
            yield pa.RecordBatch.from_arrays(
                [
                    ids[at[again]], digests[at[again]], np.array([i for x in of for i in x], np.int64), start,
                    start + phrases.lengths[which[again]],
                ],
                names=["doc_id", "digest", "item_id", "start_word", "end_word"],
            )

        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in hasher.slices(batch.column(2).to_pylist()):
                if not len(s.hashes):
                    continue
                symbols = phrases.symbols(s.hashes)
                own = s.owner()
                # maximal runs of phrase words within one document
                known = symbols > 0
                new = np.concatenate([[True], (known[1:] != known[:-1]) | (own[1:] != own[:-1])])
                run = np.cumsum(new) - 1
                keep = known & (np.bincount(run)[run] >= phrases.shortest)
                at = np.flatnonzero(keep)
                if not len(at):
                    continue
                # one separator before each run
                starts = np.flatnonzero(np.concatenate([[True], run[at][1:] != run[at][:-1]]))
                text = np.insert(symbols[at], starts, 0)
                held.append((
                    text,
                    np.insert(ids[s.rows[own[at]]], starts, 0),
                    np.insert(digests[s.rows[own[at]]], starts, 0),
                    np.insert(at - s.first[own[at]], starts, 0),
                ))
                size += len(text)
                if size >= INDEX_WORDS:
                    yield from found()
                    held.clear()
                    size = 0
        if held:
            yield from found()

    return search


def hits(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, digest, item_id, start_word, end_word): every place where a phrase of an item occurs.

    digest is the text's: rows that share a doc_id but not the text are told apart by it.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id is not null and text is not null"
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text").where(
        "doc_id is not null and text is not null"
    )
    schema = "doc_id long, digest long, item_id long, start_word long, end_word long"
    found, part, size = [], [], 0

    def scan() -> None:
        phrases = Phrases(part, n, least)
        if len(phrases.items):
            found.append(texts.mapInArrow(_searcher(phrases), schema))

    for row in items.toLocalIterator():
        part.append((row["item_id"], row["text"]))
        size += len(words_of(row["text"]))
        if size >= BENCHMARK_WORDS:
            scan()
            part, size = [], 0
    scan()
    if not found:
        return spark.createDataFrame([], schema)
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def removal_spans(docs: DataFrame, benchmark: DataFrame, n: int = PHRASE_WORDS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, digest, start_word, end_word, n_words, n_items, item_id): merged spans, end exclusive.

    Hits that overlap or touch are one span; item_id is the least of its n_items items.
    """
    by_place = Window.partitionBy("doc_id", "digest").orderBy("start_word", "end_word")
    islands = (
        hits(docs, benchmark, n, least)
        .withColumn("reached", F.max("end_word").over(by_place.rowsBetween(Window.unboundedPreceding, -1)))
        .withColumn("jump", F.when(F.col("start_word") > F.col("reached"), 1).otherwise(0))
        .withColumn("island", F.sum("jump").over(by_place.rowsBetween(Window.unboundedPreceding, 0)))
    )
    return islands.groupBy("doc_id", "digest", "island").agg(
        F.min("start_word").alias("start_word"), F.max("end_word").alias("end_word"),
        (F.max("end_word") - F.min("start_word")).alias("n_words"),
        F.countDistinct("item_id").alias("n_items"), F.min("item_id").alias("item_id"),
    ).drop("island")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal_spans(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("digest")


SQL = f"""
WITH b AS (SELECT item_id, {SQL_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, array_to_string(ws[i + 1 : i + {PHRASE_WORDS}], ' ') AS phrase
  FROM (SELECT item_id, ws, unnest(range(greatest(1, len(ws) - {PHRASE_WORDS - 1}))) AS i FROM b WHERE len(ws) >= {LEAST_WORDS})
),
d AS (SELECT DISTINCT doc_id, {SQL_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
lens AS (SELECT DISTINCT len(string_split(phrase, ' ')) AS n FROM p),
g AS (
  SELECT doc_id, i, n, array_to_string(ws[i + 1 : i + n], ' ') AS phrase
  FROM (SELECT doc_id, ws, n, unnest(range(len(ws) - n + 1)) AS i FROM d, lens WHERE len(ws) >= n)
),
m AS (SELECT DISTINCT doc_id, item_id, i AS s, i + n AS e FROM g JOIN p USING (phrase)),
r AS (
  SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM m
),
k AS (
  SELECT *, sum(CASE WHEN s > reached THEN 1 ELSE 0 END)
    OVER (PARTITION BY doc_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM r
)
SELECT doc_id, min(s) AS start_word, max(e) AS end_word, max(e) - min(s) AS n_words,
       count(DISTINCT item_id) AS n_items, min(item_id) AS item_id
FROM k GROUP BY doc_id, island
"""
