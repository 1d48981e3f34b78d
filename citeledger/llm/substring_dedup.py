"""Substring dedup: seed with winnowed anchors, extend both ways, keep maximal repeats.

A repeat is a run of at least ``min_words`` words that occurs at an earlier place, places
being ordered by (doc_id, digest of the text, word).  Seeds are k-word anchors chosen by
winnowing with a window of ``min_words - k + 1``, so every repeat holds an anchor that was
chosen at both of its places.  Anchors that occur once are dropped by a shuffle on their
hash; only the rest are extended: each carries the words around it, and all ways to grow it
left and right to ``min_words`` words are compared within its group, by hashes of 8 bytes for the
anchor and 3 for each other word.  That never pairs two documents, and of an anchor that many
rows hold, only the first place of each different window is remembered.  Grown places that touch or overlap are one maximal repeat.

Defined cases: a null doc_id or null, empty or short text has no repeats.  Rows that repeat
a doc_id with the same text are one document, with other text are different ones.  Of equal
passages the first stays; a passage that repeats inside one document counts, and so do
overlapping ones.  An empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeledger.llm.words import SQL_WORDS, WORD_RE, WordHasher, fresh, inside, mix, ngram_hashes, sliding, word_spans
from citeledger.scratch import load

MIN_WORDS, ANCHOR_WORDS = 50, 25
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Bytes of hash that each word beside an anchor is compared by; the anchor itself has 8.
WORD_BYTES = 3
#: Rows that are grown at once; bounds memory, not the result.
CHUNK_ROWS = 60_000


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"), "text"
    ).where("doc_id is not null and text is not null")


def anchors(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(anchor, doc_id, digest, word): the winnowed k-word anchors of all documents."""
    width = min_words - k + 1

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        pad = np.full(width - 1, _TOP)
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for s in hasher.slices(batch.column(2).to_pylist()):
                grams = ngram_hashes(s.hashes, k)
                if not len(grams):
                    continue
                ok = inside(s.first, len(s.hashes), k)
                grams[~ok] = _TOP
                low = sliding(np.concatenate([pad, grams, pad]), width, np.minimum)
                ok &= sliding(low, width, np.maximum) == grams
                at = np.flatnonzero(ok)
                own = np.searchsorted(s.first, at, side="right") - 1
                long_enough = np.diff(s.first)[own] >= min_words
                at, own = at[long_enough], own[long_enough]
                rows = s.rows[own]
                yield pa.RecordBatch.from_arrays(
                    [grams[at].view(np.int64), ids[rows], digests[rows], (at - s.first[own]).astype(np.int32)],
                    names=["anchor", "doc_id", "digest", "word"],
                )

    return _keyed(docs).mapInArrow(choose, "anchor long, doc_id long, digest long, word int")


def _contexts(k: int, reach: int):
    """Rows (anchor, doc_id, digest, word, left, right, context) of the shared anchors."""

    def surround(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            lists = batch.column(3)
            offsets, places = lists.offsets.to_numpy(), lists.flatten().to_numpy()
            offsets = offsets - offsets[0]
            for s in hasher.slices(batch.column(2).to_pylist()):
                grams = ngram_hashes(s.hashes, k)
                lo, hi = offsets[s.rows[0]], offsets[s.rows[-1] + 1]
                own = np.repeat(np.arange(len(s.rows)), np.diff(offsets[s.rows[0] : s.rows[-1] + 2]))
                word = places[lo:hi].astype(np.int64)
                left = np.minimum(word, reach)
                right = np.minimum(s.first[own + 1] - s.first[own] - word - k, reach)
                fits = right >= 0
                own, word, left, right = own[fits], word[fits], left[fits], right[fits]
                at = s.first[own] + word
                if not len(at):
                    continue
                small = np.concatenate(
                    [np.zeros(reach, np.uint32), (s.hashes >> np.uint64(40)).astype(np.uint32), np.zeros(reach + k, np.uint32)]
                )
                around = at[:, None] + np.concatenate([np.arange(reach), reach + k + np.arange(reach)])[None, :]
                packed = small[around].view(np.uint8).reshape(len(at), 2 * reach, 4)[:, :, :WORD_BYTES]
                rows = s.rows[own]
                yield pa.RecordBatch.from_arrays(
                    [
                        grams[at].view(np.int64), ids[rows], digests[rows], word.astype(np.int32),
                        left.astype(np.int8), right.astype(np.int8),
                        pa.FixedSizeBinaryArray.from_buffers(
                            pa.binary(2 * reach * WORD_BYTES), len(at), [None, pa.py_buffer(np.ascontiguousarray(packed))]
                        ).cast(pa.binary()),
                    ],
                    names=["anchor", "doc_id", "digest", "word", "left", "right", "context"],
                )

    return surround


class _Seen:
    """The first place of each grown window of the anchor that a chunk of rows ends with."""

    def __init__(self, reach: int):
        self.anchor: int | None = None
        none = np.zeros(0, np.int64)
        self.of = [(np.zeros(0, np.uint64), none, none, none.astype(np.int32))] * (reach + 1)

    def origins(self, out: int, keys: np.ndarray, places: tuple[np.ndarray, ...]) -> tuple[tuple[np.ndarray, ...], np.ndarray]:
        """The places of keys, or the first ones that were seen, and which were."""
        known, *first = self.of[out]
        if not len(known):
            return places, np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        there = known[at] == keys
        return tuple(np.where(there, f[at], p) for f, p in zip(first, places, strict=True)), there

    def add(self, out: int, anchor: int, keys: np.ndarray, places: tuple[np.ndarray, ...]) -> None:
        """Keys and places that are new, of the last anchor."""
        old = self.of[out] if anchor == self.anchor else tuple(x[:0] for x in self.of[out])
        joined = [np.concatenate(x) for x in zip(old, (keys, *places), strict=True)]
        order = np.argsort(joined[0], kind="stable")
        self.of[out] = tuple(x[order] for x in joined)


def _grown(reach: int):
    """For each anchor: the ways to grow it that an earlier place shares, as bits, and the first such document.

    Rows come in the order of anchor and place and are taken some at a time.  Of an anchor that
    goes on, only the first place of each different window is remembered, not its rows.
    """

    def grow_rows(table: pa.Table, seen: _Seen) -> pa.RecordBatch:
        table = table.combine_chunks()
        anchor, ids, digests, word, left, right = (table.column(i).to_numpy() for i in range(6))
        n = len(anchor)
        raw = table.column(6).chunk(0)
        data = np.frombuffer(raw.buffers()[2], np.uint8)[raw.offset * 2 * reach * WORD_BYTES :][: n * 2 * reach * WORD_BYTES]
        wide = np.zeros((n, 2 * reach, 4), np.uint8)
        wide[:, :, :WORD_BYTES] = data.reshape(n, 2 * reach, WORD_BYTES)
        around = wide.view(np.uint32)[:, :, 0].astype(np.uint64)
        step = np.uint64(0x9E3779B97F4A7C15)
        lefts, rights = [anchor.view(np.uint64)], [np.zeros(n, np.uint64)]
        for j in range(reach):
            lefts.append(mix(lefts[-1] + (around[:, reach - 1 - j] + np.uint64(1)) * step))
            rights.append(mix(rights[-1] + (around[:, reach + j] + np.uint64(1)) * step))
        bits, first = np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
        last = int(anchor[-1])
        for out in range(reach + 1):
            have = np.flatnonzero((left >= out) & (right >= reach - out))
            key = lefts[out][have] ^ (rights[reach - out][have] * np.uint64(0xD6E8FEB86659FD93))
            by = np.argsort(key, kind="stable")
            keys, own = key[by], have[by]
            start = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
            origin = own[np.maximum.accumulate(np.where(start, np.arange(len(own)), 0))] if len(own) else own
            (doc, digest, place), there = seen.origins(out, keys, (ids[origin], digests[origin], word[origin]))
            later = (doc != ids[own]) | (digest != digests[own]) | (place != word[own])
            hit = own[later]
            bits[hit] |= 1 << out
            first[hit] = np.minimum(first[hit], doc[later])
            fresh_keys = start & ~there & (anchor[own] == last)
            new = own[fresh_keys]
            seen.add(out, last, keys[fresh_keys], (ids[new], digests[new], word[new]))
        seen.anchor = last
        found = bits > 0
        return pa.RecordBatch.from_arrays(
            [ids[found], digests[found], word[found], bits[found], first[found]], names=["doc_id", "digest", "word", "grown", "first"]
        )

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, size = _Seen(reach), [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= CHUNK_ROWS:
                yield grow_rows(pa.Table.from_batches(held), seen)
                held, size = [], 0
        if held:
            yield grow_rows(pa.Table.from_batches(held), seen)

    return grow


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, k: int = ANCHOR_WORDS) -> DataFrame:
    """(doc_id, digest, start_word, end_word, n_words, first_doc_id): maximal repeats to remove.

    end_word is exclusive; first_doc_id is the least document that holds a part of it first.
    """
    if not 1 < k < min_words:
        raise ValueError("k must lie between 1 and min_words")
    reach = min_words - k
    if reach > 62:
        raise ValueError("min_words - k must be at most 62")
    by_anchor = Window.partitionBy("anchor").orderBy("doc_id", "digest", "word")
    shared = (
        anchors(docs, min_words, k)
        .withColumn("near", F.lag("doc_id").over(by_anchor).isNotNull() | F.lead("doc_id").over(by_anchor).isNotNull())
        .where("near")
        .groupBy("doc_id", "digest")
        .agg(F.sort_array(F.collect_set("word")).alias("places"))
    )
    around = (
        _keyed(docs)
        .join(shared, ["doc_id", "digest"])
        .select("doc_id", "digest", "text", "places")
        .mapInArrow(_contexts(k, reach), "anchor long, doc_id long, digest long, word int, left byte, right byte, context binary")
    )
    grown = (
        around.repartition("anchor")
        .sortWithinPartitions("anchor", "doc_id", "digest", "word")
        .mapInArrow(_grown(reach), "doc_id long, digest long, word int, grown long, first long")
    )
    runs = grown.groupBy("doc_id", "digest").agg(F.collect_list(F.struct("word", "grown", "first")).alias("hits"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: [] for c in ("doc_id", "digest", "start_word", "end_word", "n_words", "first_doc_id")}
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten()
            words, bits, firsts = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            ids, digests = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(batch.num_rows):
                w, b, f = (x[offsets[i] : offsets[i + 1]] for x in (words, bits, firsts))
                on = (b[:, None] >> np.arange(reach + 1)) & 1 > 0
                at = (w[:, None] - np.arange(reach + 1))[on]
                origin = np.repeat(f, on.sum(1))
                order = np.argsort(at, kind="stable")
                at, origin = at[order], origin[order]
                new = np.flatnonzero(np.concatenate([[True], at[1:] > at[:-1] + min_words]))
                last = np.concatenate([new[1:], [len(at)]]) - 1
                rows["doc_id"].append(np.full(len(new), ids[i]))
                rows["digest"].append(np.full(len(new), digests[i]))
                rows["start_word"].append(at[new].astype(np.int64))
                rows["end_word"].append(at[last].astype(np.int64) + min_words)
                rows["n_words"].append(at[last].astype(np.int64) + min_words - at[new])
                rows["first_doc_id"].append(np.minimum.reduceat(origin, new))
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([np.concatenate(v) for v in rows.values()], names=list(rows))

    return runs.mapInArrow(
        merge, "doc_id long, digest long, start_word long, end_word long, n_words long, first_doc_id long"
    )


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words start..end of each span and what lies between them."""
    places = word_spans(text)
    out, at = [], 0
    for start, end in sorted(spans):
        end = min(end, len(places))
        if start >= end:
            continue
        out.append(text[at : max(at, places[start, 0])])
        at = max(at, int(places[end - 1, 1]))
    out.append(text[at:])
    return "".join(out)


def without_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with the spans (doc_id, digest, start_word, end_word) cut from their texts.

    Documents of which no word is left go; those without spans stay as they are, also with a
    null doc_id or text.  n_chars follows the new text, if there is such a column.
    """
    doc, digest, found = fresh(docs.columns, "doc", "digest", "found")
    lists = spans.groupBy(F.col("doc_id").alias(doc), F.col("digest").alias(digest)).agg(
        F.collect_list(F.struct("start_word", "end_word")).alias(found)
    )

    @F.pandas_udf("string")
    def cut(text, found):
        return text.combine(found, lambda t, s: cut_words(t, [(int(x["start_word"]), int(x["end_word"])) for x in s]))

    cut = cut.asNondeterministic()
    merged = docs.withColumn(doc, F.col("doc_id").cast("long")).withColumn(digest, F.xxhash64("text")).join(lists, [doc, digest], "left")
    hit = F.col(found).isNotNull() & F.col("text").isNotNull()
    own = [F.col(f"`{c}`") for c in docs.columns]
    out = merged.where(hit).withColumn("text", cut("text", found)).where(F.col("text").rlike(WORD_RE.pattern))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*own).unionByName(merged.where(~hit).select(*own))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(load(spark, sf_dir, "documents")).drop("digest")


SQL = f"""
WITH w AS (SELECT doc_id, {SQL_WORDS} AS ws FROM documents WHERE doc_id IS NOT NULL),
g AS (
  SELECT doc_id, unnest(range(len(ws) - {MIN_WORDS - 1})) AS place, ws FROM w WHERE len(ws) >= {MIN_WORDS}
),
h AS (SELECT doc_id, place, md5(array_to_string(ws[place + 1 : place + {MIN_WORDS}], ' ')) AS gram FROM g),
f AS (
  SELECT doc_id, place, row_number() OVER (PARTITION BY gram ORDER BY doc_id, place) AS nth,
         first_value(doc_id) OVER (PARTITION BY gram ORDER BY doc_id, place) AS origin
  FROM h
),
r AS (
  SELECT doc_id, place, origin,
         CASE WHEN place > lag(place) OVER (PARTITION BY doc_id ORDER BY place) + {MIN_WORDS} THEN 1 ELSE 0 END AS jump
  FROM f WHERE nth > 1
),
i AS (SELECT doc_id, place, origin, sum(jump) OVER (PARTITION BY doc_id ORDER BY place) AS island FROM r)
SELECT doc_id, min(place) AS start_word, max(place) + {MIN_WORDS} AS end_word,
       max(place) + {MIN_WORDS} - min(place) AS n_words, min(origin) AS first_doc_id
FROM i GROUP BY doc_id, island
"""
