"""Quality rule: how far a document's histograms lie from those of its language.

The reference of a language is made of all its documents: the shares of six character classes
(a-z, A-Z, 0-9, white space, other ASCII, the rest) and the shares of its *common words*,
the words that make up at least ``least_share`` of its words, with one class for all others.
A document's distance is the Jensen-Shannon distance (root of the divergence in bits, 0 to 1).

Common words are found exactly without counting rare ones: each slice of text gives the words
that reach half of ``least_share`` in it, with their counts there; a common word's counts in
those slices must exceed that half by half of ``least_share`` of the language, which at most
2 / least_share words do.  Only these are then counted.

Defined cases: a text of fewer than ``least_words`` words (also null or empty) is too short to
judge: distances null, verdict "short", kept.  A null lang is a language of its own.  Repeated
rows are counted and judged each; a null doc_id too.  A language without words has no common
words, and nothing of it is judged.  An empty table gives an empty result.  Other columns are
not read.  A document is "divergent", and not kept, where either distance is above its limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.llm.words import SQL_WORDS, WordHasher
from citeledger.scratch import keep, load

LEAST_SHARE, LEAST_WORDS, MOST_CHARS_JSD, MOST_WORDS_JSD = 0.005, 50, 0.25, 0.36
CLASSES = 6
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13, 32]] = 0, 1, 2, 3
_CLASS[128:192], _CLASS[192:] = 6, 5  # continuation bytes count with their first


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("lang"), "text")


def _word_keys(hashes: list[bytes]) -> np.ndarray:
    return WordHasher()([0], [b" ".join(hashes)]).hashes if hashes else np.zeros(0, np.uint64)


def _slice_candidates(share: float):
    """(lang, word, n, total): words that reach the share within a slice; word null: the slice's total."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for s in hasher.slices(batch.column(1).to_pylist()):
                names, code = np.unique([langs[i] for i in s.rows], return_inverse=True)
                of = code[s.owner()]
                out: tuple[list, list, list, list] = ([], [], [], [])
                for k, name in enumerate(names.tolist()):
                    at = np.flatnonzero(of == k)
                    if not len(at):
                        continue
                    _, first, n = np.unique(s.hashes[at], return_index=True, return_counts=True)
                    often = np.flatnonzero(n >= share * len(at))
                    found = [s.word(i).decode("utf-8", "replace") for i in at[first[often]]]
                    for column, values in zip(out, ([name] * (len(found) + 1), [*found, None], [*n[often].tolist(), 0], [len(at)] * (len(found) + 1)), strict=True):
                        column.extend(values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.int64())],
                    names=["lang", "word", "n", "total"],
                )

    return find


def candidates(docs: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """(lang, word): at most 2 / least_share words of each language, its common words among them."""
    counted = (
        _texts(docs).select("lang", "text")
        .mapInArrow(_slice_candidates(least_share / 2), "lang string, word string, n long, total long")
        .groupBy("lang", "word").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    all_words = F.max(F.when(F.col("word").isNull(), F.col("total")))
    by_lang = counted.groupBy("lang").agg(all_words.alias("all"), F.collect_list(F.struct("word", "n", "total")).alias("found"))
    half = least_share / 2
    return by_lang.select("lang", "all", F.explode("found").alias("f")).where(
        F.col("f.word").isNotNull() & (F.col("f.n") - half * F.col("f.total") >= half * F.col("all") * (1 - 1e-9))
    ).select("lang", "f.word")


def histograms(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """(doc_id, lang, n_words, chars, places, counts): of each row, over its language's words."""
    keys = {lang: _word_keys([w.encode() for w in found]) for lang, found in words.items()}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        orders = {lang: np.argsort(k) for lang, k in keys.items()}
        for batch in batches:
            langs, texts = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for s in hasher.slices(texts):
                n = len(s.rows)
                own = s.owner()
                held = [(texts[i] or "").encode("utf-8", "replace") for i in s.rows]
                lengths = np.array([len(x) for x in held])
                chars = np.zeros((n, CLASSES), np.int64)
                full = np.flatnonzero(lengths)
                if len(full):
                    data = _CLASS[np.frombuffer(b"".join(held), np.uint8)]
                    begins = (np.cumsum(lengths) - lengths)[full]
                    for c in range(CLASSES):
                        chars[full, c] = np.add.reduceat(data == c, begins, dtype=np.int64)
                rows, places, counts = [], [], []
                own_lang = np.array([langs[i] for i in s.rows], object)[own] if len(own) else np.zeros(0, object)
                for lang in set(own_lang.tolist()):
                    order = orders.get(lang)
                    if order is None or not len(order):
                        continue
                    at = np.flatnonzero(own_lang == lang)
                    k = keys[lang][order]
                    near = np.minimum(np.searchsorted(k, s.hashes[at]), len(k) - 1)
                    hit = k[near] == s.hashes[at]
                    pair, times = np.unique(own[at[hit]] * len(k) + order[near[hit]], return_counts=True)
                    rows.append(pair // len(k))
                    places.append(pair % len(k))
                    counts.append(times)
                row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
                by = np.argsort(row, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(offsets, (np.concatenate(x)[by] if x else np.zeros(0, np.int64)).astype(np.int32))
                    for x in (places, counts)
                ]
                take = pa.array(s.rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(take), batch.column(1).take(take), pa.array(np.diff(s.first).astype(np.int64)),
                        pa.ListArray.from_arrays(np.arange(0, CLASSES * n + 1, CLASSES, dtype=np.int32), chars.ravel()), *lists,
                    ],
                    names=["doc_id", "lang", "n_words", "chars", "places", "counts"],
                )

    return _texts(docs).mapInArrow(
        count, "doc_id long, lang string, n_words long, chars array<long>, places array<int>, counts array<int>"
    )


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance in bits of each row of p and q, which add up to 1."""
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(-1) + np.where(q > 0, q * np.log2(q / m), 0).sum(-1)
    return np.sqrt(np.maximum(d / 2, 0))


def divergence(
    docs: DataFrame, least_share: float = LEAST_SHARE, least_words: int = LEAST_WORDS,
    most_chars: float = MOST_CHARS_JSD, most_words: float = MOST_WORDS_JSD,
) -> DataFrame:
    """(doc_id, lang, n_words, char_jsd, word_jsd, verdict, keep) of each row; distances to 6 places."""
    # at most 2 / least_share words of each language
    found: dict[str, list[str]] = {}
    for row in candidates(docs, least_share).orderBy("lang", "word").collect():
        found.setdefault(row["lang"], []).append(row["word"])
    counted = keep(histograms(docs, found), "histograms")
    sums = [F.sum(F.col("chars")[i]).alias(f"c{i}") for i in range(CLASSES)]
    totals = {r["lang"]: r for r in counted.groupBy("lang").agg(F.sum("n_words").alias("n"), *sums).collect()}
    times = counted.select("lang", F.explode(F.arrays_zip("places", "counts")).alias("x")).groupBy("lang", "x.places").agg(
        F.sum("x.counts").alias("n")
    )
    n_of = {(r["lang"], r["places"]): r["n"] for r in times.collect()}
    references = {}
    for lang, t in totals.items():
        n, words = t["n"] or 0, found.get(lang, [])
        common = [i for i in range(len(words)) if n_of.get((lang, i), 0) >= least_share * n > 0]
        to = np.full(len(words), len(common))
        to[common] = np.arange(len(common))
        shares = np.array([n_of[lang, i] for i in common] + [n - sum(n_of[lang, i] for i in common)], float)
        chars = np.array([t[f"c{i}"] or 0 for i in range(CLASSES)], float)
        references[lang] = (to, shares / max(n, 1), chars / max(chars.sum(), 1))
    held = docs.sparkSession.sparkContext.broadcast(references)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs = np.array(batch.column(1).to_pylist(), object)
            n_words = batch.column(2).to_numpy()
            chars = batch.column(3).flatten().to_numpy().reshape(n, CLASSES).astype(float)
            offsets = batch.column(4).offsets.to_numpy()
            own = np.repeat(np.arange(n), np.diff(offsets))
            places, counts = batch.column(4).flatten().to_numpy(), batch.column(5).flatten().to_numpy()
            d = np.full((n, 2), np.nan)
            for lang in set(langs.tolist()):
                to, shares, ref = held.value[lang]
                at = np.flatnonzero((langs == lang) & (n_words >= max(1, least_words)))
                if not len(at):
                    continue
                row = np.full(n, -1)
                row[at] = np.arange(len(at))
                size = len(shares)
                mine = row[own] >= 0
                h = np.bincount(row[own[mine]] * size + to[places[mine]], counts[mine], minlength=len(at) * size).reshape(len(at), size)
                h[:, -1] = n_words[at] - h[:, :-1].sum(1)
                d[at, 0] = js_distance(chars[at] / chars[at].sum(1, keepdims=True), ref)
                d[at, 1] = js_distance(h / n_words[at][:, None], shares)
            short = np.isnan(d[:, 0])
            off = ~short & ((d[:, 0] > most_chars) | (d[:, 1] > most_words))
            verdict = np.where(short, "short", np.where(off, "divergent", "ok"))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2),
                    pa.array(np.round(d[:, 0], 6), mask=short), pa.array(np.round(d[:, 1], 6), mask=short),
                    pa.array(verdict.tolist(), pa.string()), pa.array(~off),
                ],
                names=["doc_id", "lang", "n_words", "char_jsd", "word_jsd", "verdict", "keep"],
            )

    return counted.mapInArrow(
        judge, "doc_id long, lang string, n_words long, char_jsd double, word_jsd double, verdict string, keep boolean"
    )


def op3_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(load(spark, sf_dir, "documents"))


_SQL_CLASSES = [r"[^a-z]", r"[^A-Z]", r"[^0-9]", r"[^ \t\n\v\f\r]", None, r"[\x00-\x7f]"]
_OTHERS = " - ".join(f"c{i}" for i in (0, 1, 2, 3, 5))


def _sql_terms(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"(CASE WHEN {p} > 0 THEN {p} * log2({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2({q} / {m}) ELSE 0 END) / 2"


SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS body, {SQL_WORDS} AS ws FROM documents
),
k AS (
  SELECT r, doc_id, lang, ws, len(ws)::BIGINT AS n_words, length(body) AS c,
         {", ".join(f"length(regexp_replace(body, '{x}', '', 'g')) AS c{i}" for i, x in enumerate(_SQL_CLASSES) if x)}
  FROM d
),
k2 AS (SELECT *, c - ({_OTHERS.replace(" - ", " + ")}) AS c4 FROM k),
w AS (SELECT r, lang, n_words, unnest(ws) AS word FROM k2),
t AS (SELECT lang, sum(n_words) AS n, sum(c) AS c, {", ".join(f"sum(c{i}) AS t{i}" for i in range(6))} FROM k2 GROUP BY lang),
common AS (
  SELECT lang, word, count(*) / max(t.n) AS q FROM w JOIN t USING (lang) GROUP BY lang, word HAVING count(*) >= {LEAST_SHARE} * max(t.n)
),
rest AS (SELECT lang, 1 - coalesce(sum(q), 0) AS q, count(word) AS n FROM t LEFT JOIN common USING (lang) GROUP BY lang),
own AS (SELECT r, word, count(*) AS n FROM w JOIN common USING (lang, word) GROUP BY r, word),
grid AS (
  SELECT k2.r, common.q, coalesce(own.n, 0) / k2.n_words AS p
  FROM k2 JOIN common USING (lang) LEFT JOIN own ON own.r = k2.r AND own.word = common.word WHERE k2.n_words >= {LEAST_WORDS}
),
s AS (SELECT r, sum({_sql_terms("p", "q")}) AS jsd, sum(p) AS p FROM grid GROUP BY r),
j AS (
  SELECT k2.r, coalesce(s.jsd, 0) + {_sql_terms("greatest(0, 1 - coalesce(s.p, 0))", "greatest(0, rest.q)")} AS word_jsd,
         {" + ".join(_sql_terms(f"(c{i} / k2.c)", f"(t{i} / t.c)") for i in range(6))} AS char_jsd
  FROM k2 JOIN rest USING (lang) JOIN t USING (lang) LEFT JOIN s USING (r) WHERE k2.n_words >= {LEAST_WORDS}
),
o AS (
  SELECT k2.doc_id, k2.lang, k2.n_words, round(sqrt(CASE WHEN char_jsd < 0 THEN 0 ELSE char_jsd END), 6) AS char_jsd,
         round(sqrt(CASE WHEN word_jsd < 0 THEN 0 ELSE word_jsd END), 6) AS word_jsd
  FROM k2 LEFT JOIN j USING (r)
)
SELECT *, CASE WHEN char_jsd IS NULL THEN 'short' WHEN char_jsd > {MOST_CHARS_JSD} OR word_jsd > {MOST_WORDS_JSD} THEN 'divergent' ELSE 'ok' END AS verdict,
       NOT (char_jsd IS NOT NULL AND (char_jsd > {MOST_CHARS_JSD} OR word_jsd > {MOST_WORDS_JSD})) AS keep
FROM o
"""
