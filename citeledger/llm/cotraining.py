"""Quality classifier by co-training of a text-content and a page-metadata view.

The text view sees hashed distinct words and word beginnings and what its characters and
repetitions look like; the metadata view sees source, language, length and line layout.
Both are logistic regressions.  They start from a bounded sample of the labelled rows
(``max_labelled``, in the order of a hash of doc_id).  In round r every document is scored by
both, and each view hands the other documents of whose class it is ``confident``: of each class
as many as r times the share ``exchange`` of all documents, chosen by a hash of doc_id among all
that it is sure of, if it is sure of as many.  (The surest alone are too alike: one source can
fill them.)  Labelled documents are never handed over.  What is handed over grows with the corpus, so it is fitted in shards of about
``shard_rows``, each with the labelled sample in one task, and a view is the mean of its shards.
Ids that fewer than ``least_rows`` rows of a shard hold get no weight there.

A fifth of the labelled sample is never fitted: there each view is calibrated (Platt), and the
calibrated log-odds are added, less the prior counted twice.  Where that fifth, or the rest,
lacks a class, all of the sample is fitted and nothing is calibrated.

A document is good where quality is 1 and toxic is 0; a null label is not held against it.
``keep`` is score >= ``threshold``, score being the probability of good.

Defined cases: null text, lang or source count as values of their own, an empty or very long
text is scored like any other.  Labels of one doc_id that differ: the worse counts.  Repeated
rows get a row each and equal scores; of rows with one doc_id and other texts the one with the
least ids teaches, so equal tables give equal models.  A null doc_id is scored but teaches
nothing; doc_id must be a whole number or castable to one.  Without labels of both classes
every score is the share of good labels (0.5 without any) and all is kept.  Other columns are
not read, whatever their names; missing lang, source or n_chars count as null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeledger.llm.words import WordHasher, fresh, mix
from citeledger.scratch import drop, keep, load

WORD_BITS, META_BITS = 20, 12
MAX_LABELLED, ROUNDS, EXCHANGE, CONFIDENT, THRESHOLD = 20_000, 3, 0.01, 0.99, 0.5
SHARD_ROWS, LEAST_ROWS, STEPS = 5_000, 3, 150
_STYLES = 64 * 8
_SIZES = [(1 << WORD_BITS) + _STYLES, 1 << META_BITS]
_INPUT = ["text", "lang", "source", "n_chars"]
_CLASS = np.full(256, 4, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 13, 32]] = 0, 1, 2, 3
_CLASS[128:192], _CLASS[192:] = 6, 5


def _share_bin(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """0 for none of it, else 1..63 on a root scale."""
    share = np.sqrt(np.clip(part / np.maximum(whole, 1), 0, 1))
    return np.where(part > 0, 1 + np.minimum(62, (share * 32).astype(np.int64)), 0)


def _hashed(values: list, salt: int) -> np.ndarray:
    raw = [f"{salt}:{'' if v is None else '=' + str(v)}" for v in values]
    codes, at = {}, []
    for r in raw:
        if r not in codes:
            h = np.uint64(1469598103934665603)
            with np.errstate(over="ignore"):
                for b in r.encode("utf-8", "replace"):
                    h = (h ^ np.uint64(b)) * np.uint64(1099511628211)
            codes[r] = int(mix(np.array([h]))[0] >> np.uint64(64 - META_BITS))
        at.append(codes[r])
    return np.array(at, np.int64)


def _stems(s) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first five bytes of the words that have as many, and where those words are."""
    long_enough = np.flatnonzero(s.ends - s.starts >= 5)
    data = np.frombuffer(s.raw, np.uint8)
    stem = np.zeros(len(long_enough), np.uint64)
    for i in range(5):
        stem |= data[s.starts[long_enough] + i].astype(np.uint64) << np.uint64(8 * i)
    return mix(stem + np.uint64(1)), long_enough


@dataclass
class Ids:
    """Lists of ids, one a row, end to end."""

    flat: np.ndarray
    sizes: np.ndarray

    @classmethod
    def of(cls, column: pa.Array | pa.ChunkedArray) -> Ids:
        """The lists that a binary column holds as packed 32-bit integers; no row is copied on its own."""
        parts = [x for x in (column.chunks if isinstance(column, pa.ChunkedArray) else [column]) if len(x)]
        if not parts:
            return cls(np.zeros(0, np.uint32), np.zeros(0, np.int64))
        flat, sizes = [], []
        for part in parts:
            ends = np.frombuffer(part.buffers()[1], np.int64 if pa.types.is_large_binary(part.type) else np.int32)[part.offset :][: len(part) + 1]
            if ends[-1] > ends[0]:
                flat.append(np.frombuffer(part.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint32))
            sizes.append(np.diff(ends).astype(np.int64) // 4)
        flat = flat or [np.zeros(0, np.uint32)]
        return cls(flat[0] if len(flat) == 1 else np.concatenate(flat), np.concatenate(sizes))

    def packed(self) -> pa.Array:
        """The binary column that ``of`` reads."""
        ends = np.zeros(len(self.sizes) + 1, np.int32)
        np.cumsum(self.sizes * 4, out=ends[1:])
        return pa.Array.from_buffers(pa.binary(), len(self.sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.flat, np.uint32))])


def _features(hasher: WordHasher, texts, langs, sources, sizes) -> Iterator[tuple[np.ndarray, Ids, Ids]]:
    """(rows, text ids, metadata ids) of consecutive slices."""
    for s in hasher.slices(texts):
        n = len(s.rows)
        own = s.owner()
        key = np.unique((own.astype(np.int64) << WORD_BITS) | (s.hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        stems, stemmed = _stems(s)
        stem_key = np.unique((own[stemmed].astype(np.int64) << WORD_BITS) | (stems >> np.uint64(64 - WORD_BITS)).astype(np.int64))
        counts = np.bincount(own, minlength=n)
        distinct = np.bincount(key >> WORD_BITS, minlength=n)
        again = np.zeros(len(own), np.int64)
        again[1:] = (s.hashes[1:] == s.hashes[:-1]) & (own[1:] == own[:-1])
        repeated = np.bincount(own, again, minlength=n)
        held = [(texts[i] or "").encode("utf-8", "replace") for i in s.rows]
        lengths = np.array([len(x) for x in held])
        classes = np.zeros((n, 7), np.int64)
        full = np.flatnonzero(lengths)
        if len(full):
            data = _CLASS[np.frombuffer(b"".join(held), np.uint8)]
            begins = (np.cumsum(lengths) - lengths)[full]
            for c in range(7):
                classes[full, c] = np.add.reduceat(data == c, begins, dtype=np.int64)
        lines = np.array([x.count(b"\n") + 1 for x in held])
        pipes = np.array([x.count(b"|") for x in held])
        chars = classes[:, :6].sum(1)
        letters = classes[:, 0] + classes[:, 1] + classes[:, 5]
        # sublinear expectation: long texts repeat words anyway
        expected = np.maximum(1, counts**0.85)
        styles = np.stack(
            [
                _share_bin(classes[:, 1], letters), _share_bin(classes[:, 2], chars), _share_bin(classes[:, 4], chars),
                _share_bin(repeated, counts), _share_bin(distinct, expected), _share_bin(letters, counts * 16),
                _share_bin(pipes, chars), np.minimum(63, (np.log2(counts + 1) * 4).astype(np.int64)),
            ],
            axis=1,
        )
        styles += (1 << WORD_BITS) + 64 * np.arange(8)
        key = np.unique(np.concatenate([key, stem_key]))
        # each row's words, then its eight styles
        held = np.bincount(key >> WORD_BITS, minlength=n)
        flat = np.empty(len(key) + 8 * n, np.uint32)
        place = np.arange(len(key)) + 8 * (key >> WORD_BITS)
        flat[place] = key & ((1 << WORD_BITS) - 1)
        flat[(np.cumsum(held) + 8 * np.arange(n))[:, None] + np.arange(8)] = styles
        given = [sizes[i] for i in s.rows]
        meta = np.stack(
            [
                _hashed([langs[i] for i in s.rows], 1), _hashed([sources[i] for i in s.rows], 2),
                _hashed([(langs[i], sources[i]) for i in s.rows], 3),
                _hashed([None if g is None or not np.isfinite(g) else int(np.log2(max(0, g) + 1) * 2) for g in given], 4),
                _hashed(np.log2(lines).round().astype(int).tolist(), 5),
                _hashed(np.log2(np.maximum(1, chars / lines)).round().astype(int).tolist(), 6),
            ],
            axis=1,
        )
        yield s.rows, Ids(flat, held + 8), Ids(meta.astype(np.uint32).ravel(), np.full(n, meta.shape[1]))


@dataclass
class View:
    """A logistic regression over ids; calibrated as scale * logit + shift."""

    weights: np.ndarray
    bias: float
    scale: float = 1.0
    shift: float = 0.0

    def logits(self, ids: Ids) -> np.ndarray:
        sums = np.zeros(len(ids.flat) + 1)
        np.cumsum(self.weights[ids.flat], dtype=np.float64, out=sums[1:])
        ends = np.cumsum(ids.sizes)
        return sums[ends] - sums[ends - ids.sizes] + self.bias


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_view(ids: Ids, good: np.ndarray, size: int, least_rows: int, start: View | None = None) -> View:
    """Full-batch Adam on the log-loss with an L2 penalty; ids that fewer than ``least_rows`` rows hold get no weight.

    Entries are held twice, by row and by id, so that both sums run over whole 32-bit arrays.
    """
    n, y = len(ids.sizes), good.astype(np.float32)
    used = np.flatnonzero(np.bincount(ids.flat.view(np.int32), minlength=size) >= least_rows)
    place = np.full(size, -1, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    flat = place[ids.flat]
    on = flat >= 0
    held = np.bincount(np.repeat(np.arange(n, dtype=np.int32), ids.sizes)[on], minlength=n)
    # the bias is an id that every row holds last, so no row and no id is without an entry
    last = np.cumsum(held + 1) - 1
    own_id = np.ones(int(held.sum()) + n, bool)
    own_id[last] = False
    by_row, row_first = np.full(len(own_id), len(used), np.int32), last - held
    by_row[own_id] = flat[on]
    del flat, on, own_id, place
    # by id, then by row: sorted in place, as two halves of one number
    key = by_row.astype(np.int64)
    key <<= 32
    key |= np.repeat(np.arange(n, dtype=np.int32), held + 1)
    key.sort()
    by_id, id_first = key.astype(np.int32), np.searchsorted(key, np.arange(len(used) + 1) << 32)
    del key
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w = np.zeros(len(used) + 1, np.float32)
    w[-1] = np.log(share / (1 - share))
    if start is not None:
        w[:-1], w[-1] = start.weights[used], start.bias
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, STEPS + 1):
        z = np.add.reduceat(w[by_row], row_first)
        error = ((_sigmoid(z) - y) / n).astype(np.float32)
        g = np.add.reduceat(error[by_id], id_first) + np.float32(2e-5) * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= (0.1 / (1 - 0.9**t) * m / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)).astype(np.float32)
    weights = np.zeros(size, np.float32)
    weights[used] = w[:-1]
    return View(weights, float(w[-1]))


def platt(logits: np.ndarray, good: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """(scale, shift) that best turn logits into probabilities, by Newton steps on smoothed targets."""
    n1 = good.sum()
    y = np.where(good, (n1 + 1) / (n1 + 2), 1 / (len(good) - n1 + 2))
    x = np.stack([logits, np.ones(len(logits))], axis=1)
    theta = np.array([0.0, 0.0])
    for _ in range(steps):
        p = _sigmoid(x @ theta)
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - y) + 1e-4 * theta)
        theta -= step * min(1.0, 5 / (1e-9 + np.abs(step).max()))
    return max(0.0, float(theta[0])), float(theta[1])


@dataclass
class Model:
    """Both views and the log-odds of the labels; without views everything scores the prior."""

    text: View | None
    meta: View | None
    prior: float

    def scores(self, words: Ids, meta: Ids) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) by the text view, the metadata view, and both."""
        if self.text is None:
            flat = np.full(len(words.sizes), _sigmoid(np.array([self.prior]))[0])
            return flat, flat, flat
        a = self.text.logits(words) * self.text.scale + self.text.shift
        b = self.meta.logits(meta) * self.meta.scale + self.meta.shift
        return _sigmoid(a), _sigmoid(b), _sigmoid(a + b - self.prior)


def _inputs(docs: DataFrame) -> list:
    kinds = {"n_chars": "double"}
    names = fresh(docs.columns, *_INPUT)
    return [
        (F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(name)
        for c, name in zip(_INPUT, names, strict=True)
    ]


def features(docs: DataFrame, carried: bool = False) -> DataFrame:
    """(doc_id, words, meta): the ids that the views see, as packed 32-bit integers.

    ``carried``: all columns of docs, then words and meta under names that docs does not have.
    """
    first = docs if carried else docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    width = len(first.columns)
    names = [*first.columns, *fresh(first.columns, "words", "meta")]
    kinds = T.StructType([*first.schema.fields, *(T.StructField(x, T.BinaryType()) for x in names[-2:])])

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            columns = [batch.column(width + i).to_pylist() for i in range(4)]
            for rows, words, meta in _features(hasher, *columns):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(i).take(at) for i in range(width)),
                        words.packed(), meta.packed(),
                    ],
                    names=names,
                )

    own = [F.col(f"`{c}`") for c in docs.columns] if carried else [F.col("doc_id").cast("long").alias("doc_id")]
    return docs.select(*own, *_inputs(docs)).mapInArrow(compute, kinds)


def _sure(views: list[View], ids: list[Ids], slot: int, confident: float) -> np.ndarray:
    """Which rows a view is sure of; slot 2 * view + class."""
    z = views[slot // 2].logits(ids[slot // 2])
    return (z if slot % 2 else -z) >= np.log(confident / (1 - confident))


def _tally(views: list[View], confident: float):
    """(slot, n): how many rows each view is sure of by class; at -1 all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(5, np.int64)
        for batch in batches:
            ids = [Ids.of(batch.column(1)), Ids.of(batch.column(2))]
            found[:4] += [_sure(views, ids, slot, confident).sum() for slot in range(4)]
            found[4] += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([0, 1, 2, 3, -1], pa.int32()), pa.array(found)], names=["slot", "n"])

    return count


def _choose(views: list[View], confident: float, shares: list[float]):
    """(view, doc_id, good, ids) of a share of the rows of each slot, by a hash of doc_id, for the view that is taught."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = mix(batch.column(0).to_numpy().astype(np.uint64)).astype(np.float64) / 2.0**64
            ids = [Ids.of(batch.column(1)), Ids.of(batch.column(2))]
            for slot, share in enumerate(shares):
                at = np.flatnonzero((part < share) & _sure(views, ids, slot, confident))
                if len(at):
                    # each view teaches the other one
                    taught, at = 1 - slot // 2, pa.array(at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), taught, np.int32)), batch.column(0).take(at), pa.array(np.full(len(at), slot % 2 == 1)), batch.column(1 + taught).take(at)],
                        names=["view", "doc_id", "good", "ids"],
                    )

    return choose


def _fitted(examples: DataFrame, shards: list[int], least_rows: int, start: list[View] | None = None) -> list[View]:
    """The views fitted to (view, shard, doc_id, good, ids), each shard in one task, as the mean over a view's shards."""
    block = 4096

    def fit(group: pa.Table) -> pa.Table:
        view, shard = group["view"][0].as_py(), group["shard"][0].as_py()
        group = group.sort_by("doc_id")
        good, ids = group["good"].to_numpy().astype(bool), Ids.of(group["ids"])
        del group
        model = fit_view(ids, good, _SIZES[view], least_rows, start[view] if start else None)
        parts = [model.weights[i : i + block] for i in range(0, _SIZES[view], block)]
        held = [i for i, x in enumerate(parts) if x.any()]
        return pa.table(
            {
                "view": pa.array([view] * (len(held) + 1), pa.int32()), "shard": pa.array([shard] * (len(held) + 1), pa.int32()),
                "block": pa.array([-1, *held], pa.int32()),
                "part": pa.array([np.array([model.bias], np.float32).tobytes(), *(parts[i].tobytes() for i in held)], pa.binary()),
            }
        )

    def mean(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        total = np.sum([np.frombuffer(x, np.float32) for x in group["part"].to_pylist()], axis=0, dtype=np.float64)
        part = (total / shards[group["view"][0].as_py()]).astype(np.float32).tobytes()
        return pa.table({"view": group["view"][:1], "block": group["block"][:1], "part": pa.array([part], pa.binary())})

    blocks = (
        examples.groupBy("view", "shard").applyInArrow(fit, "view int, shard int, block int, part binary")
        .groupBy("view", "block").applyInArrow(mean, "view int, block int, part binary")
    )
    out = [View(np.zeros(size, np.float32), 0.0) for size in _SIZES]
    # the weights themselves, 4 MB whatever the input
    for row in blocks.toArrow().to_pylist():
        part = np.frombuffer(row["part"], np.float32)
        if row["block"] < 0:
            out[row["view"]].bias = float(part[0])
        else:
            out[row["view"]].weights[row["block"] * block :][: len(part)] = part
    return out


def _given(labels: DataFrame) -> DataFrame:
    """(doc_id, good) of the labelled documents; of labels that differ, the worse counts."""
    good = (F.min(F.coalesce("quality", F.lit(1))) == 1) & (F.max(F.coalesce("toxic", F.lit(0))) == 0)
    return (
        labels.where("doc_id is not null and (quality is not null or toxic is not null)")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(good.alias("good"))
    )


def train(
    table: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS,
    exchange: float = EXCHANGE, confident: float = CONFIDENT, shard_rows: int = SHARD_ROWS, least_rows: int = LEAST_ROWS,
) -> Model:
    """The model co-trained on ``features`` of all documents and their labels."""
    given = _given(labels)
    # at most max_labelled narrow rows, whatever the size of the corpus
    sample = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    labelled = keep(
        table.join(F.broadcast(sample), "doc_id")
        .groupBy("doc_id", "good")
        .agg(F.min(F.struct("words", "meta")).alias("row"))
        .select("doc_id", "good", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4).alias("apart"), "row.words", "row.meta"),
        "labelled",
    )
    try:
        counts = {(r["good"], r["apart"]): r["n"] for r in labelled.groupBy("good", "apart").agg(F.count("*").alias("n")).collect()}
        n_good, n_bad = (sum(n for (g, _), n in counts.items() if g is kind) for kind in (True, False))
        share = (n_good + 1) / (n_good + n_bad + 2)
        prior = float(np.log(share / (1 - share)))
        if not n_good or not n_bad:
            return Model(None, None, prior)
        # a fold that lacks a class calibrates nothing: then all is fitted and the logits stand as they are
        folds = len(counts) == 4
        base = labelled.where(~F.col("apart")) if folds else labelled

        def examples(shards: list[int], handed: DataFrame | None) -> DataFrame:
            out = None
            for view, ids in enumerate(("words", "meta")):
                part = base.select(
                    F.lit(view).alias("view"), F.explode(F.sequence(F.lit(0), F.lit(shards[view] - 1))).alias("shard"),
                    "doc_id", "good", F.col(ids).alias("ids"),
                )
                out = part if out is None else out.unionAll(part)
            if handed is not None:
                shard = F.when(F.col("view") == 0, F.pmod(F.xxhash64("doc_id"), F.lit(shards[0]))).otherwise(F.pmod(F.xxhash64("doc_id"), F.lit(shards[1])))
                out = out.unionAll(handed.select("view", shard.cast("int").alias("shard"), "doc_id", "good", "ids"))
            return out

        views = _fitted(examples([1, 1], None), [1, 1], least_rows)
        pool = table.where("doc_id is not null").select("doc_id", "words", "meta")
        for nth in range(1, rounds + 1):
            tally = dict(pool.mapInArrow(_tally(views, confident), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas().to_numpy())
            if not any(tally.get(slot) for slot in range(4)):
                break
            most = int(np.ceil(nth * exchange * tally[-1]))
            shares = [min(1.0, most / max(1, tally[slot])) for slot in range(4)]
            handed = (
                pool.mapInArrow(_choose(views, confident, shares), "view int, doc_id long, good boolean, ids binary")
                .join(given.select("doc_id"), "doc_id", "left_anti")
                .groupBy("view", "doc_id")
                .agg(F.min(F.struct("ids", "good")).alias("row"))
                .select("view", "doc_id", "row.good", "row.ids")
            )
            taught = [sum(min(most, int(tally[slot])) for slot in slots) for slots in ((2, 3), (0, 1))]
            shards = [max(1, -(-n // shard_rows)) for n in taught]
            views = _fitted(examples(shards, handed), shards, least_rows, views)
        if folds:
            # at most a fifth of max_labelled, two numbers each
            fold = _logits(labelled.where("apart"), views).toArrow()
            good = np.array(fold["good"].to_pylist(), bool)
            for view, name in zip(views, ("text", "meta"), strict=True):
                view.scale, view.shift = platt(fold[name].to_numpy(), good)
        return Model(*views, prior)
    finally:
        drop(labelled)


def _logits(labelled: DataFrame, views: list[View]) -> DataFrame:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = views[0].logits(Ids.of(batch.column(1))), views[1].logits(Ids.of(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(a), pa.array(b)], names=["good", "text", "meta"])

    rows = labelled.orderBy("doc_id").select("good", "words", "meta")
    return rows.mapInArrow(score, "good boolean, text double, meta double")


def scored(table: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for each row of ``features``."""
    held = table.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, both = held.value.scores(Ids.of(batch.column(1)), Ids.of(batch.column(2)))
                good = both >= threshold if held.value.text is not None else np.ones(len(both), bool)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(a), pa.array(b), pa.array(both), pa.array(good)],
                    names=["doc_id", "text_score", "meta_score", "score", "keep"],
                )

    return table.select("doc_id", "words", "meta").mapInArrow(
        score, "doc_id long, text_score double, meta_score double, score double, keep boolean"
    )


def without_rejected(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """docs without the rows that the classifier rejects; no shuffle of the documents, features computed once."""
    table = keep(features(docs, carried=True), "features")
    words, meta = table.columns[-2:]
    ids = [F.col(f"`{words}`").alias("words"), F.col(f"`{meta}`").alias("meta")]
    model = train(table.select(F.col("doc_id").cast("long").alias("doc_id"), *ids), labels, **settings)
    held = docs.sparkSession.sparkContext.broadcast(model)
    width = len(docs.columns)

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
            if held.value.text is not None:
                both = held.value.scores(Ids.of(batch.column(width)), Ids.of(batch.column(width + 1)))[2]
                part = part.filter(pa.array(both >= threshold))
            yield part

    return table.mapInArrow(accept, docs.schema)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = keep(features(load(spark, sf_dir, "documents")), "features")
    return scored(table, train(table, load(spark, sf_dir, "labels")))
