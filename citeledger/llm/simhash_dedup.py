"""SimHash near-dedup by meet-in-the-middle ball hashing.

A document's signature is ``tables`` independent SimHash fingerprints of 32 bits over its
distinct words.  For each fingerprint every variant within half the radius (radius 2, so one
flipped bit: 33 variants) is emitted and shuffled: two fingerprints within the radius always
share a variant.  Documents that meet in a bucket are verified on the whole signature
(Hamming distance at most ``most_bits``), and verified pairs are joined into groups.

The same bits are also dealt out anew, every ``tables``-th bit to one of as many further keys,
which meet in the same way.  A fingerprint of 32 bits keeps chance meetings rare up to some
10^8 distinct signatures.  Pairs of up to 14 differing bits of 160 always meet; of those at 18,
19 and 20 bits the five fingerprints alone would find 88, 81 and 74 %, all ten keys find 98, 96
and 93 % (differing bits drawn at random), before groups close over shared members.

Equal signatures are one node before anything is emitted, so exact copies cost nothing.
Within a bucket, components are found exactly: each member is compared with those not yet
reached, so a bucket of n near copies needs about n comparisons, not n squared, and no
bucket is cut off.

Defined cases: a null or empty text is in a group of its own, kept.  A document of fewer
than ``least`` distinct words is near only to documents with the same words in the same order.
Rows that repeat a doc_id with the same text are one row; a null doc_id is kept and alone.
The least doc_id of a group is kept.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.llm.words import WordHasher, fresh, mix
from citeledger.scratch import drop, keep, load

TABLES, MOST_BITS, LEAST_WORDS = 5, 20, 8
_BITS = 32


def simhash(words, tables: int = TABLES, least: int = LEAST_WORDS) -> np.ndarray:
    """The signatures of a slice's rows, shape (rows, tables), 32 bits each."""
    n = len(words.rows)
    own = words.owner()
    # distinct words of each row
    order = np.lexsort((words.hashes, own))
    h, o = words.hashes[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    h, o = h[new], o[new]
    counts = np.bincount(o, minlength=n)
    halves = (tables + 1) // 2
    planes = np.stack([mix(h + np.uint64(0x632BE59BD9B4E019 * (j + 1) % (1 << 64))) for j in range(halves)], axis=1)
    sums = np.zeros((n, halves * 64), np.int32)
    # bits are added up some rows at a time, to bound what is unpacked at once
    ends = np.cumsum(counts)
    row = 0
    while row < n:
        begin = ends[row] - counts[row]
        stop = max(row + 1, int(np.searchsorted(ends, begin + 60_000)))
        bits = np.unpackbits(planes[begin : ends[stop - 1]].view(np.uint8), axis=1)
        full = np.flatnonzero(counts[row:stop])
        if len(full):
            at = ends[row:stop][full] - counts[row:stop][full] - begin
            sums[row + full] = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
        row = stop
    signs = np.packbits(sums * 2 > counts[:, None], axis=1).view(np.uint32)[:, :tables]
    # short texts: a hash of the words in order stands for the signature
    first = words.first
    position = (np.arange(len(words.hashes)) - first[:-1][own]).astype(np.uint64)
    folded = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words.hashes + position * np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64)])
    whole = folded[first[1:]] - folded[first[:-1]]
    exact = np.stack([mix(whole + np.uint64(j + 1)) for j in range(halves)], axis=1).view(np.uint32)[:, :tables]
    return np.where((counts < least)[:, None], exact, signs).astype(np.int64)


def signatures(docs: DataFrame, tables: int = TABLES, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, prints): the fingerprints of each document that has words."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for s in hasher.slices(batch.column(1).to_pylist()):
                full = np.diff(s.first) > 0
                prints = simhash(s, tables, least)[full]
                offsets = np.arange(len(prints) + 1, dtype=np.int32) * tables
                yield pa.RecordBatch.from_arrays(
                    [ids[s.rows[full]], pa.ListArray.from_arrays(offsets, prints.ravel())], names=["doc_id", "prints"]
                )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return texts.mapInArrow(sign, "doc_id long, prints array<long>")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (variant, node) rows of one partition: (bucket, node) of buckets with several nodes.

    Buckets with the same members are given once.
    """
    keys, nodes = [], []
    for batch in batches:
        keys.append(batch.column(0).to_numpy())
        nodes.append(batch.column(1).to_numpy())
    if not keys:
        return
    key, node = np.concatenate(keys), np.concatenate(nodes)
    keys.clear()
    nodes.clear()
    order = np.argsort(key)
    key, node = key[order], node[order]
    same = key[1:] == key[:-1]
    several = np.zeros(len(key), bool)
    several[1:] |= same
    several[:-1] |= same
    key, node = key[several], node[several]
    if not len(key):
        return
    order = np.lexsort((node, key))
    key, node = key[order], node[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.concatenate([start, [len(key)]]))
    members = np.add.reduceat(mix(node.view(np.uint64)), start)
    _, once = np.unique(members, return_index=True)
    chosen = np.zeros(len(start), bool)
    chosen[once] = True
    pick = np.repeat(chosen, sizes)
    yield pa.RecordBatch.from_arrays([key[pick], node[pick]], names=["bucket", "node"])


def near_components(prints: np.ndarray, most_bits: int) -> np.ndarray:
    """For each row of 32-bit fingerprints the least row it is joined with by near pairs."""
    n = len(prints)
    label = np.arange(n)
    rest = np.arange(n)
    while len(rest):
        seed, rest = rest[0], rest[1:]
        front = [seed]
        while front and len(rest):
            at = front.pop()
            near = np.bitwise_count(prints[rest] ^ prints[at]).sum(axis=1) <= most_bits
            found = rest[near]
            label[found] = seed
            front.extend(found.tolist())
            rest = rest[~near]
    return label


def _verify(most_bits: int):
    """From (bucket, node, prints) rows sorted by bucket: verified edges (a, b), a < b."""

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def of(table: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, node = table.column(0).to_numpy(), table.column(1).to_numpy()
            flat = table.column(2).combine_chunks().flatten().to_numpy()
            prints = flat.reshape(len(node), -1).astype(np.uint32)
            start = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.concatenate([start, [len(bucket)]]))
            low, high = [], []
            two = start[sizes == 2]
            near = np.bitwise_count(prints[two] ^ prints[two + 1]).sum(axis=1) <= most_bits
            low.append(node[two[near]])
            high.append(node[two[near] + 1])
            for s, size in zip(start[sizes > 2], sizes[sizes > 2], strict=True):
                label = near_components(prints[s : s + size], most_bits)
                joined = np.flatnonzero(label != np.arange(size))
                low.append(node[s + label[joined]])
                high.append(node[s + joined])
            a, b = np.concatenate(low), np.concatenate(high)
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pairs[:, 0].copy(), pairs[:, 1].copy()], names=["a", "b"])

        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < 200_000:
                continue
            table = pa.Table.from_batches(held)
            bucket = table.column(0).to_numpy()
            cut = int(np.searchsorted(bucket, bucket[-1]))
            if cut:
                yield from of(table.slice(0, cut))
                held = table.slice(cut).to_batches()
                size -= cut
        if held:
            yield from of(pa.Table.from_batches(held))

    return edges


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for the nodes with an edge.

    Alternates large-star and small-star steps, which halve path lengths and need a number of
    rounds that grows with their logarithm.  Each round is written to the shared folder.
    """
    pairs = keep(edges.select("a", "b").where("a <> b").distinct(), "edges")
    while True:
        both = pairs.union(pairs.select("b", "a"))
        # large star: a node links its larger neighbours to its least neighbour
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node links its smaller neighbours and itself to the least of them
        down = large.where("a > b")
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(low.select("a", F.col("m").alias("b")))
            .distinct()
        )
        following = keep(small, "edges")
        change = pairs.select("a", "b").exceptAll(following.select("a", "b")).isEmpty() and (
            following.select("a", "b").exceptAll(pairs.select("a", "b")).isEmpty()
        )
        drop(pairs)
        pairs = following
        if change:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _with_extra(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, prints) rows: (node, keys), the fingerprints and what is dealt out anew of their bits."""
    for batch in batches:
        if not batch.num_rows:
            continue
        prints = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype("<u4")
        tables = prints.shape[1]
        bits = np.unpackbits(prints.view(np.uint8), axis=1)
        # of one table nothing can be dealt out
        more = [np.packbits(bits[:, j::tables], axis=1).view("<u4") for j in range(tables if tables > 1 else 0)]
        keys = np.concatenate([prints, *more], axis=1).astype(np.int64)
        offsets = np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, keys.ravel())], names=["node", "keys"])


def near_pairs(prints: DataFrame, most_bits: int = MOST_BITS, tables: int = TABLES) -> DataFrame:
    """(a, b): verified edges between nodes (node, prints) that join all near ones."""
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << i).cast("long") for i in range(_BITS)))
    variants = (
        prints.select("node", "prints").mapInArrow(_with_extra, "node long, keys array<long>")
        .select("node", F.posexplode("keys").alias("t", "print"))
        .select("node", "t", "print", F.explode(flips).alias("flip"))
        .select((F.shiftleft(F.col("t").cast("long"), _BITS) + F.col("print").bitwiseXOR(F.col("flip"))).alias("variant"), "node")
    )
    meetings = variants.repartition("variant").mapInArrow(_meetings, "bucket long, node long")
    return (
        meetings.join(prints, "node")
        .select("bucket", "node", "prints")
        .repartition("bucket")
        .sortWithinPartitions("bucket")
        .mapInArrow(_verify(most_bits), "a long, b long")
    )


def groups(docs: DataFrame, tables: int = TABLES, most_bits: int = MOST_BITS, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, group_id, keep): each doc_id once, with the least doc_id of its group."""
    if tables < 1 or tables > 1 << (63 - _BITS) or most_bits < 0:
        raise ValueError("tables and most_bits are out of range")
    signed = keep(signatures(docs, tables, least), "signatures")
    nodes = keep(signed.groupBy("prints").agg(F.min("doc_id").alias("node")), "nodes")
    roots = components(near_pairs(nodes, most_bits, tables))
    rooted = nodes.join(roots, "node", "left").select("prints", F.coalesce("root", "node").alias("group_id"))
    # rows of one doc_id with several texts: the least group
    found = signed.join(rooted, "prints").groupBy("doc_id").agg(F.min("group_id").alias("group_id"))
    # documents without words are groups of their own
    alone = docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    return alone.join(found, "doc_id", "left").select(
        "doc_id", F.coalesce("group_id", "doc_id").alias("group_id"),
        F.coalesce(F.col("group_id") == F.col("doc_id"), F.lit(True)).alias("keep"),
    )


def without_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """docs with one document of each group; a null doc_id stays, repeated rows of a kept one too."""
    (name,) = fresh(docs.columns, "kept")
    kept = groups(docs, **settings).where("keep").select(F.col("doc_id").alias(name))
    known = docs.where("doc_id is not null").join(kept, F.col("doc_id").cast("long") == F.col(name), "left_semi")
    return known.unionByName(docs.where("doc_id is null"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(load(spark, sf_dir, "documents"))
