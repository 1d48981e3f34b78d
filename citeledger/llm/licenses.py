"""License scan: MinHash bands over overlapping text windows, then exact shingle containment.

A template is a known license text or notice.  For each template length L, windows of L words
that start every max(1, L // 4) words are signed by MinHash over their ``SHINGLE``-word
shingles, and windows that agree with a template in one of ``BANDS`` bands of ``ROWS`` values
retrieve it.  A window at most L / 8 words off a full copy has Jaccard similarity 0.6 or more,
which 16 bands of 2 meet with probability 1 - (1 - 0.36) ** 16 > 0.999.  Each retrieval is
then verified: the containment of the template's shingles is counted exactly at every start
within L words of the window, and the best start is reported where it reaches ``least``.

Windows that hold no shingle of any template cannot verify, so they are not signed.  That
screen reads every shingle of every text, and drops nothing else.

Defined cases: null, empty and short texts hold no license; a template of fewer words than a
shingle has is refused.  Of equal containments in a document the first place counts; a document
with several templates has a row for each.  Rows that repeat a doc_id with the same text count
once; with other texts the best one counts.  A null doc_id is not scanned.  Empty tables give
an empty result.  Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.llm.words import WordHasher, inside, mix, ngram_hashes, sliding
from citeledger.scratch import load

SHINGLE, BANDS, ROWS, LEAST = 3, 16, 2, 0.8

#: (name, text): notices and opening passages of widely used licenses, then the whole texts in ``license_texts``.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction, including without limitation the rights to use, "
            "copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
                "License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General "
             "Public License as published by the Free Software Foundation"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("reserved", "All rights reserved. No part of this publication may be reproduced"),
    ("reserved", "All rights reserved."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General "
                 "Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("ISC", "Released under the ISC License."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    *(
        (f"CC-{short}-4.0", f"This work is licensed under a Creative Commons {terms} 4.0 International License.")
        for short, terms in (
            ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    ),
    *((f.stem, f.read_text(encoding="utf-8")) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))),
]


class Templates:
    """The shingle sets and band keys of the templates, by template length."""

    def __init__(self, templates: list[tuple[str, str]], bands: int, rows: int):
        hasher = WordHasher()
        self.names = [name for name, _ in templates]
        self.bands, self.rows = bands, rows
        self.shingles, self.sizes = [], []
        for s in (hasher([0], [w]) for w in self._cleaned(templates)):
            grams = np.unique(ngram_hashes(s.hashes, SHINGLE))
            if not len(grams):
                raise ValueError(f"a template needs {SHINGLE} words")
            self.shingles.append(grams)
            self.sizes.append(len(s.hashes))
        self.all = np.unique(np.concatenate(self.shingles))
        self.bits = np.zeros(1 << 16, bool)
        self.bits[(self.all >> np.uint64(48)).astype(np.int64)] = True
        self.keys = [self.band_keys(self.signature_of(g)[None, :])[0] for g in self.shingles]

    @staticmethod
    def _cleaned(templates: list[tuple[str, str]]) -> list[bytes]:
        from citeledger.llm.words import clean_bytes

        return [clean_bytes(text) for _, text in templates]

    def seeded(self, grams: np.ndarray, i: int) -> np.ndarray:
        return mix(grams + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64)))

    def signature_of(self, grams: np.ndarray) -> np.ndarray:
        return np.array([self.seeded(grams, i).min() for i in range(self.bands * self.rows)])

    def band_keys(self, signatures: np.ndarray) -> np.ndarray:
        """(windows, bands) from (windows, bands * rows)."""
        out = np.zeros((len(signatures), self.bands), np.uint64)
        for r in range(self.rows):
            out = mix(out + signatures[:, r :: self.rows] * np.uint64(2 * r + 3))
        return out

    def known(self, grams: np.ndarray) -> np.ndarray:
        """Which shingles occur in a template."""
        at = np.flatnonzero(self.bits[(grams >> np.uint64(48)).astype(np.int64)])
        near = np.minimum(np.searchsorted(self.all, grams[at]), len(self.all) - 1)
        out = np.zeros(len(grams), bool)
        out[at] = self.all[near] == grams[at]
        return out


def best_start(grams: np.ndarray, template: np.ndarray, width: int) -> tuple[int, int]:
    """(start, hits): the first window of ``width`` shingles with the most distinct template shingles."""
    near = np.minimum(np.searchsorted(template, grams), len(template) - 1)
    which = np.where(template[near] == grams, near, -1)
    starts = max(1, len(grams) - width + 1)
    at = np.flatnonzero(which >= 0)
    # an occurrence counts in the windows that hold it and do not hold the one before it
    change = np.zeros(starts + 1, np.int64)
    last: dict[int, int] = {}
    for place in at.tolist():
        low = max(0, place - width + 1, last.get(which[place], -1) + 1)
        high = min(place, starts - 1)
        if low <= high:
            change[low] += 1
            change[high + 1] -= 1
        last[int(which[place])] = place
    hits = np.cumsum(change[:-1])
    start = int(np.argmax(hits))
    return start, int(hits[start])


def _scan(templates: Templates, least: float):
    lengths = sorted(set(templates.sizes))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out = []
            for s in hasher.slices(batch.column(1).to_pylist()):
                grams = ngram_hashes(s.hashes, SHINGLE)
                if not len(grams):
                    continue
                hit = np.flatnonzero(templates.known(grams) & inside(s.first, len(s.hashes), SHINGLE))
                for row in np.unique(np.searchsorted(s.first, hit, side="right") - 1).tolist():
                    own = ngram_hashes(s.of_row(row), SHINGLE)
                    held = hit[(hit >= s.first[row]) & (hit < s.first[row + 1])] - s.first[row]
                    for name, start, end, share in _matches(templates, own, held, lengths, least):
                        out.append((int(ids[s.rows[row]]), name, start, end, share))
            if out:
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.float64())],
                    names=["doc_id", "template", "start_word", "end_word", "containment"],
                )

    return scan


def _matches(templates: Templates, grams: np.ndarray, held: np.ndarray, lengths: list[int], least: float):
    """(template, start, end, containment) of one text; held: places of its known shingles."""
    distinct = len(np.unique(grams[held]))
    for size in lengths:
        # a text with too few known shingles for any template of this length can't verify
        if distinct < least * min(len(g) for g, n in zip(templates.shingles, templates.sizes, strict=True) if n == size):
            continue
        width, step = size - SHINGLE + 1, max(1, size // 4)
        # the windows that hold a known shingle; a text shorter than a window is one window
        count = max(1, -(-(len(grams) - width) // step) + 1) if len(grams) > width else 1
        low = np.maximum(0, -(-(held - width + 1) // step))
        windows = np.unique(np.concatenate([np.minimum(low + j, count - 1) for j in range(-(-width // step) + 1)]))
        starts = windows * step
        spans = [grams[a : a + width] for a in starts.tolist()]
        flat = np.concatenate(spans)
        begins = np.cumsum([0] + [len(x) for x in spans[:-1]])
        signatures = np.stack(
            [np.minimum.reduceat(templates.seeded(flat, i), begins) for i in range(templates.bands * templates.rows)], axis=1
        )
        keys = templates.band_keys(signatures)
        for t in (t for t, n in enumerate(templates.sizes) if n == size):
            met = np.flatnonzero((keys == templates.keys[t]).any(axis=1))
            best: tuple[int, int] | None = None
            for a in starts[met].tolist():
                low = max(0, a - size)
                at, hits = best_start(grams[low : a + width + size], templates.shingles[t], width)
                if best is None or hits > best[1]:
                    best = (low + at, hits)
            if best and best[1] >= least * len(templates.shingles[t]):
                yield t, best[0], min(best[0] + size, len(grams) + SHINGLE - 1), best[1] / len(templates.shingles[t])


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """(doc_id, template, license, start_word, end_word, containment); one row a template found."""
    ready = Templates(templates, BANDS, ROWS)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    found = texts.mapInArrow(
        _scan(ready, least), "doc_id long, template int, start_word long, end_word long, containment double"
    )
    best = F.max(F.struct("containment", (-F.col("start_word")).alias("at"), (-F.col("end_word")).alias("end"))).alias("b")
    # few rows reach this shuffle: those that matched
    return found.groupBy("doc_id", "template").agg(best).select(
        "doc_id", "template", F.array(*(F.lit(n) for n in ready.names))[F.col("template")].alias("license"),
        (-F.col("b.at")).alias("start_word"), (-F.col("b.end")).alias("end_word"), F.round("b.containment", 6).alias("containment"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(load(spark, sf_dir, "documents"))
