"""The operators against brute force, on small fixtures with every defined case."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeledger.llm import cotraining, decontaminate, divergence, harmonic_packing, licenses, quotations, sharding, simhash_dedup, substring_dedup, token_rollup
from citeledger.llm.words import words_of
from citeledger.scratch import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
RNG = random.Random(7)


def words(n, vocabulary=400, rng=RNG):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def docs(spark, rows):
    full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    return spark.createDataFrame(full, DOCS).withColumn("digest", F.lit("clash")).withColumn("size", F.lit(1))


ODD = [(None, "one two three"), (901, None), (902, ""), (903, "..."), (904, "short"), (904, "short")]


def test_minimax_equals_dynamic_programming(spark):
    for shards in (1, 3, 7):
        rng = random.Random(shards)
        rows = [(i, "x" * rng.choice([0, 1, 5, 50]) + str(i)) for i in range(60)] + [(100 + i, "same text") for i in range(9)] + ODD
        got = sharding.shard(docs(spark, rows), shards).collect()
        assert len(got) == len(rows)
        sizes = defaultdict(int)
        for r in got:
            sizes[r.group_id] += r["size"]
        order = sorted(sizes, key=lambda g: (g is not None, g))
        prefix = np.concatenate([[0], np.cumsum([sizes[g] for g in order])])
        best = [0] + [10**9] * len(order)
        for _ in range(shards):
            best = [0] + [min(max(best[j], prefix[i] - prefix[j]) for j in range(i + 1)) for i in range(1, len(order) + 1)]
        loads, at = defaultdict(int), [next(r.shard for r in got if r.group_id == g) for g in order]
        for r in got:
            loads[r.shard] += r["size"]
        assert max(loads.values()) == best[-1] == got[0].capacity and at == sorted(at) and max(at) < shards
        assert all(len({r.shard for r in got if r.group_id == g}) == 1 for g in order)
    assert sharding.shard(docs(spark, [])).count() == 0


def test_minimax_narrows_to_few_totals(spark):
    """A skewed table (one text has a tenth of all characters) with a coarse grid and a small search."""
    rng = random.Random(41)
    rows = [(i, "x" * rng.choice([0, 1, 7, 30, 200])) for i in range(3000)]
    rows += [(5000 + i, "the same long text of all " * 3) for i in range(300)] + [(9000, None), (None, "loose"), (None, "loose"), (9001, "")]
    searched = []
    frame = docs(spark, [(i, t if t is None or len(t) > 70 else t + str(i)) for i, t in rows])
    for shards in (1, 5, 16):
        want = sharding.shard(frame, shards).select("capacity", "group_id", "shard").distinct().collect()
        got = sharding.shard(frame, shards, points=50, gathered=40).select("capacity", "group_id", "shard").distinct().collect()
        assert sorted(map(str, got)) == sorted(map(str, want))
        loads = defaultdict(int)
        for r in sharding.shard(frame, shards, points=7, gathered=1).collect():
            loads[r.shard] += r["size"]
            searched.append(r.capacity)
        assert max(loads.values()) == want[0].capacity == searched[-1]


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = rng.random() < 0.3
        text = words(60, rng=rng) + (" filth grime" if bad else " ")
        rows.append((i, text))
        if i < 400:
            labels.append((i, 1, int(bad)))
    labels += [(0, None, None), (None, 1, 1), (5, 1, None)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    frame = docs(spark, rows + ODD)
    scores = cotraining.scored(f := cotraining.features(frame), cotraining.train(f, table))
    got = {r.doc_id: r.keep for r in scores.collect()}
    assert scores.count() == len(rows) + len(ODD)
    right = [got[i] == ("filth" not in t) for i, t in rows[400:]]
    assert np.mean(right) > 0.95
    kept = cotraining.without_rejected(frame, table)
    assert kept.columns == frame.columns and {r.doc_id for r in kept.collect()} - {None} == {i for i, k in got.items() if k} - {None}
    none = cotraining.without_rejected(frame, table.where("false"))
    assert none.count() == frame.count()
    assert cotraining.without_rejected(docs(spark, []), table).count() == 0


def test_views_teach_each_other(spark):
    """Words that no label shows are learnt from documents that the metadata view is sure of."""
    rng = random.Random(17)
    rows, labels, unseen = [], [], []
    for i in range(1500):
        bad, labelled, held_out = rng.random() < 0.4, i < 500, i >= 1200
        by_text = labelled and i % 2 == 0
        cue = " filth" * (bad and by_text) + " grime soot" * (bad and not labelled)
        source = "spam" if bad and not by_text and not held_out else rng.choice("ab")
        rows.append((i, words(40, 60, rng) + cue, "en", source, 200))
        if labelled:
            labels.append((i, 1, int(bad)))
        elif held_out:
            unseen.append((i, bad))
    frame = spark.createDataFrame(rows, DOCS)
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    f = cotraining.features(frame).cache()

    def accuracy(rounds):
        keep = {r.doc_id: r.keep for r in cotraining.scored(f, cotraining.train(f, table, rounds=rounds, exchange=0.05, shard_rows=100)).collect()}
        return np.mean([keep[i] != bad for i, bad in unseen])

    without, with_rounds = accuracy(0), accuracy(3)
    assert with_rounds > 0.95 and with_rounds > without + 0.2, (without, with_rounds)


def test_equal_tables_give_equal_models(spark):
    rng = random.Random(23)
    rows = [(i % 80, words(30, 50, rng) + " filth" * (i % 80 % 3 == 0), "en", "s", 9) for i in range(240)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(60)], "doc_id long, quality int, toxic int")
    frames = [spark.createDataFrame(r, DOCS).withColumns({"words": F.lit(1), "__text": F.lit("x"), "META": F.lit(2)}) for r in (rows, rows[::-1])]
    models = [cotraining.train(cotraining.features(f), labels) for f in frames]
    assert np.array_equal(models[0].text.weights, models[1].text.weights) and models[0].meta.scale == models[1].meta.scale
    kept = [sorted(map(tuple, cotraining.without_rejected(f, labels).collect()), key=str) for f in frames]
    assert kept[0] == kept[1] and cotraining.without_rejected(frames[0], labels).columns == frames[0].columns
    long = spark.createDataFrame([(1, "word " * 300_000, None, None, None), (2, None, "en", "s", None)], DOCS)
    assert cotraining.without_rejected(long, labels).count() == 2  # no labelled document: nothing is rejected


def test_fitting_holds_few_copies_of_its_entries(monkeypatch):
    import tracemalloc

    monkeypatch.setattr(cotraining, "STEPS", 2)
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 200, 4000)
    flat = rng.integers(0, 5000, sizes.sum()).astype(np.uint32)
    tracemalloc.start()
    view = cotraining.fit_view(cotraining.Ids(flat, sizes), rng.random(4000) < 0.5, 5001, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * len(flat) and view.weights[:5000].all() and not view.weights[5000]


def test_divergence_equals_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["the", "of", "and", f"r{rng.randrange(500)}"]) for _ in range(80))) for i in range(40)]
    rows += [(50, "1234 5678 " * 60), (51, "ZZ!! " * 70)] + ODD
    got = divergence.divergence(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    lists = [words_of(t) for _, t in rows]
    total = sum(map(len, lists))
    counts = defaultdict(int)
    for ws in lists:
        for w in ws:
            counts[w] += 1
    common = sorted(w for w, n in counts.items() if n >= divergence.LEAST_SHARE * total)
    q = np.array([counts[w] / total for w in common] + [1 - sum(counts[w] for w in common) / total])
    of = {r.doc_id: r for r in got}
    for (i, _), ws in zip(rows, lists, strict=True):
        if i is None:
            continue
        if len(ws) < divergence.LEAST_WORDS:
            assert of[i].verdict == "short" and of[i].keep and of[i].word_jsd is None
            continue
        p = np.array([ws.count(w) / len(ws) for w in common] + [sum(w not in common for w in ws) / len(ws)])
        assert of[i].word_jsd == pytest.approx(float(divergence.js_distance(p, q)), abs=2e-6)
    assert not of[51].keep and of[0].keep
    assert divergence.divergence(docs(spark, [])).count() == 0


def test_simhash_groups(spark):
    rng = random.Random(11)
    base = [words(120, 5000, rng).split() for _ in range(25)]
    rows, group = [], {}
    for g, ws in enumerate(base):
        for k in range(4):
            near = list(ws)
            for _ in range(k // 2):
                near[rng.randrange(len(near))] = "changed"
            rows.append((g * 10 + k, " ".join(near)))
            group[g * 10 + k] = g * 10
    found = {r.doc_id: r for r in simhash_dedup.groups(docs(spark, rows + ODD)).collect()}
    assert sum(found[d].group_id == g for d, g in group.items()) >= 0.95 * len(group)
    assert all(found[d].group_id // 10 == d // 10 for d in group)
    assert all(found[d].keep for d in (901, 902, 903, 904))
    left = simhash_dedup.without_near_copies(docs(spark, rows + ODD))
    assert left.where("doc_id is null").count() == 1 and left.where("doc_id = 904").count() == 2
    assert simhash_dedup.groups(docs(spark, [])).count() == 0


def test_simhash_recall_at_the_upper_distances(spark):
    rng = random.Random(23)
    rows = []
    for g in range(1200):
        ws = words(100, 50_000, rng).split()
        near = list(ws)
        for at in rng.sample(range(100), rng.randint(5, 12)):
            near[at] = f"changed{rng.randrange(10**6)}"
        rows += [(2 * g, " ".join(ws)), (2 * g + 1, " ".join(near))]
    signed = simhash_dedup.signatures(docs(spark, rows)).select(F.col("doc_id").alias("node"), "prints")
    prints = {r.node: np.array(r.prints, np.uint32) for r in signed.collect()}
    found = {(r.a, r.b) for r in simhash_dedup.near_pairs(signed).collect()}
    order = np.stack([prints[i] for i in range(len(rows))])
    apart = {}
    for i in range(len(rows)):
        bits = np.bitwise_count(order[i + 1 :] ^ order[i]).sum(axis=1)
        apart |= {(i, i + 1 + int(j)): int(bits[j]) for j in np.flatnonzero(bits <= simhash_dedup.MOST_BITS)}
    assert found <= set(apart) and all(p in found for p, n in apart.items() if n <= 14)
    upper = [p in found for p, n in apart.items() if n >= 19]
    assert len(upper) > 80 and np.mean(upper) >= 0.9


def test_licenses(spark):
    mit = licenses.TEMPLATES[2][1]
    rows = [(1, words(50) + " Licensed under CC BY-NC 4.0. " + words(50)), (2, words(30) + " " + mit.upper() + " " + words(9)),
            (3, words(500)), (4, "Released under the MIT License."), (4, "Released under the MIT License."),
            (5, " ".join(w for i, w in enumerate(mit.split()) if i != 20))] + ODD
    found = licenses.scan(docs(spark, rows)).collect()
    by = {(r.doc_id, r.license): r for r in found}
    assert {(1, "CC-BY-NC-4.0"), (2, "MIT"), (4, "MIT"), (5, "MIT")} <= set(by) and not [r for r in found if r.doc_id == 3]
    assert by[1, "CC-BY-NC-4.0"].start_word == 50 and by[2, "MIT"].containment == 1 and 0.8 <= by[5, "MIT"].containment < 1
    # brute force: every start of every template length
    for i, text in rows:
        ws = words_of(text)
        for t, (_, template) in enumerate(licenses.TEMPLATES):
            tw = words_of(template)
            grams = lambda x: {tuple(x[j : j + 3]) for j in range(len(x) - 2)}
            best = max((len(grams(ws[a : a + len(tw)]) & grams(tw)) / len(grams(tw)) for a in range(max(1, len(ws) - len(tw) + 1))), default=0)
            mine = [r.containment for r in found if r.doc_id == i and r.template == t]
            if i is not None:
                assert mine == ([pytest.approx(best, abs=1e-6)] if best >= licenses.LEAST else [])
    assert licenses.scan(docs(spark, [])).count() == 0


def test_license_families_and_bodies(spark):
    of = {name: text for name, text in licenses.TEMPLATES}  # the last text of a name is the whole one
    whole = ["Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-2.1", "MPL-2.0", "CC0-1.0", "Unlicense", "BSD", "MIT"]
    rows = [(1, words(40) + "\nAll rights reserved.\n" + words(40)), (2, words(9) + " Licensed under CC BY-ND 4.0. " + words(9)), (3, "All rights are reserved")]
    # bodies without their first tenth: neither notice nor opening words
    rows += [(10 + i, words(30) + " " + " ".join(of[n].split()[len(of[n].split()) // 10 :]) + " " + words(30)) for i, n in enumerate(whole)]
    found = {(r.doc_id, r.license) for r in licenses.scan(docs(spark, rows)).collect()}
    assert {(1, "reserved"), (2, "CC-BY-ND-4.0")} <= found and not [d for d, _ in found if d == 3]
    assert {(10 + i, n) for i, n in enumerate(whole)} <= found


@pytest.mark.parametrize("chunk", [60_000, 3])
def test_substring_repeats_equal_brute_force(spark, monkeypatch, chunk):
    """Also where rows of one anchor are grown three at a time."""
    monkeypatch.setattr(substring_dedup, "CHUNK_ROWS", chunk)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", chunk)
    rng = random.Random(13)
    shared = words(30, rng=rng)
    rows = [(i, words(20, rng=rng) + " " + (shared if i % 2 else words(5, rng=rng)) + " " + words(8, rng=rng)) for i in range(8)]
    rows += [(20, shared + " " + shared)] + ODD
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeats(docs(spark, rows), 12, 5).collect()}
    seen, hits = {}, defaultdict(list)
    for i, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ws = words_of(text)
        for a in range(len(ws) - 11):
            gram = tuple(ws[a : a + 12])
            if seen.setdefault(gram, (i, a)) != (i, a):
                hits[i].append(a)
    want = set()
    for i, at in hits.items():
        start = prev = at[0]
        for a in [*at[1:], 10**9]:
            if a > prev + 12:
                want.add((i, start, prev + 12))
                start = a
            prev = a
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want and want
    assert substring_dedup.repeats(docs(spark, [])).count() == 0


def test_rollup(spark):
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-test-{random.random()}")
    of = lambda rows: spark.createDataFrame(rows, "op string, source string, lang string, tokenizer string, tokens long, old_tokens long")
    load = of([("insert", "a", "en", "t1", 10, None), ("insert", "a", "en", "t1", 5, None), ("insert", None, "en", "t1", None, None)])
    assert rollup.commit("load", load) and not rollup.commit("load", load)
    assert rollup.commit("fix", of([("revise", "a", "en", "t1", 7, 10), ("delete", "a", "en", "t1", 5, None)]))
    want = {("a", 1, 7), (None, 1, 0)}
    assert {(r.source, r.docs, r.tokens) for r in rollup.totals().collect()} == want
    rollup.compact()
    assert not rollup.commit("fix", load) and rollup.commit("empty", load.where("false"))
    assert rollup.commit("gone", of([("delete", None, "en", "t1", 0, None)]))
    assert {(r.source, r.docs, r.tokens) for r in rollup.totals().collect()} == {("a", 1, 7)}
    with pytest.raises(Exception, match="no such op"):
        rollup.commit("bad", of([("upsert", "a", "en", "t1", 1, None)]))


def test_token_counts_by_vocabulary(spark):
    versions = token_rollup.vocabularies()
    if not versions:
        pytest.skip("no vocabulary files")
    texts = ["The cat's 12 naïve  words\n", "", None, "日本語 text", "x" * 5000, "The cat's 12 naïve  words\n"]
    rows = [(i % 5, t, "en", "a" if i % 2 else None) for i, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({"copy": F.lit(1), "body": F.lit(2)})
    facts = token_rollup.counted(frame, versions).cache()
    encoders = {n: token_rollup.encoder(n, r) for n, r in versions.items()}
    for n, e in encoders.items():
        assert e.decode(e.encode_ordinary(texts[0])) == texts[0] and e.encode_ordinary(texts[0]) == merged_pairs(texts[0], versions[n])
    got = {(r.doc_id, r.source, r.copy): r for r in facts.collect()}
    assert len(got) == len(texts)
    first, second = versions
    kept = {}
    for r in sorted(facts.collect(), key=lambda r: (r.doc_id, r.source or "", r.lang)):
        kept.setdefault(r.copy, r)
    want = defaultdict(lambda: [0, 0])
    for r in kept.values():
        for n in versions:
            want[r.source, r.lang, n][0] += 1
            want[r.source, r.lang, n][1] += r[n]
    assert {(r.source, r.lang, r.tokenizer): [r.docs, r.tokens] for r in token_rollup.rolled_up(facts, first, second).collect()} == dict(want)
    assert token_rollup.rolled_up(facts.where("false"), first, second).count() == 0 and token_rollup.vocabularies("/none") == {}


@pytest.mark.parametrize("there", [(), token_rollup.VOCABULARIES[:1]])
def test_rollup_without_a_vocabulary_fails(spark, tmp_path, there):
    docs(spark, [(1, "one two"), (2, "three")]).write.parquet(f"{tmp_path}/sf/documents.parquet")
    for name in there:
        (tmp_path / f"{name}.tiktoken").write_bytes(b"")
    with pytest.raises(FileNotFoundError, match=f"{token_rollup.VOCABULARIES[-1]}.tiktoken;"):
        token_rollup.op7_token_rollup(spark, f"{tmp_path}/sf", str(tmp_path))
    assert {r.tokenizer for r in token_rollup.token_rollup_by_patterns(spark, f"{tmp_path}/sf").collect()} == set(token_rollup.PATTERNS)


def merged_pairs(text, ranks):
    """Byte-pair merging by its definition: the pair of least rank first."""
    import base64

    import regex

    rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.split(b"\n")))}
    out = []
    for part in regex.findall(token_rollup.PARTS, text):
        pieces = [bytes([b]) for b in part.encode()]
        while pairs := [(rank[a + b], i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])) if a + b in rank]:
            i = min(pairs)[1]
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        out += [rank[x] for x in pieces]
    return out


def test_rollup_survives_a_broken_commit(spark):
    folder = f"{shared_folder(spark)}/rollup-broken-{random.random()}"
    rollup = token_rollup.Rollup(spark, folder)
    assert rollup.totals().count() == 0
    batch = spark.createDataFrame([("insert", "a", "en", "t", 3, None, 1)], "op string, source string, lang string, tokenizer string, tokens long, old_tokens long, docs long")
    assert rollup.commit("one", batch)
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/batches/one/_SUCCESS")
    marker.getFileSystem(spark._jsc.hadoopConfiguration()).delete(marker, False)
    assert rollup.totals().count() == 0 and rollup.commit("one", batch) and not rollup.commit("one", batch)
    assert [(r.docs, r.tokens) for r in rollup.totals().collect()] == [(1, 3)]


def test_quotations(spark):
    rows = [
        (1, 0, "a", "Shall we meet on Monday at noon?\n\nBring the long report."), (1, 1, "b", "> Shall we meet on\n> Monday at noon?\nYes, that suits me well."),
        (1, 2, "c", ">> Shall we meet on Monday at noon?\n> Yes, that suits me well.\n\nI can join both of you."),
        (1, 3, "d", "> Bring the long report.\nIt is not finished yet."), (1, 4, "e", "> never said by anyone here\nLost quote."),
        (2, 0, "a", "> Shall we meet on Monday at noon?\nAnother conversation."), (None, None, None, None), (3, None, "x", ""), (3, 1, "x", "dup"), (3, 1, "x", "dup"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("position", F.lit(9))
    got = quotations.linked(table).collect()
    assert len(got) == len(rows)
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [one[t].reply_to for t in range(5)] == [None, 0, 1, 0, 3]
    assert [one[t].position for t in range(5)] == [1, 2, 3, 4, 5] and one[2].links == 2 and one[2].quoted_level == 1
    assert one[1].text == "Yes, that suits me well." and one[4].quoted_level == 0
    assert next(r for r in got if r.conv_id is None).text is None
    assert quotations.linked(table.where("false")).count() == 0
    assert quotations.parse("a\n> > b\n>c") == ([(0, "a"), (2, "b"), (1, "c")], "a")


def test_partial_quotations(spark):
    first = "The red boat left early.\nNobody saw the old captain.\nHis dog stayed behind here."
    rows = [
        (0, first), (1, "Fine weather today."), (2, "> Nobody saw the old captain.\n> His dog stayed behind here.\nSo I heard."),
        (3, "I can come on Sunday; the train leaves at nine, and my brother will drive us."), (4, "Nothing new from me."),
        (5, "> the train leaves at nine\nToo late for me."), (6, "> Fine weather\nIt rains."), (7, "> The red boat left [...]\n> the old captain\nWho?"),
        (8, "> The red boat left early.\n> words that nobody ever wrote\nYes."), (9, "> fine day\n> ...\nNo."), (10, ">> My brother will drive us\n> Too late for me.\nWell."),
        (11, "> it rains tomorrow at nine\nNo."),
    ]
    table = spark.createDataFrame([(1, t, "r", x) for t, x in rows], "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotations.linked(table).collect()}
    assert [got[t].reply_to for t, _ in rows] == [None, 0, 0, 2, 3, 3, 1, 0, 0, 8, 5, 10]
    assert [got[t].links for t, _ in rows] == [0, 0, 1, 0, 0, 1, 1, 1, 1, 0, 2, 0]

    # against brute force: runs of words cut out of earlier messages
    rng = random.Random(17)
    owns, rows, want = [], [], {}
    for t in range(60):
        own = "\n".join(words(rng.randint(4, 12), 60, rng) for _ in range(rng.randint(1, 4)))
        quote = ""
        if t > 2 and rng.random() < 0.6:
            ws = owns[rng.randrange(t)].split()
            a = rng.randrange(len(ws) - 3)
            part = ws[a : a + rng.randint(3, 9)]
            quote = "> " + " ".join(w + ("\n>" if rng.random() < 0.2 else "") for w in part[:-1]) + f" {part[-1]}.\n"
            want[t] = sum(f" {' '.join(part)} " in f" {' '.join(o.split())} " for o in owns)
        owns.append(own)
        rows.append((2, t, "r", quote + own))
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.turn: r for r in quotations.linked(table).collect()}
    assert {t: r.links for t, r in got.items() if r.links} == want and len(want) > 20


def test_packing_and_decontamination(spark):
    rows = [(i, words(i * 37 % 300 + 1)) for i in range(80)] + [(500, words(700))] + ODD
    bins = harmonic_packing.pack(docs(spark, rows), capacity=256, classes=16, bucket_rows=40).collect()
    loads = defaultdict(list)
    for r in bins:
        if r.bin:
            loads[r.bin].append(r.n_words)
    assert all(sum(v) <= 256 for v in loads.values()) and sum(map(sum, loads.values())) == sum(len((t or "").split()) for _, t in rows)
    item = words(20, 9000)
    bench = spark.createDataFrame([(1, item), (2, None), (3, "too short")], "item_id long, text string")
    clean = [(i, words(100, 9000)) for i in range(5)]
    spans = decontaminate.removal_spans(docs(spark, [*clean, (7, words(10) + " " + item.upper() + " " + words(10)), *ODD]), bench).collect()
    assert [(r.doc_id, r.start_word, r.end_word, r.item_id) for r in spans] == [(7, 10, 30, 1)]
    assert decontaminate.removal_spans(docs(spark, []), bench).count() == 0


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as pipe

    assert [n for n, _ in pipe.STAGES] == ["quality_classifier", "simhash_dedup", "substring_dedup", "decontaminate", "packing"]
    frame = docs(spark, [(i, words(80, 9000)) for i in range(12)] + ODD)
    for name, stage in pipe.STAGES[1:3]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns and out.where("doc_id < 12").count() == 12, name


def test_pipeline_stages_take_texts_in_batches_of_few_bytes(spark):
    import pyarrow as pa

    import corpus_pipeline as pipe

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], names=["n", "size"])

    stage = pipe._clearing(lambda spark, frame, sf_dir: frame.mapInArrow(sizes, "n long, size long"))
    rows = stage(spark, spark.range(9000).selectExpr("id", "repeat('x', 2000) AS text").coalesce(1), "").collect()
    assert sum(r.n for r in rows) == 9000 and max(r["size"] for r in rows) < 5 << 20


def repeated_windows(texts, size):
    """Brute force: of each text (id, words), the merged places of windows that occur earlier."""
    seen, out = set(), {}
    for i, ws in texts:
        at = []
        for a in range(len(ws) - size + 1):
            gram = tuple(ws[a : a + size])
            if gram in seen:
                at.append(a)
            seen.add(gram)
        out[i] = at
    return out


def test_pipeline_equals_brute_force(spark):
    """Each stage on what the one before it kept, and run() as a whole."""
    import corpus_pipeline as pipe

    sf = "/root/testdata/sf0.001"
    stages, tables = dict(pipe.STAGES), [pipe.load(spark, sf, "documents")]
    for name, stage in pipe.STAGES:
        tables.append(pipe.keep(stage(spark, tables[-1], sf), name))
    rows = [{r.doc_id: r for r in t.collect()} for t in tables[:5]]
    assert all(t.columns == tables[0].columns for t in tables[1:5]) and len(stages) == 5
    # 1: the rows that the classifier keeps
    f = cotraining.features(tables[0]).cache()
    model = cotraining.train(f, pipe.load(spark, sf, "labels"))
    assert set(rows[1]) == {r.doc_id for r in cotraining.scored(f, model).collect() if r.keep}
    # 2: all pairs; those within 14 bits surely meet, those beyond 20 never do
    signed = [(r.doc_id, np.array(r.prints, np.uint32)) for r in simhash_dedup.signatures(tables[1]).collect()]

    def dropped(bits):
        parent = {i: i for i, _ in signed}

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for n, (i, a) in enumerate(signed):
            for j, b in signed[n + 1 :]:
                if np.bitwise_count(a ^ b).sum() <= bits and root(i) != root(j):
                    low, high = sorted((root(i), root(j)))
                    parent[high] = low
        return {i for i in parent if root(i) != i}

    gone = set(rows[1]) - set(rows[2])
    assert dropped(14) <= gone <= dropped(simhash_dedup.MOST_BITS)
    # 3: passages of 50 words that occur earlier go
    lists = [(i, words_of(r.text)) for i, r in sorted(rows[2].items())]
    size, want = substring_dedup.MIN_WORDS, {}
    for i, at in repeated_windows(lists, size).items():
        text = rows[2][i].text
        want[i] = substring_dedup.cut_words(text, sharding.merged([(a, a + size) for a in at])) if at else text
    assert {i: r.text for i, r in rows[3].items()} == {i: t for i, t in want.items() if words_of(t) or t == rows[2][i].text}
    # 4: phrases of the benchmark go
    n, phrases = decontaminate.PHRASE_WORDS, set()
    for item in pipe.load(spark, sf, "benchmark").collect():
        ws = words_of(item.text)
        if len(ws) >= decontaminate.LEAST_WORDS:
            phrases |= {tuple(ws[a : a + n]) for a in range(max(1, len(ws) - n + 1))}
    want = {}
    for i, r in rows[3].items():
        ws = words_of(r.text)
        at = [(a, a + k) for k in {len(p) for p in phrases} for a in range(len(ws) - k + 1) if tuple(ws[a : a + k]) in phrases]
        want[i] = substring_dedup.cut_words(r.text, sharding.merged(sorted(at))) if at else r.text
    assert {i: r.text for i, r in rows[4].items()} == {i: t for i, t in want.items() if words_of(t) or t == rows[3][i].text}
    # 5: all words that are left, in sequences
    packed = tables[5].collect()
    assert sorted(w for r in packed for w in r.text.split()) == sorted(w for r in rows[4].values() for w in r.text.split())
    assert all(r.n_words == len(r.text.split()) <= harmonic_packing.CAPACITY for r in packed)
    assert sorted(map(str, pipe.run(spark, sf).collect())) == sorted(map(str, packed))


def test_sequences_hold_what_pack_places(spark):
    rng = random.Random(29)
    rows = [(i, words(rng.choice([1, 3, 9, 20, 45, 130]), rng=rng)) for i in range(300)] + ODD
    frame = docs(spark, rows)
    packed = [r for r in harmonic_packing.pack(frame, 40, 8, 50).collect() if r.bin]
    bins = {r.bin: r for r in harmonic_packing.sequences(frame, 40, 8, 50).collect()}
    held = defaultdict(list)
    for r in packed:
        held[r.bin].append(r)
    assert set(bins) == set(held)
    for name, parts in held.items():
        b = bins[name]
        assert b.n_words == sum(p.n_words for p in parts) <= 40 and sorted(b.doc_ids, key=str) == sorted((p.doc_id for p in parts), key=str)
        assert len(b.text.split()) == b.n_words and len(parts) <= max(1, b["class"])
    # all words of all documents are in some sequence
    assert sorted(w for b in bins.values() for w in b.text.split()) == sorted(w for _, t in rows for w in (t or "").split())
    assert harmonic_packing.sequences(docs(spark, [])).count() == 0


def test_spans_are_cut_from_their_own_text(spark):
    from citeledger.llm.words import word_spans

    rows = [(1, "a b c\nd", "x"), (1, "p q r s", "x"), (2, "a b c\n", "x"), (3, None, "x"), (None, "a b", "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, digest string").withColumns({"__doc": F.lit(1), "found": F.lit(2), "DOC": F.lit(3)})
    spans = frame.where("text like 'a b c%'").select("doc_id", F.xxhash64("text").alias("digest"), F.lit(0).alias("start_word"), F.lit(3).alias("end_word"))
    left = substring_dedup.without_spans(frame, spans)
    assert left.columns == frame.columns and sorted((r.doc_id, r.text) for r in left.where("doc_id is not null and text is not null").collect()) == [(1, "\nd"), (1, "p q r s")]
    assert left.count() == 4 and len(word_spans("a b c\nd")) == 4
    assert substring_dedup.cut_words("one two, three four.", [(1, 3)]) == "one  four." and substring_dedup.cut_words("a b", [(0, 9), (5, 6)]) == ""
    assert simhash_dedup.without_near_copies(frame.withColumns({"kept": F.lit(0), "__kept": F.lit(0)})).count() == 5
