import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from citeledger.functions import identifiers as ids
from citeledger.functions.names import Person, agree, compare_bylines, demojibake, one_edit, parse_people, parse_person, people
from citeledger.functions.text import clean, clean_text, fold, fold_text, ratio, settled
from citeledger.operators import relations as rel
from citeledger.operators.compare import compared, verdict
from citeledger.operators.resolve import latest_notices, merged_notices
from citeledger.plans import derived
from citeledger.plans import queries as core
from citeledger.schema import ISSUE, RECORD, REFERENCE

SF = "/root/testdata/sf0.001"


def test_fold_paths_agree(spark):
    values = ["Plain  Text, v. 2", "a & b", "Caf\\'e {X}", "Straße", "ﬁn²", "<i>Big</i> deal", "", None, "x y", "&amp; more"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select(fold(F.col("v")).alias("f")).collect()
    assert [r.f for r in got] == [fold_text(v) for v in values]
    assert fold_text("Straße") == "stra e" and fold_text("Gómez & Co") == "gomez and co"
    assert clean_text("{\\'e}tude \\emph{x} “q”") == 'etude x "q"'


def test_fold_and_clean_of_every_letter_in_one_python_stage(spark):
    values = [f"a{chr(c)} b\t {chr(c)}" for c in [*range(1, 0x250), 0x1E9E, 0x2013, 0x201C, 0x212A, 0x4E00, 0x1F600]]
    rows = spark.createDataFrame([(v,) for v in values], "v string")
    got = rows.select("v", fold(F.col("v")).alias("f"), clean(F.col("v")).alias("c"), people(F.col("v")).alias("p"))
    assert all((r.f, r.c) == (fold_text(r.v), clean_text(r.v)) for r in got.collect())
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_settled_columns_are_computed_once(spark):
    rows = settled(spark.createDataFrame([("a", 1), ("b", 2)], "s string, n int"), {"u": F.transform(F.array("s", "s"), F.upper), "n": F.col("n") + 1})
    out = rows.select(F.transform(F.sequence(F.lit(0), F.lit(1)), lambda i: F.concat(F.get("u", i), F.col("n").cast("string"))).alias("x"))
    assert sorted(r.x for r in out.collect()) == [["A2", "A2"], ["B3", "B3"]]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1


def test_references_and_records_of_one_small_file_reach_every_core(spark):
    for rows in (derived.stored(spark, SF), derived.registry(spark, SF)):
        assert rows.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(
    ("raw", "want"),
    [("https://doi.org/10.1234/AbC", "10.1234/abc"), ("(10.1234/x).", "10.1234/x"), ("10.1016/S0140-6736(03)14065-2", "10.1016/s0140-6736(03)14065-2"),
     ("10.1234/x.)", "10.1234/x."), ("", ""), (None, "")],
)
def test_normalize_doi(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "v string").select(ids.normalize_doi(F.col("v"))).first()[0] == want


def test_identifiers(spark):
    row = spark.sql("select '0-306-40615-2' i, '0306406153' bad, 'e0123456' p, '0027--31' q, 'May 2021' y, 'Journal Article' k")
    got = row.select(
        ids.normalize_isbn13(F.col("i")), ids.normalize_isbn13(F.col("bad")), ids.is_article_number(F.col("p")),
        ids.first_page(F.col("q")), ids.parse_year(F.col("y")), ids.normalize_kind(F.col("k")),
    ).first()
    assert tuple(got) == ("9780306406157", None, True, "27", 2021, "article")


def test_names():
    assert parse_person("Casper H. J. van Eijck") == Person("van Eijck", "Casper H. J.")
    assert parse_person("Smith, John") == Person("Smith", "John")
    assert [p.et_al for p in parse_people("Smith, J. and Jones, A. et al.")] == [False, False, True]
    assert len(parse_people("The Hormones and Cancer Collaborative Group")) == 1
    assert demojibake("GÃ³mez") == "Gómez" and demojibake("Gómez") is None
    assert one_edit("abc", "abd") and one_edit("abc", "abcd") and not one_edit("abc", "abc") and not one_edit("abc", "badc")
    assert agree(Person("Gómez", "A"), Person("GÃ³mez", "A")) == (True, "registry mojibake")
    assert agree(Person("王"), Person("李")) == (False, None)
    assert agree(Person("Price", "A"), Person("Rice", "A"))[0] is False
    a, b, c = Person("Smith", "J"), Person("Jones", "K"), Person("Brown", "L")
    assert compare_bylines([a, b], [b, a])[1] == [(1, "reordered"), (2, "reordered")]
    assert compare_bylines([a, b], [a, c])[0] == [(2, "Jones, K", "Brown, L")]
    assert compare_bylines([a, b, c], [a, b])[2]
    assert compare_bylines([Person("First"), a, b, c], [a, b, c])[1] == [(1, "registry omits the first author")]
    group = Person(literal="Study Group", collective=True)
    assert compare_bylines([a, b], [a, group, b])[1][0][1].endswith("Study Group")
    assert compare_bylines([], [a]) == ([], [], True)


def test_ratio():
    assert ratio("tide", "diet") == 0.25 and ratio("diet", "tide") == 0.5
    assert ratio("", "x") == 0 and ratio("A-b", "a b") == 1


def test_verdict_lattice(spark):
    cases = [
        ([("status", "retracted", "error")], [], False, "RETRACTED"), ([("doi", "unresolved", "error")], [], False, "BAD-ID"),
        ([("identifier", "absent", "error")], [], False, "UNCONFIRMED"), ([("title", "wrong-work", "error")], [], False, "WRONG-WORK"),
        ([("title", "wrong-work", "error")], [], True, "FIELD-MISMATCH"), ([("volume", "disputed", "info"), ("year", "missing", "warning")], [], True, "DISPUTED"),
        ([("year", "missing", "warning")], [], True, "INCOMPLETE"), ([], [("x", "suppressed:mismatch", "info")], True, "ADJUDICATED"),
        ([], [("x", "registry-artifact", "info")], True, "REGISTRY-ARTIFACT"), ([("title", "drift", "info")], [], True, "TITLE-DRIFT"),
        ([("title", "cosmetic", "info")], [], True, "COSMETIC"), ([], [], True, "OK"),
    ]
    pad = lambda issues: [(*i, "", "", "", "") for i in issues]
    df = spark.createDataFrame([(pad(a), pad(b), ok, w) for a, b, ok, w in cases], f"i array<{ISSUE}>, s array<{ISSUE}>, ok boolean, want string")
    for r in df.select(verdict(F.col("i"), F.col("s"), F.col("ok")).alias("got"), "want").collect():
        assert r.got == r.want


def test_alternate_containers_are_folded(spark):
    cases = [
        ("Science & Technology", ["Other", "Science & Technology"], True), ("Science and Technology", ["Science &amp; Technology"], True),
        ("Revista de Física", ["Revista de Física"], True), ("Revista de Fisica", [None, "<i>Revista</i> de F{\\'i}sica"], True),
        ("Methods in Biobanking", ["Methods in biobanking."], True), ("Methods in Biobanking", ["Methods in Biology", "", " "], False),
        ("Física", ["", None, "\u00a0"], False), ("Física", None, False), ("物理", [" ", "\u00a0", ""], False),
    ]
    record = {"source": "crossref", "title": "A title", "container": "The Series", "kind": "journal-article", "retracted": False, "authors": [], "years": []}
    for second in (False, True):
        rows = []
        for i, (container, alternates, _) in enumerate(cases):
            one, other = ({**record, "container_alternates": a} for a in ([] if second else alternates, alternates))
            rows.append({"pos": i, "kind": "article", "title": "A title", "container": container, "authors": [], "identifier": "10.1/a",
                         "route": "doi", "asked": ["crossref"], "primary": one, "corroborator": other if second else None, "records": [one]})
        schema = f"{REFERENCE}, identifier string, route string, asked array<string>, primary struct<{RECORD}>, corroborator struct<{RECORD}>, records array<struct<{RECORD}>>"
        got = {r.pos: r for r in compared(spark.createDataFrame(rows, schema)).select("pos", "issues", "verdict").collect()}
        for i, (container, _, alternate) in enumerate(cases):
            kinds = [x.kind for x in got[i].issues if x.field == "container"]
            assert kinds == ["alternate-title" if alternate else "mismatch"], (container, second)
            assert (got[i].verdict == "FIELD-MISMATCH") != alternate


def test_notices(spark):
    rows = [(1, "10.1/a", "Correction", "2004-01-01"), (2, "10.1/a", "Retraction", "2010-01-01"), (3, "10.1/b", "Retraction", "2010-01-01"),
            (4, "10.1/b", "Reinstatement", "2011-01-01"), (5, "10.1/c", "", None), (6, "10.1/d", "Novelty", "2012-01-01"),
            (7, "10.1/e", "Retraction", "2012-01-01"), (8, "10.1/e", "Correction", "2012-01-01")]
    df = spark.createDataFrame(rows, "seq long, doi string, nature string, at string").withColumn("notice_doi", F.lit(None).cast("string"))
    got = latest_notices(df)
    assert {r.doi: r.kind for r in got.collect()} == {"10.1/a": "retraction", "10.1/c": "retraction", "10.1/e": "retraction"}
    left = got.withColumn("source", F.lit("retraction-watch"))
    right = spark.createDataFrame([("10.1/a", "expression-of-concern", "n", "pubmed"), ("10.1/z", "retraction", None, "pubmed")], "doi string, kind string, notice_doi string, source string")
    both = {r.doi: (r.kind, r.source, r.notice_doi) for r in merged_notices(left, right).collect()}
    assert both["10.1/a"] == ("retraction", "pubmed,retraction-watch", "n") and both["10.1/z"][1] == "pubmed" and len(both) == 4


def test_fuzzy_duplicates_against_all_pairs(spark):
    import random

    rng = random.Random(1)
    titles = {"".join(rng.choice("abcd ") for _ in range(rng.randint(5, 60))).strip() for _ in range(60)}
    for t in list(titles):
        for _ in range(2):
            at = rng.randrange(len(t))
            titles.add((t[:at] + rng.choice(["", "x", "yz"]) + t[at + rng.randint(0, 1) :]).strip())
    titles = sorted(t for t in titles if t)

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        return new

    want = {(a, b) for i, a in enumerate(titles) for b in titles[i + 1 :] if 200 * lcs(a, b) >= 95 * (len(a) + len(b))}
    df = spark.createDataFrame([(t, t) for t in titles], "key string, title_key string")
    assert {(r.a, r.b) for r in rel.fuzzy_duplicates(df).collect()} == want and want


def test_tree_with_a_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "parent string, child string")
    got = rel.descendants(edges, spark.createDataFrame([("a",)], "node string")).collect()
    assert {(r.node, r.depth) for r in got} == {("a", 0), ("b", 1), ("c", 2)}


def test_citekeys(spark):
    df = spark.createDataFrame([("see [@smith2020; -@jones:a], @fig-1, me@home.org and @end.",)], "text string")
    assert [r.citekey for r in rel.citekeys(df).collect()] == ["smith2020", "jones:a", "end"]


@pytest.mark.parametrize("name", ["verdicts", "issues", "resolution", "suppression", "richest_per_customer", "geography", "isbn_keys"])
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in "part orders region nation supplier".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = core.queries()[name](spark, SF).toPandas()
    want = con.execute(core.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got[columns].astype(str).values)) == sorted(map(tuple, want[columns].astype(str).values))


def test_entry(spark):
    assert entry.entry(spark).count() > 1 and set(entry.oracle_sql()) <= set(entry.queries())
