"""Hand-made audit cases: what is stored, what registries hold, and what must be found.

Each case overrides fields of one reference and of one record.  Queries deal the cases out over
a driver table; their SQL states the findings, written down here and not computed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.schema import RECORD, REFERENCE

PERSON = ("family", "given", "literal", "collective", "et_al")


def _p(family: str, given: str = "", literal: str = "", collective: bool = False, et_al: bool = False) -> dict:
    return dict(zip(PERSON, (family, given, literal, collective, et_al), strict=True))


def _y(**slots: int) -> list[dict]:
    return [{"slot": s, "year": y} for s, y in slots.items()]


TITLE, JOURNAL = "Coffee and risk of stroke", "Journal of Tests"
_SMITH, _JONES, _LEE = _p("Smith", "J"), _p("Jones", "K"), _p("Lee", "B")
_GROUP = _p("", literal="Stroke Study Group", collective=True)
_REF = {"kind": "article", "doi": "10.1/{n}", "title": TITLE, "authors": [_SMITH, _JONES], "year": 2010, "container": JOURNAL, "volume": "5", "issue": "2", "pages": "10-19", "publisher": ""}
_REC = {"doi": "10.1/{n}", "title": TITLE, "authors": [_SMITH, _JONES], "years": _y(print=2010), "container": JOURNAL, "container_short": "J Tests",
        "container_alternates": [], "volume": "5", "issue": "2", "pages": "10-19", "publisher": "", "kind": "journal-article", "retracted": False}
_ISBN = {"kind": "book", "doi": None, "isbn": "0-306-40615-2", "volume": "", "issue": "", "pages": "", "container": ""}


def _case(found: list[tuple], verdict: str, ref: dict | None = None, crossref: dict | None = None, pubmed: dict | None = None, **more) -> dict:
    """found: (field, kind, severity, stored, registry, source, note), suppressed ones too."""
    return {"found": found, "verdict": verdict, "ref": ref or {}, "crossref": crossref, "pubmed": pubmed, **more}


_A, _I, _W, _E = "registry-artifact", "info", "warning", "error"
CASES = [
    _case([], "OK"),
    _case([("title", "drift", _I, TITLE + "s", TITLE, "crossref", "")], "TITLE-DRIFT", {"title": TITLE + "s"}),
    _case([("title", "drift", _W, "Coffee, tea and the risk of stroke", TITLE, "crossref", "similarity 0.86")], "INCOMPLETE", {"title": "Coffee, tea and the risk of stroke"}),
    _case([("title", "mismatch", _E, "Tea and the risk of strokes", TITLE, "crossref", "similarity 0.77")], "FIELD-MISMATCH", {"title": "Tea and the risk of strokes"}),
    _case([("title", "wrong-work", _E, "Quantum walks on trees", TITLE, "crossref", "similarity 0.43"), ("authors", "mismatch", _E, "#1 Smith, J", "#1 Lee, B", "crossref", "")], "WRONG-WORK",
          {"title": "Quantum walks on trees"}, {"authors": [_LEE, _JONES]}),
    _case([("title", "wrong-work", _E, "Quantum walks on trees", TITLE, "crossref", "similarity 0.43")], "FIELD-MISMATCH", {"title": "Quantum walks on trees"}),
    _case([("title", "cosmetic", _I, TITLE.upper(), TITLE, "crossref", "")], "COSMETIC", {"title": TITLE.upper()}),
    _case([("title", _A, _I, TITLE + " in men", TITLE, "crossref", "registry stores a shortened title")], "REGISTRY-ARTIFACT", {"title": TITLE + " in men"}),
    _case([("title", _A, _I, TITLE, f"[The parent article]: {TITLE}", "crossref", "registry prefixes the parent article's title")], "REGISTRY-ARTIFACT", None, {"title": f"[The parent article]: {TITLE}"}),
    _case([("title", _A, _I, "Sorting in O(n) time", "Sorting in O(n)O(n) time", "crossref", "registry title repeats an operator token")], "REGISTRY-ARTIFACT", {"title": "Sorting in O(n) time"}, {"title": "Sorting in O(n)O(n) time"}),
    _case([("title", "missing", _E, "", TITLE, "crossref", "")], "FIELD-MISMATCH", {"title": None}),
    _case([("authors", "count", _W, "1 authors", "2 authors", "crossref", "")], "INCOMPLETE", {"authors": [_SMITH]}),
    _case([("authors", "missing", _E, "", "Smith, J; Jones, K", "crossref", "")], "FIELD-MISMATCH", {"authors": []}),
    _case([("authors", _A, _I, "Smith, J", "Smith, J", "crossref", "registry interleaves collective creator(s) the byline omits: Stroke Study Group")], "REGISTRY-ARTIFACT", None, {"authors": [_SMITH, _GROUP, _JONES]}),
    _case([("authors", _A, _I, "Stroke Study Group", "Smith, J", "crossref", "collective author")], "REGISTRY-ARTIFACT", {"authors": [_GROUP]}),
    _case([("authors", _A, _I, "Jones, K", "Smith, J", "crossref", "reordered"), ("authors", _A, _I, "Smith, J", "Jones, K", "crossref", "reordered")], "REGISTRY-ARTIFACT", {"authors": [_JONES, _SMITH]}),
    _case([("authors", _A, _I, "Gómez, J", "GÃ³mez, J", "crossref", "registry mojibake")], "REGISTRY-ARTIFACT", {"authors": [_p("Gómez", "J"), _JONES]}, {"authors": [_p("GÃ³mez", "J"), _JONES]}),
    _case([("authors", _A, _I, "van Berg, J", "Berg, J", "crossref", "particle filing")], "REGISTRY-ARTIFACT", {"authors": [_p("van Berg", "J"), _JONES]}, {"authors": [_p("Berg", "J"), _JONES]}),
    _case([("authors", _A, _I, "Andersson, J", "Anderson, J", "crossref", "spelling variant with matching initials")], "REGISTRY-ARTIFACT", {"authors": [_p("Andersson", "J"), _JONES]}, {"authors": [_p("Anderson", "J"), _JONES]}),
    _case([("authors", _A, _I, "Garcia, J", "Lopez Garcia, J", "crossref", "compound surname shortened")], "REGISTRY-ARTIFACT", {"authors": [_p("Garcia", "J"), _JONES]}, {"authors": [_p("Lopez Garcia", "J"), _JONES]}),
    _case([("authors", _A, _I, "others", "Jones, K", "crossref", "et-al marker")], "REGISTRY-ARTIFACT", {"authors": [_SMITH, _p("", literal="others", et_al=True)]}),
    _case([("authors", _A, _I, "Smith, J", "Jones, K", "crossref", "registry omits the first author")], "REGISTRY-ARTIFACT", {"authors": [_SMITH, _JONES, _LEE, _p("Roe", "C")]}, {"authors": [_JONES, _LEE, _p("Roe", "C")]}),
    _case([("year", "mismatch", _E, "2012", "print=2010", "crossref", "")], "FIELD-MISMATCH", {"year": 2012}),
    _case([("year", "missing", _W, "", "2010", "crossref", "")], "INCOMPLETE", {"year": None}),
    _case([("year", "alternate-date", _I, "2009", "online=2009, print=2010", "crossref", "cites the online date; registry prefers 2010")], "OK", {"year": 2009}, {"years": _y(print=2010, online=2009)}),
    _case([("year", "alternate-date", _I, "2009", "print=2010, pubmed:issued=2009", "crossref", "stored year is the pubmed:issued one; crossref leads with 2010")], "OK", {"year": 2009}, None, {"years": _y(issued=2009)}),
    _case([("year", _A, _I, "2010", "2015", "crossref", "registry date is a deposit stamp")], "REGISTRY-ARTIFACT", None, {"years": _y(issued=2015)}),
    _case([("container", "alternate-title", _I, "Revista Espanola", JOURNAL, "crossref", "crossref lists this title too")], "OK", {"container": "Revista Espanola"}, {"container_alternates": ["Revista Española"]}),
    _case([("container", _A, _I, "J Tests", JOURNAL, "crossref", "stored name is the journal's ISO abbreviation")], "REGISTRY-ARTIFACT", {"container": "J Tests"}),
    _case([("container", _A, _I, "Jour Tests", JOURNAL, "crossref", "stored name abbreviates the registry name")], "REGISTRY-ARTIFACT", {"container": "Jour Tests"}),
    _case([("container", "disputed", _I, JOURNAL, f"crossref='Tests Quarterly' vs pubmed='{JOURNAL}'", "both", "the corroborating registry has the stored value")], "DISPUTED", None, {"container": "Tests Quarterly"}, {}),
    _case([("container", "disputed", _I, JOURNAL, "crossref='Second' vs pubmed='Third'", "both", "the registries disagree")], "DISPUTED", None, {"container": "Second"}, {"container": "Third"}),
    _case([("container", "mismatch", _E, "Annals", JOURNAL, "crossref", "")], "FIELD-MISMATCH", {"container": "Annals"}),
    _case([("volume", "missing", _W, "", "5", "crossref", "")], "INCOMPLETE", {"volume": ""}),
    _case([("volume", "missing", _W, "", "6", "pubmed", "")], "INCOMPLETE", {"volume": ""}, {"volume": ""}, {"volume": "6"}),
    _case([("pages", "mismatch", _E, "11-19", "10-19", "crossref", "")], "FIELD-MISMATCH", {"pages": "11-19"}),
    _case([], "OK", {"pages": "0010--19"}),
    _case([("pages", _A, _I, "10-19", "e12345", "crossref", "one side gives an article number")], "REGISTRY-ARTIFACT", None, {"pages": "e12345"}),
    _case([("pages", "disputed", _I, "11", "crossref='10-19' vs pubmed='11-20'", "both", "the corroborating registry has the stored value")], "DISPUTED", {"pages": "11"}, None, {"pages": "11-20"}),
    _case([("kind", "incompatible", _W, "thesis", "article", "crossref", "the record is of another type than the entry")], "INCOMPLETE", {"kind": "thesis"}),
    _case([], "OK", {"kind": "preprint"}),
    _case([("doi", "alias", _I, "10.1/{n}", "10.1/other", "crossref", "the record is filed under another DOI than the one that led to it")], "OK", None, {"doi": "10.1/other"}),
    _case([("status", "retracted", _E, "", "Retraction", "crossref", "retraction recorded by crossref; pubmed answered without one")], "RETRACTED", None, {"retracted": True, "retraction_kind": "Retraction"}, {}),
    _case([("status", "expression-of-concern", _E, "", "expression-of-concern", "retraction-watch", "doubt, not retraction: concern recorded by retraction-watch")], "FIELD-MISMATCH", notice=("expression-of-concern", "retraction-watch")),
    _case([("status", "retracted", _E, "", "pubmed=retraction; retraction-watch=retraction", "pubmed,retraction-watch", "retraction recorded by pubmed, retraction-watch; crossref answered without one")], "RETRACTED", notice=("retraction", "pubmed,retraction-watch")),
    _case([("doi", "unresolved", _E, "10.1/{n}", "", "", "no registry that was asked has it")], "BAD-ID", absent=True),
    _case([("isbn", "malformed", _E, "0306406153", "", "", "the ISBN's check digit is wrong, so no registry was asked")], "BAD-ID", {**_ISBN, "isbn": "0306406153"}, absent=True),
    _case([], "OK", _ISBN, absent=True, book=True),
    _case([("publisher", "missing", _W, "", "Press", "openlibrary", "")], "INCOMPLETE", {**_ISBN, "isbn": "9780140328721"}, absent=True, book="Press"),
    _case([("identifier", "not-asked", _I, "123", "", "", "no registry was asked for this identifier")], "UNCHECKED", {"doi": None, "pmid": "123"}, absent=True),
    _case([("identifier", "absent", _E, "", "", "", "no identifier, and no registry record that surely is this work")], "UNCONFIRMED", {"doi": None}, absent=True),
]


def _filled(values: dict, n: int) -> dict:
    return {k: v.format(n=n) if isinstance(v, str) and "{n}" in v else v for k, v in values.items()}


def tables(spark: SparkSession) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(references numbered by pos, registries, notices) of all cases: a few dozen literal rows."""
    rows: dict[str, list] = {"refs": [], "crossref": [], "pubmed": [], "openlibrary": [], "notices": []}
    for n, case in enumerate(CASES):
        rows["refs"].append({"pos": n, "key": f"c{n}", "locator": f"c.bib:{n}"} | _filled(_REF | case["ref"], n))
        key = {"key": f"10.1/{n}", "identifier": f"10.1/{n}"}
        if not case.get("absent"):
            rows["crossref"].append(key | {"source": "crossref"} | _filled(_REC | (case["crossref"] or {}), n))
        if case["pubmed"] is not None:
            rows["pubmed"].append(key | {"source": "pubmed"} | _filled(_REC | case["pubmed"], n))
        if book := case.get("book"):
            isbn = "9780306406157" if book is True else "9780140328721"
            found = {"title": TITLE, "authors": [_SMITH, _JONES], "years": _y(issued=2010), "kind": "book", "publisher": "" if book is True else book, "retracted": False}
            rows["openlibrary"].append({"key": isbn, "identifier": isbn, "source": "openlibrary"} | found)
        if notice := case.get("notice"):
            rows["notices"].append((f"10.1/{n}", *notice))
    records = {s: spark.createDataFrame(rows[s], f"key string, {RECORD}") for s in ("crossref", "pubmed", "openlibrary")}
    records["datacite"] = spark.createDataFrame([], f"key string, {RECORD}")
    return spark.createDataFrame(rows["refs"], REFERENCE), records, spark.createDataFrame(rows["notices"], "doi string, kind string, source string")


def dealt(cases: DataFrame, rows: DataFrame, pos: str) -> DataFrame:
    """cases, one for each of rows, in turn; ``pos`` names the row."""
    # a few dozen literal rows
    return rows.select(F.col(pos).alias("row"), (F.col(pos) % len(CASES)).alias("nth")).join(
        F.broadcast(cases.withColumnRenamed("pos", "nth")), "nth"
    ).withColumn("pos", F.col("row")).drop("row", "nth")


def _literal(value) -> str:
    return "'" + str(value).replace("'", "''") + "'"


def issues_sql() -> str:
    """DuckDB SQL for the findings of cases dealt out over part."""
    rows = [
        f"({n}, {', '.join(_literal(x.format(n=n)) for x in issue)})" for n, case in enumerate(CASES) for issue in case["found"]
    ]
    return f"""SELECT p_partkey AS pos, field, kind, severity, stored, registry, source, note FROM part
        JOIN (VALUES {', '.join(rows)}) AS c(nth, field, kind, severity, stored, registry, source, note) ON p_partkey % {len(CASES)} = nth"""


def verdicts_sql() -> str:
    rows = ", ".join(f"({n}, {_literal(case['verdict'])})" for n, case in enumerate(CASES))
    return f"SELECT p_partkey AS pos, verdict FROM part JOIN (VALUES {rows}) AS c(nth, verdict) ON p_partkey % {len(CASES)} = nth"
