"""The command line from files to exit codes, against registries in a dictionary."""

import io
import json

import pytest

from citeledger.cli import duplicate_report, main
from citeledger.report import Style, has_colour, issue_lines
from citeledger.sources.bibtex import read_bibtex
from citeledger.sources.http import Client
from citeledger.suggest import with_fields
from tests.test_sources import Fake

BIB = """@article{good,
  title = {A good title about rivers},
  author = {Smith, John},
  year = {2010},
  journal = {River Studies},
  doi = {10.1234/good}
}
@article{wrong, title = {Another title about lakes}, author = {Doe, Jane}, year = {1999}, journal = {River Studies}, volume = {1}, doi = {10.1234/wrong}}
@article{gone, title = {Retracted paper on ponds}, author = {Roe, Ann}, year = {2001}, journal = {Ponds}, doi = {10.1234/gone}}
@article{noid, title = {Without identifier but findable}, author = {Poe, Al}, year = {2005}}
"""


def _work(doi, title, family, year, **more):
    return {"DOI": doi, "title": [title], "author": [{"family": family, "given": "J."}], "issued": {"date-parts": [[year]]}, "container-title": ["River Studies"], "type": "journal-article", **more}


WORKS = [
    _work("10.1234/GOOD", "A good title about rivers", "Smith", 2010, volume="7"),
    _work("10.1234/wrong", "Another title about lakes", "Doe", 2001, volume="1"),
    {**_work("10.1234/gone", "Retracted paper on ponds", "Roe", 2001), "container-title": ["Ponds"], "updated-by": [{"type": "retraction", "DOI": "10.1234/notice"}]},
]
FOUND = {"message": {"items": [_work("10.1234/found", "Without identifier but findable", "Poe", 2005)]}}
ANSWERS = [("query.bibliographic", FOUND), ("filter=doi", {"message": {"items": WORKS}}), ("esearch", {"esearchresult": {"idlist": []}}), ("retractionwatch", b"OriginalPaperDOI,RetractionNature,RetractionDate,RetractionDOI\n")]


@pytest.fixture
def project(tmp_path):
    (tmp_path / "refs.bib").write_text(BIB)
    (tmp_path / "page.md").write_text("---\nbibliography: refs.bib\n---\nSee @good and @missing.\n")
    return tmp_path


def test_check(spark, project, capsys):
    client = Client(transport=Fake(ANSWERS), wait=lambda s: None)
    cache, out = ["--cache-dir", str(project / "kept")], ["-o", str(project / "report.json"), "--format", "json"]
    assert main(["check", str(project), "--suggest", *cache, *out], spark, client) == 1
    report = json.loads((project / "report.json").read_text())
    verdicts = {r["key"]: r["verdict"] for r in report["results"]}
    assert verdicts == {"good": "INCOMPLETE", "wrong": "FIELD-MISMATCH", "gone": "RETRACTED", "noid": "INCOMPLETE"}
    assert report["summary"]["exit_code"] == 1 and report["results"][0]["consulted"]["crossref"] == "answered"
    copy = (project / "refs.suggested.bib").read_text()
    assert "  volume = {7},\n}" in copy and "doi = {10.1234/found}" in copy and (project / "refs.bib").read_text() == BIB
    assert "+" in (project / "refs.suggested.diff").read_text() and "not" not in capsys.readouterr().out
    # a second run needs no network
    offline = Client(transport=Fake([], ["http"]), wait=lambda s: None)
    assert main(["check", str(project / "refs.bib"), "--offline", "--fail-on", "retracted", "-v", "--show-suppressed", *cache], spark, offline) == 1
    text = capsys.readouterr().out
    assert "RETRACTED  (1)" in text and "FAIL: 1" in text and "failing set: RETRACTED" in text and "year/mismatch" in text
    assert main(["cache", "info", *cache], spark) == 0 and "answers" in capsys.readouterr().out
    assert main(["cache", "clear", *cache], spark) == 0


def test_usage(spark, tmp_path, capsys):
    (tmp_path / "empty.bib").write_text("")
    for args in (["check", str(tmp_path / "none.bib")], ["check", str(tmp_path / "empty.bib"), "--cache-dir", str(tmp_path / "c")]):
        assert main(args, spark) == 2
    assert capsys.readouterr().err.count("citeledger:") == 2


def test_report_parts(spark, project):
    issue = {"field": "year", "kind": "mismatch", "severity": "error", "stored": "1" * 200, "registry": "2", "source": "", "note": "why"}
    lines = list(issue_lines(issue, Style()))
    assert lines[0] == "      year/mismatch  (why)" and lines[1].endswith("1…") and lines[2].split() == ["registry", "2"]
    assert Style(True).verdict("RETRACTED").startswith("\x1b[31m") and Style().verdict("OK") == "OK" and not has_colour(io.StringIO())
    assert with_fields("@a{k, t = {x}}", {"year": "1"}) == "@a{k, t = {x},\n  year = {1},\n}" and with_fields("@a(k)", {"y": "1"}) == "@a(k)"
    refs, _ = read_bibtex(spark, [str(project / "refs.bib")])
    twice = refs.unionByName(refs)
    report = duplicate_report(twice)
    assert report["doi"].count() == 3 and report["key"].count() == 4 and duplicate_report(refs)["title"].count() == 0
