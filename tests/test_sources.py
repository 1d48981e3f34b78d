"""Files, libraries and registry answers, on small fixtures with every case."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from citeledger.functions.names import Person
from citeledger.scratch import spread
from citeledger.sources import libraries, lookups, markdown, notices, registries, rules
from citeledger.sources.bibtex import bad_blocks, bibtex_blocks, bibtex_references, blocks_of, entry_locators
from citeledger.sources.files import UsageError, expand, file_table, text_table
from citeledger.sources.http import Answers, Client, Transient, jitter, retry_after

BIB = r"""% notes with a stray { and @nothing
@article{one, title = {First}, author = {Smith, John}, year = 2020, journal = {J One}}@article{two, title = {Second}, author = {Doe, Jane}, year = {2021}, journal = {J Two}}
@string{pub = "Big Press"}
@comment{@article{hidden, title = {No}}}
@article{at,
  author  = {Garcia, Maria},
  title   = {Replies to {@}mentions, @article{x} too},
  doi     = {10.1016/S0140-6736(03)14065-2},
}
  @Book(volume1,
    editor = "Hidalgo, P. and {World Health Organization}",
    title = {Methods} # " in " # {Banking},
    publisher = pub,
    url = {https://doi.org/10.1234/Url.Only},
    doi = {N/A},
    isbn = {0-306-40615-2},
    date = {2015-03-01})
@article{group, author = {{The Hormones and Cancer Collaborative Group}}, title = {T \& \'{e}t\'{e}}, volume={3}, number={4}, pages={1--9}}
@article{many, author = {Gil, M and Huerta, C and others}, title = {Cut}}
@article{one, title = {Again}, year = {1999}}
@article{twice, title = {A}, title = {B}}
@article{broken, title = {never closed, year = {2000}
@article{after, title = {Read all the same}, year = {2001}}
@article{open, title = {end of file}
"""


@pytest.fixture(scope="module")
def bib(spark):
    files = spark.createDataFrame([(0, "/x/refs.bib", bytearray(BIB.encode()))], "file_no int, path string, content binary")
    blocks = bibtex_blocks(files).cache()
    return blocks, {r.key: r for r in bibtex_references(blocks).collect()}


def test_bibtex_entries(bib):
    blocks, refs = bib
    assert sorted(refs) == ["after", "at", "group", "many", "one", "two", "volume1"]
    assert refs["one"].title == "First" and refs["one"].year == 2020 and refs["one"].locator == refs["two"].locator == "refs.bib:2"
    assert refs["at"].title == "Replies to @mentions, @articlex too" and refs["at"].doi == "10.1016/s0140-6736(03)14065-2" and refs["at"].locator == "refs.bib:5"
    book = refs["volume1"]
    assert (book.title, book.publisher, book.doi, book.isbn, book.year, book.kind) == ("Methods in Banking", "Big Press", "10.1234/url.only", "0-306-40615-2", 2015, "book")
    assert [(a.family, a.literal) for a in book.authors] == [("Hidalgo", ""), ("", "World Health Organization")] and json.loads(book.raw)["creator_role"] == "editor"
    assert len(refs["group"].authors) == 1 and refs["group"].authors[0].collective and refs["group"].title == "T \\& ete"
    assert (refs["group"].volume, refs["group"].issue, refs["group"].pages) == ("3", "4", "1--9")
    assert [a.et_al for a in refs["many"].authors] == [False, False, True]
    order = [r.key for r in bibtex_references(blocks).orderBy("pos").collect()]
    assert order == ["one", "two", "at", "volume1", "group", "many", "after"]


def test_bibtex_bad_blocks(spark, bib):
    bad = {(r.key, r.line): r.reason for r in bad_blocks(bib[0]).collect()}
    assert "duplicate citekey" in bad["one", 20] and "given twice" in bad["twice", 21]
    assert "failed to parse" in bad["broken", 22] and "failed to parse" in bad["open", 24] and len(bad) == 4
    keys = spark.createDataFrame([("/x/refs.bib", "at"), ("/x/refs.bib", "nowhere")], "path string, key string")
    assert {r.locator for r in entry_locators(bib[0], keys).collect()} == {"refs.bib:5", "refs.bib:?"}
    assert list(blocks_of("x", b"")) == [] and list(blocks_of("x", "@ {} @".encode())) == []


NOTE = """---
title: "A: b"
bibliography: [refs/a.bib, "b.bib"]
nocite: |
  @early2000, @fig-none

  @later2001
other: 1
---
See [@smith2020; -@jones:a], @fig-1, me@home.org, `@code2000` and [[@linked2019|note]] but ![[@embedded]].
DOIs: 10.1000/abc, `10.1000/Code` and (https://doi.org/10.1000/abc).
```{r}
x <- read.delim(text = "Author|Year|Journal|DOI
Smith & Jones|2001|J One|10.2000/t1
Doe|2002||10.2000/t2
short|row", sep = "|", header = TRUE) # 10.9999/comment
y <- data.frame(Year = c(1999, 2000), DOI = c('10.3000/v1', "10.3000/v2"), Author = c("A, B", "C, D"))
z <- data.frame(DOI = c("10.4000/u1", "10.4000/u2"), Year = c(1999)) # ragged
```
~~~
@masked 10.5000/fenced
"""


def test_markdown_scan(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".obsidian").mkdir()
    note, plain = tmp_path / "sub" / "note.md", tmp_path / "plain.qmd"
    note.write_text(NOTE)
    plain.write_text("No front matter @solo.\n")
    refs, cited, bibs = markdown.read_markdown(spark, [tmp_path])
    places = {}
    for r in cited.orderBy("pos").collect():
        places.setdefault(r.citekey, []).append(r.locator)
    assert list(places) == ["solo", "early2000", "later2001", "linked2019", "smith2020", "jones:a"]
    assert places["later2001"] == ["sub/note.md:7"] and places["smith2020"] == ["sub/note.md:10"] and places["solo"] == ["plain.qmd:1"]
    found = {r.doi: r for r in refs.collect()}
    assert set(found) == {f"10.{x}" for x in "1000/abc 1000/code 2000/t1 2000/t2 3000/v1 3000/v2 4000/u1 4000/u2 5000/fenced 9999/comment".split()}
    t1, v2, u1 = found["10.2000/t1"], found["10.3000/v2"], found["10.4000/u1"]
    assert (t1.kind, t1.year, t1.container, [a.family for a in t1.authors], t1.locator) == ("article", 2001, "J One", ["Smith", "Jones"], "sub/note.md:14")
    assert (v2.year, v2.authors[0].family, v2.kind, v2.locator) == (2000, "C", "article", "sub/note.md:17")
    assert u1.year is None and u1.kind == "other" and "not paired" in json.loads(u1.raw)["warning"]
    assert found["10.1000/abc"].kind == "other" and found["10.1000/abc"].locator == "sub/note.md:11"
    assert [p.name for p in bibs] == ["a.bib", "b.bib"] and bibs[0].parent == tmp_path.resolve() / "refs"


def test_project_bibliography(tmp_path):
    (tmp_path / "_quarto.yml").write_text("project:\n  type: book\nbibliography:\n  - one.bib\n  - 'two.bib'\nx: 1\n")
    (tmp_path / "a").mkdir()
    assert [p.name for p in markdown.project_bibliography(tmp_path / "a")] == ["one.bib", "two.bib"]
    assert markdown.yaml_values(["bibliography: x.bib\n"], "bibliography") == ["x.bib"] and markdown.yaml_values(["a: 1"], "b") == []
    assert markdown.front_matter(["---\n", "a: 1\n"]) == 0 and markdown.front_matter(["﻿---\n", "...\n"]) == 2


def test_expand(tmp_path):
    for name in ("a.bib", "b.md", "c.suggested.bib", "d.txt", ".hidden/e.bib", "_site/f.md", "lib.json"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    bibs, docs, libs = expand([str(tmp_path), str(tmp_path / "a.bib"), str(tmp_path / "lib.json"), "local"])
    assert [p.name for p in bibs] == ["a.bib"] and [p.name for p in docs] == ["b.md"] and [x[-8:] for x in libs] == ["lib.json", "local"]
    for bad in (tmp_path / "none", tmp_path / "d.txt"):
        with pytest.raises(UsageError):
            expand([str(bad)])


def test_rules(tmp_path):
    (tmp_path / rules.CONFIG).write_text('[[ignore]]\nkey = "smith*"\nfield = "year"\nreason = "print date"\n[[ignore]]\nreason = "x"\n')
    (tmp_path / "deep").mkdir()
    assert rules.load_rules(tmp_path / "deep")[0] == [("smith*", "year", "*", "print date"), ("*", "*", "*", "x")]
    (tmp_path / "deep" / ".git").mkdir()
    assert rules.load_rules(tmp_path / "deep") == ([], None)
    for bad in ("[[ignore]]\nkey='a'", "[[ignore]]\nreason='r'\nkind2='x'", "ignore = 3", "ignore = [1]", "="):
        with pytest.raises(rules.RuleError):
            rules.parse_rules(bad)


def _files(spark, text):
    return spark.createDataFrame([(0, "x.json", bytearray(text.encode()))], "file_no int, path string, content binary")


def test_csl_and_native_json(spark):
    csl = [
        {"id": "a", "type": "article-journal", "title": "T", "author": [{"family": "Smith", "given": "J"}, {"literal": "The Group"}], "issued": {"date-parts": [["2020", 1]]},
         "DOI": "https://doi.org/10.1/A", "container-title": "J", "volume": 3, "page": "1-2"},
        {"id": "b", "type": "book", "title": "B", "editor": [{"family": "Ed", "given": "I"}], "issued": {"raw": "circa 1999"}, "ISBN": "1"}, "no item", {"type": "chapter", "issued": {"date-parts": [[2001]]}},
    ]
    got = {r.key: r for r in libraries.json_references(_files(spark, json.dumps(csl))).collect()}
    a, b = got["a"], got["b"]
    assert (a.kind, a.doi, a.year, a.container, a.volume, a.pages, a.locator) == ("article", "10.1/a", 2020, "J", "3", "1-2", "zotero:a")
    assert [(n.family, n.literal, n.collective) for n in a.authors] == [("Smith", "", False), ("", "The Group", True)]
    assert b.year == 1999 and b.authors[0].family == "Ed" and json.loads(b.raw)["creator_role"] == "editor" and got["unknown"].year == 2001
    native = [{"key": "K1", "data": {"key": "K1", "itemType": "journalArticle", "title": "N", "date": "May 2010", "DOI": "10.2/b", "creators": [
        {"creatorType": "author", "lastName": "Doe", "firstName": "J"}, {"creatorType": "author", "name": "WHO"}, {"creatorType": "translator", "lastName": "X"}]}},
        {"key": "K2", "data": {"key": "K2", "itemType": "attachment"}}]
    for wrapped in (native, {"items": native}, {"data": native}):
        rows = libraries.json_references(_files(spark, json.dumps(wrapped))).collect()
        assert [(r.key, r.year, r.kind, len(r.authors), r.authors[1].collective) for r in rows] == [("K1", 2010, "article", 2, True)]
    with pytest.raises(libraries.LibraryError):
        libraries.json_references(_files(spark, json.dumps(native)), csl_only=True)
    assert libraries.json_references(_files(spark, "{}")).count() == 0 and not libraries.invalid_json(_files(spark, "{no")).isEmpty()


def _database(path):
    con = sqlite3.connect(path)
    for name, columns in libraries.TABLES.items():
        con.execute(f'CREATE TABLE "{name}" ({columns.replace(" int", " INTEGER").replace(" string", " TEXT")})')
    put = lambda t, *rows: con.executemany(f'INSERT INTO "{t}" VALUES ({",".join("?" * len(rows[0]))})', rows)
    put("libraries", (1, "user"), (2, "group"), (3, "group"))
    put("groups", (2, "Lab"))
    put("itemTypes", (1, "journalArticle"), (2, "attachment"), (3, "book"))
    put("items", (1, 1, 1, "AAA"), (2, 2, 1, "BBB"), (3, 3, 1, "CCC"), (4, 1, 2, "DDD"), (5, 1, 1, "EEE"), (6, 1, 3, "FFF"))
    put("fieldsCombined", (1, "title"), (2, "date"), (3, "DOI"), (4, "publicationTitle"))
    put("itemDataValues", (1, "One"), (2, "2011-02-03"), (3, "10.1/x"), (4, "J"), (5, "Book"), (6, "Last wins"))
    put("itemData", (1, 1, 1), (1, 2, 2), (1, 3, 3), (1, 4, 4), (3, 1, 5), (5, 1, 5), (1, 1, 6), (4, 1, 1))
    put("creatorTypes", (1, "author"), (2, "editor"))
    put("creators", (1, "Ann", "Alpha", 0), (2, "", "The Group", 1), (3, "Ed", "Itor", 0))
    put("itemCreators", (1, 2, 1, 1), (1, 1, 1, 0), (1, 3, 2, 2), (3, 3, 2, 0))
    put("deletedItems", (5,))
    put("collections", (1, "Top", None, 1), (2, "Sub", 1, 1), (3, "top", None, 2), (4, "Loop", 2, 1))
    con.execute("UPDATE collections SET parentCollectionID = 4 WHERE collectionID = 1")
    put("collectionItems", (2, 1), (3, 4))
    con.commit()
    con.close()


def test_library_database(spark, tmp_path):
    path = tmp_path / "zotero.sqlite"
    _database(path)
    base = libraries.Database(spark, tmp_path)
    got = {r.key: r for r in libraries.database_references(base).collect()}
    assert sorted(got) == ["AAA", "CCC"] and got["AAA"].title == "Last wins" and got["AAA"].doi == "10.1/x" and got["AAA"].year == 2011 and got["AAA"].container == "J"
    assert [(n.family, n.literal) for n in got["AAA"].authors] == [("Alpha", ""), ("", "The Group")]
    assert got["CCC"].authors[0].family == "Itor" and json.loads(got["CCC"].raw)["creator_role"] == "editor" and got["CCC"].kind == "book"
    assert {r.key for r in libraries.database_references(base, trashed=True).collect()} == {"AAA", "CCC", "EEE"}
    assert [r.key for r in libraries.database_references(base, collection="TOP").collect()] == ["AAA"]
    with pytest.raises(libraries.LibraryError):
        base.collection_items("none", 1)
    assert {(r.name, r.n) for r in base.group_items(1).collect()} == {("Lab", 1), (None, 1)}
    with pytest.warns(RuntimeWarning, match="Lab"):
        libraries.warn_of_groups(base)
    (tmp_path / "zotero.sqlite-wal").write_bytes(b"")
    with pytest.warns(RuntimeWarning, match="being written"):
        libraries.Database(spark, path)
    with pytest.raises(FileNotFoundError):
        libraries.Database(spark, tmp_path / "none.sqlite")


def test_running_library(spark):
    items = [{"data": {"key": f"K{i}", "itemType": "book", "title": f"T{i}", "collections": ["C2"] if i % 2 else []}} for i in range(130)]
    tree = [{"data": {"key": "C1", "name": "Top", "parentCollection": False}}, {"data": {"key": "C2", "name": "Sub", "parentCollection": "C1"}}]
    pages = {"/items": items, "/items/trash": [{"data": {"key": "Z", "itemType": "book"}}], "/collections": tree}
    call = lambda path, p: pages[path][int(p["start"]) : int(p["start"]) + int(p["limit"])]
    assert libraries.local_references(spark, call=call).count() == 130
    assert libraries.local_references(spark, trashed=True, call=call).count() == 131
    assert libraries.local_references(spark, collection="top", call=call).count() == 65
    with pytest.raises(libraries.LibraryError):
        libraries.local_collections(spark, "none", call)


def _one(spark, function, payload, key="k"):
    return function(spark.createDataFrame([(key, payload if isinstance(payload, str) else json.dumps(payload))], "key string, payload string")).first()


def test_crossref_records(spark):
    work = {
        "DOI": "10.1/A", "title": ["A <i>title</i>"], "subtitle": ["More"], "author": [{"family": "Smith", "given": "J"}, {"name": "Group"}, {}], "editor": [{"family": "No"}],
        "published-print": {"date-parts": [[2020, 1]]}, "published-online": {"date-parts": [[None]]}, "issued": {"date-parts": [[2019]]},
        "container-title": ["Series", "Volume", ""], "short-container-title": ["Ser"], "volume": "3", "page": "1-9", "type": "journal-article",
        "updated-by": [{"DOI": "10.1/n", "type": "correction"}, {"DOI": "10.1/c", "type": "Expression of Concern"}, {"DOI": "10.1/r", "type": "Retraction"}],
    }
    r = _one(spark, registries.crossref_records, work)
    assert (r.doi, r.title, r.container, r.container_alternates, r.container_short, r.volume, r.issue, r.pages) == ("10.1/a", "A title: More", "Series", ["Volume"], "Ser", "3", None, "1-9")
    assert [(a.family, a.literal) for a in r.authors] == [("Smith", ""), ("", "Group")] and [(y.slot, y.year) for y in r.years] == [("print", 2020), ("issued", 2019)]
    assert r.retracted and r.retraction_kind == "Retraction" and r.source == "crossref"
    notice = {"DOI": "10.1/n", "title": ["N"], "subtitle": ["n"], "editor": [{"family": "Ed"}],
              "update-to": [{"DOI": "10.1/p", "type": "retraction", "source": "publisher"}, {"DOI": "10.1/p", "type": "retraction", "source": "retraction-watch"}],
              "updated-by": [{"DOI": "10.1/p", "type": "retraction", "source": "publisher"}]}
    r = _one(spark, registries.crossref_records, notice)
    assert not r.retracted and r.title == "N" and r.authors[0].family == "Ed"
    notice["updated-by"].append({"DOI": "10.1/p", "type": "retraction", "source": "retraction-watch"})
    assert _one(spark, registries.crossref_records, notice).retracted
    empty = _one(spark, registries.crossref_records, {})
    assert empty.title is None and empty.authors == [] and empty.years == [] and not empty.retracted


def test_datacite_records(spark):
    a = {"titles": [{"title": "Sub", "titleType": "Subtitle"}, {"title": "Main"}], "creators": [
        {"familyName": "Doe", "givenName": "J"}, {"name": "CERN", "nameType": "Organizational"}, {"name": "Roe, Jane"}, {}], "publicationYear": 2015,
        "container": {"title": "C", "firstPage": "3", "lastPage": "9"}, "types": {"resourceTypeGeneral": "Dataset"}}
    for payload in (a, {"data": {"attributes": a}}):
        r = _one(spark, registries.datacite_records, payload)
        assert (r.title, r.years[0].year, r.container, r.pages, r.kind) == ("Main", 2015, "C", "3-9", "Dataset")
        assert [(n.family, n.literal, n.collective) for n in r.authors] == [("Doe", "", False), ("", "CERN", True), ("Roe", "", False)]
    assert _one(spark, registries.datacite_records, {"titles": [{"title": "Only", "titleType": "Other"}]}).title == "Only"


MEDLINE = """PMID- 1
TI  - A long title that
      goes on in the U.S.A.
FAU - Smith, John
FAU - Study Group
DP  - 2010 May
JT  - Journal of Things
TA  - J Things
VI  - 5
PG  - 10-9
PT  - Journal Article
PT  - Retracted Publication

PMID- 2
TI  - [Ein Titel].
AU  - van der Berg JK
AU  - Consortium of All
DP  - no year
ECI - Lancet. 2012;1:2. doi: 10.5555/concern. PMID 3
"""


def test_medical_records(spark):
    rows = registries.medline_rows(spark.createDataFrame([(MEDLINE,), ("",), (None,)], "text string")).withColumn("key", F.concat(F.lit("10.1/"), "pmid"))
    got = {r.key: r for r in registries.medical_records(rows.select("key", "fields")).collect()}
    a, b = got["10.1/1"], got["10.1/2"]
    assert a.title == "A long title that goes on in the U.S.A." and a.retracted and a.retraction_kind == "Retracted Publication" and a.years[0].year == 2010
    assert [(n.family, n.collective) for n in a.authors] == [("Smith", False), ("", True)] and a.container_short == "J Things"
    assert b.title == "Ein Titel" and [(n.family, n.given) for n in b.authors][0] == ("van der Berg", "JK") and b.authors[1].collective and b.years == []
    found = {r.doi: (r.kind, r.notice_doi, r.date) for r in notices.medical_notices(registries.medical_records(rows.select("key", "fields"))).collect()}
    assert found == {"10.1/1": ("retraction", None, "2010"), "10.1/2": ("expression-of-concern", "10.5555/concern", "2012")}


def test_books_and_discovery(spark):
    b = _one(spark, registries.book_records, {"title": "T", "subtitle": "S", "authors": [{"name": "Ann Lee"}], "publish_date": "May 1999", "publishers": [{"name": "P"}], "number_of_pages": 12})
    assert (b.title, b.authors[0].family, b.years[0].year, b.publisher, b.pages, b.kind) == ("T: S", "Lee", 1999, "P", "12", "book")
    d = _one(spark, registries.book_search_records, {"title": "T", "author_name": ["A B"], "first_publish_year": 2001, "publisher": ["P", "Q"], "number_of_pages_median": 0})
    assert (d.title, d.years[0].year, d.publisher, d.pages) == ("T", 2001, "P", None)
    e = _one(spark, registries.europepmc_records, {"doi": "10.1/E", "title": "T", "pubYear": "2003", "journalInfo": {"volume": "1", "journal": {"title": "J"}}, "pubTypeList": {"pubType": ["preprint"]},
             "authorList": {"author": [{"collectiveName": "G"}, {"lastName": "L", "initials": "AB"}, {"fullName": "Doe J"}, {}]}})
    assert (e.doi, e.container, e.kind) == ("10.1/e", "J", "preprint") and [(n.family, n.given, n.literal) for n in e.authors] == [("", "", "G"), ("L", "AB", ""), ("Doe", "J", "")]
    o = _one(spark, registries.openalex_records, {"doi": "https://doi.org/10.1/O", "display_name": "T", "publication_year": 2004, "biblio": {"first_page": "1", "last_page": "2"},
             "authorships": [{"author": {"display_name": "Jo Roe"}}, {"raw_author_name": "Bo Poe"}], "primary_location": {"source": None}, "type": "article"})
    assert (o.doi, o.title, o.pages, o.container) == ("10.1/o", "T", "1-2", None) and [n.family for n in o.authors] == ["Roe", "Poe"]


def test_notice_export(spark, tmp_path):
    head = "Record ID,Title,RetractionDate,RetractionDOI,OriginalPaperDOI,RetractionNature,Notes,"
    rows = [
        '1,"A, quoted\nover lines",3/6/2004 0:00,10.1/n1,10.1/A,Correction,,', "2,x,2/6/2010 0:00,10.1/n2,10.1/a,Retraction,,", "3,x,1/1/2020 0:00,unavailable,10.1/b,,,",
        "4,x,1/1/2019 11:30:00 PM,10.1/n4,10.1/c,Retraction,,", "5,x,6/15/2022 0:00,10.1/n5,10.1/c,Reinstatement,,", "6,x,1/1/2020 0:00,10.1/n6,,Retraction,,",
        "7,x,1/1/2020 0:00,10.1/n7,Unavailable,Retraction,,", "8,x,1/1/2020 0:00,10.1/n8,10.1/d,Republication,,", "9,x,someday,10.1/n9,10.1/e,Expression of concern,,",
    ]
    (tmp_path / "n.csv").write_text("\n".join([head, *rows]) + "\n")
    got = {r.doi: (r.kind, r.notice_doi, r.date) for r in notices.notice_index(notices.read_notices(spark, str(tmp_path / "n.csv"))).collect()}
    assert got == {"10.1/a": ("retraction", "10.1/n2", "2010-02-06"), "10.1/b": ("retraction", None, "2020-01-01"), "10.1/e": ("expression-of-concern", "10.1/n9", None)}


def test_client():
    said, slept = [], []

    def transport(url, headers, timeout):
        said.append(url)
        answers = {"http://a/ok": (200, {}, b'{"x": 1}'), "http://a/none": (404, {}, b""), "http://a/busy": (503, {"Retry-After": "500"}, b"")}
        if url == "http://a/down":
            raise OSError("no route")
        return answers[url]

    client = Client("me@x.org", transport=transport, wait=slept.append)
    assert client.json("http://a/ok") == {"x": 1} and client.json("http://a/none") is None and client.headers()["User-Agent"].endswith("me@x.org")
    for bad in ("http://a/down", "http://a/busy"):
        with pytest.raises(Transient):
            client.text(bad)
    assert said.count("http://a/down") == 5 and 60.0 in slept
    with pytest.raises(ValueError):
        client.body("file:///etc/passwd")
    assert 0 <= jitter("x") <= 0.5 and jitter("x") == jitter("x") and retry_after({"Retry-After": "soon"}) is None and retry_after({}) is None


class Fake:
    """A registry in a dictionary; addresses that contain ``down`` fail."""

    def __init__(self, answers, down=()):
        self.answers, self.down = answers, down

    def __call__(self, url, headers, timeout):
        if any(d in url for d in self.down):
            raise OSError("down")
        body = next((b for part, b in self.answers if part in url), None)
        return (404, {}, b"") if body is None else (200, {}, body if isinstance(body, bytes) else json.dumps(body).encode())


def test_lookups_keep_answers(spark, tmp_path):
    work = {"DOI": "10.1/A", "title": ["T"]}
    client = Client(transport=Fake([("works?rows", {"message": {"items": [work]}})]), wait=lambda s: None)
    keys = spark.createDataFrame([("10.1/a",), ("10.1/b",), (None,), ("10.1/a",)], "key string")
    answers = Answers(spark, tmp_path / "kept")
    records, failed = lookups.Lookups(client, answers).crossref(keys)
    assert [r.key for r in records.collect()] == ["10.1/a"] and failed.isEmpty() and answers.info()[0] == 2
    offline = lookups.Lookups(Client(transport=Fake([], ["http"]), wait=lambda s: None), answers, offline=True)
    records, failed = offline.crossref(keys.unionByName(spark.createDataFrame([("10.1/new",)], "key string")))
    assert [r.title for r in records.collect()] == ["T"] and [r.key for r in failed.collect()] == ["10.1/new"]
    down = lookups.Lookups(Client(transport=Fake([], ["http"]), wait=lambda s: None), answers, refresh=True)
    assert down.crossref(keys)[1].count() == 2
    assert Answers(spark, tmp_path / "kept", days=-1).known("crossref", keys.where("key is not null")).isEmpty()
    answers.clear()
    assert answers.info() == (0, 0)
    (tmp_path / "file").write_text("")
    with pytest.warns(RuntimeWarning, match="can't hold"):
        assert not Answers(spark, tmp_path / "file" / "below").usable


def test_pubmed_two_hops(spark, tmp_path):
    answers = [
        ("esearch", {"esearchresult": {"idlist": ["1", "9"]}}),
        ("esummary", {"result": {"uids": ["1", "9"], "1": {"articleids": [{"idtype": "doi", "value": "10.1/A"}]}, "9": {"articleids": [{"idtype": "doi", "value": "10.9/other"}]}}}),
        ("efetch", MEDLINE.encode()),
    ]
    client = Client(transport=Fake(answers), wait=lambda s: None)
    keys = spark.createDataFrame([("10.1/a",), ("10.1/b",)], "key string")
    records, failed = lookups.Lookups(client, Answers(spark, tmp_path)).pubmed(keys)
    assert [(r.key, r.source, r.retracted) for r in records.collect()] == [("10.1/a", "pubmed", True)] and failed.isEmpty()


def test_search_candidates(spark, tmp_path):
    hits = {"message": {"items": [{"DOI": "10.1/x", "title": ["The title"], "author": [{"family": "Smith"}], "issued": {"date-parts": [[2001]]}}]}}
    epmc = {"resultList": {"result": [{"doi": "10.1/X", "title": "The title"}, {"title": "Without DOI"}]}}
    client = Client(transport=Fake([("query.bibliographic", hits), ("europepmc", epmc)], ["openalex"]), wait=lambda s: None)
    person = Person("Smith", "J")
    refs = spark.createDataFrame([(1, "article", "The title", [person], 2001, "J & K"), (2, "book", "", [], None, None)], "pos long, kind string, title string, "
        "authors array<struct<family:string,given:string,literal:string,collective:boolean,et_al:boolean>>, year int, container string")  # fmt: skip
    rows = lookups.Lookups(client, Answers(spark, tmp_path)).candidates(refs).orderBy("rank", "nth").collect()
    assert [(r.ref, r["rank"], r.doi, r.failed) for r in rows if r.record is not None] == [(1, 0, "10.1/x", None), (1, 1, None, None)]
    assert [(r.ref, r.failed) for r in rows if r.record is None] == [(1, "openalex")]


def test_text_table_parses_like_files(spark):
    rows = spark.createDataFrame([("a", "@article{k, title={T}}"), ("b", None)], "name string, body string")
    assert [r.key for r in bibtex_references(bibtex_blocks(text_table(rows, "name", "body"))).collect()] == ["k"]


def test_file_table_numbers_by_path(spark, tmp_path):
    for n in ("b", "a", "c d"):
        (tmp_path / f"{n}.bib").write_text(n)
    rows = file_table(spark, [tmp_path / f"{n}.bib" for n in ("b", "a", "c d")]).orderBy("file_no").collect()
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content).decode()) for r in rows] == [("a.bib", "a"), ("b.bib", "b"), ("c d.bib", "c d")]
    assert file_table(spark, []).count() == 0


def test_parsed_rows_of_many_files_share_a_batch(spark):
    files = spark.range(0, 900, 1, 1).selectExpr("int(id) file_no", "concat('/d', id, '.md') path", "encode('as [@a; @b] and 10.1/x', 'UTF-8') content")
    out = markdown.markdown_scan(files).mapInPandas(lambda frames: (f[["sort"]].assign(sort=str(len(f))) for f in frames), "sort string")
    sizes = [int(r.sort) for r in out.collect()]
    assert len(sizes) == 900 * 2 and min(sizes) > 100


def test_markdown_scan_of_one_sort(tmp_path):
    text = b"---\nbibliography: a.bib\nnocite: \"@n\"\n---\n[@k] 10.1234/x `10.1234/y`\n```{r}\nx <- data.frame(doi = c('10.1234/z'))\n```\n@last\n"
    every = list(markdown.scan_of("a.md", text))
    assert {x["sort"] for x in every} == {"bib", "cite", "ref"}
    for sort in ("bib", "cite", "ref"):
        assert list(markdown.scan_of("a.md", text, (sort,))) == [x for x in every if x["sort"] == sort]


def test_spread_gives_every_core_rows(spark):
    held = spread(spark.range(0, 1000, 1, 1)).groupBy(F.spark_partition_id()).count().collect()
    assert len(held) >= spark.sparkContext.defaultParallelism and sum(r["count"] for r in held) == 1000
