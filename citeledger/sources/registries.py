"""Registry answers as records: JSON and MEDLINE text taken apart by native columns.

Each function takes rows (key, payload) and gives (key, the columns of a record).  Texts are
made plain as one array a row; only names that must be parsed, and values that are not plain,
reach Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeledger.functions.identifiers import doi_of, normalize_doi, parse_year
from citeledger.functions.names import NAMES, NAMES_ARROW, Person, each_person, is_collective, parse_person
from citeledger.functions.text import clean_each, clean_text, fold_each, settled
from citeledger.schema import RECORD_FIELDS

_WHO = "array<struct<family:string,given:string,name:string>>"
_UPDATE = "array<struct<DOI:string,type:string,source:string>>"
_DATE = "struct<`date-parts`:array<array<int>>>"
WORK = (
    f"DOI string, title array<string>, subtitle array<string>, author {_WHO}, editor {_WHO}, `published-print` {_DATE}, `published-online` {_DATE}, "
    f"issued {_DATE}, `container-title` array<string>, `short-container-title` array<string>, volume string, issue string, page string, "
    f"publisher string, type string, `update-to` {_UPDATE}, `updated-by` {_UPDATE}"
)
ATTRIBUTES = (
    "titles array<struct<title:string,titleType:string>>, creators array<struct<name:string,nameType:string,familyName:string,givenName:string>>, "
    "publicationYear string, container struct<title:string,volume:string,issue:string,firstPage:string,lastPage:string>, "
    "types struct<resourceTypeGeneral:string>"
)
BOOK = (
    "title string, subtitle string, authors array<struct<name:string>>, publish_date string, publishers array<struct<name:string>>, number_of_pages string"
)
SEARCH_DOC = "title string, subtitle string, author_name array<string>, first_publish_year string, publisher array<string>, number_of_pages_median string"
EUROPEPMC = (
    "doi string, title string, pubYear string, pageInfo string, pubTypeList struct<pubType:array<string>>, "
    "journalInfo struct<volume:string,issue:string,journal:struct<title:string>>, authorList struct<author:array<struct<"
    "collectiveName:string,lastName:string,firstName:string,initials:string,fullName:string>>>"
)
OPENALEX = (
    "doi string, title string, display_name string, publication_year string, type string, primary_location struct<source:struct<display_name:string>>, "
    "biblio struct<volume:string,issue:string,first_page:string,last_page:string>, "
    "authorships array<struct<author:struct<display_name:string>,raw_author_name:string>>"
)
#: kinds of notice that withdraw or doubt a work, worst first
WITHDRAWING = ["retraction", "withdrawal", "removal", "partial retraction", "expression of concern"]
_WITNESS = "retraction-watch"
_NO_YEARS = "array<struct<slot:string,year:int>>"


def _some(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def _texts(rows: DataFrame, **values: Column) -> tuple[DataFrame, dict[str, Column]]:
    """rows with display texts of values as one array, and each as a column ('' for none)."""
    names = list(values)
    rows = settled(rows, {"texts": clean_each(F.array(*(_some(values[n]) for n in names)))})
    return rows, {n: F.get("texts", F.lit(i)) for i, n in enumerate(names)}


def _record(rows: DataFrame, source: str, **fields: Column) -> DataFrame:
    """(key, the columns of a record): what fields don't give is null; '' is null too."""
    out = []
    for name, kind in RECORD_FIELDS:
        value = {"source": F.lit(source), "identifier": F.col("key"), "retracted": F.lit(False)}.get(name, F.lit(None))
        value = fields.get(name, value).cast(kind)
        out.append((F.nullif(value, F.lit("")) if kind == "string" else value).alias(name))
    return rows.select("key", *out, *(c for c in rows.columns if c in ("ref", "nth", "concerns")))


def _one_slot(year: Column) -> Column:
    return F.when(year.isNotNull(), F.array(F.struct(F.lit("issued").alias("slot"), year.alias("year")))).otherwise(F.array().cast(_NO_YEARS))


def _joined_title(rows: DataFrame, title: Column, subtitle: Column) -> tuple[DataFrame, Column]:
    """Title and subtitle with a colon between, unless the title has the subtitle already."""
    rows = settled(rows, {"title_keys": fold_each(F.array(title, subtitle))})
    held = F.contains(F.get("title_keys", F.lit(0)), F.get("title_keys", F.lit(1)))
    return rows, F.when((subtitle == "") | ((title != "") & held), title).when(title == "", subtitle).otherwise(F.concat(title, F.lit(": "), subtitle))


def _pages(first: Column, last: Column) -> Column:
    return F.when((first != "") & (last != ""), F.concat(first, F.lit("-"), last)).otherwise(first)


def _split_names(rows: DataFrame, people: Column, fields: tuple[str, str, str], column: str = "authors_") -> DataFrame:
    """rows with names of creators that come split: a literal one is a body; those without any text are left out."""
    family, given, literal = fields
    flat = F.flatten(F.transform(people, lambda p: F.array(_some(p[literal]), _some(p[family]), _some(p[given]))))
    rows = settled(rows, {"who": clean_each(F.coalesce(flat, F.array().cast("array<string>")))})
    at = lambda i, n: F.get("who", (i * 3 + n).cast("int"))
    one = lambda i: F.struct(
        F.when(at(i, 0) == "", at(i, 1)).otherwise("").alias("family"), F.when(at(i, 0) == "", at(i, 2)).otherwise("").alias("given"),
        at(i, 0).alias("literal"), (at(i, 0) != "").alias("collective"), F.lit(False).alias("et_al"),
    )
    places = F.filter(F.sequence(F.lit(0), F.size("who")), lambda i: (i * 3 < F.size("who")) & (F.concat(at(i, 0), at(i, 1), at(i, 2)) != ""))
    return rows.withColumn(column, F.transform(places, one)).drop("who")


def _relations(rows: DataFrame, name: str) -> DataFrame:
    """rows with the updates of a field as (type key, DOI, shown type, source), in order."""
    entries = F.coalesce(F.col(f"w.`{name}`"), F.array().cast(_UPDATE))
    column = name.replace("-", "_")
    rows = settled(
        rows,
        {
            f"{column}_keys": fold_each(F.transform(entries, lambda e: _some(e["type"]))), f"{column}_shown": clean_each(F.transform(entries, lambda e: _some(e["type"]))),
            f"{column}_dois": clean_each(F.transform(entries, lambda e: _some(e["DOI"]))),
        }
    )
    listed = F.transform(
        entries,
        lambda e, i: F.struct(
            F.concat(F.get(f"{column}_keys", i), F.lit("\t"), doi_of(F.get(f"{column}_dois", i))).alias("what"), F.get(f"{column}_keys", i).alias("kind"),
            F.get(f"{column}_shown", i).alias("shown"), (_some(e["source"]) == _WITNESS).alias("witnessed"),
        ),
    )
    return settled(rows, {column: listed}).drop(f"{column}_keys", f"{column}_shown", f"{column}_dois")


def crossref_records(works: DataFrame) -> DataFrame:
    """Records of the first registry's works (key, payload: JSON of a work).

    A notice's own record may list the paper as updating it, and the paper the notice: where the
    same update runs both ways, the direction that the notice database attests alone is left
    out, so that a notice is not taken for retracted.
    """
    rows = works.withColumn("w", F.from_json("payload", WORK))
    rows = _relations(_relations(rows, "update-to"), "updated-by")
    what = lambda c, test=None: F.transform(F.col(c) if test is None else F.filter(c, test), lambda u: u["what"])
    told = F.filter(F.array_intersect(what("update_to"), what("updated_by")), lambda w: w.rlike(r"^[^\t]+\t."))
    seen = lambda u: u["witnessed"]
    discounted = F.array_except(F.array_intersect(told, what("update_to", seen)), what("updated_by", seen))
    rows = rows.withColumn("against", F.filter("updated_by", lambda u: ~F.array_contains(discounted, u["what"])))

    def shown_as(kind: str) -> Column:
        return F.get(F.transform(F.filter("against", lambda u: u["kind"] == kind), lambda u: u["shown"]), F.lit(0))

    notice = F.coalesce(*map(shown_as, WITHDRAWING))
    people = F.when(F.coalesce(F.size("w.author"), F.lit(0)) > 0, F.col("w.author")).otherwise(F.coalesce("w.editor", F.array().cast(_WHO)))
    rows = _split_names(rows.withColumn("notice", notice), people, ("family", "given", "name"))
    at = lambda c, n=0: F.get(F.col(f"w.`{c}`"), F.lit(n))
    rows, t = _texts(
        rows, title=at("title"), subtitle=at("subtitle"), container=at("container-title"), short=at("short-container-title"), volume=F.col("w.volume"),
        issue=F.col("w.issue"), page=F.col("w.page"), publisher=F.col("w.publisher"),
    )
    rows, title = _joined_title(rows, t["title"], t["subtitle"])
    rest = clean_each(F.slice(F.col("w.`container-title`"), F.lit(2), F.greatest(F.size(F.col("w.`container-title`")), F.lit(0))))
    slot = lambda name, field: F.struct(F.lit(name).alias("slot"), F.get(F.get(F.col(f"w.`{field}`.`date-parts`"), F.lit(0)), F.lit(0)).alias("year"))
    years = F.filter(F.array(slot("print", "published-print"), slot("online", "published-online"), slot("issued", "issued")), lambda y: y["year"].isNotNull())
    return _record(
        rows, "crossref", doi=normalize_doi(F.col("w.DOI")), title=title, authors=F.col("authors_"), years=years, container=t["container"],
        container_short=t["short"], container_alternates=F.filter(F.coalesce(rest, F.array().cast("array<string>")), lambda c: c != ""),
        volume=t["volume"], issue=t["issue"], pages=t["page"], publisher=t["publisher"], kind=F.col("w.type"),
        retracted=F.col("notice").isNotNull(), retraction_kind=F.col("notice"),
    )


@F.arrow_udf(NAMES)
def _mixed_names(creators: pa.Array) -> pa.Array:
    """Creators that are split, an organisation, or one string to be parsed."""
    out = []
    for people in creators.to_pylist():
        names = []
        for p in people or []:
            family, literal = clean_text(p["familyName"]), clean_text(p["name"])
            if family:
                names.append(Person(family, clean_text(p["givenName"])))
            elif literal and (p["nameType"] or "").strip().lower() == "organizational":
                names.append(Person(literal=literal, collective=True))
            elif literal:
                names.append(parse_person(literal))
        out.append([n._asdict() for n in names])
    return pa.array(out, NAMES_ARROW)


def datacite_records(rows: DataFrame) -> DataFrame:
    """Records of the second registry (key, payload: JSON of an answer or of its attributes)."""
    found = F.coalesce(F.get_json_object("payload", "$.data.attributes"), F.col("payload"))
    rows = rows.withColumn("a", F.from_json(found, ATTRIBUTES)).where("a is not null")
    titles = F.coalesce("a.titles", F.array().cast("array<struct<title:string,titleType:string>>"))
    shown = clean_each(F.transform(titles, lambda t: _some(t["title"])))
    rows = settled(rows, {"listed": shown})
    untyped = F.get(F.filter(F.transform(titles, lambda t, i: F.when(_some(t["titleType"]) == "", F.get("listed", i))), lambda t: _some(t) != ""), F.lit(0))
    rows, t = _texts(
        rows, container=F.col("a.container.title"), volume=F.col("a.container.volume"), issue=F.col("a.container.issue"),
        first=F.col("a.container.firstPage"), last=F.col("a.container.lastPage"), kind=F.col("a.types.resourceTypeGeneral"),
    )
    return _record(
        rows, "datacite", doi=F.col("key"), title=F.coalesce(untyped, F.get("listed", F.lit(0))), authors=_mixed_names(F.col("a.creators")),
        years=_one_slot(parse_year(F.col("a.publicationYear"))), container=t["container"], volume=t["volume"], issue=t["issue"],
        pages=_pages(t["first"], t["last"]), kind=t["kind"],
    )


_TAG = re.compile(r"([A-Z]{2,4})\s*- (.*)")


def medline_fields(text: str) -> Iterator[dict[str, list[str]]]:
    """The records of a MEDLINE text: tag to values, continued lines joined; blank lines part records."""
    for block in re.split(r"\n\s*\n", text.replace("\r\n", "\n").replace("\r", "\n")):
        fields: dict[str, list[str]] = {}
        last: list[str] | None = None
        for line in filter(str.strip, block.split("\n")):
            if found := _TAG.fullmatch(line):
                last = fields.setdefault(found[1], [])
                last.append(found[2].strip())
            elif last:
                last[-1] = f"{last[-1]} {line.strip()}".strip()
        if fields:
            yield fields


_TAGS = "PMID TI FAU AU DP JT TA VI IP PG PT ECI".split()


def medline_rows(texts: DataFrame) -> DataFrame:
    """(pmid, fields): the records of MEDLINE texts (text); only the tags that records are made of."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("pmid", pa.string()), ("fields", pa.map_(pa.string(), pa.list_(pa.string())))])
        for batch in batches:
            found = [f for text in batch.column(0).to_pylist() if text for f in medline_fields(text)]
            out = [{"pmid": (f.get("PMID") or [None])[0], "fields": [(t, f[t]) for t in _TAGS if t in f]} for f in found]
            if out:
                yield pa.RecordBatch.from_pylist(out, kind)

    return texts.select("text").mapInArrow(rows, "pmid string, fields map<string,array<string>>")


@F.arrow_udf(NAMES)
def _short_names(values: pa.Array) -> pa.Array:
    """Names with the initials last, as the index abbreviates them."""
    out = []
    for people in values.to_pylist():
        names = []
        for raw in people or []:
            text = clean_text(raw)
            surname, _, initials = text.rpartition(" ")
            if text and is_collective(text):
                names.append(Person(literal=text, collective=True))
            elif text:
                names.append(parse_person(f"{surname}, {initials}") if surname else Person(text))
        out.append([n._asdict() for n in names])
    return pa.array(out, NAMES_ARROW)


def medical_records(rows: DataFrame) -> DataFrame:
    """Records of the medical index (key, fields: tags to values), with ``concerns``, its cross-references to concern.

    A title in brackets is a translation; the full stop goes from others unless it ends an
    abbreviation.
    """
    first = lambda tag: F.get(F.col("fields")[tag], F.lit(0))
    rows, t = _texts(rows, title=first("TI"))
    inner = F.trim(F.regexp_extract(t["title"], r"^\[(.*)\]\.?$", 1))
    bare = F.when(t["title"].rlike(r"\.$") & ~t["title"].rlike(r"(?:[A-Za-z]\.){2,}$"), F.rtrim(F.regexp_replace(t["title"], r"\.$", ""))).otherwise(t["title"])
    title = F.when(t["title"].rlike(r"^\[.*\]\.?$"), inner).otherwise(bare)
    kinds = F.coalesce(F.col("fields")["PT"], F.array().cast("array<string>"))
    rows = settled(rows, {"kinds": fold_each(kinds), "kinds_shown": clean_each(kinds)})
    place = F.array_position("kinds", "retracted publication").cast("int")
    full, short = F.col("fields")["FAU"], F.col("fields")["AU"]
    rows = rows.withColumn("concerns", F.coalesce(F.col("fields")["ECI"], F.array().cast("array<string>")))
    has_full = F.coalesce(F.size(full), F.lit(0)) > 0
    return _record(
        rows, "pubmed", doi=F.col("key"), title=title,
        authors=F.when(has_full, each_person(F.when(has_full, full))).otherwise(_short_names(F.when(~has_full, short))),
        years=_one_slot(parse_year(first("DP"))), container=first("JT"), container_short=first("TA"), volume=first("VI"), issue=first("IP"), pages=first("PG"),
        retracted=place > 0, retraction_kind=F.when(place > 0, F.get("kinds_shown", place - 1)),
    )


def book_records(rows: DataFrame) -> DataFrame:
    """Records of the book catalogue (key, payload: JSON of a book)."""
    rows = rows.withColumn("b", F.from_json("payload", BOOK)).where("b is not null")
    rows, t = _texts(rows, title=F.col("b.title"), subtitle=F.col("b.subtitle"), publisher=F.get("b.publishers", F.lit(0))["name"])
    rows, title = _joined_title(rows, t["title"], t["subtitle"])
    names = F.transform("b.authors", lambda a: _some(a["name"]))
    pages = F.col("b.number_of_pages").try_cast("int")
    return _record(
        rows, "openlibrary", title=title, authors=each_person(names), years=_one_slot(parse_year(F.col("b.publish_date"))),
        publisher=t["publisher"], pages=F.when(pages > 0, pages.cast("string")), kind=F.lit("book"),
    )


def book_search_records(rows: DataFrame) -> DataFrame:
    """Records of the book catalogue's search hits (key, payload: JSON of a hit)."""
    rows = rows.withColumn("b", F.from_json("payload", SEARCH_DOC)).where("b is not null")
    rows, t = _texts(rows, title=F.col("b.title"), subtitle=F.col("b.subtitle"), publisher=F.get("b.publisher", F.lit(0)))
    rows, title = _joined_title(rows, t["title"], t["subtitle"])
    pages = F.col("b.number_of_pages_median").try_cast("int")
    return _record(
        rows, "openlibrary", title=F.when(t["title"] == "", "").otherwise(title), authors=each_person(F.col("b.author_name")),
        years=_one_slot(F.col("b.first_publish_year").try_cast("int")), publisher=t["publisher"], pages=F.when(pages > 0, pages.cast("string")), kind=F.lit("book"),
    )


@F.arrow_udf(NAMES)
def _europepmc_names(authors: pa.Array) -> pa.Array:
    out = []
    for people in authors.to_pylist():
        names = []
        for p in people or []:
            body, last, full = (clean_text(p[k]) for k in ("collectiveName", "lastName", "fullName"))
            surname, _, initials = full.rpartition(" ")
            if body:
                names.append(Person(literal=body, collective=True))
            elif last:
                names.append(Person(last, clean_text(p["firstName"] or p["initials"])))
            elif full:
                names.append(Person(surname, initials) if surname else Person(full))
        out.append([n._asdict() for n in names])
    return pa.array(out, NAMES_ARROW)


def europepmc_records(rows: DataFrame) -> DataFrame:
    """Records of one discovery service's hits (key, payload: JSON of a hit)."""
    rows = rows.withColumn("h", F.from_json("payload", EUROPEPMC)).where("h is not null")
    info = F.col("h.journalInfo")
    rows, t = _texts(
        rows, title=F.col("h.title"), container=info["journal"]["title"], volume=info["volume"], issue=info["issue"], pages=F.col("h.pageInfo"),
        kind=F.get("h.pubTypeList.pubType", F.lit(0)),
    )
    return _record(
        rows, "europepmc", doi=normalize_doi(F.col("h.doi")), title=t["title"], authors=_europepmc_names(F.col("h.authorList.author")),
        years=_one_slot(parse_year(F.col("h.pubYear"))), container=t["container"], volume=t["volume"], issue=t["issue"], pages=t["pages"], kind=t["kind"],
    )


def openalex_records(rows: DataFrame) -> DataFrame:
    """Records of the other discovery service's hits (key, payload: JSON of a hit)."""
    rows = rows.withColumn("h", F.from_json("payload", OPENALEX)).where("h is not null")
    b = F.col("h.biblio")
    rows, t = _texts(
        rows, title=F.coalesce(F.nullif("h.title", F.lit("")), F.col("h.display_name")), container=F.col("h.primary_location.source.display_name"),
        volume=b["volume"], issue=b["issue"], first=b["first_page"], last=b["last_page"],
    )
    names = F.transform("h.authorships", lambda a: _some(F.coalesce(F.nullif(a["author"]["display_name"], F.lit("")), a["raw_author_name"])))
    return _record(
        rows, "openalex", doi=normalize_doi(F.col("h.doi")), title=t["title"], authors=each_person(names), years=_one_slot(parse_year(F.col("h.publication_year"))),
        container=t["container"], volume=t["volume"], issue=t["issue"], pages=_pages(t["first"], t["last"]), kind=F.col("h.type"),
    )
