"""Queries that send driver tables through the parsers: as files, library tables and registry answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.operators.relations import duplicate_members, unused_rules
from citeledger.operators.resolve import bridged, wanted_notices
from citeledger.operators.search import candidate_union, confirmed
from citeledger.plans import cases
from citeledger.plans.audit import AuditOptions, Registries, audit
from citeledger.report import error_fields, json_rows, summary
from citeledger.schema import NAME
from citeledger.scratch import keep, load, spread
from citeledger.sources import libraries, registries
from citeledger.sources.bibtex import bad_blocks, bibtex_blocks, bibtex_references
from citeledger.sources.files import text_table
from citeledger.sources.markdown import cited_keys, markdown_references, markdown_scan
from citeledger.sources.notices import notice_index
from citeledger.suggest import suggestions

Spark = SparkSession
_FILE = 50  # entries of one file


def _bib_files(spark: Spark, d: str) -> DataFrame:
    """Every fifty parts as one BibTeX file, an entry a line."""
    entry = F.expr("""
        case p_partkey % 10
        when 9 then concat('@article{k', p_partkey - 1, ', title = {Twice}}')
        when 1 then concat('@article{k', p_partkey, ', title = {The {', p_name, '} of ', p_size, '}, author = {', p_brand, ', A. and van ', p_type, ', Bo and others}, year = ', 1980 + p_size, ', journal = {J. of ', p_brand, '}, number = {', p_size, '}, DOI = {https://doi.org/10.1234/P(', p_partkey, ')}}')
        when 2 then concat('  @Book{k', p_partkey, ', editor = "', p_brand, ', E.", title = "', p_name, '" # { II}, publisher = {P}, url = {http://dx.doi.org/10.5555/U', p_partkey, '}, doi = {N/A}, date = {', 1980 + p_size, '-02}}')
        when 3 then concat('@article{k', p_partkey, ', title = {never closed}')
        when 4 then concat('@comment{@article{hidden', p_partkey, ', title = {x}}} @misc{k', p_partkey, ', title = {', p_name, '}}')
        when 5 then concat('@inbook{k', p_partkey, ', title={a}, title={b}}')
        else concat('@inbook(k', p_partkey, ', booktitle = {', p_name, ' @ ', p_brand, '}, pages = {', p_size, '--', p_size + 9, '}, volume = {', p_size, '}, author = {{', p_brand, ' Study Group}})')
        end""")
    part = load(spark, d, "part").select((F.col("p_partkey") / _FILE).cast("int").alias("file"), "p_partkey", entry.alias("entry"))
    # at most fifty entries a row
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "entry"))), lambda e: e["entry"]), "\n")
    return text_table(part.groupBy("file").agg(text.alias("text")).select(F.concat(F.lit("/b/f"), "file", F.lit(".bib")).alias("name"), "text"), "name", "text")


def bibtex_entries(spark: Spark, d: str) -> DataFrame:
    refs = bibtex_references(bibtex_blocks(_bib_files(spark, d)))
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    first = F.get("authors", F.lit(0))
    return refs.select(
        "key", "locator", "kind", *(some(c) for c in ("doi", "title", "year", "container", "volume", "issue", "pages", "publisher", "url")),
        F.size("authors").cast("long").alias("n_authors"), F.coalesce(F.concat(first["family"], first["literal"]), F.lit("")).alias("first_author"),
        F.coalesce(F.get_json_object("raw", "$.creator_role"), F.lit("")).alias("role"),
    )


def bibtex_bad_blocks(spark: Spark, d: str) -> DataFrame:
    why = F.when(F.contains("reason", F.lit("duplicate")), "duplicate").when(F.contains("reason", F.lit("twice")), "field twice").otherwise("open")
    return bad_blocks(bibtex_blocks(_bib_files(spark, d))).select("path", F.col("line").cast("long").alias("line"), "key", why.alias("why"))


_BIB = f"""b AS (SELECT *, p_partkey // {_FILE} AS f, p_partkey % {_FILE} + 1 AS line, p_partkey % 10 AS c FROM part),
    -- an entry that is not closed loses nothing but itself: the next begins its own line
    e AS (SELECT *, 'f' || f || '.bib:' || line AS locator FROM b)"""


def _notes(spark: Spark, d: str, sort: str) -> DataFrame:
    """Every order as a document, scanned for rows of a sort."""
    text = F.expr(r"""concat(
        '---\ntitle: x\nbibliography: refs.bib\nnocite: "@no', o_orderkey, '"\n---\n',
        'See [@key', o_custkey, '; -@pair:', o_orderkey % 7, '] or @fig-a, `@code`, me@x.org and [[@note', o_orderkey, '|n]].\n',
        'As in (https://doi.org/10.1000/D', o_orderkey, '), `10.1000/d', o_orderkey, '` and ![[@embed]].\n',
        '```{r}\nt <- read.delim(text = "Author|Year|DOI\nSmith & Doe|', 1990 + o_orderkey % 30, '|10.2000/T', o_orderkey, '", sep = "|") # 10.9\n',
        'v <- data.frame(DOI = c("10.3000/V', o_orderkey, '", "10.3000/W', o_orderkey, '"), Year = c(1999', if(o_orderkey % 2 = 0, ', 2000', ''), '))\n```\n')""")
    orders = spread(load(spark, d, "orders").select("o_orderkey", "o_custkey")).select(F.concat(F.lit("/n/o"), "o_orderkey", F.lit(".md")).alias("name"), text.alias("text"))
    return markdown_scan(text_table(orders, "name", "text"), "/n", [sort])


def document_citations(spark: Spark, d: str) -> DataFrame:
    return cited_keys(_notes(spark, d, "cite")).select("citekey", "locator")


def document_references(spark: Spark, d: str) -> DataFrame:
    refs = markdown_references(_notes(spark, d, "ref"))
    warned = F.get_json_object("raw", "$.warning").isNotNull()
    return refs.select("key", "locator", "kind", F.coalesce("year", F.lit(0)).cast("long").alias("year"), F.size("authors").cast("long").alias("n_authors"), warned.alias("warned"))


class TableLibrary(libraries.Database):
    """A library whose tables are DataFrames."""

    def __init__(self, tables: dict[str, DataFrame]):
        self.tables, self.there = tables, set(tables)

    def table(self, name: str) -> DataFrame:
        return self.tables[name]


def _library(spark: Spark, d: str) -> TableLibrary:
    """Parts as items of three libraries, their columns as field rows, suppliers as creators."""
    part, line = load(spark, d, "part"), load(spark, d, "lineitem")
    nth = lambda df, key: df.withColumn("nth", F.col(key).cast("int"))
    items = part.selectExpr("int(p_partkey) itemID", "int(1 + p_size % 3) itemTypeID", "int(1 + p_partkey % 3) libraryID", "concat('I', p_partkey) key")
    facts = part.selectExpr("int(p_partkey) itemID", "stack(4, 1, p_name, 2, p_brand, 3, string(1990 + p_size), 4, concat('10.1/', p_partkey)) as (fieldID, value)")
    values = facts.selectExpr("itemID", "fieldID", "itemID * 4 + fieldID - 1 valueID", "value")
    pairs = line.groupBy("l_partkey").agg(F.min("l_suppkey").alias("a"), F.max("l_suppkey").alias("b"))
    creators = load(spark, d, "supplier").selectExpr("int(s_suppkey) creatorID", "'S' firstName", "s_name lastName", "int(s_suppkey % 2) fieldMode")
    links = pairs.selectExpr("int(l_partkey) itemID", "stack(2, int(a), 1, 1, int(b), 2, 0) as (creatorID, creatorTypeID, orderIndex)")
    rows = lambda r, s: spark.createDataFrame(r, s)
    return TableLibrary(
        {
            "libraries": rows([(1, "user", 1), (2, "group", 2), (3, "group", 3)], "libraryID int, type string, nth int"), "groups": rows([(2, "Lab", 1)], "libraryID int, name string, nth int"),
            "itemTypes": rows([(1, "journalArticle", 1), (2, "attachment", 2), (3, "book", 3)], "itemTypeID int, typeName string, nth int"), "items": nth(items, "itemID"),
            "fields": rows([(1, "title", 1), (2, "publicationTitle", 2), (3, "date", 3), (4, "DOI", 4)], "fieldID int, fieldName string, nth int"),
            "itemData": nth(values.select("itemID", "fieldID", "valueID"), "valueID"), "itemDataValues": nth(values.select("valueID", "value"), "valueID"),
            "creatorTypes": rows([(1, "author", 1), (2, "editor", 2)], "creatorTypeID int, creatorType string, nth int"), "creators": nth(creators, "creatorID"),
            "itemCreators": nth(links, "itemID"), "deletedItems": nth(items.where("itemID % 5 = 0").select("itemID"), "itemID"),
            "collections": rows([(1, "Top", None, 1, 1), (2, "Sub", 1, 1, 2), (3, "Loop", 2, 1, 3), (4, "top", None, 2, 4)], "collectionID int, collectionName string, parentCollectionID int, libraryID int, nth int"),
            "collectionItems": nth(items.selectExpr("int(1 + itemID % 4) collectionID", "itemID"), "itemID"),
        }
    )


def _library_rows(refs: DataFrame) -> DataFrame:
    shown = F.transform("authors", lambda a: F.concat(a["family"], a["literal"]))
    return refs.select("key", "kind", "title", "container", "doi", F.col("year").cast("long").alias("year"), F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("authors"))


def library_references(spark: Spark, d: str) -> DataFrame:
    return _library_rows(libraries.database_references(_library(spark, d)))


def library_collection(spark: Spark, d: str) -> DataFrame:
    return _library_rows(libraries.database_references(_library(spark, d), trashed=True, collection="TOP"))


def library_groups(spark: Spark, d: str) -> DataFrame:
    return _library(spark, d).group_items(1).select("libraryID", F.coalesce("name", F.lit("")).alias("name"), "n")


_LIBRARY = """SELECT 'I' || p_partkey AS key, CASE p_size % 3 WHEN 0 THEN 'article' ELSE 'book' END AS kind, p_name AS title, p_brand AS container,
    '10.1/' || p_partkey AS doi, (1990 + p_size)::BIGINT AS year, coalesce(s_name, '') AS authors FROM part
    LEFT JOIN (SELECT l_partkey, min(l_suppkey) AS a FROM lineitem GROUP BY 1) ON l_partkey = p_partkey LEFT JOIN supplier ON s_suppkey = a
    WHERE p_partkey % 3 = 0 AND p_size % 3 <> 1"""


def _payloads(spark: Spark, d: str) -> DataFrame:
    return spread(load(spark, d, "part")).select("*", F.concat(F.lit("10.1/"), "p_partkey").alias("key"))


def registry_records(spark: Spark, d: str) -> DataFrame:
    """Every part as an answer of each registry, parsed."""
    part = _payloads(spark, d)
    json = lambda sql: part.selectExpr("key", f"to_json({sql}) payload")
    work = """named_struct('DOI', upper(key), 'title', array(concat(p_name, ' &amp; more')), 'subtitle', array(if(p_size % 2 = 0, p_brand, 'more')),
        'author', array(named_struct('family', p_brand, 'given', 'A.', 'name', cast(null as string)), named_struct('family', null, 'given', null, 'name', 'The Group')),
        'published-print', named_struct('date-parts', array(array(1990 + p_size, 1))), 'issued', named_struct('date-parts', array(array(1980 + p_size))),
        'container-title', array('Series', p_type), 'page', '1-9', 'type', 'book-chapter',
        'update-to', if(p_size % 5 = 0, array(named_struct('DOI', '10.9/x', 'type', 'Retraction', 'source', 'retraction-watch')), array()),
        'updated-by', if(p_size % 10 < 6, array(named_struct('DOI', '10.9/x', 'type', 'retraction', 'source', 'publisher'), named_struct('DOI', '10.9/y', 'type', 'correction', 'source', 'publisher')), array()))"""
    attributes = """named_struct('titles', array(named_struct('title', 'Sub', 'titleType', 'Subtitle'), named_struct('title', p_name, 'titleType', null)),
        'creators', array(named_struct('name', concat(p_brand, ', Ann'), 'nameType', 'Personal'), named_struct('name', 'CERN', 'nameType', 'Organizational')),
        'publicationYear', 1990 + p_size, 'container', named_struct('title', p_type, 'firstPage', '3', 'lastPage', '9'), 'types', named_struct('resourceTypeGeneral', 'Dataset'))"""
    book = "named_struct('title', p_name, 'subtitle', p_name, 'authors', array(named_struct('name', concat('Ann ', p_brand))), 'publish_date', concat('May ', 1990 + p_size), 'publishers', array(named_struct('name', 'P')), 'number_of_pages', p_size)"
    hit = "named_struct('doi', upper(key), 'title', p_name, 'pubYear', string(1990 + p_size), 'pageInfo', '1-9', 'journalInfo', named_struct('journal', named_struct('title', p_type)), 'authorList', named_struct('author', array(named_struct('lastName', p_brand, 'initials', 'AB'))))"
    alex = "named_struct('doi', concat('https://doi.org/', upper(key)), 'display_name', p_name, 'publication_year', 1990 + p_size, 'biblio', named_struct('first_page', '1', 'last_page', '9'), 'authorships', array(named_struct('author', named_struct('display_name', concat('Ann ', p_brand)))), 'primary_location', named_struct('source', named_struct('display_name', p_type)))"
    medline = part.selectExpr(r"""concat('PMID- ', p_partkey, '\nTI  - ', p_name, '\n      goes on.\n', if(p_size % 2 = 0, concat('FAU - ', p_brand, ', Ann\n'), concat('AU  - ', p_brand, ' AB\n')),
        'DP  - ', 1990 + p_size, ' May\nJT  - ', p_type, '\nPG  - 1-9\n', if(p_size % 7 = 0, 'PT  - Retracted Publication\n', '')) text""")
    bridge = part.selectExpr("key", "string(p_partkey) pmid")
    found = [
        registries.crossref_records(json(work)), registries.datacite_records(json(attributes)), registries.book_records(json(book)), registries.europepmc_records(json(hit)),
        registries.openalex_records(json(alex)), registries.medical_records(bridged(part.select("key"), bridge, registries.medline_rows(medline)).select("key", "fields")).drop("concerns"),
    ]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    some = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    shown = F.array_join(F.transform("authors", lambda a: F.concat(a["family"], a["literal"])), ";")
    years = F.array_join(F.transform("years", lambda y: F.concat(y["slot"], F.lit("="), y["year"].cast("string"))), ";")
    return every.select("source", "key", *(some(c) for c in ("doi", "title", "container", "pages")), shown.alias("authors"), years.alias("years"), "retracted", F.array_join(F.coalesce("container_alternates", F.array()), ";").alias("alternates"))


_RECORDS = """WITH p AS (SELECT *, '10.1/' || p_partkey AS key, 'issued=' || (1990 + p_size) AS y FROM part)
    SELECT 'crossref' AS source, key, key AS doi, p_name || ' & more' || CASE WHEN p_size % 2 = 0 THEN ': ' || p_brand ELSE '' END AS title, 'Series' AS container, '1-9' AS pages,
      p_brand || ';The Group' AS authors, 'print=' || (1990 + p_size) || ';issued=' || (1980 + p_size) AS years,
      p_size % 10 < 6 AND p_size % 5 <> 0 AS retracted, p_type AS alternates FROM p
    UNION ALL SELECT 'datacite', key, key, p_name, p_type, '3-9', p_brand || ';CERN', y, false, '' FROM p
    UNION ALL SELECT 'openlibrary', key, '', p_name, '', p_size::VARCHAR, p_brand, y, false, '' FROM p
    UNION ALL SELECT 'europepmc', key, key, p_name, p_type, '1-9', p_brand, y, false, '' FROM p
    UNION ALL SELECT 'openalex', key, key, p_name, p_type, '1-9', p_brand, y, false, '' FROM p
    UNION ALL SELECT 'pubmed', key, key, p_name || ' goes on', p_type, '1-9', p_brand, y, p_size % 7 = 0, '' FROM p"""


def notices_in_force(spark: Spark, d: str) -> DataFrame:
    """Events as rows of the notice export, only for wanted DOIs."""
    e = load(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("https://doi.org/10.1/U"), "user_id").alias("OriginalPaperDOI"), F.date_format("ts", "M/d/yyyy H:mm").alias("RetractionDate"),
        F.when(F.col("event_type") == "purchase", "Retraction").when(F.col("event_type") == "error", "Reinstatement").when(F.col("event_type") == "view", "").when(F.col("event_type") == "click", "Expression of Concern").otherwise("Republication").alias("RetractionNature"),
        F.when(F.col("event_id") % 3 == 0, "unavailable").otherwise(F.concat(F.lit("10.2/N"), "event_id")).alias("RetractionDOI"),
    )
    wanted = e.where("user_id % 2 = 0").select(F.concat(F.lit("10.1/u"), "user_id").alias("key"))
    return wanted_notices(notice_index(rows), wanted).select("doi", "kind", F.coalesce("notice_doi", F.lit("")).alias("notice_doi"), "date")


def _cases(spark: Spark, d: str) -> tuple[DataFrame, Registries]:
    refs, records, notices = cases.tables(spark)
    return refs, Registries(records, notices)


def _audited_cases(spark: Spark, d: str) -> DataFrame:
    refs, tables = _cases(spark, d)
    found = audit(refs, tables, AuditOptions(search_unidentified=False)).select("pos", "key", "kind", "locator", "identifier", "verdict", "issues", "suppressed", "consulted", "title_similarity")
    # written once: reports read it several times
    return cases.dealt(keep(found, "cases"), load(spark, d, "part"), "p_partkey")


def audit_findings(spark: Spark, d: str) -> DataFrame:
    """All that is found in every case, with values, sources and notes."""
    return _audited_cases(spark, d).select("pos", F.explode(F.concat("issues", "suppressed")).alias("i")).select("pos", "i.*")


def audit_verdicts(spark: Spark, d: str) -> DataFrame:
    return _audited_cases(spark, d).select("pos", "verdict")


def audit_outage(spark: Spark, d: str) -> DataFrame:
    """With the first registry down every DOI is unchecked."""
    refs, tables = _cases(spark, d)
    down = Registries({k: v for k, v in tables.records.items() if k == "openlibrary"}, None, None, ("crossref", "pubmed"))
    found = audit(refs.where("doi is not null"), down, AuditOptions(search_unidentified=False))
    return cases.dealt(keep(found.select("pos", "verdict", F.col("consulted")["crossref"].alias("crossref")), "cases"), load(spark, d, "part"), "p_partkey")


def audit_summary(spark: Spark, d: str) -> DataFrame:
    return summary(_audited_cases(spark, d))


def audit_error_fields(spark: Spark, d: str) -> DataFrame:
    return error_fields(_audited_cases(spark, d))


def audit_json(spark: Spark, d: str) -> DataFrame:
    """The JSON report's rows, some of their values read back."""
    line = json_rows(_audited_cases(spark, d))
    at = lambda p, n: F.coalesce(F.get_json_object("line", p), F.lit("")).alias(n)
    return line.select("pos", at("$.verdict", "verdict"), at("$.fails", "fails"), at("$.issues[0].note", "note"), at("$.consulted.crossref", "crossref"))


_RULES = (("c1*", "title", "drift", "ours"), ("c2?", "*", "mis*", "checked"), ("nobody", "*", "*", "idle"))


def rules_unused(spark: Spark, d: str) -> DataFrame:
    refs, tables = _cases(spark, d)
    found = keep(audit(refs, tables, AuditOptions(search_unidentified=False, rules=_RULES)).select("pos", "used_rules"), "cases")
    return unused_rules(found, list(_RULES)).select("idx", "key", "reason")


def search_confirmed(spark: Spark, d: str) -> DataFrame:
    """Parts without DOI look for the parts of their brand and name among candidates of two sources.

    The first source has the name with another type, the author's or another, a year off by up
    to two, and every third without DOI; the second repeats some DOIs.
    """
    part = spread(load(spark, d, "part"))
    person = lambda c: F.array(F.struct(c.alias("family"), F.lit("A").alias("given"), F.lit("").alias("literal"), F.lit(False).alias("collective"), F.lit(False).alias("et_al"))).cast(f"array<{NAME}>")
    title = F.concat(F.lit("A long enough title about "), "p_name", F.lit(" and its properties in the field"))
    refs = part.select(
        F.col("p_partkey").alias("pos"), title.alias("title"), F.lit("article").alias("kind"), (1990 + F.col("p_size")).alias("year"), person(F.col("p_brand")).alias("authors")
    )

    def hits(doi: Column, name: Column, author: Column, year: Column, kind: Column, n: int) -> DataFrame:
        slots = F.when(year.isNotNull(), F.array(F.struct(F.lit("issued").alias("slot"), year.alias("year")))).otherwise(F.array().cast("array<struct<slot:string,year:int>>"))
        given = {"source": F.lit("s"), "doi": doi, "title": name, "kind": kind, "authors": F.when(author.isNotNull(), person(author)), "years": slots}
        fields = [f.split(":", 1) for f in ("source:string", "doi:string", "title:string", "kind:string", f"authors:array<{NAME}>", "years:array<struct<slot:string,year:int>>")]
        record = F.struct(*(given[k].cast(t).alias(k) for k, t in fields))
        return part.select(F.col("p_partkey").alias("ref"), F.lit(n).alias("nth"), record.alias("record"), F.lit(None).cast("string").alias("failed"))

    size, no = F.col("p_size"), F.lit(None).cast("string")
    first = hits(F.when(size % 3 == 0, no).otherwise(F.concat(F.lit("10.1/"), "p_partkey")), F.concat(title, F.lit("s")), F.when(size % 5 == 0, "Other").otherwise(F.col("p_brand")), (1990 + size + size % 4).cast("int"), F.lit("journal-article"), 0)
    second = hits(F.concat(F.lit("https://doi.org/10.1/"), "p_partkey"), title, F.col("p_brand"), (1990 + size).cast("int"), F.lit("journal-article"), 0)
    third = hits(F.concat(F.lit("10.2/"), "p_partkey"), title, F.when(size % 2 == 0, F.col("p_brand")), F.lit(None).cast("int"), F.when(size % 7 == 0, "thesis").otherwise("article"), 1)
    best = confirmed(refs, candidate_union([first, second.unionByName(third)]))
    return best.select("ref", F.coalesce("record.doi", F.lit("")).alias("doi"), F.coalesce("record.title", F.lit("")).alias("title"), "explanation")


_SEARCH = """WITH p AS (SELECT *, p_partkey AS ref, 'A long enough title about ' || p_name || ' and its properties in the field' AS t, p_size % 5 = 0 AS other, p_size % 4 AS off,
      p_size % 3 = 0 AS bare, p_size % 2 = 0 AND p_size % 7 <> 0 AS third FROM part),
    -- the second source's copy of a DOI that the first has is left out
    k AS (SELECT *, bare AS exact, NOT other AND off <= 1 AS first FROM p)
    SELECT ref, CASE WHEN exact THEN 'https://doi.org/10.1/' || ref WHEN third THEN '10.2/' || ref WHEN first THEN '10.1/' || ref ELSE '' END AS doi,
      CASE WHEN exact OR third THEN t WHEN first THEN t || 's' ELSE '' END AS title,
      CASE WHEN exact OR third THEN 'title 1.00 with author and year corroboration' WHEN first THEN 'title 0.99 with author and year corroboration'
        ELSE concat_ws('; ', '10.1/' || ref || ': ' || CASE WHEN other THEN 'first author disagrees' ELSE 'year ' || (1990 + p_size) || ' not among ' || (1990 + p_size + off) END,
          '10.2/' || ref || ': ' || CASE WHEN p_size % 7 = 0 THEN 'type thesis != article' ELSE 'the title alone agrees, and neither author nor year backs it' END) END AS explanation FROM k"""


def suggested_copies(spark: Spark, d: str) -> DataFrame:
    """Bibliographies of one-line entries, filled in from audit issues."""
    part = load(spark, d, "part").withColumn("file", (F.col("p_partkey") / _FILE).cast("int"))
    entry = F.concat(F.lit("@article{k"), "p_partkey", F.lit(", title = {T"), "p_partkey", F.lit("}}"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", entry.alias("e")))), lambda e: e["e"]), "\n")
    files = text_table(part.groupBy("file").agg(text.alias("text")).select(F.concat(F.lit("/b/f"), "file", F.lit(".bib")).alias("name"), "text"), "name", "text")
    issue = lambda field, kind, value: F.struct(F.lit(field).alias("field"), F.lit(kind).alias("kind"), F.lit("warning").alias("severity"), F.lit("").alias("stored"), value.alias("registry"), F.lit("crossref").alias("source"), F.lit("").alias("note"))
    issues = F.array(issue("issue", "missing", F.col("p_size").cast("string")), issue("container", "missing", F.col("p_brand")), issue("authors", "missing", F.lit("X")), issue("volume", "mismatch", F.lit("9")))
    results = part.where("p_size % 10 < 3").select(F.col("p_partkey").alias("pos"), F.concat(F.lit("k"), "p_partkey").alias("key"), F.lit("article").alias("kind"), issues.alias("issues"))
    return suggestions(files, results).select("path", F.col("entries").cast("long").alias("entries"), F.col("fields").cast("long").alias("fields"), F.md5(F.regexp_replace("new_text", r"(?m)^%.*\n", "")).alias("body"))


def duplicate_copies(spark: Spark, d: str) -> DataFrame:
    """Every document whose text another one has too."""
    return duplicate_members(load(spark, d, "documents"), F.md5("text"), "doc_id").select("value", F.col("member").alias("doc_id"), "n")


def queries() -> dict:
    every = (
        bibtex_entries, bibtex_bad_blocks, document_citations, document_references, library_references, library_collection, library_groups, registry_records,
        notices_in_force, audit_findings, audit_verdicts, audit_outage, audit_summary, audit_error_fields, audit_json, rules_unused, search_confirmed,
        suggested_copies, duplicate_copies,
    )
    return {q.__name__: q for q in every}


def oracle_sql() -> dict[str, str]:
    findings, verdicts = cases.issues_sql(), cases.verdicts_sql()
    failing = "('RETRACTED', 'BAD-ID', 'WRONG-WORK', 'FIELD-MISMATCH', 'UNCONFIRMED')"
    kept = f"(SELECT * FROM ({findings}) WHERE kind <> 'registry-artifact')"
    named = [v for v in "RETRACTED BAD-ID WRONG-WORK FIELD-MISMATCH UNCONFIRMED UNCHECKED DISPUTED INCOMPLETE ADJUDICATED REGISTRY-ARTIFACT TITLE-DRIFT COSMETIC OK".split()]
    counts = ", ".join(f"count(*) FILTER (verdict = '{v}') AS \"{v.lower().replace('-', '_')}\"" for v in named if v != "OK")
    first = ", ".join(f"({n}, {cases._literal(next((i[6] for i in case['found'] if i[1] != 'registry-artifact'), ''))})" for n, case in enumerate(cases.CASES))
    identified = ", ".join(f"({n}, {cases._literal('not-asked' if (case['ref'].get('doi', 1) is None) else 'answered')})" for n, case in enumerate(cases.CASES))
    with_doi = ", ".join(str(n) for n, case in enumerate(cases.CASES) if case["ref"].get("doi", 1) is not None)
    return {
        "bibtex_entries": f"""WITH {_BIB} SELECT 'k' || p_partkey AS key, locator,
            CASE WHEN c = 1 THEN 'article' WHEN c = 2 THEN 'book' WHEN c = 4 THEN 'other' ELSE 'chapter' END AS kind,
            CASE c WHEN 1 THEN '10.1234/p(' || p_partkey || ')' WHEN 2 THEN '10.5555/u' || p_partkey ELSE '' END AS doi,
            CASE c WHEN 1 THEN 'The ' || p_name || ' of ' || p_size WHEN 2 THEN p_name || ' II' WHEN 4 THEN p_name ELSE '' END AS title,
            CASE WHEN c IN (1, 2) THEN (1980 + p_size)::VARCHAR ELSE '' END AS year,
            CASE WHEN c = 1 THEN 'J. of ' || p_brand WHEN c IN (2, 4) THEN '' ELSE p_name || ' @ ' || p_brand END AS container,
            CASE WHEN c IN (1, 2, 4) THEN '' ELSE p_size::VARCHAR END AS volume, CASE WHEN c = 1 THEN p_size::VARCHAR ELSE '' END AS issue,
            CASE WHEN c IN (1, 2, 4) THEN '' ELSE p_size || '--' || (p_size + 9) END AS pages, CASE WHEN c = 2 THEN 'P' ELSE '' END AS publisher,
            CASE WHEN c = 2 THEN 'http://dx.doi.org/10.5555/U' || p_partkey ELSE '' END AS url,
            CASE c WHEN 1 THEN 3 WHEN 4 THEN 0 ELSE 1 END::BIGINT AS n_authors,
            CASE WHEN c IN (1, 2) THEN p_brand WHEN c = 4 THEN '' ELSE p_brand || ' Study Group' END AS first_author, CASE WHEN c = 2 THEN 'editor' ELSE '' END AS role
            FROM e WHERE c NOT IN (9, 3, 5)""",
        "bibtex_bad_blocks": f"""WITH {_BIB} SELECT '/b/f' || f || '.bib' AS path, line::BIGINT AS line, 'k' || (p_partkey - CASE WHEN c = 9 THEN 1 ELSE 0 END) AS key,
            CASE c WHEN 9 THEN 'duplicate' WHEN 3 THEN 'open' ELSE 'field twice' END AS why FROM e WHERE c IN (9, 3, 5)""",
        "document_citations": """WITH o AS (SELECT *, 'o' || o_orderkey || '.md:' AS f FROM orders)
            SELECT 'no' || o_orderkey AS citekey, f || 4 AS locator FROM o UNION ALL SELECT 'key' || o_custkey, f || 6 FROM o
            UNION ALL SELECT 'pair:' || (o_orderkey % 7), f || 6 FROM o UNION ALL SELECT 'note' || o_orderkey, f || 6 FROM o""",
        "document_references": """WITH o AS (SELECT *, 'o' || o_orderkey || '.md:' AS f, o_orderkey % 2 = 0 AS even FROM orders)
            SELECT '10.1000/d' || o_orderkey AS key, f || 7 AS locator, 'other' AS kind, 0::BIGINT AS year, 0::BIGINT AS n_authors, false AS warned FROM o
            UNION ALL SELECT '10.2000/t' || o_orderkey, f || 10, 'article', 1990 + o_orderkey % 30, 2, false FROM o
            UNION ALL SELECT '10.3000/v' || o_orderkey, f || 11, CASE WHEN even THEN 'article' ELSE 'other' END, CASE WHEN even THEN 1999 ELSE 0 END, 0, NOT even FROM o
            UNION ALL SELECT '10.3000/w' || o_orderkey, f || 11, CASE WHEN even THEN 'article' ELSE 'other' END, CASE WHEN even THEN 2000 ELSE 0 END, 0, NOT even FROM o""",
        "library_references": _LIBRARY + " AND p_partkey % 5 <> 0",
        "library_collection": _LIBRARY + " AND p_partkey % 4 <> 3",
        "library_groups": """SELECT (1 + p_partkey % 3)::INT AS libraryID, CASE p_partkey % 3 WHEN 1 THEN 'Lab' ELSE '' END AS name, count(*) AS n FROM part
            WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0 AND p_size % 3 <> 1 GROUP BY 1, 2""",
        "registry_records": _RECORDS,
        "notices_in_force": """SELECT '10.1/u' || user_id AS doi, CASE WHEN event_type IN ('purchase', 'view') THEN 'retraction' ELSE 'expression-of-concern' END AS kind,
            CASE WHEN event_id % 3 = 0 THEN '' ELSE '10.2/n' || event_id END AS notice_doi, strftime(ts, '%Y-%m-%d') AS date FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date_trunc('minute', ts) DESC, event_id) AS nth FROM events WHERE event_type <> 'signup')
            WHERE nth = 1 AND event_type <> 'error' AND user_id % 2 = 0""",
        "audit_findings": findings,
        "audit_verdicts": verdicts,
        "audit_outage": f"SELECT p_partkey AS pos, 'UNCHECKED' AS verdict, 'unreachable' AS crossref FROM part WHERE p_partkey % {len(cases.CASES)} IN ({with_doi})",
        "audit_summary": f"""SELECT count(*) AS total, count(*) FILTER (verdict IN {failing}) AS failing, count(*) FILTER (verdict = 'OK') AS ok,
            (SELECT count(*) FROM ({findings}) WHERE kind = 'registry-artifact') AS artifact_issues, 0::BIGINT AS ruled_issues, {counts} FROM ({verdicts})""",
        "audit_error_fields": f"SELECT field, count(*) AS n FROM {kept} WHERE severity = 'error' GROUP BY field",
        "audit_json": f"""SELECT pos, verdict, CASE WHEN verdict IN {failing} THEN 'true' ELSE 'false' END AS fails, a.note, b.state AS crossref FROM ({verdicts})
            JOIN (VALUES {first}) AS a(n, note) ON pos % {len(cases.CASES)} = a.n JOIN (VALUES {identified}) AS b(n, state) ON pos % {len(cases.CASES)} = b.n""",
        "rules_unused": "SELECT 2 AS idx, 'nobody' AS key, 'idle' AS reason",
        "search_confirmed": _SEARCH,
        "suggested_copies": f"""WITH b AS (SELECT *, p_partkey // {_FILE} AS f, p_size % 10 < 3 AS hit FROM part),
            e AS (SELECT f, p_partkey, hit, '@article{{k' || p_partkey || ', title = {{T' || p_partkey || '}}' ||
              CASE WHEN hit THEN ',' || chr(10) || '  number = {{' || p_size || '}},' || chr(10) || '  journal = {{' || p_brand || '}},' || chr(10) ELSE '' END || '}}' AS entry FROM b)
            SELECT '/b/f' || f || '.bib' AS path, count(*) FILTER (hit) AS entries, 2 * count(*) FILTER (hit) AS fields,
              md5(chr(10) || string_agg(entry, chr(10) ORDER BY p_partkey)) AS body FROM e GROUP BY f HAVING count(*) FILTER (hit) > 0""",
        "duplicate_copies": "SELECT md5(text) AS value, doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents QUALIFY n > 1",
    }
