"""Lookups in registries as stages of a plan: distinct keys in, answers out, what is known first.

Keys that the table of answers has are read from it; the rest is asked in batches by one task a
registry, so that its pauses hold.  A key that could not be asked has ``failed`` set.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from urllib.parse import quote, urlencode

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeledger.functions.identifiers import doi_text
from citeledger.operators.resolve import bridged, record_of
from citeledger.operators.search import candidate_union, search_terms
from citeledger.scratch import keep
from citeledger.sources import registries as reg
from citeledger.sources.http import Answers, Client, Transient
from citeledger.sources.registries import medline_fields

#: asks for a batch of keys: payloads by key; a key that is left out is not there
Ask = Callable[[Client, list[str]], dict[str, str]]

CROSSREF, DATACITE, BOOKS = "https://api.crossref.org/works", "https://api.datacite.org/dois/", "https://openlibrary.org"
EUTILS = "https://eutils.ncbi.nlm.nih.gov/entrez/eutils"
EUROPEPMC, OPENALEX = "https://www.ebi.ac.uk/europepmc/webservices/rest/search", "https://api.openalex.org/works"
NOTICES = "https://api.labs.crossref.org/data/retractionwatch"
_SELECT = ",".join(
    "DOI title subtitle author editor issued published-print published-online container-title short-container-title volume issue page type "
    "publisher ISSN update-to updated-by".split()
)
EUTILS_PAUSE, ROWS = 1 / 3, 5


def looked_up(keys: DataFrame, source: str, ask: str, size: int, client: Client, answers: Answers | None = None, offline: bool = False, refresh: bool = False) -> DataFrame:
    """(key, payload, failed) of every key (key): payload null where the registry has nothing.

    ``ask``: name of a function of ``ASK``.
    """
    asker = ASK[ask]
    keys = keys.select("key").where("key is not null").distinct()
    known = answers.known(source, keys) if answers and (offline or not refresh) else None
    asked = keys.join(known.select("key"), "key", "left_anti") if known is not None else keys

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = [k for batch in batches for k in batch.column(0).to_pylist()]
        for begin in range(0, len(every), size):
            batch = every[begin : begin + size]
            failed: set[str] = set()
            try:
                found = asker(client, batch)
            except Transient:
                found = {}
                # a batch that fails may hold one bad key
                for key in batch if size > 1 else []:
                    try:
                        found |= asker(client, [key])
                    except Transient:
                        failed.add(key)
                failed |= set(batch) if size == 1 else set()
            yield pa.RecordBatch.from_pydict(
                {"key": batch, "payload": pa.array([found.get(k) for k in batch], pa.string()), "failed": [k in failed for k in batch]}
            )

    if offline:
        fetched = asked.select("key", F.lit(None).cast("string").alias("payload"), F.lit(True).alias("failed"))
    else:
        # read again below: nothing is asked twice
        fetched = keep(
            asked.repartition(1).sortWithinPartitions("key").mapInArrow(fetch, "key string, payload string, failed boolean"), "answers"
        )
        if answers:
            answers.add(source, fetched.where("not failed"))
    return fetched if known is None else fetched.unionByName(known.withColumn("failed", F.lit(False)))


def _crossref(client: Client, dois: list[str]) -> dict[str, str]:
    if len(dois) == 1:
        found = client.json(f"{CROSSREF}/{quote(dois[0], safe='')}")
        works = [found["message"]] if found else []
    else:
        chosen = ",".join(f"doi:{quote(d, safe='')}" for d in dois)
        works = ((client.json(f"{CROSSREF}?rows={2 * len(dois)}&select={_SELECT}&filter={chosen}") or {}).get("message") or {}).get("items", [])
    return {doi_text(w.get("DOI")): json.dumps(w) for w in works}


def _datacite(client: Client, dois: list[str]) -> dict[str, str]:
    found = client.json(DATACITE + quote(dois[0], safe="/"))
    data = found.get("data") if isinstance(found, dict) else None
    attributes = data.get("attributes") if isinstance(data, dict) else None
    return {dois[0]: json.dumps(attributes)} if attributes and isinstance(attributes, dict) else {}


def _books(client: Client, isbns: list[str]) -> dict[str, str]:
    keys = ",".join(f"ISBN:{i}" for i in isbns)
    found = client.json(f"{BOOKS}/api/books?bibkeys={quote(keys, safe=',:')}&format=json&jscmd=data") or {}
    return {i: json.dumps(b) for i in isbns if isinstance(b := found.get(f"ISBN:{i}"), dict) and b}


def _eutils(client: Client, call: str, **parameters: str) -> str | None:
    return client.text(f"{EUTILS}/{call}.fcgi?{urlencode({'db': 'pubmed', **parameters})}", EUTILS_PAUSE)


def _pmids(client: Client, dois: list[str]) -> dict[str, str]:
    """DOI to PMID: a search for the DOIs, then the ids of what it finds, of which only those asked for count."""
    term = " OR ".join(f'("{d}"[aid])' for d in dois)
    hits = json.loads(_eutils(client, "esearch", term=term, retmode="json", retmax=str(max(100, 5 * len(dois)))) or "{}")
    ids = (hits.get("esearchresult") or {}).get("idlist") or []
    out: dict[str, str] = {}
    for begin in range(0, len(ids), 200):
        told = json.loads(_eutils(client, "esummary", id=",".join(ids[begin : begin + 200]), retmode="json") or "{}").get("result") or {}
        for uid in told.get("uids", []):
            own = next((a.get("value") for a in (told.get(uid) or {}).get("articleids", []) if a.get("idtype") == "doi"), None)
            if (doi := doi_text(own)) in dois:
                out[doi] = uid
    return out


def _medline(client: Client, pmids: list[str]) -> dict[str, str]:
    text = _eutils(client, "efetch", id=",".join(pmids), rettype="medline", retmode="text") or ""
    blocks = {(f.get("PMID") or [""])[0]: "\n".join(f"{t.ljust(4)}- {v}" for t, vs in f.items() for v in vs) for f in medline_fields(text)}
    return {p: blocks[p] for p in pmids if p in blocks}


def _export(client: Client, keys: list[str]) -> dict[str, str]:
    text = client.text(NOTICES)
    return {} if text is None else {keys[0]: text}


def _pages(client: Client, urls: list[str]) -> dict[str, str]:
    return {u: t for u in urls if (t := client.text(u)) is not None}


ASK: dict[str, Ask] = {
    "crossref": _crossref, "datacite": _datacite, "openlibrary": _books, "pmid": _pmids, "medline": _medline, "notices": _export, "pages": _pages,
}


class Lookups:
    """The registries' tables for an audit, asked through one client and one table of answers."""

    def __init__(self, client: Client, answers: Answers | None = None, offline: bool = False, refresh: bool = False):
        self.client, self.answers, self.offline, self.refresh = client, answers, offline, refresh

    def _ask(self, keys: DataFrame, source: str, size: int, ask: str | None = None) -> DataFrame:
        return looked_up(keys, source, ask or source, size, self.client, self.answers, self.offline, self.refresh)

    def crossref(self, dois: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(records, keys that failed) of DOIs (key)."""
        found = self._ask(dois, "crossref", 20)
        return reg.crossref_records(found.where("payload is not null").select("key", "payload")), found.where("failed").select("key")

    def datacite(self, dois: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = self._ask(dois, "datacite", 1)
        return reg.datacite_records(found.where("payload is not null").select("key", "payload")), found.where("failed").select("key")

    def pmids(self, dois: DataFrame) -> tuple[DataFrame, DataFrame]:
        """((key, pmid), keys that failed): the bridge from DOIs to the medical index."""
        found = self._ask(dois, "pmid", 20)
        return found.where("payload is not null").select("key", F.col("payload").alias("pmid")), found.where("failed").select("key")

    def pubmed(self, dois: DataFrame) -> tuple[DataFrame, DataFrame]:
        ids, failed = self.pmids(dois)
        found = self._ask(ids.select(F.col("pmid").alias("key")), "medline", 50)
        fields = reg.medline_rows(found.where("payload is not null").select(F.col("payload").alias("text")))
        lost = bridged(dois, ids, found.where("failed").select(F.col("key").alias("pmid"))).select("key")
        return reg.medical_records(bridged(dois, ids, fields).select("key", "fields")), failed.unionByName(lost)

    def books(self, isbns: DataFrame) -> tuple[DataFrame, DataFrame]:
        found = self._ask(isbns, "openlibrary", 50)
        return reg.book_records(found.where("payload is not null").select("key", "payload")), found.where("failed").select("key")

    def notice_export(self) -> str | None:
        """The notice export's text; None where there is none."""
        spark = self.answers.spark
        found = self._ask(spark.createDataFrame([("export",)], "key string"), "notices", 1).first()
        if found is None or found["failed"]:
            raise Transient("the notice export could not be fetched")
        return found["payload"]

    def candidates(self, refs: DataFrame, europepmc: bool = True, openalex: bool = True, books: bool = True) -> DataFrame:
        """Candidates (ref, nth, rank, record, failed) of references (pos, title, authors, ...) in order of the sources."""
        terms = search_terms(refs)
        words = F.trim(F.concat_ws(" ", *(F.nullif(c, F.lit("")) for c in ("title", "surname", "container"))))
        clause = lambda test, start, c, end: F.when(test, F.concat(F.lit(start), c, F.lit(end)))
        query = F.concat_ws(
            " AND ", clause(F.col("title") != "", 'TITLE:"', F.col("title"), '"'), clause(F.col("surname") != "", 'AUTH:"', F.col("surname"), '"'),
            clause(F.coalesce("year", F.lit(0)) != 0, "PUB_YEAR:", F.col("year").cast("string"), ""),
        )
        coded = lambda c: F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))
        sources = [("crossref", words, F.concat(F.lit(f"{CROSSREF}?rows={ROWS}&select={_SELECT}&query.bibliographic="), coded(words)), "message.items", reg.crossref_records)]
        if europepmc:
            url = F.concat(F.lit(f"{EUROPEPMC}?query="), coded(query), F.lit(f"&format=json&resultType=core&pageSize={ROWS}"))
            sources.append(("europepmc", query, url, "resultList.result", reg.europepmc_records))
        if openalex:
            url = F.concat(F.lit(f"{OPENALEX}?filter=title.search:"), coded(F.col("title")), F.lit(f"&per_page={ROWS}"))
            sources.append(("openalex", F.col("title"), url, "results", reg.openalex_records))
        if books:
            of = lambda name, c: F.when(F.col(c) != "", F.concat(F.lit(f"{name}="), coded(F.col(c))))
            named = F.concat_ws("&", of("title", "title"), of("author", "surname"))
            asked = F.when(F.col("kind").isin("book", "chapter"), named).otherwise("")
            sources.append(("openlibrary", asked, F.concat(F.lit(f"{BOOKS}/search.json?"), named, F.lit(f"&limit={ROWS}")), "docs", reg.book_search_records))
        return candidate_union([self._hits(terms, *source) for source in sources])

    def _hits(self, terms: DataFrame, source: str, has: Column, url: Column, path: str, records: Callable[[DataFrame], DataFrame]) -> DataFrame:
        asked = terms.where(has != "").select("ref", url.alias("key"))
        found = self._ask(asked, f"search-{source}", 1, "pages")
        answers = asked.join(found, "key")
        listed = F.from_json(F.get_json_object("payload", f"$.{path}"), "array<string>")
        hits = answers.where("payload is not null").select("ref", "key", F.posexplode(listed).alias("nth", "payload")).where(F.col("nth") < ROWS)
        made = records(hits.withColumns({"url": F.col("key")}))
        out = made.select("ref", "nth", record_of(made).alias("record"), F.lit(None).cast("string").alias("failed"))
        down = answers.where("failed").select(
            "ref", F.lit(0).alias("nth"), F.lit(None).cast(out.schema["record"].dataType).alias("record"), F.lit(source).alias("failed")
        )
        return out.unionByName(down)
