"""BibTeX files: blocks by a scanner, references by native columns.

A block opens with ``@type{`` or ``@type(`` anywhere between blocks and ends where its brace
closes; text between blocks is comment.  Values are braced, quoted or bare, may be joined by
``#`` and may name a @string; a backslash keeps the next character from counting.  A block that
is still open where another begins a line, or at the end of the file, is bad and the next one is
read; so is one that repeats a field.  Of entries with one citekey the first counts, the others
are bad.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.functions.identifiers import extract_dois, normalize_kind, parse_year
from citeledger.functions.names import people
from citeledger.functions.text import clean_each
from citeledger.schema import NAME
from citeledger.sources.files import base_name, decoded, file_table, parsed, position

BLOCKS = (
    "ok boolean, key string, entry_type string, line int, start int, end int, fields map<string,string>, raw string, role string, reason string"
)
_OPEN = re.compile(r"@([A-Za-z]+)\s*([{(])")
_NEW = re.compile(r"\n[ \t]*@[A-Za-z]+\s*[{(]")
_STEP = re.compile(r"\\.|[{}]", re.S)


class _Broken(Exception):
    """A block that can't be read: why, and where reading goes on."""

    def __init__(self, why: str, at: int):
        super().__init__(why)
        self.at = at


class _Scanner:
    def __init__(self, text: str):
        self.text, self.strings = text, {}
        self.at = self.limit = 0

    def blocks(self) -> Iterator[dict]:
        """Entries and bad blocks in order."""
        seen: set[str] = set()
        while found := _OPEN.search(self.text, self.at):
            start, kind = found.start(), found[1].lower()
            new = _NEW.search(self.text, found.end())
            self.limit = new.start() + 1 if new else len(self.text)
            base = {"line": self.text.count("\n", 0, start) + 1, "start": start, "entry_type": kind}
            self.at = found.end()
            try:
                if kind in ("comment", "preamble"):
                    self._braced("}" if found[2] == "{" else ")")
                    continue
                key, fields = self._body("}" if found[2] == "{" else ")", kind == "string")
            except _Broken as bad:
                self.at = max(bad.at, found.end())
                yield {**base, "ok": False, "key": self._key_at(found.end()), "reason": f"block failed to parse: {bad}"}
                continue
            if kind == "string":
                self.strings.update((name.lower(), value) for name, value in fields)
                continue
            base |= {"key": key, "end": self.at}
            names = [name for name, _ in fields]
            if key in seen:
                yield {**base, "ok": False, "reason": f"duplicate citekey {key!r}: only the first entry with it is read"}
            elif len(set(names)) < len(names):
                yield {**base, "ok": False, "reason": "block failed to parse: a field is given twice"}
            else:
                seen.add(key)
                low = {name.lower(): value for name, value in fields}
                role = "editor" if not low.get("author", "").strip() and low.get("editor", "").strip() else ""
                raw = dict(fields) | ({"creator_role": role} if role else {})
                yield {**base, "ok": True, "fields": low, "raw": json.dumps(raw, ensure_ascii=False), "role": role}

    def _key_at(self, at: int) -> str:
        return re.compile(r"\s*([^,\s{}()]*)").match(self.text, at)[1]

    def _blank(self) -> str:
        """The next character that is not blank, or '' at the block's limit."""
        while self.at < self.limit and self.text[self.at].isspace():
            self.at += 1
        return self.text[self.at] if self.at < self.limit else ""

    def _open_end(self, what: str) -> _Broken:
        return _Broken(f"{what} is not closed", self.limit)

    def _braced(self, close: str) -> str:
        """The text up to the closing brace, which is passed."""
        begin, depth = self.at, 0
        step = _STEP if close == "}" else re.compile(r"\\.|[{})]", re.S)
        while found := step.search(self.text, self.at, self.limit):
            self.at = found.end()
            if found[0] == close and depth == 0:
                return self.text[begin : found.start()]
            depth += {"{": 1, "}": -1}.get(found[0], 0)
        raise self._open_end("a brace")

    def _quoted(self) -> str:
        begin, depth = self.at, 0
        for found in re.compile(r'\\.|[{}"]', re.S).finditer(self.text, self.at, self.limit):
            if found[0] == '"' and depth == 0:
                self.at = found.end()
                return self.text[begin : found.start()]
            depth += {"{": 1, "}": -1}.get(found[0], 0)
        raise self._open_end("a quote")

    def _value(self, close: str) -> str:
        parts = []
        while True:
            first = self._blank()
            if not first:
                raise self._open_end("the block")
            if first in '{"':
                self.at += 1
                parts.append(self._braced("}") if first == "{" else self._quoted())
            else:
                bare = re.compile(r"[^,#\s" + re.escape(close) + "]*").match(self.text, self.at, self.limit)
                self.at = bare.end()
                parts.append(self.strings.get(bare[0].lower(), bare[0]))
            if self._blank() != "#":
                return "".join(parts)
            self.at += 1

    def _body(self, close: str, is_string: bool) -> tuple[str, list[tuple[str, str]]]:
        """(citekey, fields) up to the block's end, which is passed."""
        key = ""
        if not is_string:
            found = re.compile(r"\s*([^,\s}{]*)\s*").match(self.text, self.at, self.limit)
            key, self.at = found[1], found.end()
            if not key or self._blank() not in (",", close):
                raise _Broken("there is no citekey", self.at)
            self.at += self.text[self.at] == ","
        fields = []
        while True:
            first = self._blank()
            if not first:
                raise self._open_end("the block")
            if first == close:
                self.at += 1
                return key, fields
            if first == ",":
                self.at += 1
                continue
            named = re.compile(r"([^\s=,{}\"#]+)\s*=").match(self.text, self.at, self.limit)
            if not named:
                raise _Broken("a field has no '='", self.at + 1)
            self.at = named.end()
            fields.append((named[1], self._value(close)))
            if self._blank() not in (",", close, ""):
                raise _Broken(f"a comma is missing after {named[1]!r}", self.at + 1)


def blocks_of(path: str, content: bytes) -> Iterator[dict]:
    return _Scanner(decoded(content)).blocks()


def bibtex_blocks(files: DataFrame) -> DataFrame:
    """(file_no, path, nth, ok, key, ...): the entries and bad blocks of files (file_no, path, content)."""
    return parsed(files, blocks_of, BLOCKS)


def bad_blocks(blocks: DataFrame) -> DataFrame:
    """(path, line, key, reason) of what could not be read: nothing is dropped in silence."""
    return blocks.where("not ok").select("path", "line", "key", "reason")


def locator(path: Column, line: Column) -> Column:
    """file:line, by which a person finds the entry."""
    return F.concat(base_name(path), F.lit(":"), F.coalesce(line.cast("string"), F.lit("?")))


def entry_locators(blocks: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, key, locator) of keys (path, key); a key that its file lacks is at ``?``."""
    lines = blocks.where("ok").groupBy("path", "key").agg(F.min("line").alias("line"))
    return keys.join(lines, ["path", "key"], "left").select("path", "key", locator(F.col("path"), F.col("line")).alias("locator"))


_TEXTS = ["isbn", "url", "title", "container", "volume", "number", "pages", "publisher"]


def bibtex_references(blocks: DataFrame) -> DataFrame:
    """The entries as references."""
    given = lambda name: F.coalesce(F.col("fields")[name], F.lit(""))
    container = F.when(given("journal") != "", given("journal")).otherwise(given("booktitle"))
    texts = F.array(*(container if t == "container" else given(t) for t in _TEXTS))
    rows = blocks.where("ok").withColumn("texts", clean_each(texts))
    shown = lambda name: F.nullif(F.get("texts", F.lit(_TEXTS.index(name))), F.lit(""))
    creators = F.when(F.col("role") == "editor", given("editor")).otherwise(given("author"))
    no = F.lit(None).cast("string")
    return rows.select(
        position().alias("pos"), "key", locator(F.col("path"), F.col("line")).alias("locator"), normalize_kind(F.col("entry_type")).alias("kind"),
        F.coalesce(F.get(extract_dois(given("doi")), F.lit(0)), F.get(extract_dois(given("url")), F.lit(0))).alias("doi"),
        no.alias("pmid"), no.alias("arxiv"), shown("isbn").alias("isbn"), shown("url").alias("url"), shown("title").alias("title"),
        people(creators).cast(f"array<{NAME}>").alias("authors"), F.coalesce(parse_year(given("year")), parse_year(given("date"))).alias("year"),
        shown("container").alias("container"), shown("volume").alias("volume"), shown("number").alias("issue"), shown("pages").alias("pages"),
        shown("publisher").alias("publisher"), "raw",
    )


def read_bibtex(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, DataFrame]:
    """(references, bad blocks) of BibTeX files."""
    blocks = bibtex_blocks(file_table(spark, paths))
    return bibtex_references(blocks), bad_blocks(blocks)
