"""Markdown and Quarto documents: citation keys, DOIs, references in R chunks, bibliographies.

Each file is scanned in one pass by an executor into rows of three sorts: ``cite`` (a key),
``ref`` (a reference whose fields are still raw text) and ``bib`` (a bibliography that the front
matter names).  What the fields mean is then native columns.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.functions.identifiers import DOI, doi_text, parse_year
from citeledger.functions.names import people
from citeledger.functions.text import clean
from citeledger.operators.relations import CROSS_REFERENCES, KEY
from citeledger.schema import NAME
from citeledger.sources.files import decoded, file_table, once, parsed, position

SORTS = ("bib", "cite", "ref")
SCAN = (
    "sort string, line int, value string, kind string, doi string, year string, authors string, container string, raw string"
)
_KEY, _DOI = re.compile(KEY, re.A), re.compile(DOI)
_CODE = re.compile(r"(`{1,2})[^`]*\1")
_LINK = re.compile(r"(!?)\[\[([^\]|\n]*)(?:\|[^\]\n]*)?\]\]")
_FENCE = re.compile(r"\s*(`{3,}|~{3,})")
_CROSS = tuple(f"{x}-" for x in CROSS_REFERENCES)
_MORE = {"", "|", "|-", "|+", ">", ">-", ">+"}


def keys_in(text: str) -> list[str]:
    """Citation keys of a text in order; cross-references are none."""
    return [k for k in _KEY.findall(text) if not k.startswith(_CROSS)]


# front matter


def front_matter(lines: Sequence[str]) -> int:
    """How many lines the front matter takes with its delimiters, 0 where there is none."""
    bare = (line.lstrip("\ufeff").rstrip() for line in lines)
    if next(bare, None) != "---":
        return 0
    return next((n for n, line in enumerate(bare, 2) if line in ("---", "...")), 0)


def unquoted(value: str) -> str:
    value = value.strip()
    return value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'" else value


def yaml_values(lines: Sequence[str], name: str) -> list[str]:
    """The value of a top-level key as a list, be it a scalar, a flow list or a block list."""
    for n, line in enumerate(lines):
        head, colon, rest = line.rstrip("\r\n").partition(":")
        if head != name or not colon:
            continue
        rest = rest.strip()
        if rest.startswith("["):
            flow = " ".join([rest, *(x.strip() for x in lines[n + 1 :])]).partition("]")[0]
            return [unquoted(v) for v in flow[1:].split(",") if v.strip()]
        if rest:
            return [unquoted(rest)]
        out = []
        for item in lines[n + 1 :]:
            if not item.strip():
                continue
            found = re.match(r"\s*-\s+(.+)$", item.rstrip("\r\n"))
            if not found:
                break
            out.append(unquoted(found[1]))
        return out
    return []


def nocite_keys(lines: Sequence[str]) -> Iterator[tuple[str, int]]:
    """(key, line from 0) of the nocite entry."""
    for n, line in enumerate(lines):
        if not line.startswith("nocite:"):
            continue
        rest = line.rstrip("\r\n")[len("nocite:") :].strip()
        if rest not in _MORE:
            yield from ((k, n) for k in keys_in(unquoted(rest)))
            return
        for m, more in enumerate(lines[n + 1 :], n + 1):
            if more.strip() and not more[0].isspace():
                return
            yield from ((k, m) for k in keys_in(more))
        return


# fences


@dataclass
class Fence:
    """A fenced block: its opening line, its last masked line, and its body."""

    first: int
    last: int
    body: str


def fences(lines: Sequence[str]) -> list[Fence]:
    """Fenced blocks; one that is not closed runs to the end."""
    out, open_at, mark = [], None, ""
    for n, line in enumerate(lines):
        if open_at is None:
            if found := _FENCE.match(line):
                open_at, mark = n, found[1]
        elif (bare := line.strip()) and not bare.strip(mark[0]) and len(bare) >= len(mark):
            out.append(Fence(open_at, n, "".join(lines[open_at + 1 : n])))
            open_at = None
    if open_at is not None:
        out.append(Fence(open_at, len(lines) - 1, "".join(lines[open_at + 1 :])))
    return out


# R code

_R = re.compile(r"(?P<string>\"(?:\\.|[^\"\\])*(?:\"|$)|'(?:\\.|[^'\\])*(?:'|$))|(?P<comment>#[^\n]*)|(?P<sign>[(),])", re.S)
_ESCAPED, _TABLE, _FRAME = re.compile(r"\\(.)", re.S), re.compile(r"read\.delim\s*\("), re.compile(r"data\.frame\s*\(")
_TEXT, _SEPARATOR, _VECTOR = re.compile(r"text\s*="), re.compile(r"sep\s*=\s*(\"[^\"]*\")"), re.compile(r"([A-Za-z_][\w.]*)\s*=\s*c\(")
_json = json.JSONEncoder(ensure_ascii=False).encode
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "f": "\f", "v": "\v"}
_ROLES = {"year": "year", "author": "authors", "authors": "authors", "journal": "container", "doi": "doi"}


def column_role(name: str) -> str | None:
    return _ROLES.get(name.strip().lower())


def r_string(token: str) -> str:
    """The value of a quoted R string, which may lack its closing quote."""
    body = token[1:-1] if len(token) > 1 and token[-1] == token[0] else token[1:]
    return _ESCAPED.sub(lambda m: _ESCAPES.get(m[1], m[1]), body) if "\\" in body else body


def closing(code: str, at: int) -> int:
    """Where the bracket that opens at ``at`` is closed, or the end."""
    depth = 0
    for token in _R.finditer(code, at):
        if token.lastgroup == "sign":
            sign = token[0]
            depth += (sign == "(") - (sign == ")")
            if not depth:
                return token.start()
    return len(code)


def r_elements(code: str, start: int, end: int) -> list[tuple[str, int]]:
    """(value, offset) of the elements of a vector between start and end; empty ones are left out."""
    out, held, first, at = [], "", None, start

    def add(text: str, where: int) -> None:
        nonlocal held, first
        if first is None and text.strip():
            first = where + len(text) - len(text.lstrip())
        held += text

    def close() -> None:
        nonlocal held, first
        if held.strip():
            out.append((held.strip(), start if first is None else first))
        held, first = "", None

    for token in _R.finditer(code, start, end):
        add(code[at : token.start()], at)
        at = token.end()
        if token["string"]:
            first = token.start() if first is None else first
            held += r_string(token[0])
        elif token[0] == ",":
            close()
        elif not token["comment"]:
            add(token[0], token.start())
    add(code[at:end], at)
    close()
    return out


def _ref(line: int, kind: str, doi: str, raw: dict, **fields: str | None) -> dict:
    return {"sort": "ref", "line": line, "kind": kind, "doi": doi or None, "raw": _json(raw), **fields}


def delimited_tables(code: str) -> Iterator[tuple[str, str, int]]:
    """(content, separator, offset of the content) of each read.delim call that is given a text."""
    for call in _TABLE.finditer(code):
        begin, end = call.end() - 1, closing(code, call.end() - 1)
        named = _TEXT.search(code, begin, end)
        content = next((t for t in _R.finditer(code, named.end(), end) if t["string"]), None) if named else None
        if content is None:
            continue
        given = _SEPARATOR.search(code, begin, content.start()) or _SEPARATOR.search(code, content.end(), end)
        yield r_string(content[0]), r_string(given[1]) if given else "\t", content.start() + 1


def table_references(content: str, separator: str, offset: int, code: str, first_line: int) -> Iterator[dict]:
    rows, header, roles = content.split("\n"), None, {}
    for row in rows:
        cells = [c.strip() for c in row.split(separator)] if row.strip() else []
        if cells and header is None:
            header = cells
            roles = {role: n for n, c in reversed(list(enumerate(cells))) if (role := column_role(c))}
            if "doi" not in roles:
                return
        elif cells and len(cells) > roles["doi"]:
            of = lambda role: cells[roles[role]] if role in roles and roles[role] < len(cells) else None  # noqa: B023, E731
            yield _ref(
                first_line + code.count("\n", 0, offset), "article", doi_text(of("doi")), dict(zip(header, cells, strict=False)),
                year=of("year"), authors=of("authors"), container=of("container"),
            )
        offset += len(row) + 1


def doi_vectors(code: str) -> Iterator[dict[str, list[tuple[str, int]]]]:
    """The named vectors of each data.frame call that has one of DOIs."""
    for call in _FRAME.finditer(code):
        end = closing(code, call.end() - 1)
        vectors = {
            v[1]: r_elements(code, v.end(), closing(code, v.end() - 1)) for v in _VECTOR.finditer(code, call.end(), end)
        }
        if any(column_role(name) == "doi" for name in vectors):
            yield vectors


def vector_references(vectors: dict[str, list[tuple[str, int]]], code: str, first_line: int) -> Iterator[dict]:
    """References paired by position; with a vector of another length nothing but DOIs can be trusted."""
    dois = next(v for name, v in vectors.items() if column_role(name) == "doi")
    roles = {name: role for name in vectors if (role := column_role(name)) and role != "doi"}
    uneven = sorted(f"{name} ({len(vectors[name])})" for name in roles if len(vectors[name]) != len(dois))
    for n, (doi, offset) in enumerate(dois):
        raw = {name: v[n][0] for name, v in vectors.items() if n < len(v)}
        line = first_line + code.count("\n", 0, offset)
        if uneven:
            raw["warning"] = f"not paired, of other length than the {len(dois)} DOIs: {', '.join(uneven)}"
            yield _ref(line, "other", doi_text(doi), raw)
        else:
            yield _ref(line, "article", doi_text(doi), raw, **{role: vectors[name][n][0] for name, role in roles.items()})


def chunk_references(code: str, first_line: int) -> Iterator[dict]:
    """References of a fenced block: tables, data frames, then DOIs that neither has."""
    seen: set[str] = set()

    def fresh(found: dict) -> dict:
        seen.add(found["doi"] or "")
        return found

    for content, separator, offset in delimited_tables(code):
        yield from map(fresh, table_references(content, separator, offset, code, first_line))
    for vectors in doi_vectors(code):
        yield from map(fresh, vector_references(vectors, code, first_line))
    for found in _DOI.finditer(code):
        doi = doi_text(found[0])
        if doi and doi not in seen:
            yield fresh(_ref(first_line + code.count("\n", 0, found.start()), "other", doi, {"context": "code-chunk"}))


def scan_of(path: str, content: bytes, sorts: Sequence[str] = SORTS) -> Iterator[dict]:
    """The rows of one document, of the sorts that are wanted."""
    lines = decoded(content).splitlines(keepends=True)
    front, blocks = front_matter(lines), fences(lines)
    head = lines[1 : front - 1] if front else []
    cites, refs = "cite" in sorts, "ref" in sorts
    for value in yaml_values(head, "bibliography") if "bib" in sorts else ():
        yield {"sort": "bib", "line": 1, "value": value}
    for key, n in nocite_keys(head) if cites else ():
        yield {"sort": "cite", "line": n + 2, "value": key}
    masked = {n for block in blocks for n in range(block.first, block.last + 1)} | set(range(front))
    for n, line in enumerate(lines):
        if n in masked:
            continue
        seen: set[str] = set()
        for found in _DOI.finditer(line.replace("`", " ")) if refs and "10." in line else ():
            doi = doi_text(found[0])
            if doi and doi not in seen:
                seen.add(doi)
                yield _ref(n + 1, "other", doi, {"context": "prose"})
        if not cites or "@" not in line:
            continue
        prose = _CODE.sub(" ", line)
        # a link to a note may be named by a key; an embedded one cites nothing
        linked = [k for m in _LINK.finditer(prose) if not m[1] and m[2].startswith("@") for k in keys_in(m[2])]
        for key in linked + keys_in(_LINK.sub(lambda m: " " * len(m[0]), prose)):
            yield {"sort": "cite", "line": n + 1, "value": key}
    for block in blocks if refs else ():
        yield from chunk_references(block.body, block.first + 2)


def collected(paths: Sequence[Path]) -> list[Path]:
    """Documents that paths name or hold, each once."""
    return once(f for p in paths for f in (sorted({*p.rglob("*.qmd"), *p.rglob("*.md")}, key=Path.as_posix) if p.is_dir() else [p]))


def common_root(files: Sequence[Path]) -> Path | None:
    """The folder by which locators are told apart."""
    resolved = [f.resolve() for f in files]
    if len(resolved) < 2:
        return resolved[0].parent if resolved else None
    try:
        return Path(os.path.commonpath(resolved))
    except ValueError:
        return None


def markdown_scan(files: DataFrame, root: str = "", sorts: Sequence[str] = SORTS) -> DataFrame:
    """(file_no, path, nth, locator, ...): rows of files (file_no, path, content), located below root.

    What is read by one sort alone is found without the others.
    """
    start = F.lit(root.rstrip("/") + "/")
    shown = F.when(F.col("path").startswith(start), F.expr("substring(path, length(_start) + 1)")).otherwise(F.col("path"))
    rows = parsed(files, partial(scan_of, sorts=tuple(sorts)), SCAN).withColumn("_start", start)
    return rows.withColumn("locator", F.concat(shown, F.lit(":"), F.col("line").cast("string"))).drop("_start")


def cited_keys(scan: DataFrame) -> DataFrame:
    """(citekey, locator, pos) of every citation, in order of pos."""
    return scan.where("sort = 'cite'").select(F.col("value").alias("citekey"), "locator", position().alias("pos"))


def markdown_references(scan: DataFrame) -> DataFrame:
    """The references of documents."""
    no = F.lit(None).cast("string")
    text = lambda c: F.nullif(clean(F.col(c)), F.lit(""))
    return scan.where("sort = 'ref'").select(
        position().alias("pos"), F.coalesce("doi", F.concat(F.lit("row:"), "locator")).alias("key"), "locator", "kind", "doi",
        *(no.alias(c) for c in ("pmid", "arxiv", "isbn", "url", "title")), people(F.coalesce("authors", F.lit(""))).cast(f"array<{NAME}>").alias("authors"),
        parse_year(F.col("year")).alias("year"), text("container").alias("container"), *(no.alias(c) for c in ("volume", "issue", "pages", "publisher")), "raw",
    )


def _upwards(folder: Path) -> list[Path]:
    return [folder, *folder.parents]


def vault_root(folder: Path) -> Path | None:
    return next((f for f in _upwards(folder) if (f / ".obsidian").is_dir()), None)


def project_bibliography(folder: Path) -> list[Path]:
    """The bibliographies of the nearest project file above a folder."""
    for at in _upwards(folder.resolve()):
        if (at / "_quarto.yml").is_file():
            lines = (at / "_quarto.yml").read_text("utf-8", "replace").splitlines(keepends=True)
            return [(at / v).resolve() for v in yaml_values(lines, "bibliography")]
    return []


def bibliographies(scan: DataFrame, files: Sequence[Path]) -> list[Path]:
    """Bibliographies of documents, in order: what the front matter names, below the vault's root
    if there is one, else what the project names.  Only folders and names reach the driver."""
    named: dict[str, list[str]] = {}
    for row in scan.where("sort = 'bib'").orderBy("file_no", "nth").select("path", "value").collect():
        named.setdefault(row["path"], []).append(row["value"])
    out: dict[Path, None] = {}
    for file in files:
        folder = file.resolve().parent
        values = named.get(str(file.resolve()))
        base = vault_root(folder) or folder
        out |= dict.fromkeys([(base / v).resolve() for v in values] if values else project_bibliography(folder))
    return list(out)


def read_markdown(spark: SparkSession, paths: Sequence[Path]) -> tuple[DataFrame, DataFrame, list[Path]]:
    """(references, cited keys, bibliographies) of documents and folders of them."""
    files = collected([Path(p) for p in paths])
    scan = markdown_scan(file_table(spark, [f.resolve() for f in files]), str(common_root(files) or ""))
    return markdown_references(scan), cited_keys(scan), bibliographies(scan, files)
