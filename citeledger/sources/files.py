"""Files as rows: paths are listed on the driver, contents are read and parsed by executors."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

BIBLIOGRAPHIES, DOCUMENTS, LIBRARIES = {".bib", ".bibtex"}, {".qmd", ".md", ".markdown", ".rmd"}, {".sqlite", ".json"}
LIBRARY, GENERATED, SUGGESTED = "zotero.sqlite", {"_site", "_freeze", "node_modules"}, ".suggested.bib"

#: ``parsed`` makes Python objects of so many files at a time, and hands on so many rows, or what it found in so many bytes.
_FILES, _ROWS, _BYTES = 64, 4096, 1 << 20


class UsageError(Exception):
    """The given paths can't be audited."""


def once(paths: Iterable[Path]) -> list[Path]:
    """The paths without later spellings of the same file."""
    return list({p.resolve(): p for p in reversed(list(paths))}.values())[::-1]


def expand(paths: Sequence[str]) -> tuple[list[Path], list[Path], list[str]]:
    """(bibliographies, documents, libraries) that paths name or hold; ``local`` is the running library program."""
    found: dict[str, list[Path]] = {"bib": [], "doc": []}
    libraries: list[str] = []

    def kind(path: Path) -> str | None:
        suffix = path.suffix.lower()
        return "bib" if suffix in BIBLIOGRAPHIES else "doc" if suffix in DOCUMENTS else None

    for given in paths:
        path = Path(given).expanduser()
        if given == "local":
            libraries.append(given)
        elif not path.exists():
            raise UsageError(f"no such path: {given}")
        elif path.is_dir() and (path / LIBRARY).is_file():
            libraries.append(str(path / LIBRARY))
        elif path.is_dir():
            for child in sorted(path.rglob("*")):
                hidden = any(p.startswith(".") or p in GENERATED for p in child.relative_to(path).parts)
                if not hidden and child.is_file() and kind(child) and not child.name.lower().endswith(SUGGESTED):
                    found[kind(child)].append(child)
        elif kind(path):
            found[kind(path)].append(path)
        elif path.suffix.lower() in LIBRARIES:
            libraries.append(str(path))
        else:
            raise UsageError(f"unknown kind of file: {given}")
    return once(found["bib"]), once(found["doc"]), list(dict.fromkeys(libraries))


def file_table(spark: SparkSession, paths: Sequence[str | Path]) -> DataFrame:
    """(file_no, path, content) of the files at paths, numbered in the order of their paths."""
    if not paths:
        return spark.createDataFrame([], "file_no int, path string, content binary")
    read = spark.read.format("binaryFile").load([str(p) for p in paths])
    files = read.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), "content")
    # the driver has listed these names already: one small row a file
    numbers = read.select(F.regexp_replace("path", "^file:/*", "/").alias("path")).withColumn(
        "file_no", F.row_number().over(Window.orderBy("path")) - 1
    )
    return files.join(F.broadcast(numbers), "path").select("file_no", "path", "content")


def text_table(rows: DataFrame, name: str, text: str) -> DataFrame:
    """(file_no, path, content) of texts that are held in a table, for the same parsers.

    Files are numbered by a hash of their name: a stable order without a sort.
    """
    return rows.select(
        F.pmod(F.xxhash64(name), F.lit(1 << 30)).cast("int").alias("file_no"), F.col(name).cast("string").alias("path"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("content"),
    )


def decoded(content: bytes | None) -> str:
    return (content or b"").decode("utf-8", "replace")


def parsed(files: DataFrame, parse: Callable[[str, bytes], Iterable[dict]], schema: str) -> DataFrame:
    """(file_no, path, nth, ...): what parse finds in each file, in order."""
    full = f"file_no int, path string, nth int, {schema}"
    arrow = to_arrow_schema(StructType.fromDDL(full))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch a file would cost more than parsing; one holds many files' rows, or those of one large file
        found, read = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, _FILES):
                for row in batch.slice(at, _FILES).to_pylist():
                    content = row["content"] or b""
                    found += ({"file_no": row["file_no"], "path": row["path"], "nth": n, **x} for n, x in enumerate(parse(row["path"], content)))
                    read += len(content)
                    if len(found) >= _ROWS or read >= _BYTES:
                        if found:
                            yield pa.RecordBatch.from_pylist(found, arrow)
                        found, read = [], 0
        if found:
            yield pa.RecordBatch.from_pylist(found, arrow)

    return files.select("file_no", "path", "content").mapInArrow(rows, full)


def position() -> Column:
    """Place of a row of ``parsed`` among those of all files."""
    return F.shiftleft(F.col("file_no").cast("long"), 32) + F.col("nth")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)
