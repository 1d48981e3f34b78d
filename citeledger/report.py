"""Sinks: summaries, the text and JSON reports, citation-key problems and the exit code.

Counts are aggregations; only the rows that a report prints come to the driver, one at a time.
"""

from __future__ import annotations

import json
import os
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from typing import TextIO

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeledger.schema import ARTIFACT, FAILING, VERDICTS

LIMITS = (
    "This checks that each reference exists and that its stored fields are those that were published. Whether a work backs the "
    "statement that cites it, only reading it can tell."
)
HELP = {
    "RETRACTED": "the work itself was retracted", "BAD-ID": "no registry that was asked has the identifier", "WRONG-WORK": "the identifier is another work's",
    "FIELD-MISMATCH": "the right work with fields that differ", "UNCONFIRMED": "no identifier and no sure match: look at it",
    "UNCHECKED": "no registry answered, or none was asked", "DISPUTED": "the registries differ: somebody must decide",
    "INCOMPLETE": "the registry has fields that the entry lacks", "ADJUDICATED": "a difference that a rule of this project accepts",
    "REGISTRY-ARTIFACT": "a known defect of the registry explains it", "TITLE-DRIFT": "other wording, the same work",
    "COSMETIC": "the same but for signs and capitals", "OK": "all checked fields agree",
}
#: The order in which groups are printed, worst first.
SHOWN = [v for v in VERDICTS if v not in ("UNCHECKED", "OK")] + ["UNCHECKED", "OK"]
_YELLOW = {"DISPUTED", "INCOMPLETE", "ADJUDICATED", "UNCHECKED"}


@dataclass
class Summary:
    """What a run found, as numbers."""

    total: int = 0
    verdicts: dict[str, int] = field(default_factory=dict)
    fields: dict[str, int] = field(default_factory=dict)
    artifacts: int = 0
    adjudicated: int = 0
    blind: list[str] = field(default_factory=list)
    unsure: int = 0

    @property
    def suppressed(self) -> int:
        return self.artifacts + self.adjudicated

    @property
    def ok(self) -> int:
        return self.verdicts.get("OK", 0)

    def failing(self, verdicts: Iterable[str] = FAILING) -> int:
        return sum(self.verdicts.get(v, 0) for v in set(verdicts))

    def exit_code(self, verdicts: Iterable[str] = FAILING) -> int:
        return int(self.failing(verdicts) > 0)


def summary(results: DataFrame) -> DataFrame:
    """One row: total, failing, artifact_issues, ruled_issues and the count of each verdict."""
    of = lambda test: F.count_if(test)
    suppressed = lambda test: F.coalesce(F.sum(F.size(F.filter("suppressed", test))), F.lit(0))
    return results.agg(
        F.count("*").alias("total"), of(F.col("verdict").isin(FAILING)).alias("failing"),
        suppressed(lambda i: i["kind"] == ARTIFACT).alias("artifact_issues"), suppressed(lambda i: i["kind"] != ARTIFACT).alias("ruled_issues"),
        *(of(F.col("verdict") == v).alias(v.lower().replace("-", "_")) for v in VERDICTS),
    )


def error_fields(results: DataFrame) -> DataFrame:
    """(field, n): errors by field, most first, of equal counts the first seen."""
    found = results.select("pos", F.posexplode("issues").alias("nth", "i")).where("i.severity = 'error'")
    seen = F.min(F.struct("pos", "nth")).alias("seen")
    return found.groupBy(F.col("i.field").alias("field")).agg(F.count("*").alias("n"), seen).orderBy(F.desc("n"), "seen").select("field", "n")


def summarised(results: DataFrame) -> Summary:
    """A few dozen numbers, whatever the number of results."""
    row = summary(results).first()
    gaps = results.select("pos", F.explode(F.filter("issues", lambda i: i["kind"] == "retraction-unverified")).alias("i"))
    blind = gaps.select("pos", F.explode(F.split("i.source", ",")).alias("name")).groupBy("name").agg(F.count_distinct("pos").alias("n")).collect()
    unsure = gaps.select("pos").distinct().count() if blind else 0
    verdicts = {v: n for v in SHOWN if (n := row[v.lower().replace("-", "_")])}
    fields = {r["field"]: r["n"] for r in error_fields(results).collect()}
    return Summary(row["total"], verdicts, fields, row["artifact_issues"], row["ruled_issues"], sorted(r["name"] for r in blind), unsure)


def exit_code(results: DataFrame, failing: Iterable[str] = FAILING) -> int:
    return int(not results.where(F.col("verdict").isin(list(failing))).isEmpty())


def shortened(value: Column, most: int = 140) -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("…"))).otherwise(value)


def has_colour(stream: TextIO) -> bool:
    plain = "NO_COLOR" in os.environ or os.environ.get("TERM") == "dumb"
    return not plain and getattr(stream, "isatty", lambda: False)()


@dataclass
class Style:
    """Terminal colours, or none."""

    on: bool = False

    def _as(self, code: int, text: str) -> str:
        return f"\x1b[{code}m{text}\x1b[0m" if self.on else text

    def bold(self, text: str) -> str:
        return self._as(1, text)

    def dim(self, text: str) -> str:
        return self._as(2, text)

    def red(self, text: str) -> str:
        return self._as(31, text)

    def green(self, text: str) -> str:
        return self._as(32, text)

    def yellow(self, text: str) -> str:
        return self._as(33, text)

    def verdict(self, name: str) -> str:
        paint = self.red if name in FAILING else self.yellow if name in _YELLOW else self.green
        return paint(name)


def _cut(value: str, most: int = 140) -> str:
    return value if len(value) <= most else value[: most - 1] + "…"


def issue_lines(issue, style: Style, indent: str = "      ") -> Iterator[str]:
    yield f"{indent}{issue['field']}/{issue['kind']}" + (style.dim(f"  ({issue['note']})") if issue["note"] else "")
    if issue["stored"] or issue["registry"]:
        yield f"{indent}  stored   {_cut(issue['stored'])}"
        yield f"{indent}  {issue['source'] or 'registry':<8} {_cut(issue['registry'])}"


def text_lines(results: DataFrame, found: Summary, style: Style, verbose: bool = False, suppressed: bool = False, failing: Iterable[str] = FAILING) -> Iterator[str]:
    """The lines of the text report."""
    failing = set(failing)
    yield style.bold(f"{found.total} references checked")
    yield ""
    loud = set(SHOWN) if verbose else {*FAILING, "DISPUTED"}
    wanted = F.col("verdict").isin(sorted(loud))
    if suppressed:
        wanted = wanted | (F.size("suppressed") > 0)
    rank = F.array_position(F.array(*map(F.lit, SHOWN)), F.col("verdict"))
    rows = results.where(wanted).select("key", "locator", "verdict", "issues", "suppressed", rank.alias("rank"), "pos").orderBy("rank", "pos")
    counts = {r["verdict"]: r["n"] for r in results.where(wanted).groupBy("verdict").agg(F.count("*").alias("n")).collect()}
    group = None
    for row in rows.toLocalIterator():
        if row["verdict"] != group:
            if group:
                yield ""
            group = row["verdict"]
            yield f"{style.verdict(group)}  ({counts[group]})  {style.dim(HELP[group])}"
        yield f"    {style.bold(row['key'] or '')}  {style.dim(row['locator'] or '')}"
        for issue in row["issues"]:
            if verbose or issue["severity"] != "info":
                yield from issue_lines(issue, style)
        for issue in row["suppressed"] if suppressed else []:
            yield from map(style.dim, issue_lines(issue, style, "      ~ "))
    if group:
        yield ""
    yield style.bold("summary")
    yield from (f"  {v:<18} {n}" for v, n in found.verdicts.items())
    if found.fields:
        yield f"  {'errors by field':<18} " + ", ".join(f"{f}={n}" for f, n in found.fields.items())
    if found.suppressed:
        parts = [f"{n} {what}" for n, what in ((found.artifacts, "known registry defects"), (found.adjudicated, "by rules")) if n]
        yield f"  {'suppressed':<18} {found.suppressed}  ({', '.join(parts)})" + ("" if suppressed else "  (--show-suppressed lists them)")
    yield ""
    breaking = found.failing(failing)
    yield style.red(f"FAIL: {breaking} references in the failing set") if breaking else style.green("PASS: no reference in the failing set")
    if failing != set(FAILING):
        yield style.dim(f"  failing set: {', '.join(sorted(failing)) or 'empty, so nothing fails'}")
    if found.unsure:
        yield style.yellow(f"  retraction not fully checked for {found.unsure} references: no answer from {', '.join(found.blind)}")
    if outside := found.failing(set(FAILING) - failing):
        yield style.yellow(f"  {outside} references need a look but are outside the failing set")
    yield style.dim(LIMITS)


def render_text(results: DataFrame, stream: TextIO | None = None, **how) -> Summary:
    stream = stream or sys.stdout
    found = summarised(results)
    for line in text_lines(results, found, Style(has_colour(stream)), **how):
        print(line, file=stream)
    return found


def json_rows(results: DataFrame, failing: Iterable[str] = FAILING) -> DataFrame:
    """(pos, line): each result as one JSON object."""
    row = F.struct(
        "key", "locator", "identifier", "verdict", F.col("verdict").isin(FAILING).alias("fails"), "title_similarity", "consulted", "issues", "suppressed"
    )
    return results.select("pos", F.to_json(row, {"ignoreNullFields": "false"}).alias("line"))


def summary_json(found: Summary, failing: Iterable[str] = FAILING) -> dict:
    return {
        "total": found.total, "verdicts": found.verdicts, "errors_by_field": found.fields, "suppressed": found.suppressed, "registry_artifacts": found.artifacts,
        "adjudicated": found.adjudicated, "failing_verdicts": sorted(failing), "exit_code": found.exit_code(failing),
    }


def render_json(results: DataFrame, stream: TextIO | None = None, failing: Iterable[str] = FAILING) -> Summary:
    """One JSON document: limits, summary and all results in order."""
    stream = stream or sys.stdout
    found = summarised(results)
    head = {"tool": "citeledger", "limits": LIMITS, "summary": summary_json(found, failing)}
    stream.write(json.dumps(head, indent=2, ensure_ascii=False)[:-2] + ',\n  "results": [')
    for n, row in enumerate(json_rows(results, failing).orderBy("pos").toLocalIterator()):
        stream.write(("," if n else "") + "\n    " + row["line"])
    stream.write("\n  ]\n}\n")
    return found


def write_json(results: DataFrame, path: str) -> None:
    """All results as JSON lines, written by executors."""
    json_rows(results).select(F.col("line").alias("value")).write.mode("overwrite").text(path)


def citekey_problems(cited: DataFrame, defined: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cited but undefined, defined but uncited) keys."""
    return cited.join(defined, "citekey", "left_anti"), defined.join(cited, "citekey", "left_anti")


def render_citekeys(missing: DataFrame, unused: DataFrame, stream: TextIO | None = None, places: int = 5, names: int = 20) -> int:
    """The problems of citation keys (citekey, locator, pos) and (citekey); returns how many keys are undefined."""
    stream, style = stream or sys.stdout, Style(has_colour(stream or sys.stdout))
    # the first places of a key, not all that it is cited at
    nth = F.row_number().over(Window.partitionBy("citekey").orderBy("pos"))
    first = missing.withColumn("nth", nth).where(F.col("nth") <= places).groupBy("citekey").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "locator"))), lambda a: a["locator"]).alias("at")
    )
    listed = missing.groupBy("citekey").agg(F.count("*").alias("n")).join(first, "citekey").orderBy("citekey")
    count = listed.count()
    if count:
        print(style.red(f"undefined citation keys ({count})"), file=stream)
        for row in listed.toLocalIterator():
            print(f"    {style.bold(row['citekey'])}", file=stream)
            for at in row["at"]:
                print(f"      {style.dim(at)}", file=stream)
            if row["n"] > places:
                print(f"      {style.dim(f'… {row["n"] - places} more')}", file=stream)
        print(file=stream)
    idle = unused.select("citekey").distinct()
    if number := idle.count():
        first = [r["citekey"] for r in idle.orderBy("citekey").limit(names).collect()]
        print(style.dim(f"entries that nothing cites ({number})"), file=stream)
        print(style.dim("    " + ", ".join(first)), file=stream)
        if number > names:
            print(style.dim(f"    … {number - names} more"), file=stream)
        print(file=stream)
    return count
