"""Command line: check references, and look after the table of answers."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.functions.text import fold
from citeledger.operators.compare import Thresholds
from citeledger.operators.relations import duplicates, fuzzy_duplicates, richest
from citeledger.operators.resolve import lookup_keys, merged_notices, routed
from citeledger.plans.audit import AuditOptions, Registries, audit
from citeledger.report import citekey_problems, render_citekeys, render_json, render_text
from citeledger.schema import FAILING, REFERENCE
from citeledger.scratch import keep
from citeledger.sources.bibtex import read_bibtex
from citeledger.sources.files import UsageError, expand
from citeledger.sources.http import VERSION, Answers, Client, Transient, default_cache
from citeledger.sources.libraries import LibraryError, read_library
from citeledger.sources.lookups import Lookups
from citeledger.sources.markdown import read_markdown
from citeledger.sources.notices import medical_notices, notice_index
from citeledger.sources.rules import RuleError, load_rules
from citeledger.suggest import write_suggestions

_USUAL = Thresholds()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("citeledger", description="Checks that references exist and say what was published.")
    top.add_argument("--version", action="version", version=f"citeledger {VERSION}")
    commands = top.add_subparsers(dest="command", required=True)
    check = commands.add_parser("check", help="check references")
    check.add_argument("paths", nargs="+", help="bibliographies, documents, libraries, folders of them, or 'local'")
    check.add_argument("-b", "--bibliography", action="append", default=[], type=Path, help="a bibliography that documents cite; may be repeated")
    check.add_argument("--format", choices=("text", "json"), default="text")
    check.add_argument("-o", "--output", type=Path, help="where the report goes")
    check.add_argument("--fail-on", default=",".join(sorted(FAILING)), help="verdicts that make the run fail")
    ask = check.add_argument_group("registries")
    ask.add_argument("--mailto", help="an address that registries may write to")
    for name, text in (
        ("corroborate", "the medical index's second opinion"), ("search", "searches for entries without identifier"),
        ("retraction-check", "notices of retraction and concern"), ("isbn", "the book catalogue"), ("europepmc", "this discovery service"),
        ("openalex", "this discovery service"),
    ):
        ask.add_argument(f"--no-{name}", action="store_true", help=f"go without {text}")
    ask.add_argument("--offline", action="store_true", help="use kept answers only; the rest is UNCHECKED")
    ask.add_argument("--refresh", action="store_true", help="ask again for what is kept")
    ask.add_argument("--cache-dir", type=Path, default=default_cache())
    ask.add_argument("--cache-ttl", type=int, default=90, help="days that answers are kept for")
    ask.add_argument("--timeout", type=float, default=30.0, help="seconds until a request counts as unanswered")
    shown = check.add_argument_group("report")
    shown.add_argument("-v", "--verbose", action="store_true")
    shown.add_argument("--show-suppressed", action="store_true")
    shown.add_argument("--no-citekey-check", action="store_true")
    shown.add_argument("--suggest", action="store_true", help="write proposed copies of bibliographies beside them")
    limits = check.add_argument_group("thresholds")
    limits.add_argument("--title-wrong-work", type=float, default=_USUAL.wrong_work)
    limits.add_argument("--title-mismatch", type=float, default=_USUAL.mismatch)
    cache = commands.add_parser("cache", help="look at or clear the kept answers")
    cache.add_argument("action", choices=("info", "clear"))
    cache.add_argument("--cache-dir", type=Path, default=default_cache())
    return top


@dataclass
class Collected:
    """What the given paths hold."""

    references: DataFrame
    cited: DataFrame | None
    defined: DataFrame | None
    bibliographies: list[Path]


def collect(spark: SparkSession, args: argparse.Namespace) -> Collected:
    """References of documents, bibliographies and libraries, in that order."""
    bibs, docs, libraries = expand(args.paths)
    parts: list[DataFrame] = []
    cited = defined = None
    if docs:
        found, cited, discovered = read_markdown(spark, docs)
        parts.append(found)
        bibs += discovered
    for extra in args.bibliography:
        if not extra.expanduser().is_file():
            raise UsageError(f"no such bibliography: {extra}")
        bibs.append(extra.expanduser())
    bibs = list({b.resolve(): b for b in reversed(bibs)}.values())[::-1]
    if bibs:
        entries, bad = read_bibtex(spark, [str(b.resolve()) for b in bibs])
        for row in bad.orderBy("path", "line").toLocalIterator():
            print(f"citeledger: {Path(row['path']).name}:{row['line']}: {row['reason']}", file=sys.stderr)
        parts.append(entries)
        defined = entries.select(F.col("key").alias("citekey")).distinct()
    parts += [read_library(spark, source) for source in libraries]
    every = None
    for n, part in enumerate(parts):
        moved = part.withColumn("pos", F.col("pos") + F.lit(n << 48))
        every = moved if every is None else every.unionByName(moved)
    if every is None or every.isEmpty():
        raise UsageError("the given paths hold no references")
    return Collected(every, cited, defined, bibs)


def one_each(refs: DataFrame) -> DataFrame:
    """References with one of each identifier, the one with most fields, at the place of the first."""
    some = lambda c: F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) != "", 1).otherwise(0)
    filled = some("title") + some("year") + some("container") + some("volume") + some("issue") + some("pages") + F.when(F.size("authors") > 0, 1).otherwise(0)
    keyed = refs.withColumn("_id", F.coalesce(*(F.nullif(c, F.lit("")) for c in ("doi", "pmid", "arxiv", "isbn"))))
    best = richest(keyed.withColumn("_filled", filled), "_id", F.col("_filled"))
    return best.withColumn("pos", F.col("first_pos")).select(*refs.columns)


def ask_registries(refs: DataFrame, lookups: Lookups, options: AuditOptions, notices: bool = True, **services: bool) -> Registries:
    """The tables of an audit, asked through lookups; a registry that fails for some key counts as down."""
    way = keep(routed(refs), "routed")
    dois, isbns = lookup_keys(way, "doi"), lookup_keys(way, "isbn")
    records, down = {}, set()
    # outages are named: one look at the keys that failed

    def ask(name: str, answer: tuple[DataFrame, DataFrame]) -> None:
        records[name] = answer[0]
        if not answer[1].isEmpty():
            down.add(name)

    ask("crossref", lookups.crossref(dois))
    if "crossref" not in down:
        ask("datacite", lookups.datacite(dois.join(records["crossref"].select("key"), "key", "left_anti")))
    if options.corroborate:
        ask("pubmed", lookups.pubmed(dois))
    if options.use_isbn:
        ask("openlibrary", lookups.books(isbns))
    told = None
    searched = way.where("route = 'search'")
    found = lookups.candidates(searched, books=options.use_isbn, **services) if options.search_unidentified else None
    if options.retraction_check and notices:
        medical, lost = (records["pubmed"], None) if options.corroborate else lookups.pubmed(dois)
        if lost is not None and not lost.isEmpty():
            down.add("pubmed")
        told = medical_notices(medical)
        try:
            export = lookups.notice_export()
            if export:
                path = Path(lookups.answers.root) / "notices.csv"
                path.write_text(export, "utf-8")
                from citeledger.sources.notices import read_notices

                told = merged_notices(notice_index(read_notices(refs.sparkSession, str(path))), told)
        except Transient as failed:
            down.add("retraction-watch")
            print(f"citeledger: {failed}; retraction is checked by the medical index alone", file=sys.stderr)
    asked = ["crossref", *(s for s in ("europepmc", "openalex") if services.get(s, True))]
    return Registries(records, told, found, tuple(sorted(down)), tuple(asked))


def duplicate_report(refs: DataFrame) -> dict[str, DataFrame]:
    """Groups that are probably one work: by DOI, by citekey and by title; (value, members, n), titles as (a, b)."""
    shown = refs.withColumn("member", F.concat("key", F.lit(" ("), "locator", F.lit(")")))
    titled = shown.withColumn("title_key", fold(F.col("title"))).where("title_key <> ''").select("key", "title_key").distinct()
    same = duplicates(titled, F.col("title_key"), "key").select(F.get("members", F.lit(0)).alias("a"), F.get("members", F.lit(1)).alias("b"))
    near = fuzzy_duplicates(titled).unionByName(same)
    return {"doi": duplicates(shown, F.lower("doi"), "member"), "key": duplicates(shown, F.col("key"), "locator"), "title": near}


def run_check(spark: SparkSession, args: argparse.Namespace, client: Client | None = None) -> int:
    found = collect(spark, args)
    refs = keep(one_each(found.references), "references")
    try:
        rules, _ = load_rules(Path(args.paths[0]).expanduser().resolve())
    except RuleError as bad:
        raise UsageError(str(bad)) from bad
    limits = Thresholds(wrong_work=args.title_wrong_work, mismatch=args.title_mismatch)
    options = AuditOptions(not args.no_corroborate, not args.no_search, not args.no_retraction_check, not args.no_isbn, limits, tuple(rules))
    lookups = Lookups(client or Client(args.mailto, args.timeout), Answers(spark, args.cache_dir, args.cache_ttl), args.offline, args.refresh)
    registries = ask_registries(refs, lookups, options, europepmc=not args.no_europepmc, openalex=not args.no_openalex)
    results = keep(audit(refs.select(*(f.split(" ")[0] for f in REFERENCE.split(", "))), registries, options), "results")
    if args.suggest:
        for s in write_suggestions(spark, results, found.bibliographies):
            print(f"citeledger: {s['copy']} ({s['entries']} entries, {s['fields']} fields): look at it first; {s['path']} is as it was", file=sys.stderr)
    failing = [v.strip().upper() for v in args.fail_on.split(",") if v.strip()]
    check_keys = found.cited is not None and found.defined is not None and not args.no_citekey_check
    missing, unused = citekey_problems(found.cited, found.defined) if check_keys else (None, None)
    stream = args.output.open("w", encoding="utf-8") if args.output else sys.stdout
    try:
        if args.format == "json":
            told = render_json(results, stream, failing)
        else:
            told = render_text(results, stream, verbose=args.verbose, suppressed=args.show_suppressed, failing=failing)
            if check_keys:
                render_citekeys(missing, unused, stream)
            for kind, groups in duplicate_report(found.references).items():
                if n := groups.count():
                    print(f"duplicate {kind}: {n}", file=stream)
    finally:
        if args.output:
            stream.close()
    return 1 if check_keys and not missing.isEmpty() else told.exit_code(failing)


def run_cache(spark: SparkSession, args: argparse.Namespace) -> int:
    answers = Answers(spark, args.cache_dir)
    if args.action == "clear":
        answers.clear()
        print(f"cleared {answers.root}" if answers.usable else f"citeledger: {answers.root} can't be made; there was nothing to clear")
        return 0
    rows, size = answers.info()
    print(f"{answers.root}\n  {rows} answers, {size / 1e6:.1f} MB")
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None, client: Client | None = None) -> int:
    """0: nothing fails; 1: something does; 2: wrong usage or unreadable files; 130: interrupted."""
    args = parser().parse_args(argv)
    from citeledger.session import local_session

    try:
        spark = spark or SparkSession.getActiveSession() or local_session("citeledger")
        return run_check(spark, args, client) if args.command == "check" else run_cache(spark, args)
    except (UsageError, LibraryError, OSError) as bad:
        print(f"citeledger: {bad}", file=sys.stderr)
        return 2
    except KeyboardInterrupt:
        print("citeledger: interrupted", file=sys.stderr)
        return 130


if __name__ == "__main__":
    raise SystemExit(main())
