"""Field-by-field comparison of stored references with registry records, and the verdict.

The input is one row a reference: its own columns, ``route``, ``identifier``, ``asked``,
``primary`` and ``corroborator`` (records or null) and ``records`` (all records found).  Display
texts and comparison keys of all fields are made once, as two arrays; the checks index into
those.  Everything but title ratios and bylines is a native expression; issues come in a fixed
order.  Notes are this engine's own words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeledger.functions.identifiers import kind_of, normalize_doi, page_of
from citeledger.functions.names import byline_diff
from citeledger.functions.text import clean_each, fold_all, fold_each, settled, similarity
from citeledger.operators import rules
from citeledger.schema import ARTIFACT, COMPATIBLE_KINDS, CONCERN, ISSUE, NO_RESOLUTION_SIGNAL, NO_RETRACTION_SIGNAL, REGISTRIES


@dataclass(frozen=True)
class Thresholds:
    """Title ratios; books and chapters have lower bands."""

    wrong_work: float = 0.55
    mismatch: float = 0.85
    ok: float = 0.97
    confirm: float = 0.90
    book_wrong_work: float = 0.45
    book_mismatch: float = 0.75


def issue(field, kind: str, severity: str, stored=None, registry=None, source=None, note=None) -> Column:
    text = lambda v: F.lit(v) if isinstance(v, str) else F.lit("") if v is None else F.coalesce(v.cast("string"), F.lit(""))
    return F.struct(
        text(field).alias("field"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), text(stored).alias("stored"),
        text(registry).alias("registry"), text(source).alias("source"), text(note).alias("note"),
    )


def ordered_sources(names: Column) -> Column:
    """Distinct names, the canonical registries first."""
    known = F.array(*(F.lit(r) for r in REGISTRIES))
    return F.concat(F.array_intersect(known, names), F.array_sort(F.array_except(names, known)))


def consulted(name: Column, present: Column, asked: Column, unreachable: Column) -> Column:
    """answered, unreachable or not-asked: an outage outweighs having asked."""
    return (
        F.when(F.array_contains(unreachable, name), "unreachable")
        .when(F.array_contains(F.array_union(present, asked), name), "answered").otherwise("not-asked")
    )


def consultations(present: Column, asked: Column, unreachable: Column) -> Column:
    """Map of every registry that took part, and of the canonical ones in any case, to its state."""
    known = F.array(*(F.lit(r) for r in REGISTRIES))
    names = ordered_sources(F.array_union(known, F.array_union(present, F.array_union(asked, unreachable))))
    return F.map_from_arrays(names, F.transform(names, lambda n: consulted(n, present, asked, unreachable)))


def compatible(a: Column, b: Column) -> Column:
    pairs = [((a == x) & (b == y)) | ((a == y) & (b == x)) for x, y in COMPATIBLE_KINDS]
    out = (a == b) | (a == "other") | (b == "other")
    for p in pairs:
        out = out | p
    return out


_FIELDS = ["title", "container", "volume", "issue", "publisher", "pages"]
_SIDES = ["own", "primary", "corroborator"]
_SHORT, _KIND, _REGISTRY_KIND = (len(_FIELDS) * len(_SIDES) + i for i in range(3))


def _at(side: str, field: str) -> int:
    return _SIDES.index(side) * len(_FIELDS) + _FIELDS.index(field)


def _shown(side: str, field: str) -> Column:
    return F.get("shown", F.lit(_at(side, field)))


def _key(side: str, field: str) -> Column:
    return F.get("keys", F.lit(_at(side, field)))


def _has(side: str, field: str) -> Column:
    return F.coalesce(F.col(f"{side}.{field}"), F.lit("")) != ""


def _either(field: str) -> tuple[Column, Column, Column]:
    """(display text, key, source) of the primary's value, or of the corroborator's where it has none."""
    first, second = _has("primary", field), _has("corroborator", field)
    pick = lambda a, b, none: F.when(first, a).when(second, b).otherwise(none)
    return (
        pick(_shown("primary", field), _shown("corroborator", field), ""), pick(_key("primary", field), _key("corroborator", field), ""),
        pick(F.col("primary.source"), F.col("corroborator.source"), ""),
    )


def prepared(rows: DataFrame) -> DataFrame:
    """rows with the texts, keys, scores and byline differences that the checks need."""
    side = lambda s, f: F.col(f) if s == "own" else F.col(f"{s}.{f}")
    texts = F.array(
        *(F.coalesce(side(s, f), F.lit("")) for s in _SIDES for f in _FIELDS),
        *(F.coalesce(F.col(c), F.lit("")) for c in ("primary.container_short", "kind", "primary.kind")),
    )
    alternates = F.concat(*(F.coalesce(F.col(f"{r}.container_alternates"), F.array()) for r in ("primary", "corroborator")))
    rows = settled(rows, {"texts": texts, "alternates": alternates})
    rows = settled(rows, {"shown": clean_each(F.col("texts")), "keys": fold_each(F.col("texts")), "k_alternates": fold_all(F.col("alternates"))})
    score = lambda r: similarity(_shown("own", "title"), _shown(r, "title"), _key("own", "title"), _key(r, "title"))
    listed = F.when(F.size("primary.authors") > 0, F.col("primary.authors")).otherwise(F.col("corroborator.authors"))
    rows = settled(
        rows,
        {
            "score_p": score("primary"), "score_c": score("corroborator"), "listed": listed,
            "own_kind": kind_of(F.get("keys", F.lit(_KIND))), "registry_kind": kind_of(F.get("keys", F.lit(_REGISTRY_KIND))),
        }
    )
    # the title that is nearer to the stored one; of equal ones the primary's
    second = (_shown("corroborator", "title") != "") & ((_shown("primary", "title") == "") | (F.col("score_c") > F.col("score_p")))
    rows = settled(
        rows,
        {
            "best_title": F.when(second, _shown("corroborator", "title")).otherwise(_shown("primary", "title")),
            "best_key": F.when(second, _key("corroborator", "title")).otherwise(_key("primary", "title")),
            "best_source": F.when(second, F.col("corroborator.source")).otherwise(F.col("primary.source")),
            "best_score": F.when(second, F.col("score_c")).otherwise(F.col("score_p")),
            "diff": byline_diff(F.col("authors"), F.col("listed")),
        }
    )
    repaired = F.array(rules.once_only(F.col("best_title")), rules.without_parent(F.col("best_title")))
    changed = F.exists(repaired, lambda t: t != F.col("best_title"))
    return rows.withColumn("repaired", F.when(changed, repaired)).withColumn("repaired_keys", fold_each(F.col("repaired")))


def _quoted(value: Column) -> Column:
    """A value in quotes: double ones where it has single ones alone."""
    plain = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    single = F.contains(value, F.lit("'"))
    return F.when(single & ~F.contains(value, F.lit('"')), F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(
        F.concat(F.lit("'"), F.replace(plain, F.lit("'"), F.lit("\\'")), F.lit("'"))
    )


def _both(first: Column, second: Column) -> Column:
    return F.concat(F.col("primary.source"), F.lit("="), _quoted(first), F.lit(" vs "), F.col("corroborator.source"), F.lit("="), _quoted(second))


def _scalar(field: str) -> Column:
    """One of container, volume, issue, publisher."""
    stored, mine = _shown("own", field), _key("own", field)
    value, theirs, source = _either(field)
    other, other_key = _shown("corroborator", field), _key("corroborator", field)
    exempt = F.col("own_kind") == "book" if field in ("volume", "issue") else F.lit(False)
    ladder = F.when(value == "", None).when(stored == "", F.when(~exempt, issue(field, "missing", "warning", None, value, source)))
    ladder = ladder.when(mine == theirs, F.when(stored != value, issue(field, "cosmetic", "info", stored, value, source)))
    if field == "container":
        also = F.concat(source, F.lit(" lists this title too"))
        ladder = ladder.when(F.array_contains("k_alternates", mine), issue(field, "alternate-title", "info", stored, value, source, also))
    disputed = lambda why: issue(field, "disputed", "info", stored, _both(value, other), "both", why)
    ladder = ladder.when((other != "") & (other_key == mine), disputed("the corroborating registry has the stored value")).when(
        (other != "") & (other_key != theirs), disputed("the registries disagree")
    )
    if field == "container":
        why = rules.abbreviated_container(mine, theirs, F.get("keys", F.lit(_SHORT)))
        ladder = ladder.when(why.isNotNull(), issue(field, ARTIFACT, "info", stored, value, F.col("primary.source"), why))
    return ladder.otherwise(issue(field, "mismatch", "error", stored, value, source))


def _title(limits: Thresholds) -> Column:
    stored, mine = _shown("own", "title"), _key("own", "title")
    value, theirs, source, score = (F.col(f"best_{x}") for x in ("title", "key", "source", "score"))
    relaxed = F.col("own_kind").isin("book", "chapter")
    high = F.when(relaxed, limits.book_mismatch).otherwise(limits.mismatch)
    low = F.when(relaxed, limits.book_wrong_work).otherwise(limits.wrong_work)
    fixed = lambda i: F.get("repaired_keys", F.lit(i)) == mine
    why = F.coalesce(rules.shortened_title(mine, theirs), rules.doubled_token(fixed(0)), rules.bracketed_parent(fixed(1)))
    args, note = (stored, value, source), F.format_string("similarity %.2f", score)
    first = F.when(_shown("primary", "title") != "", _shown("primary", "title")).otherwise(_shown("corroborator", "title"))
    owner = F.when(_shown("primary", "title") != "", F.col("primary.source")).otherwise(F.col("corroborator.source"))
    return (
        F.when(value == "", None)
        .when(stored == "", issue("title", "missing", "error", None, first, owner))
        .when(mine == theirs, F.when(stored != value, issue("title", "cosmetic", "info", *args)))
        .when(why.isNotNull(), issue("title", ARTIFACT, "info", stored, value, F.col("primary.source"), why))
        .when(score >= limits.ok, issue("title", "drift", "info", *args))
        .when(score >= high, issue("title", "drift", "warning", *args, note))
        .when(score >= low, issue("title", "mismatch", "error", *args, note))
        .otherwise(issue("title", "wrong-work", "error", *args, note))
    )


def _name(n: Column) -> Column:
    literal = F.coalesce(n["literal"], F.lit(""))
    both = F.concat(F.coalesce(n["family"], F.lit("")), F.lit(", "), F.coalesce(n["given"], F.lit("")))
    return F.when(literal != "", literal).otherwise(F.regexp_replace(both, "^[, ]+|[, ]+$", ""))


def _authors() -> Column:
    """Array of the byline's issues."""
    have, listed = F.coalesce(F.size("authors"), F.lit(0)), F.coalesce(F.size("listed"), F.lit(0))
    source = F.when(F.size("primary.authors") > 0, F.col("primary.source")).otherwise(F.col("corroborator.source"))
    first = F.array_join(F.transform(F.slice(F.col("listed"), 1, 3), _name), "; ")
    at = lambda side, n: F.get(F.transform(F.col(side), _name), n - 1)
    numbered = lambda n, text: F.concat(F.lit("#"), n.cast("string"), F.lit(" "), text)
    counted = lambda n: F.concat(n.cast("string"), F.lit(" authors"))
    none = F.array().cast(f"array<{ISSUE}>")
    excused = F.transform(
        F.array_sort(F.col("diff.reasons")),
        lambda r: issue("authors", ARTIFACT, "info", at("authors", r["position"]), at("listed", r["position"]), F.col("primary.source"), r["reason"]),
    )
    count = F.when(F.col("diff.count_differs"), F.array(issue("authors", "count", "warning", counted(have), counted(listed), source))).otherwise(none)
    wrong = F.transform(
        F.col("diff.mismatches"),
        lambda m: issue("authors", "mismatch", "error", numbered(m["position"], m["stored"]), numbered(m["position"], m["registry"]), source),
    )
    return (
        F.when(listed <= 0, none)
        .when(have <= 0, F.array(issue("authors", "missing", "error", None, first, source)))
        .otherwise(F.concat(excused, count, wrong))
    )


def preferred_year(years: Column) -> Column:
    at = lambda slot: F.get(F.filter(years, lambda y: y["slot"] == slot), F.lit(0))["year"]
    return F.coalesce(at("print"), at("issued"), at("online"), F.get(years, F.lit(0))["year"])


def _year() -> Column:
    empty = F.array().cast("array<struct<slot:string,year:int>>")
    own, other = (F.coalesce(F.col(f"{r}.years"), empty) for r in ("primary", "corroborator"))
    marked = F.transform(other, lambda y: y.withField("slot", F.concat(F.col("corroborator.source"), F.lit(":"), y["slot"])))
    every, value, source = F.array_sort(F.concat(own, marked)), preferred_year(F.col("primary.years")), F.col("primary.source")
    shown = F.array_join(F.transform(every, lambda y: F.concat(y["slot"], F.lit("="), y["year"].cast("string"))), ", ")
    stored = F.col("year")
    holders = F.array_join(F.transform(F.filter(every, lambda y: y["year"] == stored), lambda y: y["slot"]), ", ")
    note = F.coalesce(
        rules.online_first(stored, own, value),
        F.concat(F.lit("stored year is the "), holders, F.lit(" one; "), source, F.lit(" leads with "), value.cast("string")),
    )
    why = rules.deposit_stamp(stored, value, own)
    accepted = F.exists(every, lambda y: y["year"] == stored)
    return (
        F.when(F.size(every) == 0, None)
        .when(stored.isNull(), issue("year", "missing", "warning", None, value, source))
        .when(accepted, F.when(stored != value, issue("year", "alternate-date", "info", stored, shown, source, note)))
        .when(why.isNotNull(), issue("year", ARTIFACT, "info", stored, value, source, why))
        .otherwise(issue("year", "mismatch", "error", stored, shown, source))
    )


def _pages() -> Column:
    stored = _shown("own", "pages")
    value, _, source = _either("pages")
    mine, other = page_of(stored), _shown("corroborator", "pages")
    why = rules.article_number(stored, value)
    return (
        F.when(value == "", None)
        .when(stored == "", F.when(F.col("own_kind") != "book", issue("pages", "missing", "warning", None, value, source)))
        .when(mine == page_of(value), None)
        .when((other != "") & (page_of(other) == mine), issue("pages", "disputed", "info", stored, _both(value, other), "both", "the corroborating registry has the stored value"))
        .when(why.isNotNull(), issue("pages", ARTIFACT, "info", stored, value, F.col("primary.source"), why))
        .otherwise(issue("pages", "mismatch", "error", stored, value, source))
    )


def _kind() -> Column:
    mine, theirs = F.col("own_kind"), F.col("registry_kind")
    return F.when(~compatible(mine, theirs), issue("kind", "incompatible", "warning", mine, theirs, F.col("primary.source"), "the record is of another type than the entry"))


def _doi() -> Column:
    mine, theirs = F.col("own_doi"), F.col("registry_doi")
    why = F.coalesce(rules.redirecting_doi(F.col("doi")), F.lit("the record is filed under another DOI than the one that led to it"))
    return F.when((mine != "") & (theirs != "") & (mine != theirs), issue("doi", "alias", "info", F.col("doi"), F.col("primary.doi"), F.col("primary.source"), why))


def _status(unreachable: Column) -> Column:
    """Array of what the records say about the work's standing."""
    flat = lambda kind: F.replace(F.lower(F.trim(kind)), F.lit("-"), F.lit(" "))
    kind_of_notice = lambda r: F.coalesce(F.nullif(r["retraction_kind"], F.lit("")), F.lit("retracted"))
    named = lambda test: ordered_sources(F.transform(F.filter(F.col("records"), test), lambda r: r["source"]))
    asserts, concern = lambda r: F.coalesce(r["retracted"], F.lit(False)), lambda r: flat(kind_of_notice(r)) == CONCERN
    retracting, concerned = named(lambda r: asserts(r) & ~concern(r)), named(lambda r: asserts(r) & concern(r))
    silent = named(lambda r: ~asserts(r))
    kind_at = lambda n: kind_of_notice(F.get(F.filter(F.col("records"), lambda r: r["source"] == n), F.lit(0)))
    detail = lambda names: F.when(F.size(names) == 1, kind_at(names[0])).otherwise(
        F.array_join(F.transform(names, lambda n: F.concat(n, F.lit("="), kind_at(n))), "; ")
    )
    said = lambda names: F.array_join(names, ", ")
    blind = ordered_sources(F.filter(unreachable, lambda u: ~u.isin(NO_RETRACTION_SIGNAL)))
    against = F.when(F.size(silent) > 0, F.concat(F.lit("; "), said(silent), F.lit(" answered without one"))).otherwise("")
    return F.array(
        F.when(F.size(retracting) > 0, issue("status", "retracted", "error", None, detail(retracting), F.array_join(retracting, ","), F.concat(F.lit("retraction recorded by "), said(retracting), against))),
        F.when(F.size(concerned) > 0, issue("status", CONCERN.replace(" ", "-"), "error", None, detail(concerned), F.array_join(concerned, ","), F.concat(F.lit("doubt, not retraction: concern recorded by "), said(concerned)))),
        F.when((F.size(retracting) == 0) & (F.size(blind) > 0), issue("status", "retraction-unverified", "info", None, None, F.array_join(blind, ","), F.concat(said(blind), F.lit(" could not be asked whether the work was retracted")))),
    )


def verdict(issues: Column, suppressed: Column, authors_ok: Column) -> Column:
    """The first of the verdicts, worst first, that the issues give."""
    some = lambda test: F.exists(issues, test)
    error = lambda kind: some(lambda i: (i["severity"] == "error") & (i["kind"] == kind))
    return (
        F.when(error("retracted"), "RETRACTED")
        .when(error("unresolved") | error("malformed"), "BAD-ID")
        .when(error("absent"), "UNCONFIRMED")
        .when(error("wrong-work") & ~authors_ok, "WRONG-WORK")
        .when(some(lambda i: i["severity"] == "error"), "FIELD-MISMATCH")
        .when(some(lambda i: i["kind"] == "disputed"), "DISPUTED")
        .when(some(lambda i: i["severity"] == "warning"), "INCOMPLETE")
        .when(F.exists(suppressed, lambda i: i["kind"] != ARTIFACT), "ADJUDICATED")
        .when(F.size(suppressed) > 0, "REGISTRY-ARTIFACT")
        .when(some(lambda i: i["kind"] == "drift"), "TITLE-DRIFT")
        .when(some(lambda i: i["kind"] == "cosmetic"), "COSMETIC")
        .otherwise("OK")
    )


def _no_record(unreachable: Column) -> Column:
    """The one issue of a reference without records."""
    down = F.exists(unreachable, lambda u: ~u.isin(NO_RESOLUTION_SIGNAL))
    identified = F.coalesce(F.col("identifier"), F.lit("")) != ""
    field = F.when(F.coalesce(F.col("doi"), F.lit("")) != "", "doi").otherwise("identifier")
    rejected = F.when(F.col("explanation").isNotNull(), F.concat(F.lit("no confident match: "), F.col("explanation")))
    of = lambda kind, severity, why: issue(field, kind, severity, F.col("identifier"), None, None, F.coalesce(rejected, F.lit(why)))
    # candidates were found wanting: that some registry was down elsewhere is no excuse
    searched = F.col("explanation").isNotNull()
    return (
        F.when(F.col("route") == "malformed-isbn", issue("isbn", "malformed", "error", F.col("identifier"), None, None, "the ISBN's check digit is wrong, so no registry was asked"))
        .when(down & ~searched, of("unreachable", "info", "no registry could be reached"))
        .when(identified & (F.size("asked") == 0), of("not-asked", "info", "no registry was asked for this identifier"))
        .when(identified, of("unresolved", "error", "no registry that was asked has it"))
        .otherwise(issue("identifier", "absent", "error", None, None, None, F.coalesce(rejected, F.lit("no identifier, and no registry record that surely is this work"))))
    )


def compared(rows: DataFrame, unreachable: list[str] = (), limits: Thresholds = Thresholds()) -> DataFrame:
    """rows with issues, suppressed, authors_ok, title_similarity, consulted and verdict.

    Optional columns: ``failed``, registries that were down for this reference alone, and
    ``explanation``, why a search confirmed no candidate.
    """
    none = F.array().cast("array<string>")
    for name, default in (("failed", none), ("explanation", F.lit(None).cast("string"))):
        if name not in rows.columns:
            rows = rows.withColumn(name, default)
    down = F.concat(F.array(*map(F.lit, sorted(unreachable))) if unreachable else none, F.coalesce("failed", none))
    ready = rows.withColumns({"down": F.array_distinct(down), "own_doi": normalize_doi(F.col("doi")), "registry_doi": normalize_doi(F.col("primary.doi"))})
    ready = prepared(ready)
    found = F.concat(
        F.array(_title(limits)), _authors(),
        F.array(_year(), *(_scalar(f) for f in ("container", "volume", "issue")), _pages(), _scalar("publisher"), _kind(), _doi()),
        _status(F.col("down")),
    )
    every = F.when(F.col("primary").isNull(), F.array(_no_record(F.col("down")))).otherwise(F.filter(found, lambda i: i.isNotNull()))
    ok = (F.size("authors") > 0) & (F.size("listed") > 0) & (F.size("diff.mismatches") == 0) & ~F.col("diff.count_differs")
    present = F.transform("records", lambda r: r["source"])
    helpers = [c for c in ready.columns if c not in rows.columns]
    out = settled(
        ready,
        {
            "every": every, "authors_ok": F.coalesce(ok, F.lit(False)), "consulted": consultations(present, F.col("asked"), F.col("down")),
            "title_similarity": F.when((_shown("own", "title") != "") & (F.col("best_title") != ""), F.col("best_score")),
        }
    )
    out = settled(
        out,
        {
            "issues": F.filter("every", lambda i: i["kind"] != ARTIFACT),
            "suppressed": F.filter("every", lambda i: i["kind"] == ARTIFACT),
        }
    )
    unchecked = F.exists("issues", lambda i: i["kind"].isin("unreachable", "not-asked"))
    return out.withColumn(
        "verdict", F.when(unchecked, "UNCHECKED").otherwise(verdict(F.col("issues"), F.col("suppressed"), F.col("authors_ok")))
    ).drop("every", *helpers)
