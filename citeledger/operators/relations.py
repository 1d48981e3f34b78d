"""Relational operators around the comparison: dedup, rules, citekeys, trees, pivots."""

from __future__ import annotations

import fnmatch

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeledger.operators.compare import verdict
from citeledger.schema import SUPPRESSED
from citeledger.scratch import keep


def richest(rows: DataFrame, key: str, richness: Column, pos: str = "pos") -> DataFrame:
    """The richest row of each key, at the position of the key's first; rows without a key all stay."""
    by_key = Window.partitionBy(key)
    known = F.coalesce(F.col(key).cast("string"), F.lit("")) != ""
    keyed = (
        rows.where(known)
        .withColumn("first_pos", F.min(pos).over(by_key))
        .withColumn("nth", F.row_number().over(by_key.orderBy(richness.desc(), pos)))
        .where("nth = 1").drop("nth")
    )
    loose = rows.where(~known).withColumn("first_pos", F.col(pos))
    return keyed.unionByName(loose)


def duplicate_members(rows: DataFrame, key: Column, member: str) -> DataFrame:
    """(value, member, n): the rows of values of key that several rows share.

    Counts come from a partial aggregation and are joined back, so a value that many rows share
    is no row of its own and its join can be split.
    """
    found = rows.withColumn("value", key).where("value is not null and value <> ''").select("value", F.col(member).alias("member"))
    return found.join(found.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value")


def duplicates(rows: DataFrame, key: Column, member: str, shown: int = 20) -> DataFrame:
    """(value, members, n): values of key that several rows share, their number and the first ``shown`` members."""
    found = rows.withColumn("value", key).where("value is not null and value <> ''")
    counts = found.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    first = (
        found.withColumn("nth", F.row_number().over(Window.partitionBy("value").orderBy(member))).where(F.col("nth") <= shown)
        .groupBy("value").agg(F.array_sort(F.collect_list(member)).alias("members"))
    )
    return counts.join(first, "value").select("value", "members", "n")


def indel_at_least(a: str, b: str, percent: float) -> bool:
    """Whether 200 * LCS / (len a + len b) reaches percent, by a bit-parallel LCS."""
    total = len(a) + len(b)
    if not total:
        return False
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return 200 * (len(a) - v.bit_count()) >= percent * total


def fuzzy_duplicates(titles: DataFrame, percent: float = 95.0, gram: int = 4) -> DataFrame:
    """(a, b): pairs of different titles (key, title_key) whose indel ratio reaches percent, by their least keys.

    Equal titles are one: ``duplicates`` has those.  A pair that reaches percent differs by few
    edits, and an edit touches at most ``gram`` of a title's runs of that many characters.  So of
    each title's runs, rarest first, one more than edits can touch are looked up: every pair
    shares one of them, and common runs bring nobody together.
    """
    low = percent / 100
    one = titles.where("title_key <> ''").groupBy("title_key").agg(F.min("key").alias("key"))
    # the other title is at most (2 - low) / low times as long
    edits = F.floor(F.length("title_key") * ((1 - low) * (1 + (2 - low) / low)) + F.lit(1e-9))
    runs = F.when(F.length("title_key") < gram, F.array("title_key")).otherwise(
        F.array_distinct(
            F.transform(F.sequence(F.lit(1), F.length("title_key") - gram + 1), lambda i: F.substring(F.col("title_key"), i, F.lit(gram)))
        )
    )
    held = one.select("key", "title_key", (edits * gram + 1).cast("int").alias("most"), F.explode(runs).alias("run"))
    rare = held.groupBy("run").agg(F.count("*").alias("held"))
    looked_up = (
        held.join(rare, "run").groupBy("key", "title_key", "most").agg(F.array_sort(F.collect_list(F.struct("held", "run"))).alias("runs"))
        .select("key", "title_key", F.explode(F.slice("runs", F.lit(1), F.col("most"))).alias("r"))
        .where("r.held > 1").select("key", "title_key", "r.run")
    )
    side = lambda n: looked_up.select(F.col("key").alias(n), F.col("title_key").alias(f"t{n}"), "run")
    short, long = (f(F.length("ta"), F.length("tb")) for f in (F.least, F.greatest))
    pairs = side("a").join(side("b"), "run").where((F.col("a") < F.col("b")) & (2 * short >= low * (short + long))).select("a", "b", "ta", "tb").distinct()

    @F.arrow_udf("boolean")
    def near(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([indel_at_least(x, y, percent) for x, y in zip(left.to_pylist(), right.to_pylist(), strict=True)])

    return pairs.where(near("ta", "tb")).select("a", "b")


def _glob(c: Column, pattern: str) -> Column:
    return c.rlike("^" + fnmatch.translate(pattern).replace("\\Z", "").replace("\\z", "") + "$")


def _rule_of(i: Column, rules: list[tuple[str, str, str, str]]) -> Column:
    """Index of the first rule that an issue matches, or null."""
    out = F.lit(None).cast("int")
    for nth, (key, field, kind, _) in reversed(list(enumerate(rules))):
        out = F.when(_glob(F.col("key"), key) & _glob(i["field"], field) & _glob(i["kind"], kind), nth).otherwise(out)
    return out


def suppressed_by(results: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """results with the issues that a rule (key, field, kind, reason) matches moved to suppressed, and used_rules.

    Patterns are case-sensitive shell globs; the first rule that matches an issue counts.
    The rules are a literal in the plan: no join, no regrouping.
    """
    if not rules:
        return results.withColumn("used_rules", F.array().cast("array<int>"))
    ruled = results.withColumn("ruled", F.transform("issues", lambda i: F.struct(i.alias("issue"), _rule_of(i, rules).alias("rule"))))
    reasons = F.array(*(F.lit(why) for *_, why in rules))
    moved = F.transform(
        F.filter("ruled", lambda r: r["rule"].isNotNull()),
        lambda r: r["issue"].withField("severity", F.lit("info")).withField("kind", F.concat(F.lit(SUPPRESSED), r["issue"]["kind"]))
        .withField("note", F.concat_ws(" — ", F.nullif(r["issue"]["note"], F.lit("")), F.get(reasons, r["rule"]))),
    )
    out = ruled.withColumns(
        {
            "suppressed": F.concat("suppressed", moved), "issues": F.transform(F.filter("ruled", lambda r: r["rule"].isNull()), lambda r: r["issue"]),
            "used_rules": F.array_sort(F.array_distinct(F.array_compact(F.transform("ruled", lambda r: r["rule"])))),
        }
    )
    # only a result that lost an issue is judged again; what was retracted, or another work, stays so
    again = verdict(F.col("issues"), F.col("suppressed"), F.col("verdict") != "WRONG-WORK")
    judged = F.when(F.size("used_rules") == 0, F.col("verdict")).when(F.col("verdict") == "RETRACTED", "RETRACTED").otherwise(again)
    return out.withColumn("verdict", judged).drop("ruled")


def unused_rules(results: DataFrame, rules: list[tuple[str, str, str, str]]) -> DataFrame:
    """(idx, key, field, kind, reason): rules that moved no issue of results."""
    table = results.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rules)], "idx int, key string, field string, kind string, reason string")
    used = results.select(F.explode("used_rules").alias("idx")).distinct()
    return table.join(used, "idx", "left_anti")


#: A key begins a text or line or follows a blank, a bracket, a comma, a semicolon or a minus.
KEY = r"(?m)(?<![^\s\[{;,(-])@([A-Za-z]\w*(?:[-:.#$%&+?<>~/]+\w+)*)"
CROSS_REFERENCES = "fig tbl sec eq lst thm def exm exr cor lem prp cnj".split()


def citekeys(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with one row for each citation key (@key); cross-references are none."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(KEY), F.lit(1))
    plain = F.filter(found, lambda k: ~k.rlike("^(" + "|".join(CROSS_REFERENCES) + ")-"))
    return texts.withColumn("citekey", F.explode(plain))


def citekey_index(found: DataFrame, where: list[str]) -> DataFrame:
    """(citekey, locators): the places of each key, in order."""
    return found.groupBy("citekey").agg(F.array_sort(F.collect_list(F.struct(*where))).alias("locators"))


def descendants(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node, depth): what roots reach along edges (parent, child); a cycle ends where it closes."""
    reached = roots.select(F.col("node").alias("root"), "node", F.lit(0).alias("depth"))
    every, frontier, depth = reached, reached, 0
    while not frontier.isEmpty():
        depth += 1
        step = frontier.join(edges, F.col("node") == F.col("parent")).select("root", F.col("child").alias("node")).distinct()
        frontier = keep(step.join(every.select("root", "node"), ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)), "frontier")
        every = every.unionByName(frontier)
    return every


def pivoted(facts: DataFrame, entity: str, name: str, value: str, order: str | None = None) -> DataFrame:
    """(entity, map): attribute rows as one map; of several values of a name the last by ``order``, else the greatest."""
    last = F.max_by(value, F.struct(order, value)) if order else F.max(value)
    one = facts.where(F.col(name).isNotNull()).groupBy(entity, name).agg(last.alias(value))
    return one.groupBy(entity).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(name, value)))).alias("attributes"))


def ordered_rows(rows: DataFrame, key: str, order: str, fields: list[str], name: str) -> DataFrame:
    """(key, name): the rows of each key as an array of structs in order."""
    listed = F.array_sort(F.collect_list(F.struct(order, *fields)))
    return rows.groupBy(key).agg(listed.alias("listed")).select(
        key, F.transform("listed", lambda r: F.struct(*(r[f].alias(f) for f in fields))).alias(name)
    )


def counted(rows: DataFrame, value: Column, pos: str) -> DataFrame:
    """(value, n, first_pos): how often each value occurs, most first, of equal counts the first seen."""
    return rows.groupBy(value.alias("value")).agg(F.count("*").alias("n"), F.min(pos).alias("first_pos")).orderBy(F.desc("n"), "first_pos")
