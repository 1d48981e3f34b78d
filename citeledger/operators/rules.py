"""Known registry defects, as an ordered list of columns: the first that matches is the reason."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeledger.functions.identifiers import article_number_of


def shortened_title(stored_key: Column, registry_key: Column) -> Column:
    hit = (registry_key != "") & (stored_key != registry_key) & stored_key.startswith(F.concat(registry_key, F.lit(" ")))
    return F.when(hit, "registry stores a shortened title")


def once_only(registry: Column) -> Column:
    """A title without the second of two equal operator tokens."""
    return F.regexp_replace(registry, r"(?i)(\b\w{1,4}\([a-z]\))\1", "$1")


def without_parent(registry: Column) -> Column:
    return F.regexp_replace(registry, r"^\[[^\]]{10,}\]\s*[:.]?\s*", "")


def doubled_token(repaired_agrees: Column) -> Column:
    return F.when(repaired_agrees, "registry title repeats an operator token")


def bracketed_parent(repaired_agrees: Column) -> Column:
    return F.when(repaired_agrees, "registry prefixes the parent article's title")


def online_first(stored_year: Column, years: Column, registry_year: Column) -> Column:
    slot = F.get(F.filter(years, lambda y: y["year"] == stored_year), F.lit(0))["slot"]
    return F.when(slot.isNotNull(), F.concat(F.lit("cites the "), slot, F.lit(" date; registry prefers "), registry_year.cast("string")))


def deposit_stamp(stored_year: Column, registry_year: Column, years: Column) -> Column:
    in_print = F.exists(years, lambda y: y["slot"] == "print")
    return F.when(~in_print & (registry_year - stored_year >= 3), "registry date is a deposit stamp")


def article_number(stored: Column, registry: Column) -> Column:
    """Of display texts, neither empty."""
    return F.when(article_number_of(stored) != article_number_of(registry), "one side gives an article number")


def abbreviated_container(stored_key: Column, registry_key: Column, short_key: Column) -> Column:
    """Every stored word begins a registry word, in order, and the last one the last."""
    words = F.split(registry_key, " ")
    start = F.struct(F.lit(0).alias("at"), F.lit(True).alias("ok"))

    def step(state: Column, token: Column) -> Column:
        rest = F.slice(words, state["at"] + 1, F.size(words))
        near = F.array_position(F.transform(rest, lambda w: w.startswith(token)), F.lit(True)).cast("int")
        return F.struct((state["at"] + near).alias("at"), (state["ok"] & (near > 0)).alias("ok"))

    end = F.aggregate(F.split(stored_key, " "), start, step)
    by_words = (stored_key != "") & (registry_key != "") & end["ok"] & (end["at"] == F.size(words))
    return F.when((short_key != "") & (short_key == stored_key), "stored name is the journal's ISO abbreviation").when(
        by_words, "stored name abbreviates the registry name"
    )


def redirecting_doi(stored: Column) -> Column:
    return F.when(stored.startswith("10.2307/"), "aggregator DOI redirects to the publisher's own")
