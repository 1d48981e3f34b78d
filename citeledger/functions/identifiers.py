"""Identifiers, years, pages and kinds as native columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeledger.functions.text import clean, clean_text, fold, let
from citeledger.schema import KINDS

_WRAPPED, _ENDING = re.compile(r"(?i)^[(\[{<\"']*(https?://(dx\.)?doi\.org/|doi:\s*)?"), re.compile(r"[.,;:'\"\]}>]+$")
DOI = r"(?i)10\.\d{4,9}/[^\s\"<>]+"


def _without_surplus(bare: Column) -> Column:
    """A DOI without closing brackets at its end that nothing opens."""
    closing = F.length(F.regexp_extract(bare, r"(\)*)$", 1))
    surplus = F.length(F.translate(bare, "(", "")) - F.length(F.translate(bare, ")", ""))
    cut = F.greatest(F.lit(0), F.least(closing, surplus))
    return F.lower(F.substring(bare, F.lit(1), F.length(bare) - cut))


def doi_of(text: Column) -> Column:
    """normalize_doi of text that is clean."""
    bare = F.regexp_replace(F.trim(text), r"(?i)^[(\[{<\"']*(https?://(dx\.)?doi\.org/|doi:\s*)?", "")
    return let(F.regexp_replace(F.trim(bare), r"[.,;:'\"\]}>]+$", ""), _without_surplus)


def normalize_doi(value: Column) -> Column:
    """Lower-case DOI without resolver, wrapping and unbalanced brackets; '' for none."""
    return doi_of(clean(value))


def doi_text(value: str | None) -> str:
    """normalize_doi of one Python string, for parsers."""
    bare = _ENDING.sub("", _WRAPPED.sub("", clean_text(value)).strip())
    closing = len(bare) - len(bare.rstrip(")"))
    cut = max(0, min(closing, bare.count(")") - bare.count("(")))
    return bare[: len(bare) - cut].lower()


def extract_dois(text: Column) -> Column:
    """The distinct DOIs of a text in order."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(DOI), F.lit(0)), doi_of)
    return F.array_distinct(F.filter(found, lambda d: d != ""))


def parse_year(value: Column) -> Column:
    return F.regexp_extract(clean(value), r"(1[5-9]\d\d|20\d\d)", 1).try_cast("int")


def page_of(text: Column) -> Column:
    """first_page of text that is clean."""
    return F.lower(F.regexp_replace(F.regexp_extract(text, r"^\s*[A-Za-z]?\d+", 0), r"^\s*([A-Za-z]?)0*(?=\d)", "$1"))


def first_page(value: Column) -> Column:
    """Opening page without leading zeros, a letter before it kept; '' for none."""
    return page_of(clean(value))


def article_number_of(text: Column) -> Column:
    """is_article_number of text that is clean."""
    enough = lambda page: (page != "") & (F.length(page) >= F.when(page.rlike(r"^\d+$"), 6).otherwise(4))
    return ~F.contains(text, F.lit("-")) & let(page_of(text), enough)


def is_article_number(value: Column) -> Column:
    return let(clean(value), article_number_of)


def kind_of(key: Column) -> Column:
    """normalize_kind of a comparison key."""
    table = F.create_map(*(F.lit(x) for pair in KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, F.replace(key, F.lit(" "), F.lit("-"))), F.lit("other"))


def normalize_kind(value: Column) -> Column:
    return kind_of(fold(value))


def _weighted(text: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        digit = F.substring(text, i + 1, 1)
        total = total + F.when(digit == "X", 10).otherwise(digit.try_cast("int")) * w
    return total


def isbn_text(value: Column) -> Column:
    return F.upper(F.regexp_replace(clean(value), r"[\s-]+", ""))


def valid_isbn10(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{9}[\dX]$") & (_weighted(text, list(range(10, 0, -1))) % 11 == 0), F.lit(False))


def valid_isbn13(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^\d{13}$") & (_weighted(text, [1, 3] * 6 + [1]) % 10 == 0), F.lit(False))


def _isbn13_of(text: Column) -> Column:
    body = F.concat(F.lit("978"), F.substring(text, 1, 9))
    check = let(body, lambda b: F.concat(b, F.pmod(-_weighted(b, [1, 3] * 6), F.lit(10)).cast("string")))
    return F.when(valid_isbn13(text), text).when(valid_isbn10(text), check)


def normalize_isbn13(value: Column) -> Column:
    """The ISBN-13 of a valid ISBN, else null."""
    return let(isbn_text(value), _isbn13_of)


def strongest_identifier(doi: Column, pmid: Column, arxiv: Column, isbn: Column) -> Column:
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (doi, pmid, arxiv, isbn)))
