"""Stored references and registry records derived from the driver tables, for queries and tests.

``part`` gives the published side; the stored side is the same with damage that depends on the
values of its columns, stated alike in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeledger.schema import NAME
from citeledger.scratch import load, spread

_PERSON = "named_struct('family', {f}, 'given', {g}, 'literal', '', 'collective', false, 'et_al', false)"
_YEARS = "array(named_struct('slot', 'print', 'year', int(1990 + p_size % 30)), named_struct('slot', 'online', 'year', int(1989 + p_size % 30)))"


def _people(*pairs: tuple[str, str]) -> str:
    return f"cast(array({', '.join(_PERSON.format(f=f, g=g) for f, g in pairs)}) as array<{NAME}>)"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The primary registry: all parts but those of size 19 (not found) and 23 (second registry)."""
    return spread(load(spark, sf_dir, "part")).where("p_size not in (19, 23)").transform(_records, "crossref")


def second(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(load(spark, sf_dir, "part")).where("p_size in (23, 29)").transform(_records, "datacite")


def medical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corroborator: sizes above 40, with the container spelt as the damage of size 43 has it."""
    return spread(load(spark, sf_dir, "part")).where("p_size > 40").transform(_records, "pubmed", "if(p_size = 43, 'Other Journal', p_brand)")


def _records(part: DataFrame, source: str, container: str = "p_brand") -> DataFrame:
    return part.selectExpr(
        "concat('10.1234/part.', p_partkey) key", "concat('10.1234/part.', p_partkey) identifier", f"'{source}' source",
        "concat('10.1234/part.', p_partkey) doi", "concat_ws(' ', p_name, p_type, p_partkey) title",
        f"{_people(('p_brand', chr(39) + 'A' + chr(39)), ('p_type', chr(39) + 'B' + chr(39)))} authors", f"{_YEARS} years",
        f"{container} container", "'' container_short", "array('') container_alternates", "cast(p_size as string) volume", "'' issue",
        "concat(p_partkey, '-', p_partkey + 9) pages", "'' publisher", "'journal-article' kind", "p_size = 31 retracted",
        "if(p_size = 31, 'retraction', null) retraction_kind",
    )


def stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References with damage by p_size: 3 upper-case title, 5 longer title, 7 year + 1, 11 no
    volume, 13 other year, 17 an author less, 37 other container, 43 the corroborator's container."""
    return spread(load(spark, sf_dir, "part")).selectExpr(
        "p_partkey pos", "concat('part', p_partkey) key", "'part.bib' locator", "'article' kind",
        "concat('https://doi.org/10.1234/PART.', p_partkey) doi", "'' pmid", "'' arxiv", "'' isbn",
        "case p_size when 3 then upper(concat_ws(' ', p_name, p_type, p_partkey)) when 5 then concat_ws(' ', p_name, p_type, p_partkey, 'Revised') "
        "else concat_ws(' ', p_name, p_type, p_partkey) end title",
        f"if(p_size = 17, {_people(('p_brand', chr(39) + 'A' + chr(39)))}, {_people(('p_brand', chr(39) + 'A' + chr(39)), ('p_type', chr(39) + 'B' + chr(39)))}) authors",
        "int(case p_size when 7 then 1989 + p_size % 30 when 13 then 1970 else 1990 + p_size % 30 end) year",
        "case when p_size = 37 then 'Annals of Nothing' when p_size = 43 then 'Other Journal' else p_brand end container",
        "if(p_size = 11, '', cast(p_size as string)) volume", "'' issue", "cast(p_partkey as string) pages", "'' publisher", "'' raw",
    )


