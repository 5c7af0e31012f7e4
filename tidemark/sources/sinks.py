"""Sinks (S20, S21, P01, U07): tables as CSV with every cell quoted, and as JSON text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def united(*tables: DataFrame) -> DataFrame:
    """Columns in order of first sight; missing cells are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def project(rows: DataFrame, columns: list[tuple[str, str | Column]]) -> DataFrame:
    """(label, column or expression) pairs."""
    return rows.select(*[(F.col(c) if isinstance(c, str) else c).alias(label) for label, c in columns])


def _cells(rows: DataFrame) -> list[Column]:
    nested = ("array", "struct", "map", "variant")
    return [F.coalesce(F.to_json(c) if t.startswith(nested) else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c, t in rows.dtypes]


def csv_lines(rows: DataFrame) -> DataFrame:
    """The lines of a CSV file as rows, without the header."""
    quoted = [F.concat(F.lit('"'), F.replace(F.col(f"`{c}`"), F.lit('"'), F.lit('""')), F.lit('"')) for c in rows.columns]
    return rows.select(*_cells(rows)).select(F.concat_ws(",", *quoted).alias("line"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.select(*_cells(rows)).write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("emptyValue", "").csv(path)


def json_text(rows: DataFrame, column: str = "json") -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns), {"pretty": "true"}).alias(column))
