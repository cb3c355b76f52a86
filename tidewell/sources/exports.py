"""Rows as text: cells as JSON values, CSV, INSERT statements, Markdown, columnar JSON.

The whole-table writers are column expressions, so they run on the executors and go to any text sink; those for
capped results work on the driver's few rows.
"""

from __future__ import annotations

import base64
import datetime
import decimal
import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(value):
    """A value as JSON: decimals as text, times in ISO form, bytes in base64, NaN and infinities as null."""
    if value is None or isinstance(value, bool | int | str):
        return value
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, decimal.Decimal):
        return str(value)
    if isinstance(value, datetime.datetime | datetime.date | datetime.time):
        return value.isoformat()
    if isinstance(value, bytes | bytearray):
        return base64.b64encode(bytes(value)).decode()
    if isinstance(value, dict):
        return {str(k): cell(v) for k, v in value.items()}
    if hasattr(value, "asDict"):
        return {k: cell(v) for k, v in value.asDict().items()}
    if isinstance(value, list | tuple):
        return [cell(v) for v in value]
    return str(value)


def columnar(columns: list[str], rows: list[list]) -> dict:
    """Columns that are null throughout are listed once instead of shown; without rows there are no columns."""
    if not rows:
        return {"columns": [], "rows": [], "allNullColumns": []}
    empty = [k for k in range(len(columns)) if all(r[k] is None for r in rows)]
    kept = [k for k in range(len(columns)) if k not in empty]
    return {"columns": [columns[k] for k in kept], "rows": [[r[k] for k in kept] for r in rows], "allNullColumns": [columns[k] for k in empty]}


def columnarize(value, keep: tuple[str, ...] = ()):
    """Every list of objects with the same keys, anywhere in a result, as columns and rows."""
    if isinstance(value, dict):
        return {k: v if k in keep else columnarize(v, keep) for k, v in value.items()}
    if isinstance(value, list):
        if len(value) > 1 and all(isinstance(x, dict) and x and x.keys() == value[0].keys() for x in value):
            names = list(value[0])
            return columnar(names, [[columnarize(x[n], keep) for n in names] for x in value])
        return [columnarize(x, keep) for x in value]
    return value


def markdown(columns: list[str], rows: list[list]) -> str:
    def one(v) -> str:
        text = "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        return text.replace("|", "\\|").replace("\n", " ")

    lines = ["| " + " | ".join(one(c) for c in columns) + " |", "| " + " | ".join("---" for _ in columns) + " |"]
    return "\n".join(lines + ["| " + " | ".join(one(v) for v in r) + " |" for r in rows])


def render(columns: list[str], rows: list[list], fmt: str) -> str:
    if fmt == "markdown":
        return markdown(columns, rows)
    if fmt == "json":
        return json.dumps([dict(zip(columns, r, strict=True)) for r in rows], ensure_ascii=False)
    if fmt == "csv":
        def one(v) -> str:
            text = "" if v is None else v if isinstance(v, str) else json.dumps(v)
            return '"' + text.replace('"', '""') + '"' if any(c in text for c in ',"\n') else text

        return "".join(line + "\n" for line in [",".join(f'"{c}"' for c in columns), *(",".join(map(one, r)) for r in rows)])
    return json.dumps(columnar(columns, rows), ensure_ascii=False)


def cap(text: str, limit: int) -> tuple[str, bool]:
    """At most ``limit`` bytes, cut between characters."""
    data = text.encode()
    return (text, False) if len(data) <= limit else (data[:limit].decode(errors="ignore"), True)


def as_text(df: DataFrame, name: str, col: Column | None = None) -> Column:
    """A column of df as text, or another column of its type."""
    kind = df.schema[name].dataType.typeName()
    col = F.col(f"`{name}`") if col is None else col
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(col, "yyyy-MM-dd'T'HH:mm:ss")
    if kind in ("array", "map", "struct"):
        return F.to_json(col)
    return F.base64(col) if kind == "binary" else col.cast("string")


def csv_lines(df: DataFrame) -> DataFrame:
    """line: one CSV line a row. A cell is quoted if it holds a comma, a line end or a quote; null is empty."""

    def one(name: str) -> Column:
        text = F.coalesce(as_text(df, name), F.lit(""))
        return F.when(text.rlike('[,"\\n\\r]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return df.select(F.concat_ws(",", *[one(c) for c in df.columns]).alias("line"))


def csv_header(df: DataFrame) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in df.columns)


def insert_lines(df: DataFrame, schema: str, table: str) -> DataFrame:
    """line: one INSERT statement a row; numbers and truth values bare, all else in single quotes."""

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def one(name: str) -> Column:
        kind = df.schema[name].dataType.typeName()
        text = as_text(df, name)
        if kind == "boolean":
            text = F.upper(text)
        elif kind not in ("byte", "short", "integer", "long", "float", "double", "decimal"):
            text = F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'"))
        return F.coalesce(text, F.lit("NULL"))

    head = f"INSERT INTO {quoted(schema)}.{quoted(table)} ({', '.join(map(quoted, df.columns))}) VALUES ("
    return df.select(F.concat(F.lit(head), F.concat_ws(", ", *[one(c) for c in df.columns]), F.lit(");")).alias("line"))


def insert_statements(columns: list[str], rows: list[list], schema: str, table: str) -> str:
    """INSERT statements of rows that are on the driver, written as ``insert_lines`` writes them."""

    def quoted(name: str) -> str:
        return '"' + name.replace('"', '""') + '"'

    def one(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    head = f"INSERT INTO {quoted(schema)}.{quoted(table)} ({', '.join(map(quoted, columns))}) VALUES ("
    return "\n".join(head + ", ".join(map(one, r)) + ");" for r in rows)


def markdown_lines(df: DataFrame) -> DataFrame:
    """line: one row of a pipe table; pipes are escaped, line ends become spaces."""

    def one(name: str) -> Column:
        text = F.coalesce(as_text(df, name), F.lit(""))
        return F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))

    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *[one(c) for c in df.columns]), F.lit(" |")).alias("line"))


def all_null_columns(df: DataFrame) -> DataFrame:
    """column: the columns without any value, found in one scan."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(df.columns)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"c{k}").alias("n")) for k, c in enumerate(df.columns)])).alias("x")).where("x.n = 0").select("x.column")
