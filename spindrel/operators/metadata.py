"""Metadata of documents: rows keyed by position, filtered by SQL conditions.

Columns are inferred from the rows: names in the order they are first seen, a type from the first value that isn't null.
Whole numbers and booleans are BIGINT, other numbers DOUBLE, dates and times ISO text, columns without a value BINARY.
"""

from __future__ import annotations

import datetime
import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.ranks import renumbered

KEY = "_subset_"
NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def check_name(name: str) -> str:
    if not isinstance(name, str) or not NAME.fullmatch(name):
        raise ValueError(f"{name!r} is no column name: letters, digits and _ only, no digit first")
    return name


def _type_of(value) -> T.DataType:
    if isinstance(value, (bool, int)):
        return T.LongType()
    if isinstance(value, float):
        return T.DoubleType()
    if isinstance(value, (str, datetime.date, datetime.time)):
        return T.StringType()
    return T.BinaryType()


def _stored(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(value, (datetime.date, datetime.time)):
        value = value.isoformat()
    if isinstance(kind, T.LongType):
        return int(value)
    if isinstance(kind, T.DoubleType):
        return float(value)
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else str(value)
    return value if isinstance(value, (bytes, bytearray)) else str(value).encode()


def from_rows(spark: SparkSession, rows: Sequence[dict], first: int = 0, known: T.StructType | None = None) -> DataFrame:
    """Metadata of a list of dicts, numbered from ``first``; ``known`` columns keep their type. Missing keys are null."""
    names = list(dict.fromkeys(k for row in rows for k in row))
    types = {f.name: f.dataType for f in known or [] if f.name != KEY}
    for name in names:
        check_name(name)
        if name not in types or isinstance(types[name], T.BinaryType):
            types[name] = _type_of(next((row[name] for row in rows if row.get(name) is not None), None))
    schema = T.StructType([T.StructField(KEY, T.LongType(), False), *(T.StructField(n, types[n]) for n in names)])
    return spark.createDataFrame([(first + i, *(_stored(row.get(n), types[n]) for n in names)) for i, row in enumerate(rows)], schema)


def extended(current: DataFrame, rows: DataFrame) -> DataFrame:
    """``current`` with further rows; new columns are added, columns that ``rows`` lacks are null."""
    for name in rows.columns:
        check_name(name)
    empty = [c for c in current.columns if c in rows.columns and current.schema[c].dataType != rows.schema[c].dataType and isinstance(current.schema[c].dataType, T.BinaryType)]
    for c in empty:  # a column that had no value takes the type of its first one
        current = current.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
    return current.unionByName(rows, allowMissingColumns=True)


def next_key(current: DataFrame) -> int:
    """One after the largest key; 0 for no rows."""
    top = current.agg(F.max(KEY)).first()[0]
    return 0 if top is None else top + 1


def appended(current: DataFrame, rows: Sequence[dict] | DataFrame) -> DataFrame:
    """Rows at the end, numbered on from the largest key."""
    first = next_key(current)
    if isinstance(rows, DataFrame):
        fresh = renumbered(rows.withColumn(KEY, F.monotonically_increasing_id()), [KEY], KEY).withColumn(KEY, F.col(KEY) + first)
    else:
        fresh = from_rows(current.sparkSession, rows, first, current.schema)
    return extended(current, fresh)


def ids_of(subset: int | Iterable[int], ordered: bool = False) -> list[int]:
    """The ids of a subset: whole numbers; with ``ordered`` they must be in ascending order."""
    ids = [subset] if isinstance(subset, int) else list(subset)
    if any(isinstance(i, bool) or not isinstance(i, int) for i in ids):
        raise TypeError("ids must be whole numbers")
    if ordered and any(a > b for a, b in zip(ids, ids[1:])):
        raise ValueError("ids must be in ascending order")
    return ids


def id_frame(spark: SparkSession, ids: Sequence[int], name: str = KEY) -> DataFrame:
    return spark.createDataFrame([(i,) for i in dict.fromkeys(ids)], f"{name} long")


def deleted(current: DataFrame, subset: int | Iterable[int] | DataFrame) -> DataFrame:
    """The rows whose key isn't in the subset, numbered anew from 0 in their order. An empty subset changes nothing."""
    if not isinstance(subset, DataFrame):
        ids = ids_of(subset, ordered=True)
        if not ids:
            return current
        subset = id_frame(current.sparkSession, ids)
    return renumbered(current.join(subset, KEY, "left_anti"), [KEY], KEY)


def checked_condition(spark: SparkSession, condition: str) -> str:
    """A lone SQL expression in Spark's dialect: LIKE ignores the case of letters, as it does in SQLite; GLOB is refused."""
    bare = re.sub(r"'(?:[^']|'')*'", lambda m: "'" + " " * (len(m[0]) - 2) + "'", condition)
    if re.search(r"\bGLOB\b", bare, re.I):
        raise ValueError("GLOB isn't supported; use LIKE or RLIKE")
    for m in reversed(list(re.finditer(r"\bLIKE\b", bare, re.I))):
        condition = condition[: m.start()] + "ILIKE" + condition[m.end() :]
    parser = spark._jsparkSession.sessionState().sqlParser()
    try:
        parser.parseExpression(condition)
    except Exception as e:
        raise ValueError(f"{condition!r} is no lone SQL expression") from e
    return condition


def filtered(current: DataFrame, condition: str, parameters: Sequence = ()) -> DataFrame:
    """The rows for which a SQL condition with ``?`` for the parameters holds. Text is compared with text, numbers with numbers."""
    spark = current.sparkSession
    condition = checked_condition(spark, condition)
    view = f"metadata_{uuid.uuid4().hex}"
    current.createOrReplaceTempView(view)
    try:
        values = [p.isoformat() if isinstance(p, (datetime.date, datetime.time)) else p for p in parameters]
        return spark.sql(f"SELECT * FROM {view} WHERE {condition}", args=values or None)
    finally:
        spark.catalog.dropTempView(view)


def where(current: DataFrame, condition: str, parameters: Sequence = ()) -> DataFrame:
    """(_subset_) of the rows for which the condition holds, in order."""
    return filtered(current, condition, parameters).select(KEY).orderBy(KEY)


def get(current: DataFrame, condition: str | None = None, parameters: Sequence = (), subset: int | Iterable[int] | DataFrame | None = None) -> DataFrame:
    """Whole rows in order: those of a condition, or those of a subset (none for an empty one), or all."""
    if condition is not None and subset is not None:
        raise ValueError("give a condition or a subset, not both")
    if condition is not None:
        current = filtered(current, condition, parameters)
    elif subset is not None:
        frame = subset if isinstance(subset, DataFrame) else id_frame(current.sparkSession, ids_of(subset))
        current = current.join(frame, KEY, "left_semi")
    return current.orderBy(KEY)
