"""Integrity rules as data: what a table's constraints would reject, counted."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dq_violations(tables: dict[str, DataFrame], rules: list[tuple]) -> DataFrame:
    """table_name, rule, n for each (table, rule, kind, what).

    unique: what lists key columns; n keys stand more than once.  exists: what is (column, other table, its key);
    n rows refer to nothing.  holds: what is a condition; n rows break it.
    """
    parts = []
    for name, rule, kind, what in rules:
        df = tables[name]
        if kind == "unique":
            bad = df.groupBy(*what).agg(F.count("*").alias("_n")).where("_n > 1")
        elif kind == "exists":
            column, other, key = what
            bad = df.where(F.col(column).isNotNull()).join(other, F.col(column) == F.col(key), "left_anti")
        else:
            bad = df.where(~F.expr(what))
        parts.append(bad.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), F.lit(rule).alias("rule"), "n"))
    return reduce(DataFrame.unionByName, parts)
