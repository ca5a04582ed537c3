"""Declared constraints as data checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from contrail.schemas import Table


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _columns_failing(df: DataFrame, table: str, tests: dict[tuple[str, str], Column]) -> DataFrame:
    """One scan: rows checked and rows failing per (rule, column)."""
    names = {f"_{number}": key for number, key in enumerate(tests)}
    counts = [F.count(F.when(tests[key], 1)).alias(name) for name, key in names.items()]
    totals = df.agg(F.count(F.lit(1)).alias("_rows"), *counts)
    cases = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(column).alias("column"), F.col(name).alias("failed"))
            for name, (rule, column) in names.items()
        ]
    )
    return totals.select(F.col("_rows").alias("checked"), F.explode(cases).alias("c")).select(
        "c.rule", F.lit(table).alias("table"), "c.column", "checked", "c.failed"
    )


_INTEGER_LIMITS = {"smallint": 1 << 15, "int": 1 << 31}


def fit_type(name: str, kind: str) -> Column:
    """The text as its declared type, or null where it does not fit.

    Short integers are read as long ones and compared with their range, as a
    failing narrow cast costs far more.
    """
    if kind not in _INTEGER_LIMITS:
        return F.col(name).try_cast(kind)
    limit, value = _INTEGER_LIMITS[kind], F.col(name).try_cast("bigint")
    return F.when(value.between(-limit, limit - 1), value).cast(kind)


def typed_load(raw: DataFrame, table: Table) -> tuple[DataFrame, DataFrame]:
    """Cast text to the declared types: (typed rows, rejected values).

    A value that does not fit becomes null in the typed rows and one reject row
    (key, column, value).
    """
    present = [c for c in table.columns if c.name in raw.columns]
    typed = [fit_type(c.name, c.type).alias(c.name) for c in present]
    unfit = [
        F.when(
            F.col(c.name).isNotNull() & fit_type(c.name, c.type).isNull(),
            F.struct(F.lit(c.name).alias("column"), F.col(c.name).alias("value")),
        )
        for c in present
        if c.type != "string"
    ]
    rejects = (
        raw.select(F.col(table.key).alias("row_key"), F.explode(F.array(*unfit)).alias("b"))
        .filter("b IS NOT NULL")
        .select("row_key", "b.*")
    )
    return raw.select(typed), rejects


def rules(df: DataFrame, table: Table, kinds: tuple[str, ...]) -> dict[tuple[str, str], Column]:
    """The row-wise rules of a table that ``df`` has the columns for, by (rule, column)."""
    held = [c for c in table.columns if c.name in df.columns]
    tests = {}
    if "type" in kinds:
        tests |= {
            ("type", c.name): F.col(c.name).isNotNull() & fit_type(c.name, c.type).isNull()
            for c in held
            if c.type != "string"
        }
    if "length" in kinds:
        tests |= {("length", c.name): F.length(F.col(c.name)) > c.length for c in held if c.length}
    if "not_null" in kinds:
        tests |= {("not_null", c.name): F.col(c.name).isNull() for c in held if c.required}
    if "enum" in kinds:
        tests |= {("enum", name): ~F.col(name).isin(values) for name, values in table.enums.items()}
    return tests


def checks(df: DataFrame, table: Table, *kinds: str) -> DataFrame:
    """Type, length, not-null and enum rules of one table, counted together in one scan."""
    return _columns_failing(df, table.name, rules(df, table, kinds))


def too_long(df: DataFrame, table: Table) -> DataFrame:
    return checks(df, table, "length")


def missing(df: DataFrame, table: Table) -> DataFrame:
    return checks(df, table, "not_null")


def outside_enum(df: DataFrame, table: Table) -> DataFrame:
    return checks(df, table, "enum")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def key_report(df: DataFrame, table: Table) -> DataFrame:
    """Rows beyond the first of each key."""
    per_key = df.groupBy(table.key).agg(F.count(F.lit(1)).alias("n"))
    return per_key.select(
        F.lit("primary_key").alias("rule"),
        F.lit(table.name).alias("table"),
        F.lit(table.key).alias("column"),
        "n",
    ).groupBy("rule", "table", "column").agg(
        F.sum("n").alias("checked"), F.sum(F.col("n") - 1).alias("failed")
    )


def orphans(df: DataFrame, table: Table, parents: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: rows whose value has no parent, and how many distinct values.

    One pass over the child for all its keys. Child rows are counted per value before
    the shuffle, so a value that a third of the rows share costs one row; a parent
    key that repeats counts once.
    """
    columns = list(table.parents)
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns]
    )
    values = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.v").agg(F.count(F.lit(1)).alias("n"))
    used: dict[tuple[str, str], list[str]] = {}
    for column, parent in table.parents.items():
        used.setdefault(parent, []).append(column)
    known = _union(
        [
            parents[parent].select(
                F.explode(F.array(*[F.lit(c) for c in of])).alias("column"),
                F.col(key).cast("string").alias("v"),
            )
            for (parent, key), of in used.items()
        ]
    ).distinct()
    lost = F.col("v").isNotNull() & F.col("known").isNull()
    joined = values.join(known.withColumn("known", F.lit(True)), ["column", "v"], "left")
    counted = joined.groupBy("column").agg(
        F.sum("n").alias("checked"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("failed"),
        F.count(F.when(lost, 1)).alias("failed_values"),
    )
    return counted.select(
        F.lit("foreign_key").alias("rule"), F.lit(table.name).alias("table"), "column", "checked", "failed", "failed_values"
    )


def load_report(raw: DataFrame, table: Table) -> DataFrame:
    return checks(raw, table, "type")


def report(parts: list[DataFrame]) -> DataFrame:
    """All rule results in one table: rule, table, column, checked, failed."""
    return _union([p.select("rule", "table", "column", "checked", "failed") for p in parts])
