"""Key, mandatory-column and reference checks on the star tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DIMENSIONS, NOT_NULL, REFERENCES, UNIQUE


class IntegrityError(ValueError):
    """A table breaks one of its declared rules."""


def check_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with the number of copies. NULL keys never clash."""
    return (
        df.filter(_present(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))
        .filter(F.col("copies") > 1)
    )


def check_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns holding NULL, with the number of rows; one pass for all columns."""
    counts = [F.expr(f"count_if({c} IS NULL)").alias(c) for c in columns]
    return df.agg(*counts).unpivot([], list(columns), "column_name", "violations").filter("violations > 0")


def check_fk(child: DataFrame, column: str, parent: DataFrame, key: str | None = None) -> DataFrame:
    """Values of ``child.column`` missing from ``parent``, with their rows. NULL refers to nothing.

    Values are counted before the anti join, so it sees each once however often it is used.
    """
    used = (
        child.filter(F.col(column).isNotNull())
        .groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    )
    return used.join(parent.select(F.col(key or column).alias(column)), column, "left_anti")


def _present(columns: Sequence[str]) -> Column:
    return F.expr(" AND ".join(f"{c} IS NOT NULL" for c in columns))


def _and(template: str, columns: Sequence[str]) -> str:
    return " AND ".join(template.format(c) for c in columns)


def _union(parts: Sequence[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def _pairs(pairs: Mapping[str, str]) -> str:
    """``stack`` arguments for (text, expression) pairs."""
    return ", ".join([str(len(pairs)), *(f"'{text}', {expr}" for text, expr in pairs.items())])


def _unique_sql(name: str, keys: Sequence[str]) -> str:
    cols = ", ".join(keys)
    return f"""
      SELECT '{name}' AS table_name, 'unique({cols})' AS rule, count(*) AS checked, count_if(n > 1) AS violations
      FROM (SELECT count(*) AS n FROM {{{name}}} WHERE {_and("{} IS NOT NULL", keys)} GROUP BY {cols})"""


def _not_null_sql(name: str, columns: Sequence[str]) -> str:
    counts = ", ".join(f"count_if({c} IS NULL) AS {c}" for c in columns)
    return f"""
      SELECT table_name, rule, checked, violations FROM (
        SELECT '{name}' AS table_name, checked,
               stack({_pairs({f"not null({c})": c for c in columns})}) AS (rule, violations)
        FROM (SELECT count(*) AS checked, {counts} FROM {{{name}}}))"""


def _dimension_unique_sql(names: Sequence[str]) -> str:
    """Unique keys of all dimensions in one aggregation, a key being written as one text."""
    def keys(name: str) -> dict[str, str]:
        return {
            f"unique({', '.join(k)})":
                f"CASE WHEN {_and('{} IS NOT NULL', k)} THEN concat_ws('\\u0001', {', '.join(k)}) END"
            for k in UNIQUE[name]
        }

    values = _union([
        f"SELECT '{n}' AS table_name, stack({_pairs(keys(n))}) AS (rule, key) FROM {{{n}}}" for n in names
    ])
    return f"""
      SELECT table_name, rule, count(*) AS checked, count_if(n > 1) AS violations
      FROM (SELECT table_name, rule, key, count(*) AS n FROM ({values})
            WHERE key IS NOT NULL GROUP BY table_name, rule, key)
      GROUP BY table_name, rule"""


def _dimension_not_null_sql(names: Sequence[str]) -> str:
    """Mandatory columns of all dimensions in one aggregation."""
    values = _union([
        f"""SELECT '{n}' AS table_name,
                   stack({_pairs({f"not null({c})": f"{c} IS NULL" for c in NOT_NULL[n]})}) AS (rule, missing)
            FROM {{{n}}}"""
        for n in names
    ])
    return f"""
      SELECT table_name, rule, count(*) AS checked, count_if(missing) AS violations
      FROM ({values}) GROUP BY table_name, rule"""


def _references_sql(children: Mapping[str, Mapping[str, str]]) -> str:
    """All references at once. Combinations of a table's reference columns are counted first, from
    one scan; there are far fewer of them than rows, and only they become (rule, key) pairs."""
    used = _union([
        f"""SELECT '{n}' AS table_name, uses,
                   stack({_pairs({f"references({c})": f"cast({c} AS string)" for c in refs})}) AS (rule, key)
            FROM (SELECT {", ".join(refs)}, count(*) AS uses FROM {{{n}}} GROUP BY {", ".join(refs)})"""
        for n, refs in children.items()
    ])
    known = _union([
        f"SELECT '{n}' AS table_name, 'references({c})' AS rule, cast({c} AS string) AS key FROM {{{parent}}}"
        for n, refs in children.items() for c, parent in refs.items()
    ])
    return f"""
      SELECT table_name, rule, sum(uses) AS checked, sum(if(found, 0, uses)) AS violations
      FROM (SELECT table_name, rule, key, sum(uses) AS uses FROM ({used})
            WHERE key IS NOT NULL GROUP BY table_name, rule, key)
      LEFT JOIN (SELECT DISTINCT *, true AS found FROM ({known})) USING (table_name, rule, key)
      GROUP BY table_name, rule"""


#: What a writer counted while it wrote a table: rule -> (checked, violations).
Counted = Mapping[str, tuple[int, int]]


def unique_rule(keys: Sequence[str]) -> str:
    return f"unique({', '.join(keys)})"


def not_null_rule(column: str) -> str:
    return f"not null({column})"


def _counted_sql(name: str, counted: Counted) -> str:
    rows = ", ".join(f"('{name}', '{rule}', {checked}L, {bad}L)" for rule, (checked, bad) in counted.items())
    return f"SELECT * FROM VALUES {rows} AS t(table_name, rule, checked, violations)"


def integrity_report(tables: Mapping[str, DataFrame], counted: Mapping[str, Counted] | None = None) -> DataFrame:
    """One row per declared rule of the given tables: what was checked and what breaks it.

    Unique keys and mandatory columns of the tables in ``counted`` were checked while they were
    written; those counts are reported as they are, and only references are looked up.
    """
    counted = counted or {}
    small = [n for n in tables if n in DIMENSIONS]
    parts = [_dimension_unique_sql(small), _dimension_not_null_sql(small)] if small else []
    for name in tables:
        if name in counted:
            parts.append(_counted_sql(name, counted[name]))
        elif name not in small:
            parts += [_unique_sql(name, keys) for keys in UNIQUE[name]]
            parts.append(_not_null_sql(name, NOT_NULL[name]))
    children = {n: REFERENCES[n] for n in tables if n in REFERENCES}
    if children:
        parts.append(_references_sql(children))
    spark = next(iter(tables.values())).sparkSession
    return spark.sql(_union(parts), **tables)


def assert_integrity(tables: Mapping[str, DataFrame], counted: Mapping[str, Counted] | None = None) -> None:
    """Raise if any rule is broken. Collects broken rules only, at most one row per rule."""
    broken = integrity_report(tables, counted).filter("violations > 0").collect()
    if broken:
        lines = [f"{r.table_name}: {r.rule} broken by {r.violations} of {r.checked}" for r in broken]
        raise IntegrityError("; ".join(sorted(lines)))
