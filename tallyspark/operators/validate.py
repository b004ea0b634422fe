"""Validation (F5) and data-quality audits (Q1-Q7).

The source system lets MySQL enforce keys, NOT NULL, VARCHAR lengths, the
ENUM domain and defaults at write time; parquet tables need them as jobs.
Every audit returns violating rows tagged with a rule name.  All declared keys
of all tables take one scan of each table and one partial aggregation
(``audit_keys``); not-null, length and domain rules are one scan each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

from tallyspark.schemas import RULES, TableRules


def missing(df: DataFrame, c: str) -> Column:
    """JavaScript falsiness for one column: NULL, '' (strings), 0 (numbers),
    false (booleans)."""
    t = df.schema[c].dataType
    col = F.col(c)
    if isinstance(t, StringType):
        return col.isNull() | (col == F.lit(""))
    if isinstance(t, NumericType):
        return col.isNull() | (col == F.lit(0))
    if isinstance(t, BooleanType):
        return col.isNull() | ~col
    return col.isNull()


def require(df: DataFrame, cols: list[str], reason_prefix: str = "Missing required fields: ") -> DataFrame:
    """add ``accepted`` and ``reason`` (the missing fields, in list order).
    Split with ``where('accepted')`` / ``where('NOT accepted')``."""
    flags = [F.when(missing(df, c), F.lit(c)) for c in cols]
    any_missing = reduce(lambda a, b: a | b, [missing(df, c) for c in cols])
    return df.withColumn("accepted", ~any_missing).withColumn(
        "reason", F.when(any_missing, F.concat(F.lit(reason_prefix), F.concat_ws(", ", *flags))))


def split_required(df: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    checked = require(df, cols)
    return checked.where("accepted").drop("accepted", "reason"), checked.where("NOT accepted").drop("accepted")


def _key_str(cols) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in cols])


def audit_unique(df: DataFrame, keys: list[str], table: str = "", collation: str | None = None,
                 rule: str = "unique") -> DataFrame:
    """Q1: key groups held by more than one row.  Rows with a NULL key part are
    exempt (SQL UNIQUE).  String keys compare under ``collation`` when given."""
    k = [F.collate(F.col(c), collation).alias(c) if collation and isinstance(df.schema[c].dataType, StringType)
         else F.col(c) for c in keys]
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in keys])
    g = df.where(not_null).groupBy(*k).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    return g.select(F.lit(table).alias("table_name"), F.lit(rule).alias("rule"),
                    _key_str(keys).alias("key"), "n")


def audit_table_unique(df: DataFrame, name: str, collation: str | None = "UNICODE_CI_AI") -> DataFrame:
    """Q1: every declared unique key of a known table; names compare under ``collation``."""
    parts = [audit_unique(df, list(k), name, collation) for k in RULES[name].unique]
    if not parts:
        raise ValueError(f"{name} has no unique key besides its primary key")
    return reduce(lambda a, b: a.unionByName(b), parts)


def audit_not_null(df: DataFrame, cols: list[str], key_cols: list[str], table: str = "") -> DataFrame:
    """Q3: one row per (violating row, column), all columns in one pass."""
    tags = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in cols]))
    return (df.select(_key_str(key_cols).alias("key"), F.explode(tags).alias("column_name"))
            .select(F.lit(table).alias("table_name"), F.lit("not_null").alias("rule"), "key", "column_name"))


def _key_rows(df: DataFrame, table: str, primary: list[str], unique: list[list[str]], collation: str | None) -> DataFrame:
    """(table_name, rule, hash, key, folded): a row for each declared key of each row, in one scan.

    A primary key compares exactly (by its hash and its text), a unique key with strings by its text under the
    collation.  A row with a NULL in a primary key gives a 'not_null' row instead; a NULL in a unique key exempts it."""
    name = collation or "UTF8_BINARY"

    def entry(rule: str, cols: list[str], fold: bool) -> Column:
        text = _key_str(cols)
        return F.struct(F.lit(rule).alias("rule"), (F.lit(0).cast("long") if fold else F.xxhash64(*cols)).alias("hash"), F.when(F.lit(not fold), text).alias("key"),
                        F.collate(F.when(F.lit(fold), text), name).alias("folded"))

    rows = []
    if primary:
        null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in primary])
        rows.append(F.when(null, entry("not_null", primary, False)).otherwise(entry("primary_key", primary, False)))
    for cols in unique:
        full = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
        fold = collation is not None and any(isinstance(df.schema[c].dataType, StringType) for c in cols)
        rows.append(F.when(full, entry("unique", list(cols), fold)))
    return df.select(F.lit(table).alias("table_name"), F.explode(F.array_compact(F.array(*rows))).alias("_k")).select("table_name", "_k.*")


def _key_faults(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("table_name", "rule", "hash", "key", "folded").agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("rule") == "not_null"))
    return out.select("table_name", "rule", F.coalesce("key", F.collate("folded", "UTF8_BINARY")).alias("key"), "n")


def audit_keys(tables: dict[str, DataFrame], collation: str | None = "UNICODE_CI_AI") -> DataFrame:
    """Q1, Q2: every declared primary and unique key of the given tables: table_name, rule ('primary_key', 'unique',
    'not_null' for NULLs in a primary key), key, n.  Each table is scanned once and all keys share one aggregation.  A
    key is audited if the frame has its columns."""
    parts = []
    for name, df in tables.items():
        r, have = RULES[name], set(df.columns)
        primary = list(r.primary_key) if set(r.primary_key) <= have else []
        unique = [list(k) for k in r.unique if set(k) <= have]
        if primary or unique:
            parts.append(_key_rows(df, name, primary, unique, collation))
    return _key_faults(reduce(DataFrame.unionByName, parts))


def audit_references(tables: dict[str, DataFrame]) -> DataFrame:
    """Q6: every declared reference between the given tables, as anti joins: table_name, rule, key, parent, ref."""
    parts = []
    for name, df in tables.items():
        for cols, parent, parent_cols in RULES[name].references:
            if parent in tables and set(cols) <= set(df.columns):
                key = [c for c in RULES[name].primary_key if c in df.columns]
                parts.append(audit_reference(df, list(cols), tables[parent], list(parent_cols), key, name, parent))
    return reduce(DataFrame.unionByName, parts)


def audit_primary_key(df: DataFrame, keys: list[str], table: str = "") -> DataFrame:
    """Q2: duplicate keys (rule 'primary_key') and NULL key parts ('not_null'), in one scan and one aggregation."""
    return _key_faults(_key_rows(df, table, keys, [], None))


def audit_length(df: DataFrame, lengths: dict, key_cols: list[str], table: str = "") -> DataFrame:
    """Q4: values longer than the declared VARCHAR length (in characters)."""
    tags = F.array_compact(F.array(*[F.when(F.char_length(F.col(c)) > F.lit(n), F.lit(c))
                                     for c, n in lengths.items()]))
    return (df.select(_key_str(key_cols).alias("key"), F.explode(tags).alias("column_name"))
            .select(F.lit(table).alias("table_name"), F.lit("length").alias("rule"), "key", "column_name"))


def audit_domain(df: DataFrame, domains: dict, key_cols: list[str], table: str = "") -> DataFrame:
    """Q5: non-NULL values outside the declared ENUM domain."""
    tags = F.array_compact(F.array(*[F.when(F.col(c).isNotNull() & ~F.col(c).isin(list(v)), F.lit(c))
                                     for c, v in domains.items()]))
    return (df.select(_key_str(key_cols).alias("key"), F.explode(tags).alias("column_name"))
            .select(F.lit(table).alias("table_name"), F.lit("domain").alias("rule"), "key", "column_name"))


def audit_reference(child: DataFrame, cols: list[str], parent: DataFrame, parent_cols: list[str],
                    key_cols: list[str], table: str = "", parent_name: str = "") -> DataFrame:
    """Q6: child rows whose (non-NULL) reference has no parent row.  A left
    anti join against the parent's keys (no distinct needed: an anti join
    only tests existence)."""
    pk = parent.select(*[F.col(p).alias(c) for p, c in zip(parent_cols, cols)])
    not_null = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])
    orphans = child.where(not_null).join(pk, cols, "left_anti")
    return orphans.select(F.lit(table).alias("table_name"), F.lit("reference").alias("rule"),
                          _key_str(key_cols).alias("key"), F.lit(parent_name).alias("parent"),
                          _key_str(cols).alias("ref"))


def default_fill(df: DataFrame, rules: TableRules, schema=None) -> DataFrame:
    """Q7: add declared defaults for *absent* columns only; an explicit NULL is
    a not-null matter (Q3), not a default."""
    out = df
    for c, v in rules.defaults.items():
        if c not in df.columns:
            lit = F.lit(v)
            if schema is not None and c in schema.fieldNames():
                lit = lit.cast(schema[c].dataType)
            out = out.withColumn(c, lit)
    return out


def audit_table(df: DataFrame, name: str, key_cols: list[str] | None = None) -> DataFrame:
    """Not-null, length and domain rules of a known table in one frame."""
    r = RULES[name]
    key_cols = key_cols or list(r.primary_key)
    parts = []
    present = set(df.columns)
    nn = [c for c in r.not_null if c in present]
    if nn:
        parts.append(audit_not_null(df, nn, key_cols, name))
    ln = {c: n for c, n in r.lengths.items() if c in present}
    if ln:
        parts.append(audit_length(df, ln, key_cols, name))
    dm = {c: v for c, v in r.domains.items() if c in present}
    if dm:
        parts.append(audit_domain(df, dm, key_cols, name))
    return reduce(lambda a, b: a.unionByName(b), parts)
