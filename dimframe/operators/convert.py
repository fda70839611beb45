"""Converting columns to narrower types that keep their values, by rules."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField


def number_text(c: Column) -> Column:
    """A number as the shortest text of 15 significant digits: ``1``, not ``1.0``."""
    whole = (c == F.floor(c)) & (F.abs(c) < 1e15)
    return F.when(whole, c.cast("long").cast("string")).otherwise(c.cast("string"))


Convert = Callable[[Column], Column]


@dataclass(frozen=True)
class Rule:
    """For fields that ``when`` takes: conversions tried in order (by name), and whether a value survived one.

    ``same`` gets the field's column and the converted one; null is false. Nulls
    of the field are not asked. A rule without conversions leaves its fields as
    they are.
    """

    when: Callable[[StructField], bool]
    do: Mapping[str, Convert]
    same: Callable[[Column, Column], Column]


def _truth(c: Column) -> Column:
    return F.when(F.upper(c).isin("TRUE", "T"), True).when(F.upper(c).isin("FALSE", "F"), False)


def _as_text(c: Column, made: Column) -> Column:
    return made.cast("string") == c


#: Text becomes the first of truth values, whole numbers, numbers and dates that gives the same text again (truth in any spelling).
TEXT = Rule(
    lambda f: f.dataType.simpleString() == "string",
    {"boolean": _truth, "int": lambda c: F.when(_as_text(c, c.try_cast("int")), c.try_cast("int")), "double": lambda c: F.when(number_text(c.try_cast("double")) == c, c.try_cast("double")), "date": lambda c: F.when(_as_text(c, c.try_cast("date")), c.try_cast("date"))},
    lambda c, made: made.isNotNull(),
)
#: Numbers become truth values if all are 0 or 1, or else whole numbers.
WHOLE = Rule(lambda f: f.dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"), {"boolean": lambda c: c.cast("boolean")}, lambda c, made: made.cast("int") == c)
NUMBER = Rule(lambda f: f.dataType.simpleString() in ("float", "double"), {"boolean": lambda c: c.cast("boolean"), "int": lambda c: c.try_cast("int")}, lambda c, made: made.cast("int").cast("double") == c)
STANDARD = {"text": TEXT}


def convertible(df: DataFrame, columns: Sequence[str] | None = None, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """A row for each column that a rule takes: how many values are there (n_n) and how many survive each conversion (n_...), null for those of other rules.

    All conversions of all columns are one aggregate.
    """
    asked = _asked(df, columns, STANDARD if rules is None else rules)
    kinds = list(dict.fromkeys(k for rule in asked.values() for k in rule.do))
    aggs = []
    for name, rule in asked.items():
        c = F.col(f"`{name}`")
        aggs.append(F.count(c).alias(f"{name}.n"))
        aggs += [F.count(F.when(c.isNotNull() & F.coalesce(rule.same(c, make(c)), F.lit(False)), True)).alias(f"{name}.{k}") for k, make in rule.do.items()]
    if not aggs:
        return df.sparkSession.createDataFrame([], "column string, n_n long")
    row = df.agg(*aggs)
    count = lambda name, k: F.col(f"`{name}.{k}`") if k == "n" or k in asked[name].do else F.lit(None).cast("long")
    return row.select(F.inline(F.array(*[F.struct(F.lit(name).alias("column"), *[count(name, k).alias(f"n_{k}") for k in ("n", *kinds)]) for name in asked])))


def _asked(df: DataFrame, columns: Sequence[str] | None, rules: Mapping[str, Rule]) -> dict[str, Rule]:
    """The first rule that takes each column."""
    found = {f.name: next((r for r in rules.values() if r.when(f)), None) for f in df.schema if columns is None or f.name in columns}
    return {n: r for n, r in found.items() if r is not None and r.do}


def auto_convert(df: DataFrame, columns: Sequence[str] | None = None, rules: Mapping[str, Rule] | None = None) -> DataFrame:
    """Columns converted by the first rule that takes them, in the first way that all their values survive.

    ``rules``, by name, are asked in order; the standard one looks at text.
    Columns that no rule takes, that no conversion suits or that hold nothing
    stay as they are.
    """
    rules = STANDARD if rules is None else rules
    asked = _asked(df, columns, rules)
    made: dict[str, Column] = {}
    for row in convertible(df, columns, rules).collect():  # a row for each column
        name = row["column"]
        kind = next((k for k in asked[name].do if row["n_n"] and row[f"n_{k}"] == row["n_n"]), None)
        if kind:
            made[name] = asked[name].do[kind](F.col(f"`{name}`")).alias(name)
    return df.select(*[made.get(c, F.col(f"`{c}`")) for c in df.columns])


def as_numeric(c: str | Column) -> Column:
    """A number, or an error where there is none."""
    return (F.col(c) if isinstance(c, str) else c).cast("double")
