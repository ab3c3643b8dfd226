"""Operators as declarative plans: SQL over named inputs, planned by Catalyst.

An operator is a query text whose inputs stand in braces. ``apply`` runs one over any DataFrames with the
right columns; ``bound`` runs it over the test tables by a binding (how a table stands in for an input).
Number literals with a fraction are written with an exponent, which makes them doubles on every engine.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from notegrain.plans import kernels
from notegrain.plans.shared import table


@dataclass(frozen=True)
class Op:
    name: str
    sql: str
    what: str = ""
    check: str | None = None
    """The same query for the checking engine, where its dialect differs."""

    @property
    def inputs(self) -> list[str]:
        return _names(self.sql)


@dataclass(frozen=True)
class Binding:
    sql: str
    check: str | None = None
    tables: tuple[str, ...] = field(default=())
    build: Callable[[SparkSession, str], DataFrame] | None = None
    """Makes the input where SQL does not; ``check`` then has its text for the checking engine."""


def _ready(spark: SparkSession, text: str) -> str:
    """The text, with the functions of ``kernels`` that it names made known to the session."""
    for name, function in kernels.FUNCTIONS.items():
        if f"{name}(" in text:
            spark.udf.register(name, function)
    return text


def _names(text: str) -> list[str]:
    return list(dict.fromkeys(f for _, f, _, _ in string.Formatter().parse(text) if f))


def apply(op: Op, **inputs: DataFrame) -> DataFrame:
    """The operator over the given DataFrames, by input name."""
    spark = next(iter(inputs.values())).sparkSession if inputs else SparkSession.active()
    return spark.sql(_ready(spark, op.sql), **inputs)


def bound(op: Op, bindings: dict[str, Binding]):
    """A query over the test tables, and its text for the checking engine."""

    def make(spark: SparkSession, d: str, name: str) -> DataFrame:
        b = bindings.get(name)
        if b is None:
            return table(spark, d, name)
        if b.build:
            return b.build(spark, d)
        return spark.sql(_ready(spark, b.sql), **{n: make(spark, d, n) for n in _names(b.sql)})

    def run(spark: SparkSession, d: str) -> DataFrame:
        return spark.sql(_ready(spark, op.sql), **{n: make(spark, d, n) for n in op.inputs})

    with_: dict[str, str] = {}

    def add(name: str) -> None:
        if name in bindings and name not in with_:
            text = bindings[name].check or bindings[name].sql
            for n in _names(text):
                add(n)
            with_[name] = text.format(**{n: n for n in _names(text)})

    text = op.check or op.sql
    for n in _names(text):
        add(n)
    body = text.format(**{n: n for n in _names(text)})
    head = ", ".join(f"{n} AS ({s})" for n, s in with_.items())
    stripped = body.strip()
    if head and stripped[:15].upper() == "WITH RECURSIVE ":
        return run, f"WITH RECURSIVE {head}, {stripped[15:]}"
    if head and stripped[:5].upper() == "WITH ":
        return run, f"WITH {head}, {stripped[5:]}"
    return run, (f"WITH {head} {stripped}" if head else stripped)
