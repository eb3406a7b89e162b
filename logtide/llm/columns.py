"""Columns of any name: dots, backticks, names that differ in case only from one that a step adds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> Column:
    """The column of exactly this name."""
    return F.col("`" + name.replace("`", "``") + "`")


def row(docs: DataFrame) -> Column:
    """All columns of ``docs`` as one struct; ``select("<alias>.*")`` gives them back."""
    return F.struct(*map(quoted, docs.columns))


def field(parent: str, name: str) -> Column:
    """The field of exactly this name of a struct column, under its name."""
    return F.col(f"{parent}.`" + name.replace("`", "``") + "`").alias(name)


def without(docs: DataFrame, *names: str) -> DataFrame:
    """``docs`` without the columns of these names, whatever their case."""
    gone = {n.lower() for n in names}
    return docs.select(*[quoted(n) for n in docs.columns if n.lower() not in gone])


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with columns named by their place (c0, c1, ...), as functions need that look columns up by name."""
    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
