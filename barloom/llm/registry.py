"""Queries of the subpackage, by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from barloom.session import ship


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


ENTRIES: dict[str, Entry] = {}


def entry(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return fn(spark, sf_dir)

        ENTRIES[name] = Entry(run, sql)
        return fn

    return register
