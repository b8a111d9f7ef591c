"""Registers query functions with their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Queries:
    def __init__(self):
        self.functions: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, sql: str | None = None) -> Callable:
        """Decorator; without sql only rows can be checked from outside."""

        def put(fn: Callable) -> Callable:
            self.functions[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn

        return put


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
