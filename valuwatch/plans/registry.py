"""Registered queries: a callable over a Book and, where SQL can say it, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..model import Book
from . import prelude


@dataclass(frozen=True)
class Query:
    run: Callable[[Book], DataFrame]
    oracle: str | None


CATALOG: dict[str, Query] = {}


def query(name: str, oracle: str | None = None, raw: bool = False, **views: str):
    """Register the decorated `Book -> DataFrame` function under `name`.

    `oracle` is a statement over the prelude's views (plus `views`), or complete SQL if `raw`.
    """
    def add(fn: Callable[[Book], DataFrame]):
        if name in CATALOG:
            raise ValueError(f"{name} is registered twice")
        CATALOG[name] = Query(fn, (oracle if raw else prelude.sql(oracle, **views)) if oracle else None)
        return fn

    return add
