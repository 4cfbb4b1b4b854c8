"""Plugins: functions at points of the pipeline, custom tokenizers and scorers.

A hook takes a frame and returns one; None filters everything out, as it does for single
items with row hooks. A hook that fails is logged and skipped, and the frame goes on.
"""

from __future__ import annotations

import logging
from collections import defaultdict
from collections.abc import Callable, Iterator
from enum import StrEnum

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)


class Point(StrEnum):
    PRE_CRAWL = "pre_crawl"
    POST_CRAWL = "post_crawl"
    PRE_INDEX = "pre_index"
    POST_INDEX = "post_index"
    PRE_SEARCH = "pre_search"
    POST_SEARCH = "post_search"
    PRE_RANK = "pre_rank"
    POST_RANK = "post_rank"
    CUSTOM_TOKENIZER = "custom_tokenizer"
    CUSTOM_SCORER = "custom_scorer"


def default_tokens(text: Column) -> Column:
    """Lower-case words of at least two characters."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), 1), lambda w: F.length(w) >= 2)


class Plugins:
    """Hooks by point, in the order of their registration, and the named plugins that brought them."""

    def __init__(self):
        self._hooks: dict[Point, list[Callable]] = defaultdict(list)
        self.named: dict[str, str] = {}

    def hook(self, point: Point | str):
        """Decorator that registers a function from frame to frame; at the last two points from column to column."""

        def add(f):
            self._hooks[Point(point)].append(f)
            return f

        return add

    def rows(self, point: Point | str):
        """Decorator that registers a function from a row, a dict, to a row or None; it runs in Arrow batches."""

        def add(f):
            self._hooks[Point(point)].append(lambda df: df.mapInPandas(lambda parts: _each(f, parts), df.schema))
            return f

        return add

    def register(self, name: str, version: str = "0.0.1", hooks: dict | None = None, setup: Callable | None = None) -> None:
        """A named plugin; setup is called once, before its hooks count."""
        if setup:
            setup()
        self.named[name] = version
        for point, f in (hooks or {}).items():
            self.hook(point)(f)

    def run(self, point: Point | str, df: DataFrame) -> DataFrame:
        for f in self._hooks[Point(point)]:
            try:
                out = f(df)
                if out is not None:
                    out.schema  # a frame that cannot be planned fails here, not in what follows
            except Exception:  # noqa: BLE001
                log.warning("hook %s at %s failed", getattr(f, "__name__", f), point, exc_info=True)
                continue
            if out is None:
                return df.limit(0)
            df = out
        return df

    def tokens(self, text: Column) -> Column:
        """The last registered tokenizer's tokens, else the default ones."""
        return (self._hooks[Point.CUSTOM_TOKENIZER] or [default_tokens])[-1](text)

    @property
    def tokenizer(self) -> Callable | None:
        """The last registered tokenizer, None without one."""
        return (self._hooks[Point.CUSTOM_TOKENIZER] or [None])[-1]

    def score(self, combined: Column) -> Column:
        """The combined score after all registered scorers."""
        for f in self._hooks[Point.CUSTOM_SCORER]:
            combined = f(combined)
        return combined


def _each(f: Callable, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        kept = []
        for row in part.to_dict("records"):
            try:
                row = f(dict(row))
            except Exception:  # noqa: BLE001 - a hook that fails on a row leaves it as it is
                log.warning("row hook failed", exc_info=True)
            if row is not None:
                kept.append(row)
        yield pd.DataFrame(kept, columns=part.columns)
