"""Queries of this subpackage and the SQL each is checked against."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

MODULES = ("mixing", "quality", "urls", "zipwarc", "graph", "ngram", "toxicity", "forest", "templates", "repeats",
           "langid", "whitening", "trie")


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for name in MODULES:
        out |= importlib.import_module(f"driftline.llm.{name}").QUERIES
    return out | {"pipeline": importlib.import_module("corpus_pipeline").run}


def oracles() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(importlib.import_module(f"driftline.llm.{name}"), "ORACLES", {})
    pipeline = importlib.import_module("corpus_pipeline").ORACLE_SQL
    return out | ({"pipeline": pipeline} if pipeline else {})
