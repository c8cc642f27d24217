"""Named queries with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators.measures import Star
from ledgerloom.plans.medallion import Medallion, write_stages
from ledgerloom.plans.oracle_base import with_base
from ledgerloom.session import shared_dir
from ledgerloom.sources.fixtures import AS_OF, SEGMENT_GROUPS, Fixtures

RESOLVED_AT = "2002-01-01 00:00:00"


def groups_of_segments() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for segment, group in SEGMENT_GROUPS.items():
        out.setdefault(group, []).append(segment)
    return out


class Context:
    """One data folder in one session. Stages are written to the shared folder once and read by every query."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir
        self.fixtures = Fixtures(spark, sf_dir, lambda name, df: self.keep(name, df))

    @cached_property
    def dir(self) -> str:
        return shared_dir(self.spark)

    @cached_property
    def keep(self):
        return write_stages(self.spark, self.dir)

    @cached_property
    def m(self) -> Medallion:
        return Medallion(self.fixtures, RESOLVED_AT, groups_of_segments(), self.keep)

    @property
    def star(self) -> Star:
        return Star(self.m.fact, self.m.dim_company, self.m.dim_investor, self.m.dim_date)

    def t(self, name: str) -> DataFrame:
        return self.fixtures.t(name)

    @cached_property
    def _kept(self) -> dict[str, DataFrame]:
        return {}

    def kept(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._kept:
            self._kept[name] = self.keep(name, build())
        return self._kept[name]


_contexts: dict[tuple[str, str], Context] = {}


def context(spark: SparkSession, sf_dir: str) -> Context:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _contexts:
        _contexts[key] = Context(spark, sf_dir)
    return _contexts[key]


@dataclass
class Query:
    name: str
    build: Callable[[Context], DataFrame]
    sql: str | None
    covers: list[str] = field(default_factory=list)

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(context(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None, covers: str = "") -> Callable:
    """Register a query. `sql` may use the base expressions; `covers` lists the operator ids it exercises."""

    def add(fn: Callable[[Context], DataFrame]) -> Callable[[Context], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, fn, with_base(sql) if sql else None, covers.split() or [name.split("_")[0]])
        return fn

    return add


__all__ = ["AS_OF", "Context", "QUERIES", "RESOLVED_AT", "context", "query"]
