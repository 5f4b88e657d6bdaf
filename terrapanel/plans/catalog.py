"""A named query: its Spark form, its SQL form, and one declared output shape for both."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _nudge(kind: str) -> float:
    """Tips exact halves of the last place up, whatever order an engine summed in."""
    return 10.0 ** -(int(kind[1:]) + 4)


@dataclass(frozen=True)
class Query:
    name: str
    shape: str  # "name:type ..." with l=bigint, d=date, s=string, b=boolean, fN=double rounded to N places
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None

    @property
    def columns(self) -> list[tuple[str, str]]:
        return [tuple(part.rsplit(":", 1)) for part in self.shape.split()]

    def spark(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.run(spark, sf_dir)
        kinds = {"l": "long", "d": "date", "s": "string", "b": "boolean"}
        out = []
        for name, kind in self.columns:
            if kind.startswith("f"):
                out.append((F.round(F.col(name).cast("double") + _nudge(kind), int(kind[1:])) + 0.0).alias(name))
            else:
                out.append(F.col(name).cast(kinds[kind]).alias(name))
        return df.select(*out)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        kinds = {"l": "bigint", "d": "date", "s": "varchar", "b": "boolean"}
        out = []
        for name, kind in self.columns:
            if kind.startswith("f"):
                out.append(f'round(cast("{name}" as double) + {_nudge(kind)!r}, {int(kind[1:])}) + 0e0 as "{name}"')
            else:
                out.append(f'cast("{name}" as {kinds[kind]}) as "{name}"')
        return f"select {', '.join(out)} from ({self.sql})"


REGISTRY: dict[str, Query] = {}


def register(name: str, shape: str, sql: str | None = None):
    def wrap(run):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, shape, run, sql)
        return run

    return wrap
