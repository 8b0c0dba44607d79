"""A query and its SQL, held together so that they cannot drift apart."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from quillon.session import table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def _put(self, name: str, query: Query, oracle: str | None) -> None:
        if name in self.queries:
            raise ValueError(f"two queries named {name}")
        self.queries[name] = query
        if oracle is not None:
            self.sql[name] = oracle

    def query(self, oracle: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
        """Registers a function of (spark, sf_dir) under its name."""

        def keep(f: Query) -> Query:
            self._put(name or f.__name__, f, oracle)
            return f

        return keep

    def spark_sql(self, name: str, tables: str, text: str, oracle: str | None = None) -> None:
        """Registers Spark SQL over the named tables; the oracle is the same text unless given."""

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables.split()})

        plain = text
        for t in tables.split():
            plain = plain.replace("{" + t + "}", t)
        self._put(name, run, oracle if oracle is not None else plain)

    def add_all(self, other: Registry) -> None:
        for name, f in other.queries.items():
            self._put(name, f, other.sql.get(name))
