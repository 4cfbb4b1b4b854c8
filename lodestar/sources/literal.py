"""Small literal tables, the same for Spark and SQL: for inputs that the tables of a data folder do not have."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_SQL = {"string": "VARCHAR", "long": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


@dataclass(frozen=True)
class Literal:
    """name, a Spark schema of simple types, and rows."""

    name: str
    schema: str
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    @property
    def sql(self) -> str:
        """The table as a common table expression."""
        columns = [c.split() for c in self.schema.split(",")]
        cells = lambda row: ", ".join(f"{_quoted(v)}::{_SQL[k]}" for v, (_, k) in zip(row, columns, strict=True))
        return f"{self.name} AS (SELECT * FROM (VALUES " + ", ".join(f"({cells(r)})" for r in self.rows) + f") v({', '.join(c for c, _ in columns)}))"


def _quoted(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
