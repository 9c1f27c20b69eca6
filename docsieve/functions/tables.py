"""Small fixed tables that Spark knows the size of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _sql(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, int):
        return str(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal_table(spark: SparkSession, columns: list[str], rows: list[tuple]) -> DataFrame:
    """Configuration rows as a local relation: its exact size lets the planner broadcast it by itself."""
    body = ", ".join("(" + ", ".join(_sql(v) for v in row) + ")" for row in rows)
    return spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(columns)})")


def with_struct(df: DataFrame, name: str, parts: dict[str, Column]) -> DataFrame:
    """Add a struct whose fields are columns of their own underneath.

    Readers of single fields then refer to those columns. A struct of inline
    expressions would be taken apart by the optimizer and every expression
    repeated at each place that reads it.
    """
    temporary = {f"__{name}_{k}": c for k, c in parts.items()}
    packed = F.struct(*[F.col(f"__{name}_{k}").alias(k) for k in parts])
    return df.withColumns(temporary).withColumn(name, packed).drop(*temporary)


def with_prefixed(df: DataFrame, prefix: str, parts: dict[str, Column]) -> DataFrame:
    """Add flat columns `{prefix}_{name}`; wide flat plans stay cheap to optimize where nested ones do not."""
    return df.withColumns({f"{prefix}_{k}": c for k, c in parts.items()})


class Prefixed:
    """Read access to the columns of `with_prefixed`: `Prefixed("ev")["scale"]`."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __getitem__(self, name: str) -> Column:
        return F.col(f"{self.prefix}_{name}")
