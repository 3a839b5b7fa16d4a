"""How a query and its checking SQL are written down and rounded alike."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    """``build`` makes the frame; ``sql`` (if any) gives the same rows.

    Sums are added up in another order by the two engines, so floating point
    columns (``rounds`` in the SQL) are compared to ``digits`` digits.
    """

    build: Build
    sql: str | None = None
    rounds: Sequence[str] = ()
    digits: int = 6

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(self.build(spark, sf_dir), self.digits)

    def check(self) -> str | None:
        if self.sql is None or not self.rounds:
            return self.sql
        with_clause, body = self.sql.rsplit("\n--\n", 1) if "\n--\n" in self.sql else ("", self.sql)
        # a negative zero would compare unequal as text
        parts = ", ".join(
            f"CASE WHEN round({c}, {self.digits}) = 0 THEN 0e0 ELSE round({c}, {self.digits}) END AS {c}"
            for c in (f'"{r}"' for r in self.rounds)
        )
        return f"{with_clause}\nSELECT * REPLACE ({parts}) FROM (\n{body}\n) AS outcome"


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Round every floating point column for comparison; zero has no sign.

    As in the SQL a value is scaled, rounded to a whole number, and scaled back: a decimal
    rounding differs where only the product ends in a half.
    """
    scale = float(10 ** digits)

    def column(field: T.StructField):
        if not isinstance(field.dataType, T.DoubleType):
            return F.col(field.name)
        own = F.col(field.name)
        whole = F.round(own * scale)
        value = F.when(F.abs(whole) == float("inf"), own).otherwise(whole / scale)
        return F.when(value == 0, F.lit(0.0)).otherwise(value).alias(field.name)

    return df.select(*[column(f) for f in df.schema.fields])


def with_tables(tables: Sequence[tuple[str, str]], body: str) -> str:
    """A WITH clause and a body, kept apart so that ``check`` can wrap the body."""
    listed = ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in tables)
    return f"WITH {listed}\n--\n{body}"
