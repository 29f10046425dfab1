"""Register a Spark query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


GUARD = 1e4


def rounded(df: DataFrame, names: list[str], digits: int = 6) -> DataFrame:
    """Round the named columns to the nearest value so that the order of floating additions cannot show.

    Four more digits are rounded first: sums that differ in their last bits then agree on which side
    of a half way value they lie, and no value is moved.
    """
    fine, scale = F.lit(10.0 ** digits * GUARD), F.lit(10.0 ** digits)
    return df.select(*[
        (F.rint(F.rint(F.col(f"`{name}`") * fine) / F.lit(GUARD)) / scale + F.lit(0.0)).alias(name) if name in names else F.col(f"`{name}`")
        for name in df.columns
    ])


def query(name: str, sql: str | None = None, floats: str = "", digits: int = 6):
    """Decorator.  ``floats`` names the double columns, rounded on both sides."""

    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return rounded(function(spark, sf_dir), floats.split(), digits)

        run.__name__ = name
        run.__doc__ = function.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            names = floats.split()
            if names:
                fine, scale, guard = (f"{x!r}::DOUBLE" for x in (10.0 ** digits * GUARD, 10.0 ** digits, GUARD))
                replaced = ", ".join(f'round_even(round_even("{n}" * {fine}, 0) / {guard}, 0) / {scale} + 0.0 AS "{n}"' for n in names)
                ORACLES[name] = f"SELECT * REPLACE ({replaced}) FROM (\n{sql.strip()}\n) AS q"
            else:
                ORACLES[name] = sql.strip()
        return function

    return register
