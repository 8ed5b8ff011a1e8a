"""Where query modules put their queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    def __init__(self):
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None):
        """Registers the function under its name, with its SQL if there is one."""

        def add(f: Query) -> Query:
            self.queries[f.__name__] = f
            if sql is not None:
                self.sql[f.__name__] = sql
            return f

        return add


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one that the session names, for what a query stores and reads."""
    import uuid

    from heddle.sources.tables import own_folder

    return f"{own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_list(xs) -> str:
    return "(" + ", ".join(quoted(x) for x in xs) + ")"


def sql_array(xs) -> str:
    return "[" + ", ".join(quoted(x) for x in xs) + "]"


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], columns: str) -> str:
    """The same rows as a SQL table expression."""
    one = lambda x: "NULL" if x is None else quoted(x) if isinstance(x, str) else str(x).lower() if isinstance(x, bool) else str(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS v({columns})"
