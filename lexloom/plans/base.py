"""The registry, and the given tables as the operators see them: orders as jobs, lineitem as requests, nations as tags."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# The same expressions in Spark and in the oracle.
REQUESTS = {
    "id": "l_orderkey * 10 + l_linenumber", "job": "l_orderkey", "site": "l_suppkey", "target": "l_partkey % 50", "is_search": "l_linenumber = 1", "changed": "l_shipdate",
    "status": "case when l_returnflag = 'R' then 'committed' when l_returnflag = 'A' then 'failed' when l_linestatus = 'F' then 'ran' when l_linenumber % 2 = 0 then 'waiting' else 'scheduled' end",
    "lead_count": "l_linenumber % 4",
}
JOBS = {"job": "o_orderkey", "owner": "o_custkey", "status": "case o_orderstatus when 'O' then 'working' when 'F' then 'terminated' else 'waiting' end", "asked": "o_orderdate", "started": "o_orderdate"}
LINKS = {"site": "s_suppkey", "tag": "s_nationkey", "level": "cast(floor(s_acctbal / 5) as int)"}


def _cte(name: str, columns: dict[str, str], table: str) -> str:
    return f"{name} as (select {', '.join(f'{e} as {c}' for c, e in columns.items())} from {table})"


WITH = f"with {_cte('requests', REQUESTS, 'lineitem')}, {_cte('jobs', JOBS, 'orders')}, {_cte('links', LINKS, 'supplier')} "


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _made(self, columns: dict[str, str], table: str) -> DataFrame:
        return getattr(self, table).selectExpr(*[f"{e} as {c}" for c, e in columns.items()])

    @property
    def requests(self) -> DataFrame:
        return self._made(REQUESTS, "lineitem")

    @property
    def jobs(self) -> DataFrame:
        return self._made(JOBS, "orders")

    @property
    def links(self) -> DataFrame:
        return self._made(LINKS, "supplier")


def query(sql: str | None = None) -> Callable:
    """Registers a function of the tables under its name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def ts(text: str):
    return F.lit(text).cast("timestamp")
