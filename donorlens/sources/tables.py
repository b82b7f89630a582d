"""SQL over registered tables, and table writers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from donorlens.sources import versions


def run_sql(spark: SparkSession, query: str, args: Mapping[str, Any] | Sequence[Any] | None = None, **frames: DataFrame) -> DataFrame:
    """Run a query over the session's tables and views; errors are raised.

    ``args`` are the values of its markers, ``:name`` or ``?`` in order. A value is never read as SQL; a name of a table or
    column is one only inside ``IDENTIFIER(:name)``. ``frames`` are DataFrames that the query calls ``{name}``.
    """
    return spark.sql(query, args=args, **frames) if args or frames else spark.sql(query)


def register(views: dict[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def overwrite_table(df: DataFrame, name: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).saveAsTable(name)


def overwrite_path(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def default_store(spark: SparkSession) -> str:
    """The versions of the analytics tables, in the warehouse."""
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/donorlens_versions"


def load_tables(spark: SparkSession, frames: Mapping[str, DataFrame], store: str | None = None) -> int:
    """Replace several tables together: new versions beside the old, one pointer for all, then views of their names."""
    store = store or default_store(spark)
    number = versions.publish(spark, store, frames)
    versions.register(spark, store)
    return number


def load_datasets(
    actions: DataFrame,
    donations: DataFrame,
    actions_table: str = "customers",
    donations_table: str = "orders",
    store: str | None = None,
) -> int:
    """Replace both analytics tables together."""
    return load_tables(actions.sparkSession, {actions_table: actions, donations_table: donations}, store)


def write_if_absent(df: DataFrame, name: str) -> bool:
    """Write the table unless it exists; tells whether it was written."""
    if df.sparkSession.catalog.tableExists(name):
        return False
    df.write.mode("ignore").saveAsTable(name)
    return True


def write_jdbc_if_absent(df: DataFrame, url: str, table: str, batch_rows: int = 4000, **properties: str) -> None:
    """The same for a database reached over JDBC, in batches of ``batch_rows`` per insert."""
    df.write.mode("ignore").option("batchsize", batch_rows).jdbc(url, table, properties=properties)
