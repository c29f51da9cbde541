"""Parquet tables as sources, and the names that the naming rules can read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Column names of the driver's tables whose prefixes hide what they mean.
ALIASES = {
    "region": {"r_regionkey": "region_key", "r_name": "region_name"},
    "nation": {"n_nationkey": "nation_key", "n_name": "nation_name", "n_regionkey": "region_key"},
    "customer": {"c_custkey": "customer_key", "c_name": "customer_name", "c_nationkey": "nation_key", "c_acctbal": "account_balance", "c_mktsegment": "market_segment"},
    "supplier": {"s_suppkey": "supplier_key", "s_name": "supplier_name", "s_nationkey": "nation_key", "s_acctbal": "account_balance"},
    "part": {"p_partkey": "part_key", "p_name": "part_name", "p_brand": "brand", "p_type": "part_type", "p_size": "part_size", "p_retailprice": "retail_price"},
    "orders": {"o_orderkey": "order_key", "o_custkey": "customer_key", "o_orderstatus": "order_status", "o_totalprice": "total_price", "o_orderdate": "order_date",
               "o_orderpriority": "order_priority"},
    "lineitem": {"l_orderkey": "order_key", "l_partkey": "part_key", "l_suppkey": "supplier_key", "l_linenumber": "line_number", "l_quantity": "quantity",
                 "l_extendedprice": "extended_price", "l_discount": "discount", "l_tax": "tax", "l_returnflag": "return_flag", "l_linestatus": "line_status",
                 "l_shipdate": "ship_date"},
}


def read_table(spark: SparkSession, folder: str, name: str, aliases: dict[str, dict[str, str]] | None = None) -> DataFrame:
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    names = (aliases or {}).get(name)
    return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(names.get(c, c)) for c in df.columns]) if names else df


def read_star(spark: SparkSession, folder: str, names=tuple(ALIASES)) -> dict[str, DataFrame]:
    """The order tables under readable names."""
    return {n: read_table(spark, folder, n, ALIASES) for n in names}
