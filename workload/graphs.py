"""Edge sets over the driver's tables.

Each is a function from (spark, folder of parquet tables) to edges ``src, dst``; ``EDGE_SQL`` holds
the same edges as SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from archipelago import edges_from_columns, edges_from_shared_value

# A line that two documents share links them if it has at least this many characters.
TELLING_LINE = 40

EdgeSet = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_part(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and the parts they contain."""
    return edges_from_columns(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey", two_kinds=True)


def bulk_order_part(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and the parts they contain in bulk (a quantity of 49 or 50)."""
    bulk = table(spark, folder, "lineitem").filter(F.col("l_quantity") >= 49)
    return edges_from_columns(bulk, "l_orderkey", "l_partkey", two_kinds=True)


def part_supplier(spark: SparkSession, folder: str) -> DataFrame:
    """Parts and the suppliers they came from: few suppliers, so every one of them is a hub."""
    return edges_from_columns(table(spark, folder, "lineitem"), "l_partkey", "l_suppkey", two_kinds=True)


def customer_order(spark: SparkSession, folder: str) -> DataFrame:
    """Customers and their orders."""
    return edges_from_columns(table(spark, folder, "orders"), "o_custkey", "o_orderkey", two_kinds=True)


def supplier_nation(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers and their nations."""
    return edges_from_columns(table(spark, folder, "supplier"), "s_suppkey", "s_nationkey", two_kinds=True)


def order_part_lines(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Orders and parts again, as the first five lines of each order and the lines that came later."""
    lines = table(spark, folder, "lineitem")
    first, later = F.col("l_linenumber") <= 5, F.col("l_linenumber") > 5
    return tuple(edges_from_columns(lines.filter(part), "l_orderkey", "l_partkey", two_kinds=True) for part in (first, later))


def weighted_order_part(spark: SparkSession, folder: str) -> DataFrame:
    """Orders and parts, nearer the more of a part was ordered (``weight`` from 0 for 50 pieces to 49)."""
    lines = table(spark, folder, "lineitem").withColumn("weight", (50 - F.col("l_quantity")).cast("int"))
    edges = lines.select("weight", (2 * F.col("l_orderkey")).alias("src"), (2 * F.col("l_partkey") + 1).alias("dst"))
    return edges.select("src", "dst", "weight")


def customer_order_pending(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Customers and their orders again, as those decided and those pending."""
    orders = table(spark, folder, "orders")
    pending = F.col("o_orderstatus") == "P"
    return tuple(edges_from_columns(orders.filter(part), "o_custkey", "o_orderkey", two_kinds=True) for part in (~pending, pending))


def doc_copies(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with the same text."""
    return edges_from_shared_value(table(spark, folder, "documents"), "doc_id", "text")


def doc_lines(spark: SparkSession, folder: str, hot_rows: int | None = None) -> DataFrame:
    """Documents that share a line of at least ``TELLING_LINE`` characters, which the SQL asks for too."""
    lines = table(spark, folder, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    telling = lines.select("doc_id", F.trim("line").alias("line")).filter(F.length("line") >= TELLING_LINE)
    return edges_from_shared_value(telling, "doc_id", "line", hot_rows)


def _star_sql(holders: str) -> str:
    return f"""
        select distinct src, dst from (
            select min(doc_id) over (partition by held) as src, doc_id as dst from ({holders}) h
        ) linked where src <> dst"""


WEIGHTED_SQL = """
    select 2 * l_orderkey as src, 2 * l_partkey + 1 as dst, cast(50 - l_quantity as integer) as weight from lineitem"""

EDGE_SQL: dict[str, str] = {
    "order_part": "select 2 * l_orderkey as src, 2 * l_partkey + 1 as dst from lineitem",
    "bulk_order_part": """
        select 2 * l_orderkey as src, 2 * l_partkey + 1 as dst from lineitem where l_quantity >= 49""",
    "part_supplier": "select 2 * l_partkey as src, 2 * l_suppkey + 1 as dst from lineitem",
    "customer_order": "select 2 * o_custkey as src, 2 * o_orderkey + 1 as dst from orders",
    "order_part_first_lines": "select 2 * l_orderkey as src, 2 * l_partkey + 1 as dst from lineitem where l_linenumber <= 5",
    "customer_order_decided": """
        select 2 * o_custkey as src, 2 * o_orderkey + 1 as dst from orders where o_orderstatus <> 'P'""",
    "supplier_nation": """
        select 2 * s_suppkey as src, cast(2 * s_nationkey + 1 as bigint) as dst from supplier""",
    "doc_copies": _star_sql("select doc_id, text as held from documents"),
    "doc_lines": _star_sql(
        f"""
            select doc_id, trim(line) as held
            from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) l
            where length(trim(line)) >= {TELLING_LINE}"""
    ),
}
