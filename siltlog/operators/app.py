"""The product, order and session store on top of the log: JSON values, prefix lookups, stock accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltlog.functions.fold import ordered_fold
from siltlog.operators.scan import prefix_visible_page

PRODUCT = "sku string, name string, stock long"
ORDER = "id string, user string, sku string, count long"
SESSION = "user string, token string"


def records(live: DataFrame, bucket: str, schema: str) -> DataFrame:
    """The visible values of a bucket, parsed."""
    return live.where(F.col("bucket") == bucket).select("key", F.from_json("value", schema).alias("r")).select("key", "r.*")


def orders_by_user(indexed: DataFrame, user: str, now: int) -> DataFrame:
    """Orders under the keys 'user:order'; a bucket or user without orders gives none."""
    page = prefix_visible_page(indexed, "user_orders", f"{user}:", now=now)
    return page.select(F.split("key", ":")[1].alias("order_key"), F.from_json("value", ORDER).alias("r")).select("order_key", "r.*")


def order_writes(placed: DataFrame, products: DataFrame, orders: DataFrame) -> DataFrame:
    """What each accepted order writes, in one transaction (tx_id) whose last entry has the marker: the product with its
    new stock, the order, and the order under its user. placed: rows of place_orders(); products: (sku, name); orders: (seq, user)."""
    done = placed.where("accepted").join(products, "sku").join(orders, "seq")
    order = F.to_json(F.struct(F.col("seq").cast("string").alias("id"), "user", "sku", "count"))
    product = F.to_json(F.struct("sku", "name", F.col("stock_after").alias("stock")))
    entry = lambda bucket, key, value, last: F.struct(F.lit(bucket).alias("bucket"), key.cast("string").alias("key"), value.alias("value"), F.lit(last).alias("status"))
    three = F.array(entry("products", F.col("sku"), product, 0), entry("orders", F.col("seq"), order, 0), entry("user_orders", F.concat("user", F.lit(":"), F.col("seq").cast("string")), order, 1))
    return done.select(F.col("seq").alias("tx_id"), F.posexplode(three).alias("pos", "e")).select("tx_id", F.col("pos").cast("long").alias("pos"), "e.*")


def place_orders(stock: DataFrame, orders: DataFrame) -> DataFrame:
    """(sku, stock) and (seq, sku, count): orders in sequence per product; accepted while the stock lasts.

    One stream per product: its stock first, then its orders. A product that is not known rejects all and has no stock.
    """
    first = stock.select("sku", F.lit(-1).cast("long").alias("seq"), F.col("stock").cast("long").alias("count"), F.lit(True).alias("is_stock"))
    rest = orders.select("sku", F.col("seq").cast("long").alias("seq"), F.col("count").cast("long").alias("count"), F.lit(False).alias("is_stock"))

    def step(s: dict, row: dict) -> tuple[dict, list[dict]]:
        if row["is_stock"]:
            return {"left": row["count"]}, []
        accepted = s["left"] is not None and s["left"] >= row["count"]
        if accepted:
            s["left"] -= row["count"]
        return s, [{"sku": row["sku"], "seq": row["seq"], "count": row["count"], "accepted": accepted, "stock_after": s["left"] or 0}]

    return ordered_fold(first.unionByName(rest), ["sku"], ["seq"], lambda: {"left": None}, step, "sku string, seq bigint, count bigint, accepted boolean, stock_after bigint")
