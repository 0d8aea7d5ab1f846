"""Dirty versions of clean tables: defects placed by key, each row read once.

Copies of rows come from exploding a row into two, not from a second scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.binding import col


def _every(key: Column, divisor: int, remainder: int = 0) -> Column:
    return key % divisor == remainder


def _with_copies(df: DataFrame, repeated: Column) -> DataFrame:
    """Every row once, rows where `repeated` holds twice."""
    copies = F.when(repeated, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return df.withColumn("copy_no", F.explode(copies)).drop("copy_no")


def dirty_customers(customer: DataFrame) -> DataFrame:
    k = col("c_custkey")
    text_key = k.cast("string")
    email = (
        F.when(_every(k, 101), None)
        .when(_every(k, 97), "")
        .when(_every(k, 89), "   ")
        .when(_every(k, 83), "not-an-email")
        .when(_every(k, 79), "missing@")
        .otherwise(F.concat(F.lit("user"), text_key, F.lit("@example.com")))
    )
    # Padded to nine digits; longer keys stay whole.
    phone = F.concat(F.lit("+91-7"), F.lpad(text_key, F.greatest(F.lit(9), F.length(text_key)), F.lit("0")))
    dirty = customer.select(
        F.when(~_every(k, 500, 7), k).alias("customer_id"),
        F.when(_every(k, 53), F.concat(F.lit("  "), "c_name", F.lit(" "))).otherwise(col("c_name")).alias("name"),
        email.alias("email"),
        F.when(_every(k, 73), "bad").otherwise(phone).alias("phone"),
        F.when(_every(k, 61), "UNKNOWN").when(_every(k, 47), F.lower("c_mktsegment"))
        .otherwise(col("c_mktsegment")).alias("segment"),
        F.when(_every(k, 211), F.lit("2030-01-01").cast("date"))
        .otherwise(F.lit("1990-01-01").cast("date")).alias("date_of_birth"),
        col("c_acctbal").alias("account_score"),
    )
    return _with_copies(dirty, _every(col("customer_id"), 250, 3))


def dirty_orders(orders: DataFrame) -> DataFrame:
    k, ordered = col("o_orderkey"), col("o_orderdate")
    future, early = _every(k, 311), _every(k, 149)
    quantity = F.when(_every(k, 199), F.lit(-3).cast("long")).otherwise(1 + k % 10)
    price = 50 + k % 9950
    surplus = F.when(_every(k, 157), 1).otherwise(0)
    dirty = orders.select(
        F.when(~_every(k, 1009, 5), k).alias("order_id"),
        F.when(_every(k, 173), None).when(_every(k, 131), col("o_custkey") + 1_000_000)
        .otherwise(col("o_custkey")).alias("customer_id"),
        F.when(future, ordered + F.expr("INTERVAL '40' YEAR")).otherwise(ordered).alias("order_date"),
        F.when(early, ordered - F.expr("INTERVAL '5' DAY"))
        .when(future, ordered + F.expr("INTERVAL '41' YEAR"))
        .otherwise(ordered + F.expr("INTERVAL '3' DAY")).alias("delivery_date"),
        quantity.alias("quantity"),
        price.cast("decimal(10,2)").alias("unit_price"),
        (quantity * price + surplus).cast("decimal(12,2)").alias("total_amount"),
        F.when(_every(k, 113), None).when(_every(k, 109), "X").otherwise(col("o_orderstatus")).alias("order_status"),
    )
    return _with_copies(dirty, _every(col("order_id"), 401))


def dirty_parts(part: DataFrame) -> DataFrame:
    k, price = col("p_partkey"), col("p_retailprice")
    return part.select(
        k.alias("product_id"),
        col("p_name").alias("product_name"),
        F.when(_every(k, 59), "OTHER").when(_every(k, 43), None).otherwise(col("p_type")).alias("category"),
        F.when(_every(k, 67), -price).otherwise(price).alias("unit_price"),
        (price * F.when(_every(k, 71), 1.25).otherwise(0.5)).alias("cost_price"),
    )


def dirty_events(events: DataFrame) -> DataFrame:
    """Works on a stream as well: no join, no second read."""
    k = col("event_id")
    dirty = events.select(
        k,
        col("ts"),
        F.when(_every(k, 173), None).when(_every(k, 131), col("user_id") + 1_000_000)
        .otherwise(col("user_id")).alias("user_id"),
        F.when(_every(k, 113), None).when(_every(k, 109), "").when(_every(k, 107), " click ")
        .when(_every(k, 103), "UNKNOWN").otherwise(col("event_type")).alias("event_type"),
        F.when(_every(k, 199), -col("value")).otherwise(col("value")).alias("amount"),
    )
    return _with_copies(dirty, _every(k, 401))
