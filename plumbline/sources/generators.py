"""Clean demo tables generated from a relation of ids.

A table is described by its attributes: some walk through a small list that is joined by position, some
are drawn from a range by spreading the id, and a few are put together from those. The same ids
always give the same rows, on any number of tasks.
"""

from __future__ import annotations

import datetime as dt
import zlib
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from plumbline.functions.predicates import moment
from plumbline.schemas import CUSTOMERS, ORDERS, PRODUCTS
from plumbline.sources.values import literal_rows

# The dimension lists of the demo data, in index order.
FIRST_NAMES = (
    "Rahul", "Priya", "Amit", "Sneha", "Vikram", "Anita", "Rajesh", "Kavita", "Suresh", "Deepa",
    "Manoj", "Neha", "Arun", "Pooja", "Ravi", "Meera", "Sanjay", "Ritu", "Gaurav", "Swati",
)
LAST_NAMES = (
    "Sharma", "Patel", "Singh", "Kumar", "Gupta", "Reddy", "Nair", "Joshi", "Mehta", "Rao",
    "Das", "Iyer", "Chopra", "Pillai", "Verma",
)
DOMAINS = ("gmail.com", "outlook.com", "yahoo.com", "company.co.in", "hotmail.com")
CITIES = (
    ("Mumbai", "Maharashtra"), ("Delhi", "Delhi"), ("Bangalore", "Karnataka"), ("Chennai", "Tamil Nadu"),
    ("Hyderabad", "Telangana"), ("Pune", "Maharashtra"), ("Kolkata", "West Bengal"), ("Ahmedabad", "Gujarat"),
)
STREETS = ("MG Road", "Park Street", "Brigade Road", "Marine Drive", "Connaught Place")
SEGMENTS = ("Premium", "Standard", "Basic", "Enterprise")
CATEGORIES = (
    ("Electronics", "Phones"), ("Electronics", "Laptops"), ("Electronics", "Tablets"),
    ("Clothing", "Shirts"), ("Clothing", "Pants"), ("Clothing", "Shoes"),
    ("Food & Beverage", "Snacks"), ("Food & Beverage", "Drinks"),
    ("Home & Garden", "Furniture"), ("Home & Garden", "Kitchen"),
    ("Sports", "Cricket"), ("Sports", "Fitness"), ("Books", "Fiction"), ("Books", "Non-Fiction"),
    ("Beauty", "Skincare"),
)
BRANDS = ("BrandA", "BrandB", "BrandC", "BrandD", "BrandE")
PAYMENT_METHODS = ("Credit Card", "Debit Card", "UPI", "Net Banking", "Cash on Delivery")
STATUSES = ("Processing", "Shipped", "Delivered", "Returned", "Cancelled")
ORDER_CITIES = (  # by id modulo 6
    ("Mumbai", "Maharashtra"), ("Delhi", "Delhi"), ("Bangalore", "Karnataka"),
    ("Chennai", "Tamil Nadu"), ("Hyderabad", "Telangana"), ("Pune", "Maharashtra"),
)

# The spread steps through its range by a fixed fraction; the modulus keeps the product in 64 bits.
SPREAD_FACTOR, SPREAD_STEP, SPREAD_MODULUS = 1103515245, 12345, 2147483648


@dataclass(frozen=True)
class Listed:
    """Columns that take the entries of a list in turn, a new one after every `step` ids from `first` on."""

    columns: tuple[str, ...]
    values: Sequence
    step: int = 1
    first: int = 1

    def position(self) -> Column:
        """One-based position of an id's entry."""
        turn = F.col("id") - self.first
        if self.step > 1:
            turn = F.floor(turn / self.step)
        return (turn % len(self.values) + 1).cast("long")

    def entries(self, spark: SparkSession, index: str) -> DataFrame:
        rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(self.values, start=1)]
        return literal_rows(spark, f"{index} bigint, " + ", ".join(f"{c} string" for c in self.columns), rows)


@dataclass(frozen=True)
class Drawn:
    """A column with one of `size` values from `low` on: a number, its hundredth, or a time so many days ago."""

    name: str
    low: int
    size: int
    kind: str = "number"

    def value(self, as_of: dt.date | dt.datetime) -> Column:
        number = spread(F.col("id"), self.name, self.size) + self.low
        if self.kind == "hundredth":
            return number.cast("decimal(10,0)") / 100
        if self.kind == "day":
            return F.date_sub(moment(as_of).cast("date"), number.cast("int"))
        if self.kind == "time":
            return _ago(as_of, number)
        return number


def spread(key: Column, name: str, size: int) -> Column:
    """An even-looking number below `size` for a key; every attribute, by its name, has another."""
    stepped = (key % SPREAD_MODULUS) * SPREAD_FACTOR + zlib.crc32(name.encode()) * SPREAD_STEP
    return F.call_function("div", stepped, F.lit(64).cast("long")) % size


def _ago(as_of: dt.date | dt.datetime, days: Column) -> Column:
    return moment(as_of).cast("timestamp_ntz") - F.make_dt_interval(days.cast("int"))


# The attributes of the demo tables; ranges are fixed values.
CUSTOMER = (
    Listed(("first_name",), FIRST_NAMES), Listed(("last_name",), LAST_NAMES, step=20), Listed(("domain",), DOMAINS),
    Listed(("city", "state"), CITIES), Listed(("street",), STREETS), Listed(("customer_segment",), SEGMENTS),
    Drawn("line", 0, 1_000_000_000), Drawn("date_of_birth", 6000, 25000, "day"), Drawn("registration_date", 0, 2000, "time"),
    Drawn("credit_score", 300, 551), Drawn("annual_income", 100_000, 4_900_000), Drawn("last_login", 0, 30, "time"),
)
PRODUCT = (
    Listed(("category", "sub_category"), CATEGORIES), Listed(("brand",), BRANDS),
    Drawn("unit_price", 50, 9950), Drawn("cost_price", 25, 4975), Drawn("stock_quantity", 10, 491), Drawn("reorder_level", 5, 46),
    Drawn("weight_kg", 10, 2990, "hundredth"), Drawn("created_date", 30, 900, "day"),
)
ORDER = (
    Listed(("payment_method",), PAYMENT_METHODS), Listed(("order_status",), STATUSES),
    Listed(("city", "state"), ORDER_CITIES, first=0), Drawn("age", 0, 730), Drawn("transit", 3, 7), Drawn("quantity", 1, 10),
    Drawn("unit_price", 50, 9950), Drawn("discount_pct", 0, 2500, "hundredth"),
)


def _build(ids: DataFrame, attributes: Sequence, as_of, ddl: str, **composed: Column) -> DataFrame:
    """The attributes of every id, then the columns that are composed of them, in the stored types."""
    for i, listed in enumerate(a for a in attributes if isinstance(a, Listed)):
        # A list of a few entries.
        ids = ids.withColumn(f"k{i}", listed.position()).join(
            F.broadcast(listed.entries(ids.sparkSession, f"k{i}")), f"k{i}").drop(f"k{i}")
    drawn = ids.withColumns({a.name: a.value(as_of) for a in attributes if isinstance(a, Drawn)})
    whole = drawn.withColumns(composed)
    return whole.select(*[F.col(f.name).cast(f.dataType) for f in StructType.fromDDL(ddl).fields])


def customers(ids: DataFrame, as_of: dt.date | dt.datetime) -> DataFrame:
    """Clean customers for a relation with a bigint column `id`."""
    k = F.col("id")
    return _build(
        ids, CUSTOMER, as_of, CUSTOMERS, customer_id=k, country=F.lit("India"), is_active=F.lit(True),
        email=F.concat(F.lower(F.concat_ws(".", "first_name", "last_name")), k, F.lit("@"), "domain"),
        phone=F.concat(F.lit("+91-7"), F.lpad(F.col("line").cast("string"), 9, "0")),
        address=F.concat_ws(" ", k, "street"), postal_code=(k % 300 + 400_001).cast("string"))


def dimension_usage(ids: DataFrame) -> DataFrame:
    """The entries of the customers' lists with the number of ids that fall on each."""
    lists = [(name.removeprefix("customer_"), part, listed) for listed in CUSTOMER if isinstance(listed, Listed)
             for part, name in enumerate(listed.columns)]
    # Every id is read once and folded to one row per entry and list.
    positions = ids.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("dimension"), listed.position().alias("idx")) for name, _, listed in lists
    ])))
    used = positions.groupBy("dimension", "idx").agg(F.count(F.lit(1)).alias("members"))
    entries = literal_rows(ids.sparkSession, "dimension string, idx bigint, value string", [
        (name, i, value[part] if isinstance(value, tuple) else value)
        for name, part, listed in lists for i, value in enumerate(listed.values, start=1)
    ])
    return entries.join(used, ["dimension", "idx"], "left").withColumn(
        "members", F.coalesce("members", F.lit(0).cast("long")))


def products(ids: DataFrame, as_of: dt.date | dt.datetime) -> DataFrame:
    """Clean products for a relation with a bigint column `id`."""
    k = F.col("id")
    return _build(ids, PRODUCT, as_of, PRODUCTS, product_id=k, product_name=F.concat(F.lit("Product_"), k),
                  is_active=F.lit(True), last_updated=moment(as_of))


def orders(ids: DataFrame, as_of: dt.date | dt.datetime, n_customers: int, n_products: int) -> DataFrame:
    """Clean orders that reference customers 1..n_customers and products 1..n_products."""
    k = F.col("id")
    references = (Drawn("customer_id", 1, n_customers), Drawn("product_id", 1, n_products))
    return _build(
        ids, (*ORDER, *references), as_of, ORDERS, order_id=k, country=F.lit("India"),
        order_date=_ago(as_of, F.col("age")), delivery_date=_ago(as_of, F.col("age") - F.col("transit")),
        total_amount=F.col("quantity") * F.col("unit_price"), shipping_address=F.concat("customer_id", F.lit(" Main St")))
