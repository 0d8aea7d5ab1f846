"""How rules bind to the driver's tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from plumbline.binding import Binding, ForeignKey, ParentDate
from plumbline.operators.scoring import load_weights
from plumbline.plans.scan import Workspace
from plumbline.sources import defects
from plumbline.sources.seed import score_weights
from plumbline.sources.tables import load

AS_OF = dt.date(2024, 6, 1)

# Accepted categories and bindings of the tables under watch.
SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
STATUSES = ("F", "O", "P")
CATEGORIES = ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")

BINDINGS = {
    "customer_dirty": Binding(
        noun="customers",
        allowed={"segment": SEGMENTS},
        phones=("phone",),
        cased=("segment",),
        ranges={"account_score": (0, None)},
        date_floors={"date_of_birth": dt.date(1900, 1, 1)},
    ),
    "orders_dirty": Binding(
        noun="orders",
        foreign_keys=(ForeignKey("customer_id", "customer_dirty", "customer_id", "customers"),),
        allowed={"order_status": STATUSES},
        date_pairs=(("order_date", "delivery_date"),),
        amounts=(("total_amount", "quantity", "unit_price"),),
        ranges={"quantity": (1, 50)},
        date_floors={"order_date": dt.date(1900, 1, 1)},
    ),
    "part_dirty": Binding(
        noun="products",
        allowed={"category": CATEGORIES},
        prices=(("cost_price", "unit_price"),),
    ),
    "lineitem": Binding(
        noun="line items",
        key=("l_orderkey", "l_linenumber"),
        foreign_keys=(
            ForeignKey("l_orderkey", "orders", "o_orderkey", "orders"),
            ForeignKey("l_partkey", "part", "p_partkey", "parts"),
            ForeignKey("l_suppkey", "supplier", "s_suppkey", "suppliers"),
        ),
        parent_dates=(ParentDate("l_shipdate", "l_orderkey", "orders", "o_orderkey", "o_orderdate"),),
    ),
    "events": Binding(noun="events", key=("event_id",), outliers=("value",), freshness={"ts": 30}),
    "events_dirty": Binding(
        noun="events",
        key=("event_id",),
        foreign_keys=(ForeignKey("user_id", "customer", "c_custkey", "users"),),
        allowed={"event_type": EVENT_TYPES},
    ),
}

# The tables a full scan covers.
SCANNED = ("customer_dirty", "lineitem", "orders_dirty", "part_dirty")
BASE_TABLES = (
    "benchmark", "conversations", "customer", "documents", "embeddings", "events", "labels",
    "lineitem", "nation", "orders", "pages", "part", "region", "supplier",
)


DIRTY = {
    "customer_dirty": ("customer", defects.dirty_customers),
    "orders_dirty": ("orders", defects.dirty_orders),
    "part_dirty": ("part", defects.dirty_parts),
    "events_dirty": ("events", defects.dirty_events),
}


class Tables(Mapping):
    """The driver's tables and their dirty views, opened when first asked for."""

    def __init__(self, spark: SparkSession, directory: str):
        self._spark, self._directory, self._opened = spark, directory, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._opened:
            if name in DIRTY:
                source, spoil = DIRTY[name]
                self._opened[name] = spoil(self[source])
            elif name in BASE_TABLES:
                self._opened[name] = load(self._spark, self._directory, name)
            else:
                raise KeyError(name)
        return self._opened[name]

    def __iter__(self):
        return iter((*BASE_TABLES, *DIRTY))

    def __len__(self) -> int:
        return len(BASE_TABLES) + len(DIRTY)


def open_workspace(spark: SparkSession, directory: str) -> Workspace:
    # A row for each dimension, read to build the plan.
    weights = load_weights(score_weights(spark))
    return Workspace(spark, Tables(spark, directory), BINDINGS, AS_OF, weights)
