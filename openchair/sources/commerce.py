"""Adapter: order tables as slots, line items as booking events.

The only module that knows the input tables. Orders are slots and each line item is one
event of its order's slot, so everything below grows with the given tables.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openchair.functions.calendar import instant
from openchair.operators.snapshot import assign_runs
from openchair.params import RunSpec

# How orders map to providers, businesses and locations.
PROVIDERS = 150
BUSINESSES = 10
LOCATIONS = 10
LEAD_HOURS = 1440
VISIBLE_DAYS = 90
LATEST_HOUR = 17

# Earliest and latest slot start that a query needs; None leaves a side open.
Starts = tuple[datetime | None, datetime | None]
ALL: Starts = (None, None)


def visible_starts(runs: Sequence[RunSpec]) -> Starts:
    """Bounds on the starts of slots published by the last snapshot."""
    return None, max(run.effective_ts for run in runs) + timedelta(days=VISIBLE_DAYS)


def seen_starts(runs: Sequence[RunSpec]) -> Starts:
    """Bounds on the starts of slots with an event by the last snapshot."""
    return None, max(run.effective_ts for run in runs) + timedelta(hours=LEAD_HOURS)


def trailing_starts(runs: Sequence[RunSpec], days: int) -> Starts:
    times = [run.effective_ts for run in runs]
    return min(times) - timedelta(days=days), max(times)


def _orders(spark: SparkSession, sf_dir: str, starts: Starts = ALL) -> DataFrame:
    """Orders as slots. ``starts`` becomes a plain bound on the order date, which reaches the scan."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    low, high = starts
    if low is not None:
        rows = rows.where(F.col("o_orderdate") >= instant(str(low - timedelta(hours=LATEST_HOUR))))
    if high is not None:
        rows = rows.where(F.col("o_orderdate") <= instant(str(high)))
    return rows.selectExpr(
        "o_orderkey",
        "o_custkey",
        "o_totalprice",
        "o_orderpriority",
        "o_orderdate + make_dt_interval(0, CAST(9 + 2 * pmod(o_orderkey, 5) AS INT))"
        " AS slot_start_at",
    )


SLOT_EXPRESSIONS = {
    "slot_id": "concat('slot_', o_orderkey)",
    "provider_id": f"concat('prov_', pmod(o_custkey, {PROVIDERS}))",
    "business_id": f"concat('biz_', pmod(o_custkey, {BUSINESSES}))",
    "service_id": "concat('svc_', substring(o_orderpriority, 1, 1))",
    "location_id": f"concat('loc_', pmod(o_custkey, {LOCATIONS}))",
    "slot_start_at": "slot_start_at",
    "slot_end_at": "slot_start_at + INTERVAL 60 MINUTES",
    "visible_at": f"slot_start_at - INTERVAL {VISIBLE_DAYS} DAYS",
}

# Type and time of the event of a line item, and a key unique over line items.
_EVENT_TYPE = """CASE WHEN pmod(l_suppkey, 20) = 0 THEN 'removed'
    WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'completed'
    WHEN l_returnflag = 'R' THEN 'canceled'
    WHEN l_linestatus = 'F' AND pmod(l_suppkey, 2) = 1 THEN 'no_show'
    WHEN l_linestatus = 'F' THEN 'rescheduled'
    ELSE 'booked' END"""
# Orders and line items meet on the slot id, so that events lie by slot for all that follows.
_SLOT_OF_ITEM, _SLOT_OF_ORDER = "concat('slot_', l_orderkey)", "concat('slot_', o_orderkey)"
EVENT_EXPRESSIONS = {
    "event_id": "concat_ws('_', 'evt', l_orderkey, l_linenumber, l_partkey, l_suppkey,"
    " floor(l_extendedprice * 100 + 0.5D))",
    "slot_id": _SLOT_OF_ITEM,
    "event_type": "event_type",
    "event_at": f"""IF(event_type IN ('completed', 'no_show'),
      slot_start_at + INTERVAL 1 HOUR,
      slot_start_at - make_dt_interval(0, CAST(1 + pmod(l_partkey, {LEAD_HOURS}) AS INT)))""",
}


def _named(expressions: dict[str, str], prefix: str = "") -> list[str]:
    return [f"{expression} AS {prefix}{name}" for name, expression in expressions.items()]


def _line_items(spark: SparkSession, sf_dir: str, starts: Starts = ALL) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        f"{_EVENT_TYPE} AS event_type",
    )
    orders = _orders(spark, sf_dir, starts).select("o_orderkey", "o_custkey", "slot_start_at")
    # A line item without its order stays, so that the rules can report it.
    how = "left" if starts == ALL else "inner"
    return items.join(orders, F.expr(f"{_SLOT_OF_ITEM} = {_SLOT_OF_ORDER}"), how)


def slot_feed(spark: SparkSession, sf_dir: str, starts: Starts = ALL) -> DataFrame:
    """Every slot once, for any number of runs that look at it."""
    return _orders(spark, sf_dir, starts).selectExpr(
        *_named(SLOT_EXPRESSIONS),
        "o_totalprice AS standard_price",
        "60 AS slot_duration_minutes",
    )


def event_feed(spark: SparkSession, sf_dir: str, starts: Starts = ALL) -> DataFrame:
    """Every event once, for any number of runs that look at it."""
    return _line_items(spark, sf_dir, starts).selectExpr(*_named(EVENT_EXPRESSIONS))


def slots(
    spark: SparkSession, sf_dir: str, runs: Sequence[RunSpec], starts: Starts = ALL
) -> DataFrame:
    return assign_runs(slot_feed(spark, sf_dir, starts), runs)


def events(
    spark: SparkSession, sf_dir: str, runs: Sequence[RunSpec], starts: Starts = ALL
) -> DataFrame:
    return assign_runs(event_feed(spark, sf_dir, starts), runs)


def raw_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots as a source system would send them: own ids, times as text."""
    ids = {n: e for n, e in SLOT_EXPRESSIONS.items() if n.endswith("_id")}
    times = {
        n: f"CAST({SLOT_EXPRESSIONS[n]} AS STRING)"
        for n in ("slot_start_at", "slot_end_at", "visible_at")
    }
    times["created_at"] = times["visible_at"]
    return _orders(spark, sf_dir).selectExpr(*_named(ids, "source_"), *_named(times))


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sent: a removal has no customer."""
    return _line_items(spark, sf_dir).selectExpr(
        f"{EVENT_EXPRESSIONS['event_id']} AS source_event_id",
        f"{EVENT_EXPRESSIONS['slot_id']} AS source_slot_id",
        "IF(event_type <> 'removed', concat('cust_', o_custkey), NULL) AS source_customer_id",
        "event_type",
        f"CAST({EVENT_EXPRESSIONS['event_at']} AS STRING) AS event_at",
    )


def raw_dimensions(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Businesses, providers, services, locations and customers behind the orders."""
    keyed = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr(
        f"concat('biz_', pmod(c_custkey, {BUSINESSES})) AS source_business_id",
        f"concat('prov_', pmod(c_custkey, {PROVIDERS})) AS source_provider_id",
        f"concat('loc_', pmod(c_custkey, {LOCATIONS})) AS source_location_id",
        "concat('cust_', c_custkey) AS source_customer_id",
        "c_mktsegment AS first_name",
        "c_name AS last_name",
    )

    def named(df: DataFrame, source: str) -> DataFrame:
        return df.withColumn("name", F.concat(F.lit("Name of "), F.col(source)))

    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    services = (
        orders.selectExpr("substring(o_orderpriority, 1, 1) AS digit")
        .distinct()
        .selectExpr(
            "concat('svc_', digit) AS source_service_id",
            "concat('biz_', digit) AS source_business_id",
            "60 AS duration_minutes",
        )
    )
    providers = keyed.select(
        "source_provider_id", "source_business_id", "source_location_id"
    ).distinct()
    locations = keyed.select("source_location_id", "source_business_id").distinct()
    return {
        "businesses": named(keyed.select("source_business_id").distinct(), "source_business_id"),
        "providers": named(providers, "source_provider_id"),
        "services": named(services, "source_service_id"),
        "locations": named(locations, "source_location_id"),
        "customers": keyed.select(
            "source_customer_id", "source_business_id", "first_name", "last_name"
        ),
    }


def feed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain event table offered as a booking feed, for the type checks."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("user_id").cast("string").alias("slot_id"),
        "event_type",
        F.col("ts").cast("string").alias("event_at"),
    )
