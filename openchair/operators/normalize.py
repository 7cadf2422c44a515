"""Raw source records to canonical tables, and canonical tables to their stored types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from openchair.functions.ids import stable_id
from openchair.params import RunSpec
from openchair.schemas import BOOKING_EVENTS, DIMENSIONS, SLOTS

# The prefix of each kind of id and the price of a slot without one.
PREFIXES = {
    "business": "biz",
    "provider": "prov",
    "service": "svc",
    "location": "loc",
    "customer": "cus",
}
DEFAULT_PRICE = 100.0

# Each dimension: its own id first, then the ids of its parents.
DIMENSION_IDS = {
    "businesses": ("business",),
    "providers": ("provider", "business", "location"),
    "services": ("service", "business"),
    "locations": ("location", "business"),
    "customers": ("customer", "business"),
}


def _entity_id(entity: str, scenario_id: str) -> Column:
    return stable_id(PREFIXES[entity], F.lit(scenario_id), F.col(f"source_{entity}_id"))


def normalize_dimension(raw: DataFrame, table: str, scenario_id: str) -> DataFrame:
    """Add stable ids of the row and its parents and the scenario tag."""
    ids = {f"{e}_id": _entity_id(e, scenario_id) for e in DIMENSION_IDS[table]}
    return raw.withColumns({**ids, "scenario_id": F.lit(scenario_id)})


def normalize_dimensions(
    raw: Mapping[str, DataFrame], scenario_id: str
) -> dict[str, DataFrame]:
    return {t: normalize_dimension(raw[t], t, scenario_id) for t in DIMENSION_IDS}


def _source_tags(run: RunSpec, source_system: str, source_run_id: str) -> dict[str, Column]:
    return {
        "source_system": F.lit(source_system),
        "source_run_id": F.lit(source_run_id),
        "scenario_id": F.lit(run.scenario_id),
        "run_id": F.lit(run.run_id),
    }


def normalize_slots(
    raw: DataFrame,
    run: RunSpec,
    source_system: str,
    source_run_id: str,
    standard_price: float = DEFAULT_PRICE,
) -> DataFrame:
    start = F.col("slot_start_at").cast("timestamp_ntz")
    end = F.col("slot_end_at").cast("timestamp_ntz")
    seconds = F.timestamp_diff("SECOND", start, end)
    parents = ("provider", "business", "service", "location")
    return raw.withColumns(
        {
            "slot_id": stable_id("slot", F.lit(run.scenario_id), F.col("source_slot_id")),
            **{f"{e}_id": _entity_id(e, run.scenario_id) for e in parents},
            **_source_tags(run, source_system, source_run_id),
            "integration_id": F.lit(source_system),
            "external_slot_id": F.col("source_slot_id"),
            "standard_price": F.lit(standard_price),
            "slot_duration_minutes": F.floor(seconds / F.lit(60)),
        }
    )


def normalize_events(
    raw: DataFrame, slots: DataFrame, run: RunSpec, source_system: str, source_run_id: str
) -> DataFrame:
    """Ids and tags; business, provider and service come from the slot of the event.

    An absent customer stays null. The slot side is unique per id; a slot with very many
    events is cut by AQE, since both sides of the join are plain exchanges.
    """
    customer = F.when(F.col("source_customer_id") != "", F.col("source_customer_id"))
    scenario = F.lit(run.scenario_id)
    events = raw.withColumns(
        {
            "event_id": stable_id("evt", scenario, F.col("source_event_id")),
            "slot_id": stable_id("slot", scenario, F.col("source_slot_id")),
            "customer_id": stable_id("cus", scenario, customer),
            **_source_tags(run, source_system, source_run_id),
        }
    )
    owners = slots.select(
        "slot_id", "business_id", "provider_id", F.col("service_id").alias("service_type")
    )
    return events.join(owners, "slot_id", "left")


def _typed(df: DataFrame, schema: T.StructType, derived: Mapping[str, Column]) -> DataFrame:
    columns = []
    for field in schema.fields:
        value = derived.get(field.name)
        if value is None:
            value = F.col(field.name)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(*columns)


def load_slots(normalized: DataFrame, run: RunSpec, config_hash: str) -> DataFrame:
    """Stored slot layout: types cast, snapshot stamped, availability still empty."""
    derived = {
        "unavailable_at": F.lit(None),
        "current_status": F.lit(None),
        "effective_ts": F.lit(str(run.effective_ts)),
        "config_hash": F.lit(config_hash),
    }
    return _typed(normalized, SLOTS, derived)


def load_events(normalized: DataFrame, run: RunSpec) -> DataFrame:
    return _typed(normalized, BOOKING_EVENTS, {"effective_ts": F.lit(str(run.effective_ts))})


def _losses(table: str) -> Column:
    """What keeps a row of a dimension from its stored layout: values that do not parse, and an absent id.

    An absent value of any other column is stored as null.
    """
    own, *others = DIMENSIONS[table].fields
    kind = "struct<column:string,value:string>"
    lost = [F.when(F.col(own.name).isNull(), F.struct(F.lit(own.name).alias("column"), F.lit(None).cast("string").alias("value")))]
    for field in others:
        value = F.col(field.name)
        if isinstance(field.dataType, T.StringType):
            continue
        broken = value.isNotNull() & value.cast("string").try_cast(field.dataType).isNull()
        lost.append(F.when(broken, F.struct(F.lit(field.name).alias("column"), value.cast("string").alias("value"))))
    return F.filter(F.array(*[column.cast(kind) for column in lost]), lambda x: x.isNotNull())


def load_dimension(normalized: DataFrame, table: str) -> DataFrame:
    """Rows in the stored layout of their dimension. Rows that would lose a value are left to ``dimension_rejects``."""
    fields = [F.col(f.name).cast("string").try_cast(f.dataType).alias(f.name) for f in DIMENSIONS[table]]
    return normalized.where(F.size(_losses(table)) == 0).select(*fields)


def dimension_rejects(normalized: DataFrame, table: str) -> DataFrame:
    """One row for each value that cannot be stored: its dimension, column, text and the whole record as JSON."""
    lost = normalized.select(F.to_json(F.struct("*")).alias("record"), _losses(table).alias("_lost"))
    return lost.select(F.lit(table).alias("dimension"), F.inline("_lost"), "record")


def align_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Give a table of an older layout the columns it lacks, as nulls of the right type."""
    empty = df.sparkSession.createDataFrame([], schema)
    return empty.unionByName(df, allowMissingColumns=True)
