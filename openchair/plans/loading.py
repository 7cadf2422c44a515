"""Load one normalized batch: stage it, check everything, then replace its scenario and run."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openchair.operators import normalize, quality
from openchair.params import RunSpec
from openchair.plans.staging import staged
from openchair.schemas import DIMENSIONS
from openchair.sources.tables import replace_scope


def load_batch(
    dims: Mapping[str, DataFrame],
    slots: DataFrame,
    events: DataFrame,
    run: RunSpec,
    config_hash: str,
    root: str,
    strict: bool = True,
    rejects: str | None = None,
) -> None:
    """Write dimensions per scenario and facts per run under ``root``.

    The batch is staged once, so what is checked is what is written. Columns, required values, types, scope, uniqueness and
    references are checked on the whole of it before any table is touched; a batch that fails a rule writes nothing.

    Dimensions are stored in their own types. A row that would lose a value, or has no id, refuses the batch; with a folder
    ``rejects`` it goes there instead, with its column and record, replacing those of the scenario's last load. References are
    then checked without it, so a batch whose facts need a rejected parent is still refused.

    Each table's scope is then replaced, also by no rows, dimensions first, so a reader never meets facts without
    their parents. A failure between two tables leaves the later ones as they were.
    """
    quality.validate_schema(slots, "slots", strict)
    quality.validate_schema(events, "booking_events", strict)
    quality.validate_dimensions(dims)
    if slots.isEmpty():
        raise ValueError("no slots to load")
    slots, events = staged(slots, "slots"), staged(events, "booking_events")
    sent = {name: staged(dims[name], name) for name in DIMENSIONS}
    loaded = {name: normalize.load_dimension(df, name) for name, df in sent.items()}
    lost = reduce(DataFrame.unionByName, (normalize.dimension_rejects(df, name) for name, df in sent.items()))
    scenario = {"scenario_id": run.scenario_id}
    scope = scenario | {"run_id": run.run_id}
    rules = [
        quality.null_rules(slots, "slots"),
        quality.null_rules(events, "booking_events"),
        quality.slot_type_rules(slots),
        quality.event_type_rules(events),
        quality.scope_rules(slots, "slots", scope),
        quality.scope_rules(events, "booking_events", scope),
        *[quality.scope_rules(df, name, scenario) for name, df in sent.items()],
        quality.integrity_rules(loaded, slots, events),
    ]
    if rejects is None:
        rules.append(quality.reject_rules(lost))
    quality.require_clean(reduce(DataFrame.unionByName, rules))
    if rejects is not None:
        replace_scope(lost.withColumn("scenario_id", F.lit(run.scenario_id)), rejects, scenario)
    for name, df in loaded.items():
        replace_scope(df, f"{root}/{name}", scenario)
    facts = {
        "booking_events": normalize.load_events(events, run),
        "slots": normalize.load_slots(slots, run, config_hash),
    }
    for name, df in facts.items():
        replace_scope(df, f"{root}/{name}", scope)
