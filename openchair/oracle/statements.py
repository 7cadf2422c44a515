"""One SQL statement per named query."""

from __future__ import annotations

from openchair.oracle.steps import FULL_WEEKDAYS, THREE_RUNS, hours, r, statement

KEY = "scenario_id, run_id, slot_id"


def _id(prefix: str, source: str) -> str:
    return f"'{prefix}_' || substr(sha256('scn_main|' || {source}), 1, 16)"


def _rounded(*columns: str) -> str:
    return ", ".join(f"{r(c)} AS {c}" for c in columns)


STRICT = {"excluded": "'svc_5'", "floor": 0.85}

# Raw records as the source system sends them ---------------------------------------------

RAW_SLOTS = """
  SELECT slot_id AS source_slot_id, provider_id AS source_provider_id,
         business_id AS source_business_id, service_id AS source_service_id,
         location_id AS source_location_id, slot_start_at::VARCHAR AS slot_start_at,
         slot_end_at::VARCHAR AS slot_end_at, visible_at::VARCHAR AS visible_at,
         visible_at::VARCHAR AS created_at
  FROM booking_slots
"""

RAW_EVENTS = """
  SELECT event_id AS source_event_id, slot_id AS source_slot_id,
         CASE WHEN event_type <> 'removed' THEN 'cust_' || o_custkey END AS source_customer_id,
         event_type, event_at::VARCHAR AS event_at
  FROM booking_events
"""

_TAGS = """'orders_feed' AS source_system, 'feed_001' AS source_run_id,
         'scn_main' AS scenario_id, 'run_19980601' AS run_id"""

NORMAL_SLOTS = f"""
  SELECT raw.*, {_id('slot', 'source_slot_id')} AS slot_id,
         {_id('prov', 'source_provider_id')} AS provider_id,
         {_id('biz', 'source_business_id')} AS business_id,
         {_id('svc', 'source_service_id')} AS service_id,
         {_id('loc', 'source_location_id')} AS location_id,
         {_TAGS}, 'orders_feed' AS integration_id, source_slot_id AS external_slot_id,
         100.0::DOUBLE AS standard_price,
         date_diff('second', slot_start_at::TIMESTAMP, slot_end_at::TIMESTAMP) // 60
           AS slot_duration_minutes
  FROM ({RAW_SLOTS}) raw
"""

NORMAL_EVENTS = f"""
  SELECT e.*, {_id('evt', 'e.source_event_id')} AS event_id,
         {_id('slot', 'e.source_slot_id')} AS slot_id,
         CASE WHEN e.source_customer_id IS NOT NULL
              THEN {_id('cus', 'e.source_customer_id')} END AS customer_id,
         {_TAGS}, s.business_id, s.provider_id, s.service_id AS service_type
  FROM ({RAW_EVENTS}) e
  LEFT JOIN ({NORMAL_SLOTS}) s ON s.source_slot_id = e.source_slot_id
"""

DIMENSIONS = {
    "businesses": f"""
      SELECT DISTINCT 'businesses' AS dimension,
             {_id('biz', "('biz_' || (c_custkey % 10))")} AS entity_id,
             {_id('biz', "('biz_' || (c_custkey % 10))")} AS business_id, '-' AS location_id
      FROM customer""",
    "providers": f"""
      SELECT DISTINCT 'providers', {_id('prov', "('prov_' || (c_custkey % 150))")},
             {_id('biz', "('biz_' || (c_custkey % 10))")},
             {_id('loc', "('loc_' || (c_custkey % 10))")}
      FROM customer""",
    "services": f"""
      SELECT DISTINCT 'services', {_id('svc', "('svc_' || substr(o_orderpriority, 1, 1))")},
             {_id('biz', "('biz_' || substr(o_orderpriority, 1, 1))")}, '-'
      FROM orders""",
    "locations": f"""
      SELECT DISTINCT 'locations', {_id('loc', "('loc_' || (c_custkey % 10))")},
             {_id('biz', "('biz_' || (c_custkey % 10))")}, '-'
      FROM customer""",
    "customers": f"""
      SELECT 'customers', {_id('cus', "('cust_' || c_custkey)")},
             {_id('biz', "('biz_' || (c_custkey % 10))")}, '-'
      FROM customer""",
}

_SENT_SERVICES = """
  SELECT *, TRY_CAST(sent AS INTEGER) AS duration_minutes FROM (
    SELECT digit, CASE digit WHEN '1' THEN 'sixty' WHEN '2' THEN '99999999999' WHEN '3' THEN NULL ELSE '60' END AS sent
    FROM (SELECT DISTINCT substr(o_orderpriority, 1, 1) AS digit FROM orders))
"""
_SENT_CUSTOMERS = """
  SELECT *, 'biz_' || (c_custkey % 10) AS biz, 'loc_' || (c_custkey % 10) AS loc,
         'prov_' || (c_custkey % 150) AS prov
  FROM customer
"""


def _dimension(table: str, entity: str, source: str, location: str, named: bool, rows: str) -> str:
    name = "'Name of ' || name_of" if named else "NULL"
    return f"""SELECT DISTINCT '{table}' AS dimension, {_id(entity, source)} AS entity_id, {_id('biz', 'biz')} AS business_id,
      {location} AS location_id, {name} AS name, first_name, last_name, duration_minutes, 'scn_main' AS scenario_id
    FROM (SELECT *, {source} AS name_of FROM ({rows}))"""


def _of_customers(first: str = "NULL", last: str = "NULL", where: str = "true") -> str:
    return f"""SELECT biz, loc, prov, c_custkey, {first} AS first_name, {last} AS last_name, NULL::INT AS duration_minutes
      FROM ({_SENT_CUSTOMERS}) WHERE {where}"""


LOAD_DIMS = " UNION ALL ".join(
    [
        _dimension("businesses", "biz", "biz", "NULL", True, _of_customers()),
        _dimension("providers", "prov", "prov", _id("loc", "loc"), True, _of_customers()),
        _dimension(
            "services",
            "svc",
            "svc",
            "NULL",
            True,
            f"""SELECT 'svc_' || digit AS svc, 'biz_' || digit AS biz, NULL AS first_name, NULL AS last_name, duration_minutes
              FROM ({_SENT_SERVICES}) WHERE sent IS NULL OR duration_minutes IS NOT NULL""",
        ),
        _dimension("locations", "loc", "loc", _id("loc", "loc"), True, _of_customers()),
        _dimension(
            "customers",
            "cus",
            "'cust_' || c_custkey",
            "NULL",
            False,
            _of_customers("c_mktsegment", "c_name", "c_mktsegment <> 'BUILDING'"),
        ),
    ]
)

LOAD_REJECTS = f"""
  SELECT 'services' AS dimension, 'duration_minutes' AS column_name, sent AS sent_value,
         'biz_' || digit AS source_business_id, NULL AS last_name
  FROM ({_SENT_SERVICES}) WHERE sent IS NOT NULL AND duration_minutes IS NULL
  UNION ALL
  SELECT 'customers', 'customer_id', NULL, biz, c_name FROM ({_SENT_CUSTOMERS}) WHERE c_mktsegment = 'BUILDING'
"""

# Data quality ------------------------------------------------------------------------------


def _null_rule(table: str, source: str, column: str) -> str:
    return (
        f"SELECT '{table}.{column} is null' AS rule, count(*) FILTER (WHERE {column} IS NULL)"
        f" AS bad_rows FROM ({source})"
    )


NULL_RULES = " UNION ALL ".join(
    [
        _null_rule("slots", NORMAL_SLOTS, c)
        for c in ("slot_id", "provider_id", "business_id", "slot_start_at", "scenario_id", "run_id")
    ]
    + [
        _null_rule("booking_events", NORMAL_EVENTS, c)
        for c in ("event_id", "slot_id", "event_type", "event_at", "scenario_id", "run_id")
    ]
)


def _parse_rule(column: str, kind: str, word: str) -> str:
    return (
        f"SELECT 'slots.{column} is no {word}' AS rule, count(*) FILTER ("
        f"WHERE try_cast({column} AS {kind}) IS NULL) AS bad_rows FROM ({NORMAL_SLOTS})"
    )


TYPE_RULES = " UNION ALL ".join(
    [
        _parse_rule(c, "TIMESTAMP", "timestamp")
        for c in ("slot_start_at", "slot_end_at", "visible_at", "created_at")
    ]
    + [_parse_rule(c, "DOUBLE", "number") for c in ("slot_duration_minutes", "standard_price")]
    + [
        """SELECT 'booking_events.event_at is no timestamp',
                  count(*) FILTER (WHERE try_cast(ts::VARCHAR AS TIMESTAMP) IS NULL) FROM events""",
        """SELECT 'booking_events.event_type is unknown',
                  count(*) FILTER (WHERE event_type NOT IN ('booked', 'canceled', 'removed',
                    'completed', 'no_show', 'rescheduled')) FROM events""",
    ]
)

_CUSTOMER_PARENTS = {
    "business": "SELECT DISTINCT 'biz_' || (c_custkey % 10) AS id FROM customer",
    "provider": "SELECT DISTINCT 'prov_' || (c_custkey % 150) AS id FROM customer",
    "location": "SELECT DISTINCT 'loc_' || (c_custkey % 10) AS id FROM customer",
    "service": "SELECT DISTINCT 'svc_' || substr(o_orderpriority, 1, 1) AS id FROM orders",
    "customer": "SELECT 'cust_' || c_custkey AS id FROM customer",
}


def _orphan_rule(rule: str, references: str, parent: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, count(*) AS bad_rows FROM ({references}) AS x(ref)"
        f" WHERE NOT EXISTS (SELECT 1 FROM ({parent}) AS p(id) WHERE p.id = x.ref)"
    )


_BUSINESS = _CUSTOMER_PARENTS["business"]
_PROVIDERS = """SELECT DISTINCT 'prov_' || (c_custkey % 150) AS p, 'biz_' || (c_custkey % 10) AS b,
                       'loc_' || (c_custkey % 10) AS l FROM customer"""
INTEGRITY_RULES = " UNION ALL ".join(
    [
        "SELECT 'slot id is duplicated' AS rule, count(*) - count(DISTINCT slot_id) AS bad_rows"
        " FROM booking_slots",
        "SELECT 'event id is duplicated', count(*) - count(DISTINCT event_id) FROM booking_events",
        _orphan_rule(
            "provider has unknown location",
            f"SELECT l FROM ({_PROVIDERS})",
            _CUSTOMER_PARENTS["location"],
        ),
        _orphan_rule("provider has unknown business", f"SELECT b FROM ({_PROVIDERS})", _BUSINESS),
        _orphan_rule(
            "service has unknown business",
            "SELECT DISTINCT 'biz_' || substr(o_orderpriority, 1, 1) FROM orders",
            _BUSINESS,
        ),
        _orphan_rule("location has unknown business", _BUSINESS, _BUSINESS),
        _orphan_rule(
            "customer has unknown business",
            "SELECT 'biz_' || (c_custkey % 10) FROM customer",
            _BUSINESS,
        ),
    ]
    + [
        _orphan_rule(
            f"slot has unknown {e}",
            f"SELECT source_{e}_id FROM ({RAW_SLOTS})",
            _CUSTOMER_PARENTS[e],
        )
        for e in ("provider", "service", "location")
    ]
    + [
        _orphan_rule(
            "event has unknown slot",
            "SELECT slot_id FROM booking_events",
            "SELECT slot_id FROM booking_slots",
        ),
        _orphan_rule(
            "event has unknown customer",
            f"SELECT source_customer_id FROM ({RAW_EVENTS}) WHERE source_customer_id IS NOT NULL",
            _CUSTOMER_PARENTS["customer"],
        ),
        "SELECT 'slot is visible after its start', count(*) FROM booking_slots"
        " WHERE visible_at > slot_start_at",
    ]
)

# The same rules over a batch with faults, each counted from the tables it was made of.
_SENT = {
    "business": f"SELECT id FROM ({_BUSINESS}) WHERE id <> 'biz_1'",
    "provider": _CUSTOMER_PARENTS["provider"],
    "location": f"SELECT id FROM ({_CUSTOMER_PARENTS['location']}) WHERE id <> 'loc_2'",
    "service": f"SELECT id FROM ({_CUSTOMER_PARENTS['service']}) WHERE id <> 'svc_3'",
    "customer": "SELECT 'cust_' || c_custkey AS id FROM customer WHERE c_mktsegment <> 'BUILDING'",
}
_SENT_SLOTS = """
  SELECT slot_id, provider_id, service_id, location_id, visible_at, slot_start_at FROM booking_slots
  UNION ALL
  SELECT slot_id, 'prov_none', service_id, location_id, slot_end_at, slot_start_at FROM booking_slots
  WHERE service_id = 'svc_1'
"""
_SENT_EVENTS = """
  SELECT event_id, CASE WHEN event_type = 'removed' THEN 'slot_none' ELSE slot_id END AS slot_id,
         CASE WHEN event_type <> 'removed' THEN 'cust_' || o_custkey END AS customer_id
  FROM booking_events, range(2) copies(copy) WHERE copy = 0 OR event_type = 'no_show'
"""
INTEGRITY_FAULTS = " UNION ALL ".join(
    [
        f"SELECT 'slot id is duplicated' AS rule, count(*) - count(DISTINCT slot_id) AS bad_rows FROM ({_SENT_SLOTS})",
        f"SELECT 'event id is duplicated', count(*) - count(DISTINCT event_id) FROM ({_SENT_EVENTS})",
        _orphan_rule("provider has unknown location", f"SELECT l FROM ({_PROVIDERS})", _SENT["location"]),
        _orphan_rule("provider has unknown business", f"SELECT b FROM ({_PROVIDERS})", _SENT["business"]),
        _orphan_rule(
            "service has unknown business",
            f"SELECT 'biz_' || substr(id, 5) FROM ({_SENT['service']})",
            _SENT["business"],
        ),
        _orphan_rule(
            "location has unknown business",
            f"SELECT 'biz_' || substr(id, 5) FROM ({_SENT['location']})",
            _SENT["business"],
        ),
        _orphan_rule(
            "customer has unknown business",
            "SELECT 'biz_' || (c_custkey % 10) FROM customer WHERE c_mktsegment <> 'BUILDING'",
            _SENT["business"],
        ),
        *[
            _orphan_rule(f"slot has unknown {e}", f"SELECT {e}_id FROM ({_SENT_SLOTS})", _SENT[e])
            for e in ("provider", "service", "location")
        ],
        _orphan_rule(
            "event has unknown slot", f"SELECT slot_id FROM ({_SENT_EVENTS})", "SELECT slot_id AS id FROM booking_slots"
        ),
        _orphan_rule(
            "event has unknown customer",
            f"SELECT customer_id FROM ({_SENT_EVENTS}) WHERE customer_id IS NOT NULL",
            _SENT["customer"],
        ),
        f"SELECT 'slot is visible after its start', count(*) FROM ({_SENT_SLOTS}) WHERE visible_at > slot_start_at",
    ]
)

GATE = f"""
  SELECT count(*) AS rules, count(*) FILTER (WHERE bad_rows > 0) AS failed_rules,
         sum(bad_rows)::BIGINT AS bad_rows, bool_and(bad_rows = 0) AS accepted
  FROM ({NULL_RULES} UNION ALL {TYPE_RULES} UNION ALL {INTEGRITY_RULES})
"""


def _repeated(rule: str, keys: str, source: str) -> str:
    return (
        f"SELECT '{rule}' AS rule, count(*) AS bad_rows FROM ("
        f"SELECT 1 FROM {source} GROUP BY {keys} HAVING count(*) > 1)"
    )


VERSIONED = f"{KEY}, feature_snapshot_version"
DUPLICATES = " UNION ALL ".join(
    [
        _repeated("cohort_baselines", "run_id, feature_snapshot_version, cohort_id", "cohorts"),
        _repeated("feature_snapshots", VERSIONED, "features"),
        _repeated("underbooking_outputs", VERSIONED, "flagged"),
        _repeated("business_calibrations", "run_id, business_id", "calibrations"),
        _repeated("scoring_outputs", VERSIONED, "scored"),
        _repeated("pricing_actions", KEY, "decisions"),
        _repeated("slots_over_all_runs", "slot_id", "booking_slots"),
    ]
)

_UNIT_SCORES = (
    "booking_probability",
    "calibrated_booking_probability",
    "predicted_fill_by_start",
    "shortfall_score",
    "confidence_score",
)
RANGES = " UNION ALL ".join(
    [
        f"SELECT '{c} outside 0 to 1' AS rule,"
        f" count(*) FILTER (WHERE {c} NOT BETWEEN 0 AND 1) AS bad_rows FROM scored"
        for c in _UNIT_SCORES
    ]
    + [
        "SELECT 'calibration_factor out of bounds', count(*) FILTER ("
        "WHERE calibration_factor NOT BETWEEN 0.1 AND 2.0) FROM calibrations",
        "SELECT 'slot ends before it is visible', count(*) FILTER ("
        "WHERE visible_at > unavailable_at) FROM known_slots",
    ]
)

READINESS = """
  SELECT *, slots > 0 AS slots_loaded, open_slots = 0 OR scores > 0 AS scoring_complete,
         open_slots = 0 OR (scores > 0 AND calibrations > 0) AS ready_to_recommend,
         slots > 0 AND features > 0 AND actions > 0 AS ready_to_evaluate
  FROM (
    SELECT k.scenario_id, k.run_id, count(*) AS slots,
           count(*) FILTER (WHERE current_status = 'open' AND slot_start_at >= effective_ts)
             AS open_slots,
           (SELECT count(*) FROM features x WHERE x.run_id = k.run_id) AS features,
           (SELECT count(*) FROM scored x WHERE x.run_id = k.run_id) AS scores,
           (SELECT count(*) FROM calibrations x WHERE x.run_id = k.run_id) AS calibrations,
           (SELECT count(*) FROM decisions x WHERE x.run_id = k.run_id) AS actions
    FROM known_slots k GROUP BY 1, 2)
"""


def _correlation(x: str, y: str) -> str:
    """Over the discounted rows only."""
    discounted = "FILTER (WHERE action_value > 0)"
    return (
        f"covar_pop({x}, {y}) {discounted}"
        f" / nullif(stddev_pop({x}) {discounted} * stddev_pop({y}) {discounted}, 0)"
    )


def _policy_rule(rule: str, condition: str) -> str:
    return (
        f"SELECT scenario_id, run_id, '{rule}' AS rule,"
        f" count(*) FILTER (WHERE {condition}) AS bad_rows FROM decisions GROUP BY 1, 2"
    )


POLICY = " UNION ALL ".join(
    [
        _policy_rule(
            "required field is missing",
            "action_type IS NULL OR action_value IS NULL OR decision_timestamp IS NULL"
            " OR confidence_score IS NULL OR rationale_codes IS NULL",
        ),
        _policy_rule(
            "action is not permitted",
            "NOT (list_contains(eligible, action_value::INT)"
            " AND action_value::INT IN (0, 5, 10, 15, 20))",
        ),
        _policy_rule(
            "healthy slot is discounted",
            "NOT underbooked AND NOT was_exploration AND action_value <> 0",
        ),
        _policy_rule(
            "excluded service is discounted", "service_id = 'svc_5' AND action_value > 0"
        ),
        _policy_rule(
            "price is below the floor",
            "standard_price * (1.0 - action_value / 100.0) < standard_price * 0.85 - 1e-9",
        ),
        f"""SELECT scenario_id, run_id, 'discounts fall with severity',
              coalesce({_correlation('shortfall_score', 'action_value')} < -0.25, false)::BIGINT
            FROM decisions GROUP BY 1, 2""",
    ]
)

# Evaluation --------------------------------------------------------------------------------

SIMILAR = """
  SELECT p.run_id, avg(CASE
           WHEN avg_action = 0 THEN CASE WHEN coalesce(std_action, 0) = 0 THEN 1.0 ELSE 0.0 END
           ELSE greatest(0.0, 1.0 - coalesce(std_action, 0.0) / avg_action) END) AS score
  FROM (
    SELECT run_id, provider_id, service_id, time_of_day_bucket, avg(action_value) AS avg_action,
           stddev_samp(action_value) AS std_action
    FROM decisions GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2) p
  GROUP BY 1
"""


def _metric(name: str, value: str) -> str:
    return (
        f"SELECT scenario_id, run_id, '{name}' AS metric_name,"
        f" {r(f'coalesce(({value})::DOUBLE, 0.0)')} AS metric_value FROM runs"
    )


def _flag_share(condition: str, source: str) -> str:
    return (
        f"SELECT avg(CASE WHEN {condition} THEN 1.0 ELSE 0.0 END) FROM {source} x"
        " WHERE x.run_id = runs.run_id"
    )


def _rows(source: str) -> str:
    return f"SELECT count(*) FROM {source} x WHERE x.run_id = runs.run_id"


_COMPLIES = "list_contains(eligible, action_value::INT)"
EVALUATION = " UNION ALL ".join(
    [
        _metric("core_slots_count", _rows("booking_slots")),
        _metric("feature_snapshot_count", _rows("features")),
        _metric("scoring_output_count", _rows("scored")),
        _metric("pricing_action_count", _rows("decisions")),
        _metric("underbooked_rate", _flag_share("underbooked", "flagged")),
        _metric("discounted_action_rate", _flag_share("action_value > 0", "decisions")),
        _metric(
            "healthy_zero_rate",
            _flag_share("NOT underbooked AND action_value = 0", "decisions"),
        ),
        _metric("rationale_coverage", _flag_share("rationale_codes <> '[]'", "decisions")),
        _metric("eligible_discount_compliance_rate", _flag_share(_COMPLIES, "decisions")),
        _metric(
            "discount_shortfall_correlation",
            f"SELECT {_correlation('action_value', 'shortfall_score')} FROM decisions x"
            " WHERE x.run_id = runs.run_id",
        ),
        _metric(
            "low_demand_flag_rate",
            _flag_share("pace_gap_normalized >= 0.30 AND underbooked", "flagged"),
        ),
        _metric(
            "healthy_overflag_rate",
            _flag_share("pace_gap_normalized <= 0.05 AND underbooked", "flagged"),
        ),
        _metric(
            "eligible_underbooked_discount_rate",
            _flag_share(f"underbooked AND {_COMPLIES} AND action_value > 0", "decisions"),
        ),
        _metric(
            "similar_slot_action_consistency",
            f"coalesce((SELECT score FROM ({SIMILAR}) x WHERE x.run_id = runs.run_id), 1.0)",
        ),
    ]
)

RUN_SUMMARY = f"""
  SELECT scenario_id, run_id, ({_rows('booking_slots')}) AS total_slots,
         (SELECT count(*) FROM flagged x WHERE x.run_id = runs.run_id AND underbooked)
           AS underbooked_slots,
         ({_rows('scored')}) AS scored_slots, ({_rows('decisions')}) AS pricing_actions,
         coalesce({r(f"({_flag_share('was_exploration', 'decisions')})")}, 0.0)
           AS exploration_share_observed
  FROM runs
"""

# Explorer ----------------------------------------------------------------------------------

RECOMMENDATIONS = f"""
  SELECT {KEY}, business_id, provider_id, service_id, effective_lead_time_band, underbooked,
         {_rounded('severity_score')}, action_value AS recommended_discount,
         {_rounded('standard_price')},
         {r('floor(standard_price * (1 - action_value / 100.0) * 100 + 0.5) / 100.0')}
           AS implied_price,
         rationale_codes, was_exploration
  FROM decisions
"""


def _counts(column: str, alias: str, where: str = "true") -> str:
    return (
        f"SELECT scenario_id, run_id, {column} AS {alias}, count(*) AS recommendation_count"
        f" FROM decisions WHERE {where} GROUP BY 1, 2, 3"
    )


_MODEL_INPUTS = (
    "hours_until_slot",
    "hist_fill_rate_similar",
    "fill_rate_provider_service",
    "fill_rate_business_service",
    "expected_booking_pace_per_day",
    "observed_booking_pace_per_day",
    "pace_deviation",
    "provider_utilization_7d",
    "provider_utilization_14d",
    "provider_utilization_28d",
    "business_fill_trend",
    "cohort_fill_rate",
)
_SCORES = (
    "booking_probability",
    "calibrated_booking_probability",
    "predicted_fill_by_start",
    "shortfall_score",
    "confidence_score",
    "score_margin",
)
_WINDOWED = tuple(
    f"{name}_{days}d"
    for name in ("provider_utilization", "booking_volume")
    for days in (7, 14, 28)
)
_COHORTS = f"""
  SELECT cohort_id, day_of_week, time_of_day_bucket, service_type, observation_count,
         {_rounded('fill_rate', 'expected_booking_pace_per_day', 'avg_lead_time_hours',
                   'completion_rate')},
         is_sparse, feature_snapshot_version, run_id, scenario_id
  FROM cohorts
"""
_AUDIT = f"""training_row_count, {_rounded('positive_label_rate')}, used_fallback,
         label_definition, feature_contract_hash, model_version"""

# Each day looks at the slots anew, with the events it has seen.
_DAILY = """
  days AS (
    SELECT 'scn_main' AS scenario_id, 'day_' || strftime(ts, '%Y%m%d') AS run_id, ts AS effective_ts
    FROM (SELECT unnest(generate_series(TIMESTAMP '1997-06-02', TIMESTAMP '1998-06-01', INTERVAL 1 DAY)) AS ts)
  ), firsts AS (
    SELECT slot_id, min(event_at) FILTER (WHERE event_type = 'booked') AS booked_at,
           min(event_at) FILTER (WHERE event_type = 'completed') AS completed_at,
           min(event_at) AS seen_at, arg_min(event_type, (event_at, event_id)) AS seen_type
    FROM booking_events GROUP BY 1
  ), dated AS (
    SELECT k.slot_id, k.provider_id, k.business_id, k.service_id AS service_type, k.visible_at, k.slot_start_at,
           k.unavailable_at, f.* EXCLUDE (slot_id)
    FROM known_slots k LEFT JOIN firsts f USING (slot_id)
  ), daily AS (
    SELECT days.*, dated.*, coalesce(booked_at <= effective_ts, false) AS booked,
           coalesce(completed_at <= effective_ts, false) AS completed
    FROM days JOIN dated ON visible_at <= effective_ts
  )
"""


def _daily(select: str) -> str:
    body = statement("SELECT * FROM known_slots, booking_events")
    return body[: body.rindex("\nSELECT")] + "," + _DAILY + select


def _daily_window(days: int) -> str:
    inside = f"BETWEEN effective_ts - INTERVAL {days} DAY AND effective_ts"
    used = f"avg((booked OR completed)::INT) FILTER (WHERE slot_start_at {inside})"
    return f"""{r(f'coalesce({used}, 0.0)')} AS provider_utilization_{days}d,
           (count(*) FILTER (WHERE booked_at {inside}))::DOUBLE AS booking_volume_{days}d"""


DAILY_WINDOWS = _daily(
    f"SELECT scenario_id, run_id, provider_id, {', '.join(_daily_window(d) for d in (7, 14, 28))}"
    " FROM daily GROUP BY 1, 2, 3"
)
DAILY_FILL = _daily(
    """SELECT scenario_id, run_id, business_id, service_type, count(*) AS n_slots,
           count(*) FILTER (WHERE booked) AS n_booked, count(*) FILTER (WHERE completed) AS n_completed,
           count(*) FILTER (WHERE slot_start_at >= effective_ts) AS n_future,
           count(*) FILTER (WHERE seen_at <= effective_ts AND seen_type = 'canceled') AS n_first_cancel,
           count(*) FILTER (WHERE seen_at <= effective_ts AND seen_type = 'no_show') AS n_first_no_show,
           count(*) FILTER (WHERE seen_at <= effective_ts AND seen_type = 'rescheduled') AS n_first_reschedule,
           coalesce(sum(CASE WHEN booked THEN date_diff('microsecond', booked_at, slot_start_at) END), 0)::BIGINT
             AS lead_micros,
           sum(CASE WHEN least(coalesce(unavailable_at, slot_start_at), effective_ts) <= visible_at THEN 3600000000
                    ELSE date_diff('microsecond', visible_at,
                                   least(coalesce(unavailable_at, slot_start_at), effective_ts)) END)::BIGINT
             AS active_micros
       FROM daily GROUP BY 1, 2, 3, 4"""
)

_REMAINING = "count(*) AS remaining_slots FROM daily WHERE slot_start_at >= effective_ts GROUP BY ALL"
DAILY_PROVIDER_SCARCITY = _daily(
    f"SELECT scenario_id, run_id, provider_id, slot_start_at::DATE AS slot_date, {_REMAINING}"
)
DAILY_SERVICE_SCARCITY = _daily(
    f"""SELECT scenario_id, run_id, business_id, service_type, dayname(slot_start_at) AS day_of_week,
           CASE WHEN hour(slot_start_at) < 12 THEN '00-12' WHEN hour(slot_start_at) < 17 THEN '12-17'
                ELSE '17-24' END AS time_of_day_bucket, {_REMAINING}"""
)

_DECISION_INPUT = f"""SELECT {KEY}, feature_snapshot_version, business_id, provider_id, service_id,
               {_rounded('standard_price')}, slot_start_at, {_rounded('hours_until_slot',
               'provider_utilization_7d')}, day_of_week, time_of_day_bucket,
               effective_lead_time_band, {_rounded('pace_deviation')}, underbooked,
               {_rounded('severity_score', 'pace_gap_normalized', 'shortfall_score',
                         'score_margin', 'confidence_score')}
        FROM scored"""

ORACLE_SQL: dict[str, str] = {
    "scan_slots": statement(
        f"SELECT slot_id, scenario_id, run_id, provider_id, slot_start_at,"
        f" {_rounded('standard_price')} FROM booking_slots WHERE run_id = 'run_19980601'",
        THREE_RUNS,
    ),
    "stable_ids": f"SELECT o_orderkey, {_id('slot', chr(39) + 'slot_' + chr(39) + ' || o_orderkey')}"
    " AS stable_id FROM orders",
    "normalize_dims": "SELECT *, 'scn_main' AS scenario_id FROM ("
    + " UNION ALL ".join(DIMENSIONS.values())
    + ")",
    "normalize_slots": statement(NORMAL_SLOTS),
    "normalize_events": statement(NORMAL_EVENTS),
    "load_slots": statement(
        f"""SELECT slot_id, provider_id, business_id, service_id, location_id, standard_price,
               slot_duration_minutes::INT AS slot_duration_minutes, integration_id,
               external_slot_id, source_slot_id, source_provider_id, source_business_id,
               source_service_id, source_location_id, slot_start_at::TIMESTAMP AS slot_start_at,
               slot_end_at::TIMESTAMP AS slot_end_at, visible_at::TIMESTAMP AS visible_at,
               true AS unavailable_at, true AS current_status,
               created_at::TIMESTAMP AS created_at, source_system, source_run_id, scenario_id,
               run_id, TIMESTAMP '1998-06-01 00:00:00' AS effective_ts,
               'cfg_default' AS config_hash
        FROM ({NORMAL_SLOTS})"""
    ),
    "load_events": statement(
        f"""SELECT event_id, slot_id, customer_id, business_id, provider_id, service_type,
               source_event_id, source_slot_id, source_customer_id, event_type,
               event_at::TIMESTAMP AS event_at, source_system, source_run_id, scenario_id,
               run_id, TIMESTAMP '1998-06-01 00:00:00' AS effective_ts
        FROM ({NORMAL_EVENTS})"""
    ),
    "load_dims": LOAD_DIMS,
    "load_rejects": LOAD_REJECTS,
    "dq_nulls": statement(NULL_RULES),
    "dq_types": statement(TYPE_RULES),
    "dq_integrity": statement(INTEGRITY_RULES),
    "dq_integrity_faults": statement(INTEGRITY_FAULTS),
    "dq_gate": statement(GATE),
    "align_schema": statement(
        f"SELECT {KEY}, slot_start_at, 26 AS column_count, 21 AS null_columns FROM booking_slots"
    ),
    "dq_duplicates": statement(DUPLICATES, THREE_RUNS),
    "dq_ranges": statement(RANGES),
    "dq_readiness": statement(READINESS, THREE_RUNS),
    "effective_bookings": statement(f"SELECT {KEY}, event_id, event_at FROM standing_bookings"),
    "availability": statement(f"SELECT {KEY}, unavailable_at, current_status FROM known_slots"),
    "availability_asof": statement(
        f"SELECT {KEY}, unavailable_at, current_status FROM known_slots_asof"
    ),
    "visible_slots": statement(
        f"SELECT {KEY}, visible_at, slot_start_at FROM booking_slots"
        " WHERE visible_at <= effective_ts"
    ),
    "events_asof": statement(f"SELECT {KEY}, event_id, event_type, event_at FROM seen_events"),
    "first_booking": statement(f"SELECT {KEY}, first_booked_at FROM first_bookings"),
    "first_event": statement(f"SELECT {KEY}, first_event_type, first_event_at FROM first_events"),
    "slot_event_rollup": statement(
        f"""SELECT {KEY}, count(*) AS event_count, bool_or(event_type = 'booked') AS was_booked,
               bool_or(event_type = 'completed') AS was_completed
        FROM seen_events GROUP BY 1, 2, 3"""
    ),
    "slot_calendar": statement(
        f"SELECT {KEY}, day_of_week, time_of_day_bucket,"
        f" {_rounded('hours_until_slot', 'days_until_slot')}, effective_lead_time_band"
        " FROM dated_slots"
    ),
    "trailing_window": statement(
        f"SELECT {KEY}, slot_start_at FROM booking_slots WHERE slot_start_at >= effective_ts"
        " - INTERVAL 28 DAY AND slot_start_at <= effective_ts"
    ),
    "slot_flags": statement(
        f"SELECT {KEY}, booked_flag, completed_flag, booked_or_completed,"
        f" {_rounded('lead_time_hours')}, {r('active_us / 1e6 / 3600 / 24.0')} AS active_days"
        " FROM snapshot"
    ),
    "cohort_baselines": statement(_COHORTS),
    "backfill_cohort_baselines": statement(_COHORTS, THREE_RUNS),
    "daily_provider_windows": DAILY_WINDOWS,
    "daily_fill": DAILY_FILL,
    "daily_provider_scarcity": DAILY_PROVIDER_SCARCITY,
    "daily_service_scarcity": DAILY_SERVICE_SCARCITY,
    "features_pace": statement(
        f"SELECT {KEY}, {_rounded('observed_booking_pace_per_day')} FROM snapshot"
    ),
    "features_fill": statement(
        f"SELECT {KEY}, "
        + _rounded(
            "hist_fill_rate_similar", "fill_rate_provider_service", "fill_rate_business_service"
        )
        + " FROM grouped"
    ),
    "features_scarcity": statement(
        f"SELECT {KEY}, remaining_provider_slots_same_day, remaining_service_slots_window"
        " FROM grouped"
    ),
    "features_density": statement(
        f"SELECT {KEY}, inventory_density_2h FROM density JOIN snapshot USING (run_id, slot_id)"
    ),
    "features_utilization": statement(f"SELECT {KEY}, {_rounded(*_WINDOWED)} FROM grouped"),
    "features_patterns": statement(
        f"SELECT {KEY}, "
        + _rounded("cancel_rate_pattern", "no_show_rate_pattern", "reschedule_rate_pattern")
        + " FROM grouped"
    ),
    "features_business": statement(
        f"SELECT {KEY}, {_rounded('business_fill_trend', 'business_booking_trend')} FROM grouped"
    ),
    "feature_snapshots": statement(
        f"""SELECT slot_id, feature_snapshot_version, run_id, scenario_id, day_of_week,
               time_of_day_bucket, service_type, slot_duration_minutes, effective_lead_time_band,
               {_rounded('hours_until_slot', 'days_until_slot', 'hist_fill_rate_similar',
                         'fill_rate_provider_service', 'fill_rate_business_service',
                         'expected_booking_pace_per_day', 'observed_booking_pace_per_day',
                         'pace_deviation', 'avg_lead_time_hours')},
               remaining_provider_slots_same_day, remaining_service_slots_window,
               inventory_density_2h, {_rounded(*_WINDOWED)},
               {_rounded('cancel_rate_pattern', 'no_show_rate_pattern', 'reschedule_rate_pattern',
                         'business_fill_trend', 'business_booking_trend', 'cohort_fill_rate',
                         'cohort_completion_rate')}, cohort_is_sparse
        FROM features JOIN density USING (run_id, slot_id)"""
    ),
    "underbooking": statement(
        f"""SELECT slot_id, feature_snapshot_version, run_id, scenario_id,
               {_rounded('pace_gap', 'pace_gap_normalized', 'fill_gap', 'fill_gap_normalized',
                         'severity_score')}, underbooked, detection_reason
        FROM flagged"""
    ),
    "training_set": statement(
        f"SELECT {KEY}, feature_snapshot_version, business_id, {_rounded(*_MODEL_INPUTS)}, label"
        " FROM training"
    ),
    "scoring_set": statement(
        f"SELECT {KEY}, business_id, {_rounded('cohort_fill_rate', 'severity_score')},"
        f" underbooked, {_rounded('hours_until_slot', 'business_fill_trend')} FROM to_score"
    ),
    "business_calibration": statement(
        f"""SELECT run_id, scenario_id, feature_snapshot_version, business_id,
               {_rounded('calibration_factor')}, {_AUDIT} FROM calibrations"""
    ),
    "score_fallback": statement(
        f"""SELECT run_id, slot_id, scenario_id, feature_snapshot_version, business_id,
               {_rounded(*_SCORES)}, {_AUDIT} FROM scored"""
    ),
    "model_checks": statement(
        """SELECT t.scenario_id, t.run_id, t.training_rows, t.positives, true AS at_optimum,
               true AS fitted_in_range, s.scored_rows,
               CASE WHEN s.scored_rows > 0 THEN true END AS scored_in_range,
               CASE WHEN s.scored_rows > 0 THEN 0 END AS fallback_rows
        FROM (SELECT scenario_id, run_id, count(*) AS training_rows,
                     sum(booked_or_completed)::BIGINT AS positives
              FROM features WHERE slot_start_at < effective_ts GROUP BY 1, 2) t
        LEFT JOIN (SELECT run_id, count(*) AS scored_rows FROM scored GROUP BY 1) s USING (run_id)
        WHERE t.training_rows >= 10 AND t.positives > 0 AND t.positives < t.training_rows""",
        THREE_RUNS,
    ),
    "backfill_scores": statement(
        f"SELECT {KEY}, {_rounded('booking_probability', 'shortfall_score', 'confidence_score')}"
        " FROM scored",
        THREE_RUNS,
    ),
    "decision_input": statement(_DECISION_INPUT),
    "eligible_actions": statement(
        f"SELECT {KEY}, '[' || array_to_string(eligible, ', ') || ']' AS eligible_action_set"
        " FROM choices",
        **STRICT,
    ),
    "select_discount": statement(
        f"SELECT {KEY}, underbooked, target, chosen FROM choices", **STRICT
    ),
    "explore": statement(
        f"SELECT {KEY}, chosen, final_discount, was_exploration, exploration_policy,"
        " decision_reason FROM explored",
        share=0.5,
    ),
    "rationale": statement(f"SELECT {KEY}, rationale_codes FROM decisions"),
    "rationale_mapped": statement(
        f"SELECT {KEY}, rationale_codes FROM decisions",
        weekdays=FULL_WEEKDAYS,
        afternoon="'12-17'",
    ),
    "pricing_actions": statement(
        f"""SELECT action_id, slot_id, action_type, action_value, eligible_action_set,
               decision_reason, was_exploration, exploration_policy, decision_timestamp,
               feature_snapshot_version, {_rounded('confidence_score', 'score_margin')},
               rationale_codes, run_id, scenario_id
        FROM decisions"""
    ),
    "policy_checks": statement(POLICY, **STRICT),
    "policy_faults": statement(POLICY, THREE_RUNS),
    "evaluation": statement(EVALUATION),
    "backfill_evaluation": statement(EVALUATION, THREE_RUNS),
    "similar_slot_consistency": statement(
        "SELECT scenario_id, run_id, 'similar_slot_action_consistency' AS metric_name,"
        f" {r('score')} AS metric_value FROM ({SIMILAR}) JOIN runs USING (run_id)"
    ),
    "recommendations": statement(RECOMMENDATIONS),
    "recommendations_filtered": statement(
        RECOMMENDATIONS + " WHERE service_id = 'svc_2' AND action_value > 0"
    ),
    "recommendations_of_business": statement(RECOMMENDATIONS + " WHERE business_id = 'biz_1'"),
    "recommendations_explored": statement(RECOMMENDATIONS + " WHERE was_exploration", share=1.0),
    "recommendations_sorted": statement(RECOMMENDATIONS),
    "recommendations_top": statement(
        f"SELECT * FROM ({RECOMMENDATIONS})"
        " ORDER BY severity_score DESC NULLS LAST, recommended_discount DESC, slot_id LIMIT 20"
    ),
    "recommendations_of_provider": statement(RECOMMENDATIONS + " WHERE provider_id = 'prov_103'"),
    "recommendations_of_lead_band": statement(
        RECOMMENDATIONS + " WHERE effective_lead_time_band = 'gt_168h'"
    ),
    "stored_decision_input": statement(_DECISION_INPUT, THREE_RUNS) + " WHERE run_id = 'run_19980601'",
    "stored_recommendations": statement(RECOMMENDATIONS + " WHERE run_id = 'run_19970601'", THREE_RUNS),
    "stored_runs": statement(
        "SELECT scenario_id, run_id, max(effective_ts) AS effective_ts, count(*) AS slot_count"
        " FROM booking_slots GROUP BY 1, 2",
        THREE_RUNS,
    ),
    "severity_distribution": statement(
        """SELECT scenario_id, run_id, CASE WHEN severity_score < 0.25 THEN '0.00-0.24'
                 WHEN severity_score < 0.5 THEN '0.25-0.49'
                 WHEN severity_score < 0.75 THEN '0.50-0.74'
                 ELSE '0.75-1.00' END AS severity_band, count(*) AS slot_count
        FROM flagged GROUP BY 1, 2, 3"""
    ),
    "summary_by_action": statement(_counts("action_value", "action_bucket")),
    "summary_by_provider": statement(_counts("provider_id", "provider_id")),
    "summary_by_service": statement(_counts("service_id", "service_id")),
    "summary_by_lead_band": statement(
        _counts("effective_lead_time_band", "effective_lead_time_band")
    ),
    "summary_by_provider_of_service": statement(
        _counts("provider_id", "provider_id", "service_id = 'svc_2'")
    ),
    "summary_by_service_of_business": statement(
        _counts("service_id", "service_id", "business_id = 'biz_1'")
    ),
    "latest_runs": statement(
        "SELECT scenario_id, run_id, max(effective_ts) AS effective_ts, count(*) AS slot_count"
        " FROM booking_slots GROUP BY 1, 2",
        THREE_RUNS,
    ),
    "run_summary": statement(RUN_SUMMARY, THREE_RUNS),
}
