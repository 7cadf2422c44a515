"""Common table expressions from the raw tables up to the decisions, in dependency order."""

from __future__ import annotations

ONE_RUN = """
  SELECT 'scn_main' AS scenario_id, 'run_19980601' AS run_id,
         TIMESTAMP '1998-06-01 00:00:00' AS effective_ts,
         'fsv_19980601T000000Z' AS feature_snapshot_version
"""

THREE_RUNS = """
  SELECT 'scn_main' AS scenario_id, * FROM (VALUES
    ('run_19970601', TIMESTAMP '1997-06-01 00:00:00', 'fsv_19970601T000000Z'),
    ('run_19980601', TIMESTAMP '1998-06-01 00:00:00', 'fsv_19980601T000000Z'),
    ('run_19990601', TIMESTAMP '1999-06-01 00:00:00', 'fsv_19990601T000000Z')
  ) AS v(run_id, effective_ts, feature_snapshot_version)
"""


def r(expression: str) -> str:
    """Six digits and never a negative zero."""
    return f"(CASE WHEN round({expression}, 6) = 0 THEN 0.0::DOUBLE ELSE round({expression}, 6) END)"


def hours(start: str, end: str) -> str:
    return f"(date_diff('microsecond', {start}, {end}) / 1e6 / 3600)"


STEPS: dict[str, str] = {}

STEPS["booking_slots"] = """
  SELECT runs.*,
         'slot_' || o_orderkey AS slot_id,
         'prov_' || (o_custkey % 150) AS provider_id,
         'biz_' || (o_custkey % 10) AS business_id,
         'svc_' || substr(o_orderpriority, 1, 1) AS service_id,
         'loc_' || (o_custkey % 10) AS location_id,
         o_totalprice AS standard_price,
         60 AS slot_duration_minutes,
         o_orderdate + to_hours(9 + 2 * (o_orderkey % 5)) AS slot_start_at,
         o_orderdate + to_hours(9 + 2 * (o_orderkey % 5)) + INTERVAL 60 MINUTE AS slot_end_at,
         o_orderdate + to_hours(9 + 2 * (o_orderkey % 5)) - INTERVAL 90 DAY AS visible_at,
         o_orderkey, o_custkey
  FROM orders CROSS JOIN runs
"""

STEPS["typed_items"] = """
  SELECT s.scenario_id, s.run_id, s.effective_ts, s.slot_id, s.slot_start_at, s.o_custkey,
         concat_ws('_', 'evt', l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   floor(l_extendedprice * 100 + 0.5)::BIGINT) AS event_id,
         CASE WHEN l_suppkey % 20 = 0 THEN 'removed'
              WHEN l_linestatus = 'F' AND l_returnflag = 'A' THEN 'completed'
              WHEN l_returnflag = 'R' THEN 'canceled'
              WHEN l_linestatus = 'F' AND l_suppkey % 2 = 1 THEN 'no_show'
              WHEN l_linestatus = 'F' THEN 'rescheduled'
              ELSE 'booked' END AS event_type,
         l_partkey
  FROM lineitem JOIN booking_slots s ON s.o_orderkey = l_orderkey
"""

STEPS["booking_events"] = """
  SELECT scenario_id, run_id, effective_ts, slot_id, event_id, event_type, o_custkey,
         CASE WHEN event_type IN ('completed', 'no_show') THEN slot_start_at + INTERVAL 1 HOUR
              ELSE slot_start_at - to_hours(1 + l_partkey % 1440) END AS event_at
  FROM typed_items
"""

STEPS["standing_bookings"] = """
  SELECT e.scenario_id, e.run_id, e.effective_ts, e.slot_id, e.event_id, e.event_at
  FROM booking_events e
  WHERE e.event_type = 'booked'
    AND NOT EXISTS (
      SELECT 1 FROM booking_events c
      WHERE c.run_id = e.run_id AND c.slot_id = e.slot_id
        AND c.event_type = 'canceled' AND c.event_at > e.event_at)
"""

_KNOWN = """
  WITH ends AS (
    SELECT run_id, slot_id, slot_start_at AS ended_at FROM booking_slots
    UNION ALL
    SELECT run_id, slot_id, event_at FROM booking_events
    WHERE event_type IN ('removed', 'completed', 'no_show', 'rescheduled') {asof}
    UNION ALL
    SELECT run_id, slot_id, event_at FROM {standing}
  ), earliest AS (
    SELECT run_id, slot_id, min(ended_at) AS unavailable_at FROM ends GROUP BY 1, 2
  ), latest AS (
    SELECT run_id, slot_id, event_type FROM booking_events WHERE true {asof}
    QUALIFY row_number() OVER (
      PARTITION BY run_id, slot_id ORDER BY event_at DESC, event_id DESC) = 1
  )
  SELECT s.*, e.unavailable_at,
         CASE WHEN l.event_type = 'canceled' AND s.slot_start_at > s.effective_ts THEN 'open'
              WHEN l.event_type IS NOT NULL THEN l.event_type
              WHEN s.slot_start_at <= s.effective_ts THEN 'expired'
              ELSE 'open' END AS current_status
  FROM booking_slots s
  JOIN earliest e USING (run_id, slot_id)
  LEFT JOIN latest l USING (run_id, slot_id)
"""

STEPS["known_slots"] = _KNOWN.format(asof="", standing="standing_bookings")

STEPS["standing_asof"] = """
  SELECT e.run_id, e.slot_id, e.event_at
  FROM booking_events e
  WHERE e.event_type = 'booked' AND e.event_at <= e.effective_ts
    AND NOT EXISTS (
      SELECT 1 FROM booking_events c
      WHERE c.run_id = e.run_id AND c.slot_id = e.slot_id AND c.event_type = 'canceled'
        AND c.event_at > e.event_at AND c.event_at <= c.effective_ts)
"""

STEPS["known_slots_asof"] = _KNOWN.format(
    asof="AND event_at <= effective_ts", standing="standing_asof"
)

STEPS["seen_events"] = "SELECT * FROM booking_events WHERE event_at <= effective_ts"

STEPS["first_bookings"] = """
  SELECT DISTINCT ON (run_id, slot_id) scenario_id, run_id, slot_id, event_at AS first_booked_at
  FROM seen_events WHERE event_type = 'booked' ORDER BY run_id, slot_id, event_at
"""

STEPS["first_events"] = """
  SELECT scenario_id, run_id, slot_id, event_type AS first_event_type, event_at AS first_event_at
  FROM seen_events
  QUALIFY row_number() OVER (PARTITION BY run_id, slot_id ORDER BY event_at, event_id) = 1
"""

STEPS["dated_slots"] = f"""
  SELECT s.*, service_id AS service_type,
         dayname(slot_start_at) AS day_of_week,
         CASE WHEN hour(slot_start_at) < 12 THEN '00-12'
              WHEN hour(slot_start_at) < 17 THEN '12-17' ELSE '17-24' END AS time_of_day_bucket,
         {hours('effective_ts', 'slot_start_at')} AS hours_until_slot,
         {hours('effective_ts', 'slot_start_at')} / 24 AS days_until_slot,
         CASE WHEN {hours('effective_ts', 'slot_start_at')} <= 24 THEN 'lt_24h'
              WHEN {hours('effective_ts', 'slot_start_at')} <= 72 THEN '24_72h'
              WHEN {hours('effective_ts', 'slot_start_at')} <= 168 THEN '72_168h'
              ELSE 'gt_168h' END AS effective_lead_time_band
  FROM known_slots s
"""

STEPS["snapshot"] = """
  WITH timed AS (
    SELECT s.*, b.first_booked_at, f.first_event_type,
           (b.first_booked_at IS NOT NULL)::INT AS booked_flag,
           (s.slot_id IN (SELECT c.slot_id FROM seen_events c
                          WHERE c.run_id = s.run_id AND c.event_type = 'completed'))::INT
             AS completed_flag,
           coalesce(date_diff('microsecond', b.first_booked_at, s.slot_start_at), 0) AS lead_us,
           date_diff('microsecond', s.visible_at,
                     least(coalesce(s.unavailable_at, s.slot_start_at), s.effective_ts)) AS open_us,
           date_diff('microsecond', s.visible_at, s.effective_ts) AS shown_us
    FROM dated_slots s
    LEFT JOIN first_bookings b USING (run_id, slot_id)
    LEFT JOIN first_events f USING (run_id, slot_id)
    WHERE s.visible_at <= s.effective_ts
  )
  SELECT *, greatest(booked_flag, completed_flag) AS booked_or_completed,
         lead_us / 1e6 / 3600 AS lead_time_hours,
         CASE WHEN open_us <= 0 THEN 3600000000 ELSE open_us END AS active_us,
         CASE WHEN shown_us <= 0 THEN 1.0 / 24 ELSE shown_us / 1e6 / 3600 / 24.0 END AS elapsed_days,
         booked_flag / (CASE WHEN shown_us <= 0 THEN 1.0 / 24
                             ELSE shown_us / 1e6 / 3600 / 24.0 END)
           AS observed_booking_pace_per_day
  FROM timed
"""

STEPS["cohorts"] = """
  SELECT day_of_week || '|' || time_of_day_bucket || '|' || service_type AS cohort_id,
         day_of_week, time_of_day_bucket, service_type,
         count(*) AS observation_count,
         avg(booked_flag) AS fill_rate,
         sum(booked_flag) / (sum(active_us)::DOUBLE / 1e6 / 3600 / 24.0)
           AS expected_booking_pace_per_day,
         sum(lead_us)::DOUBLE / 1e6 / 3600 / count(*) AS avg_lead_time_hours,
         avg(completed_flag) AS completion_rate,
         count(*) < 3 AS is_sparse,
         feature_snapshot_version, run_id, scenario_id
  FROM snapshot GROUP BY ALL
"""

STEPS["density"] = """
  SELECT a.run_id, a.slot_id, count(DISTINCT b.slot_id)::DOUBLE AS inventory_density_2h
  FROM snapshot a JOIN snapshot b
    ON a.run_id = b.run_id AND a.business_id = b.business_id AND a.service_id = b.service_id
   AND b.slot_start_at BETWEEN a.slot_start_at - INTERVAL 2 HOUR
                           AND a.slot_start_at + INTERVAL 2 HOUR
  GROUP BY 1, 2
"""


def _trailing(days: int) -> str:
    inside = f"BETWEEN effective_ts - INTERVAL {days} DAY AND effective_ts"
    return f"""
         coalesce(avg(booked_or_completed) FILTER (WHERE slot_start_at {inside})
           OVER (PARTITION BY run_id, provider_id), 0.0) AS provider_utilization_{days}d,
         (count(DISTINCT slot_id) FILTER (WHERE first_booked_at {inside})
           OVER (PARTITION BY run_id, provider_id))::DOUBLE AS booking_volume_{days}d"""


def _pattern(name: str, event_type: str) -> str:
    return f"""
         avg(CASE WHEN first_event_type = '{event_type}' THEN 1 ELSE 0 END)
           OVER (PARTITION BY run_id, business_id, day_of_week, time_of_day_bucket, service_type)
           AS {name}_rate_pattern"""


STEPS["grouped"] = f"""
  SELECT *,
         avg(booked_flag) OVER (PARTITION BY run_id, day_of_week, time_of_day_bucket, service_id)
           AS hist_fill_rate_similar,
         avg(booked_flag) OVER (PARTITION BY run_id, provider_id, service_id)
           AS fill_rate_provider_service,
         avg(booked_flag) OVER (PARTITION BY run_id, business_id, service_id)
           AS fill_rate_business_service,
         CASE WHEN slot_start_at >= effective_ts THEN
           count(*) FILTER (WHERE slot_start_at >= effective_ts)
             OVER (PARTITION BY run_id, provider_id, slot_start_at::DATE)
         ELSE 0 END::INT AS remaining_provider_slots_same_day,
         CASE WHEN slot_start_at >= effective_ts THEN
           count(*) FILTER (WHERE slot_start_at >= effective_ts)
             OVER (PARTITION BY run_id, business_id, service_id, day_of_week, time_of_day_bucket)
         ELSE 0 END::INT AS remaining_service_slots_window,
         {_trailing(7)}, {_trailing(14)}, {_trailing(28)},
         {_pattern('cancel', 'canceled')}, {_pattern('no_show', 'no_show')},
         {_pattern('reschedule', 'rescheduled')},
         avg(booked_flag) OVER (PARTITION BY run_id, business_id) AS business_fill_trend,
         avg(observed_booking_pace_per_day) OVER (PARTITION BY run_id, business_id)
           AS business_booking_trend
  FROM snapshot
"""

STEPS["features"] = """
  SELECT g.*, c.fill_rate AS cohort_fill_rate, c.completion_rate AS cohort_completion_rate,
         c.is_sparse AS cohort_is_sparse, c.expected_booking_pace_per_day, c.avg_lead_time_hours,
         g.observed_booking_pace_per_day - c.expected_booking_pace_per_day AS pace_deviation
  FROM grouped g
  JOIN cohorts c USING (run_id, day_of_week, time_of_day_bucket, service_type)
"""

STEPS["flagged"] = """
  WITH gaps AS (
    SELECT f.*,
           greatest(expected_booking_pace_per_day - observed_booking_pace_per_day, 0.0) AS pace_gap,
           1.0 - least(greatest(hours_until_slot / 168.0, 0.0), 1.0) AS urgency,
           least(observed_booking_pace_per_day * (greatest(hours_until_slot, 0.0) / 24.0), 1.0)
             AS from_pace,
           CASE WHEN cohort_is_sparse THEN 0.6 ELSE cohort_fill_rate END AS expected_fill
    FROM features f
  ), projected AS (
    SELECT *, least(greatest(0.7 * from_pace + 0.3 * hist_fill_rate_similar, 0.0), 1.0) * urgency
              + cohort_fill_rate * (1.0 - urgency) AS projected_fill
    FROM gaps
  ), normalized AS (
    SELECT *, greatest(expected_fill - projected_fill, 0.0) AS fill_gap,
           pace_gap / (CASE WHEN expected_booking_pace_per_day = 0 THEN 1.0
                            ELSE expected_booking_pace_per_day END) AS pace_gap_normalized,
           greatest(expected_fill - projected_fill, 0.0)
             / (CASE WHEN expected_fill = 0 THEN 1.0 ELSE expected_fill END) AS fill_gap_normalized
    FROM projected
  )
  SELECT *, least(greatest(0.6 * pace_gap_normalized + 0.4 * fill_gap_normalized, 0.0), 1.0)
              AS severity_score,
         least(greatest(0.6 * pace_gap_normalized + 0.4 * fill_gap_normalized, 0.0), 1.0) >= 0.35
              AS underbooked,
         CASE WHEN cohort_is_sparse THEN 'sparse_cohort_fallback'
              WHEN pace_gap_normalized > 0 AND fill_gap_normalized > 0 THEN 'pace_gap_and_fill_gap'
              WHEN pace_gap_normalized > 0 THEN 'pace_gap'
              WHEN fill_gap_normalized > 0 THEN 'fill_gap'
              ELSE 'healthy' END AS detection_reason
  FROM normalized
"""

STEPS["training"] = """
  SELECT f.*, CASE WHEN EXISTS (
           SELECT 1 FROM booking_events e
           WHERE e.run_id = f.run_id AND e.slot_id = f.slot_id
             AND e.event_type IN ('booked', 'completed') AND e.event_at <= f.effective_ts)
         THEN 1 ELSE 0 END AS label
  FROM features f WHERE f.slot_start_at < f.effective_ts
"""

STEPS["to_score"] = """
  SELECT * FROM flagged WHERE slot_start_at >= effective_ts AND current_status = 'open'
"""

STEPS["calibrations"] = """
  WITH history AS (
    SELECT run_id, count(*) AS training_row_count, avg(label) AS positive_label_rate
    FROM training GROUP BY 1
  ), overall AS (
    SELECT run_id, CASE WHEN avg(business_fill_trend) > 0 THEN avg(business_fill_trend)
                        ELSE 0.5 END AS overall_fill
    FROM to_score GROUP BY 1
  )
  SELECT t.run_id, t.scenario_id, t.feature_snapshot_version, t.business_id,
         least(greatest(avg(t.business_fill_trend) / any_value(o.overall_fill), 0.8), 1.2)
           AS calibration_factor,
         coalesce(any_value(h.training_row_count), 0) AS training_row_count,
         coalesce(any_value(h.positive_label_rate), 0.5) AS positive_label_rate,
         true AS used_fallback,
         'booked_or_completed_as_of_effective_ts_for_started_slots' AS label_definition,
         substr(sha256('hours_until_slot|hist_fill_rate_similar|fill_rate_provider_service|'
           || 'fill_rate_business_service|expected_booking_pace_per_day|'
           || 'observed_booking_pace_per_day|pace_deviation|provider_utilization_7d|'
           || 'provider_utilization_14d|provider_utilization_28d|business_fill_trend|'
           || 'cohort_fill_rate'), 1, 16) AS feature_contract_hash,
         'pooled_logistic_v1' AS model_version
  FROM to_score t JOIN overall o USING (run_id) LEFT JOIN history h USING (run_id)
  GROUP BY 1, 2, 3, 4
"""

STEPS["scored"] = """
  WITH probable AS (
    SELECT t.*, c.calibration_factor, c.training_row_count, c.positive_label_rate,
           c.used_fallback, c.label_definition, c.feature_contract_hash, c.model_version,
           c.positive_label_rate AS booking_probability,
           least(greatest(c.positive_label_rate * c.calibration_factor, 0.0), 1.0)
             AS calibrated_booking_probability
    FROM to_score t JOIN calibrations c USING (run_id, business_id)
  )
  SELECT *, 0.5 * cohort_fill_rate + 0.5 * calibrated_booking_probability
           AS predicted_fill_by_start,
         severity_score * (1.0 - calibrated_booking_probability) AS shortfall_score,
         2.0 * abs(calibrated_booking_probability - 0.5) AS confidence_score,
         2.0 * abs(calibrated_booking_probability - 0.5) AS score_margin
  FROM probable
"""

STEPS["choices"] = """
  WITH allowed AS (
    SELECT *, list_filter([0, 5, 10, 15, 20], lambda d:
             NOT (d > 0 AND service_id IN ({excluded}))
             AND NOT (d > 0 AND hours_until_slot > 168)
             AND standard_price * (1 - d / 100.0) >= standard_price * {floor}) AS permitted
    FROM scored
  ), wanted AS (
    SELECT *, CASE WHEN len(permitted) = 0 THEN [0] ELSE permitted END AS eligible,
           CASE WHEN NOT underbooked THEN 0
                WHEN shortfall_score <= 0.2 THEN 5
                WHEN shortfall_score <= 0.4 THEN 10
                WHEN shortfall_score <= 0.7 THEN 15
                ELSE 20 END AS target
    FROM allowed
  )
  SELECT *, coalesce(list_max(list_filter(eligible, lambda d: d <= target)),
                     list_min(eligible)) AS chosen
  FROM wanted
"""

STEPS["explored"] = """
  WITH hashed AS (
    SELECT *, sha256('42|' || run_id || '|' || slot_id) AS digest,
           list_filter(eligible, lambda d: d <> chosen) AS others
    FROM choices
  ), drawn AS (
    SELECT *, ('0x' || substr(digest, 1, 13))::UBIGINT::DOUBLE / 4503599627370496::DOUBLE AS gate,
           ('0x' || substr(digest, 14, 13))::UBIGINT::DOUBLE / 4503599627370496::DOUBLE AS pick
    FROM hashed
  ), gated AS (
    SELECT *, underbooked AND len(eligible) > 1 AND gate < {share} AS was_exploration FROM drawn
  )
  SELECT *, CASE WHEN was_exploration THEN others[floor(pick * len(others))::INT + 1]
                 ELSE chosen END AS final_discount,
         CASE WHEN was_exploration THEN 'epsilon_greedy_deterministic' ELSE 'none' END
           AS exploration_policy,
         CASE WHEN was_exploration THEN 'exploration_override'
              WHEN underbooked THEN 'underbooked_optimizer'
              ELSE 'healthy_no_discount' END AS decision_reason
  FROM gated
"""

STEPS["decisions"] = """
  WITH evidence AS (
    SELECT *, list_sort(list_filter([
             CASE WHEN underbooked AND hours_until_slot <= 24
                  THEN 'short_lead_time_low_fill' END,
             CASE WHEN underbooked AND provider_utilization_7d < 0.5
                  THEN 'provider_utilization_below_target' END,
             CASE WHEN underbooked AND final_discount > 0 AND day_of_week IN ({weekdays})
                   AND time_of_day_bucket IN ({afternoon})
                  THEN 'historically_underbooked_weekday_afternoon' END,
             CASE WHEN underbooked AND pace_deviation < 0
                  THEN 'booking_pace_below_baseline' END], lambda c: c IS NOT NULL)) AS found
    FROM explored
  ), explained AS (
    SELECT *, CASE WHEN len(found) > 0 THEN found
                   WHEN underbooked THEN ['underbooked_slot_flagged']
                   WHEN final_discount > 0 THEN ['discount_applied']
                   ELSE ['healthy_slot_no_discount'] END AS rationale
    FROM evidence
  )
  SELECT *, 'act_' || substr(sha256(run_id || '|' || feature_snapshot_version || '|' || slot_id),
                             1, 16) AS action_id,
         'discount_pct' AS action_type, final_discount::DOUBLE AS action_value,
         '[' || array_to_string(eligible, ', ') || ']' AS eligible_action_set,
         '["' || array_to_string(rationale, '", "') || '"]' AS rationale_codes,
         effective_ts AS decision_timestamp
  FROM explained
"""

NO_SERVICE = "''"
SHORT_WEEKDAYS = "'mon', 'tue', 'wed', 'thu', 'fri'"
FULL_WEEKDAYS = "'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'"


def statement(
    select: str,
    runs: str = ONE_RUN,
    excluded: str = NO_SERVICE,
    floor: float = 0.7,
    share: float = 0.1,
    weekdays: str = SHORT_WEEKDAYS,
    afternoon: str = "'afternoon'",
) -> str:
    """The final select on top of the steps it needs."""
    rules = {
        "excluded": excluded,
        "floor": floor,
        "share": share,
        "weekdays": weekdays,
        "afternoon": afternoon,
    }
    bodies = {
        name: body.format(**rules) if name in ("choices", "explored", "decisions") else body
        for name, body in STEPS.items()
    }
    needed: set[str] = set()
    text = select
    for name in reversed(list(bodies)):
        if name in text:
            needed.add(name)
            text += bodies[name]
    ctes = [f"runs AS ({runs})"]
    ctes += [f"{n} AS ({b})" for n, b in bodies.items() if n in needed]
    return "WITH " + ",\n".join(ctes) + "\n" + select
