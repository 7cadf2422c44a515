"""Joining per-group results back onto rows without a hot task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FANOUT = 8


def salt_of(columns: Sequence[str], fanout: int) -> str:
    """SQL: the share of a row, from columns that tell the rows of one key apart."""
    return f"pmod(xxhash64({', '.join(columns)}), {fanout}L)"


def salt_copies(fanout: int) -> str:
    """SQL: one copy of the row per share."""
    return f"explode(sequence(0L, {fanout - 1}L))"


def attach(
    rows: DataFrame,
    groups: DataFrame,
    keys: Sequence[str],
    spread_on: Sequence[str],
    how: str = "left",
    null_safe: Sequence[str] = (),
    fanout: int = FANOUT,
) -> DataFrame:
    """Join ``groups`` (unique on ``keys``) onto ``rows``, spreading every key over ``fanout`` tasks.

    No side is hinted. Spark broadcasts ``groups`` when its own size check allows it
    (``spark.sql.autoBroadcastJoinThreshold``, from file sizes before and from real sizes
    during the run). Beyond that both sides are shuffled on ``keys`` plus a salt: one key
    holding a third of the rows lands in ``fanout`` partitions, and because the salt makes
    both sides fresh exchanges, AQE can cut each of those further by size.

    Keys about as fine as the rows take ``fanout=1``: no copies, the plain join.

    ``null_safe`` keys match null with null; the other keys never match on null.
    """
    if fanout == 1 and not null_safe:
        return rows.join(groups, list(keys), how)
    spread = rows.selectExpr("*", f"{salt_of(spread_on, fanout)} AS _salt")
    copied = groups.selectExpr("*", f"{salt_copies(fanout)} AS _salt")
    if not null_safe:
        return spread.join(copied, [*keys, "_salt"], how).drop("_salt")
    matched = copied.withColumnsRenamed({c: f"_group_{c}" for c in (*keys, "_salt")})
    equal = {key: "<=>" if key in null_safe else "=" for key in (*keys, "_salt")}
    condition = " AND ".join(f"{key} {sign} _group_{key}" for key, sign in equal.items())
    joined = spread.join(matched, F.expr(condition), how)
    return joined.drop("_salt", "_group__salt", *[f"_group_{key}" for key in keys])
