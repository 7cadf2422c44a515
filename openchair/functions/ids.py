from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", *parts), 256)


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and the first 16 hex digits of the SHA-256 of the joined parts.

    ``concat_ws`` would skip a null part and hash the rest, so a null stays null here.
    """
    digest = F.concat(F.lit(f"{prefix}_"), F.substring(_hex_digest(*parts), 1, 16))
    known = F.lit(True)
    for part in parts:
        known = known & part.isNotNull()
    return F.when(known, digest)


def uniform_draws(*parts: Column) -> tuple[Column, Column]:
    """Two reproducible numbers in [0, 1), each from 52 bits of the digest of the parts."""
    digest = _hex_digest(*parts)

    def draw(position: int) -> Column:
        bits = F.conv(F.substring(digest, position, 13), 16, 10).cast("bigint")
        return bits.cast("double") / F.lit(float(2**52))

    return draw(1), draw(14)
