"""What a chart is asked for, as range, granularity and point limit, and what it gets: or why it is refused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.exprs import bucket
from tessera.plans.registrar import registrar
from tessera.sources import views as V

QUERIES, ORACLES = {}, {}
query = registrar(QUERIES, ORACLES)

#: Ranges and granularities by their seconds, the grain that ``auto`` takes, and limits.
RANGES = {"1h": 3600, "24h": 86400, "7d": 604800, "30d": 2592000}
GRAINS = {"minute": 60, "hour": 3600, "day": 86400}
AUTO = {"1h": ("minute", 60), "24h": ("minute", 300), "7d": ("hour", 3600), "30d": ("hour", 21600), "all": ("day", 86400)}
USUAL_POINTS, MOST_POINTS = 300, 1000
#: Views that don't serve the whole history.
BOUNDED = ("market", "producers")


class Refused(ValueError):
    """A request that can't be served; the text says what to ask for instead."""


@dataclass(frozen=True)
class Spec:
    range: str
    granularity: str
    step: int
    first: int | None
    last: int
    points: int


def chart_spec(range: str = "24h", granularity: str = "auto", points: int | None = None, now: int = V.AS_OF, view: str = "", block_seconds: int = V.STEP) -> Spec:  # noqa: A002
    """The half-open range of times and the step of a chart. Ends lie on a multiple of the step at or behind ``now``,
    but for charts by block, which end now."""
    range, granularity = range.strip().lower() or "24h", granularity.strip().lower() or "auto"
    if range != "all" and range not in RANGES:
        raise Refused(f"no such range: one of {', '.join(RANGES)}, all")
    if granularity not in ("auto", "block", *GRAINS):
        raise Refused(f"no such granularity: auto, block, {', '.join(GRAINS)}")
    points = USUAL_POINTS if points is None else points
    if not 0 < points <= MOST_POINTS:
        raise Refused(f"between 1 and {MOST_POINTS} points")
    if range == "all" and view in BOUNDED:
        raise Refused(f"{view} charts don't reach over the whole history; ask for 30d or less")
    if range == "all" and granularity not in ("auto", "day"):
        raise Refused("the whole history is shown by day only")
    if granularity == "auto":
        granularity, step = AUTO[range]
    else:
        step = block_seconds if granularity == "block" else GRAINS[granularity]
    if granularity == "block":
        if RANGES[range] // block_seconds > points:
            raise Refused(f"more than {points} blocks; ask for a coarser granularity")
        return Spec(range, granularity, step, now - RANGES[range], now, points)
    last = -(-now // step) * step
    if range == "all":
        return Spec(range, granularity, step, None, last, points)
    if step > RANGES[range]:
        raise Refused(f"{granularity} is too coarse for {range}")
    if RANGES[range] // step > points:
        raise Refused(f"more than {points} points in {range}; ask for a coarser granularity")
    return Spec(range, granularity, step, last - RANGES[range], last, points)


def market(spark, d, spec: Spec) -> DataFrame:
    """Blocks, items, and fees per bucket of a chart; by block, the bucket is the block's time. The range reaches the scan."""
    rows = V.blocks(spark, d, spec.first, spec.last).where(F.col("t") < spec.last)
    if spec.first is not None:
        rows = rows.where(F.col("t") >= spec.first)
    at = F.col("t") if spec.granularity == "block" else bucket(F.col("t"), spec.step)
    return rows.groupBy(at.alias("bucket")).agg(F.count(F.lit(1)).alias("blocks"), F.sum("items").alias("items"), F.min("fee").alias("min_fee"), F.max("fee").alias("max_fee"))


_ASKED = [("1h", "auto"), ("24h", "auto"), ("7d", "auto"), ("30d", "auto"), ("24h", "block"), ("7d", "day"), ("all", "auto")]


def _sql() -> str:
    parts = []
    for r, g in _ASKED:
        s = chart_spec(r, g)
        at = "t" if s.granularity == "block" else f"t - t % {s.step}"
        low = "" if s.first is None else f"t >= {s.first} AND "
        parts.append(f"SELECT '{r} {g}' AS chart, {at} AS bucket, count(*) AS blocks, CAST(sum(items) AS BIGINT) AS items, min(fee) AS min_fee, max(fee) AS max_fee FROM blocks WHERE {low}t < {s.last} GROUP BY 1, 2")
    return " UNION ALL ".join(parts)


@query("chart_specs", _sql())
def chart_specs(spark, d):
    """The market chart for several requests, each by its spec."""
    out = None
    for r, g in _ASKED:
        rows = market(spark, d, chart_spec(r, g)).select(F.lit(f"{r} {g}").alias("chart"), "bucket", "blocks", "items", "min_fee", "max_fee")
        out = rows if out is None else out.unionByName(rows)
    return out
