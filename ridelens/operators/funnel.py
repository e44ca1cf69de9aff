"""Conversion funnels at user or ride grain, and their ratios."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridelens.functions.numeric import ratio
from ridelens.operators.joins import approved
from ridelens.operators.setops import constant_row, union_all


@dataclass(frozen=True)
class FunnelStep:
    """One funnel stage: ``count(DISTINCT key)`` over the rows of ``frame``
    that satisfy ``where`` (all rows if None); ``key=None`` marks a stage that
    does not apply at this grain (NULL count, one row only if the frame has
    rows)."""

    name: str
    frame: DataFrame
    key: str | None
    where: Column | None = None


def _single_count(number: int, step: FunnelStep) -> DataFrame:
    tag = [F.lit(number).alias("step"), F.lit(step.name).alias("funnel_name")]
    if step.key is None:
        return constant_row(step.frame, *tag, F.lit(None).cast("bigint").alias("count"))
    frame = step.frame if step.where is None else step.frame.where(step.where)
    return frame.agg(F.countDistinct(step.key).cast("bigint").alias("count")).select(*tag, "count")


def _shared_counts(numbered: list[tuple[int, FunnelStep]]) -> DataFrame:
    """Stages over the same frame and key, one pass: per key, whether any row
    reaches each stage; then per stage the number of keys that do, which is
    ``count(DISTINCT key)`` over that stage's rows (NULL keys excluded)."""
    first = numbered[0][1]
    key = first.key
    reached = [F.max(F.when(st.where if st.where is not None else F.lit(True), 1)
                     .otherwise(0)).alias(f"_h{n}") for n, st in numbered]
    per_key = first.frame.where(F.col(key).isNotNull()).groupBy(key).agg(*reached)
    totals = per_key.agg(*[F.coalesce(F.sum(f"_h{n}"), F.lit(0)).cast("bigint").alias(f"_c{n}")
                           for n, _ in numbered])
    rows = [F.struct(F.lit(n).alias("step"), F.lit(st.name).alias("funnel_name"),
                     F.col(f"_c{n}").alias("count")) for n, st in numbered]
    return totals.select(F.inline(F.array(*rows)))


def funnel_counts(steps: Sequence[FunnelStep]) -> DataFrame:
    """``step INT, funnel_name STRING, count BIGINT``, one row per stage.

    Each stage is a global distinct count (partial dedup per task, shuffle on
    the key, merge). Consecutive stages over the same frame and key (e.g.
    requested / accepted / completed rides) share one pass and one shuffle.
    The stage number is a literal of every branch, so the SQL ``UNION`` cannot
    find duplicates across branches and a plain concatenation is exact.
    """
    groups: list[list[tuple[int, FunnelStep]]] = []
    for number, step in enumerate(steps, start=1):
        last = groups[-1][-1][1] if groups else None
        if (last is not None and step.key is not None and last.key == step.key
                and last.frame is step.frame):
            groups[-1].append((number, step))
        else:
            groups.append([(number, step)])
    return union_all([_single_count(*g[0]) if len(g) == 1 else _shared_counts(g)
                      for g in groups])


def funnel_ratios(counts: DataFrame, top_lag: int, count_name: str = "count") -> DataFrame:
    """``perc_previous = count / lag(count)`` and ``perc_top = count /
    lag(count, top_lag)`` over the stage order, denominators NULLIF'ed.

    The window has no partition on purpose: it runs over the handful of stage
    rows, never over row-level data.
    """
    w = Window.orderBy("step")
    c = F.col("count")
    return counts.select(
        "step", "funnel_name", c.alias(count_name),
        ratio(c, F.lag(c, 1).over(w)).alias("perc_previous"),
        ratio(c, F.lag(c, top_lag).over(w)).alias("perc_top"))


def _presented(counts: DataFrame, top_lag: int, count_name: str) -> DataFrame:
    return funnel_ratios(counts, top_lag, count_name).orderBy("step").drop("step")


def user_funnel_steps(t: Mapping[str, DataFrame]) -> list[FunnelStep]:
    rides = t["ride_requests"]
    # count(DISTINCT r.user_id) over approved transactions LEFT JOIN rides only
    # sees users owning a ride with an approved transaction: a semi join on
    # the distinct paid ride ids (deduplicated map-side, so a ride with a
    # third of all transactions collapses before the shuffle).
    paid_ids = approved(t["transactions"]).select("ride_id").distinct()
    paid = rides.select("ride_id", "user_id").join(paid_ids, "ride_id", "left_semi")
    return [
        FunnelStep("app_downloads", t["app_downloads"], "app_download_key"),
        FunnelStep("signups", t["signups"], "user_id"),
        FunnelStep("ride_requested", rides, "user_id"),
        FunnelStep("ride_accepted", rides, "user_id", F.col("accept_ts").isNotNull()),
        FunnelStep("ride_completed", rides, "user_id", F.col("dropoff_ts").isNotNull()),
        FunnelStep("approved_transaction", paid, "user_id"),
        FunnelStep("reviewed", t["reviews"], "user_id"),
    ]


def ride_funnel_steps(t: Mapping[str, DataFrame]) -> list[FunnelStep]:
    rides = t["ride_requests"]
    return [
        FunnelStep("app_downloads", t["app_downloads"], None),
        FunnelStep("signups", t["signups"], None),
        FunnelStep("ride_requested", rides, "ride_id"),
        FunnelStep("ride_accepted", rides, "ride_id", F.col("accept_ts").isNotNull()),
        FunnelStep("ride_completed", rides, "ride_id", F.col("dropoff_ts").isNotNull()),
        FunnelStep("approved_transaction", approved(t["transactions"]), "ride_id"),
        FunnelStep("reviewed", t["reviews"], "ride_id"),
    ]


def user_funnel(t: Mapping[str, DataFrame], top_lag: int = 6) -> DataFrame:
    """``funnel_name, user_count, perc_previous, perc_top`` in stage order."""
    return _presented(funnel_counts(user_funnel_steps(t)), top_lag, "user_count")


def ride_funnel(t: Mapping[str, DataFrame], top_lag: int = 4) -> DataFrame:
    """``funnel_name, ride_count, perc_previous, perc_top`` in stage order.
    Stages 1-2 are NULL at ride grain; an empty source drops its row (and so
    shifts every lag), as in the SQL it mirrors."""
    return _presented(funnel_counts(ride_funnel_steps(t)), top_lag, "ride_count")


def stage_conversion(t: Mapping[str, DataFrame]) -> DataFrame:
    """Users completing after acceptance, ride requests accepted.
    ``metric, numerator, denominator, ratio``."""
    users = funnel_counts(user_funnel_steps(t)[2:5])   # requested, accepted, completed
    rides = funnel_counts(ride_funnel_steps(t)[2:4])   # requested, accepted

    def pick(counts, metric, num_name, den_name):
        c = F.col("count")
        num = F.max(F.when(F.col("funnel_name") == num_name, c))
        den = F.max(F.when(F.col("funnel_name") == den_name, c))
        return counts.agg(num.alias("numerator"), den.alias("denominator")).select(
            F.lit(metric).alias("metric"), "numerator", "denominator",
            ratio(F.col("numerator"), F.col("denominator")).alias("ratio"))

    return union_all([
        pick(users, "users_completed_after_accept", "ride_completed", "ride_accepted"),
        pick(rides, "rides_accepted_of_requested", "ride_accepted", "ride_requested")])
