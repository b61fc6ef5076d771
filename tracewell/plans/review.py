"""The review queue as one nested row per listed case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed
from tracewell.operators import queue as Q
from tracewell.operators.timeline import last_events, trigger_evidence, with_waiting
from tracewell.schema import KEY
from tracewell.session import materialize

# More listed cases than this are joined as the optimizer decides.
BROADCAST_KEYS = 10_000
RAISING, LOWERING, EVIDENCE, FINDINGS, TIMELINE = 8, 8, 10, 6, 12


def _gathered(rows: DataFrame, name: str, order: str, *columns: str) -> DataFrame:
    """Rows of a case as an ordered array. The rows are already limited per case."""
    item = F.struct(F.col(order).alias("place"), *columns)
    return rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(item)).alias(name))


def review_queue(
    cases: DataFrame, events: DataFrame, scores: DataFrame, contributions: DataFrame,
    capacity: int, now: Column, reviews: DataFrame | None = None,
    findings: DataFrame | None = None, anchor: str = "procedure",
    meanings: dict = fixed.TRIGGER_MEANINGS,
) -> DataFrame:
    """Highest scores first, reviewed cases left out, with all a reviewer reads.

    Details are computed for the listed cases only: every detail table is semi-joined to their
    keys first, which are broadcast up to BROADCAST_KEYS of them. Within a case
    each detail is limited before it is gathered.
    """
    scored = cases.join(scores.select(*KEY, "score"), KEY)
    if reviews is not None:
        scored = Q.without_reviewed(scored, reviews)
    listed = materialize(Q.top_of_queue(scored, capacity), "listed")
    keys = listed.select(*KEY)
    if capacity <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    of_listed = lambda df: df.join(keys, KEY, "left_semi")

    # Each large table is scanned once, however many details are drawn from it.
    here = materialize(of_listed(events), "listed-events")
    pushes = materialize(of_listed(contributions), "listed-contributions")
    evidence = trigger_evidence(here, anchor)
    ranked = Q.ranked_contributions(pushes, max(RAISING, LOWERING))
    side = lambda name, n: ranked.where((F.col("side") == name) & (F.col("place") <= n))

    row = with_waiting(Q.headline_reason(listed, evidence, pushes, meanings), now)
    counts = here.groupBy(*KEY).agg(F.count(F.lit(1)).alias("event_count"))
    parts = [
        counts,
        _gathered(side("raising", RAISING), "raising", "place", "feature", "value", "weight",
                  "contribution"),
        _gathered(side("lowering", LOWERING), "lowering", "place", "feature", "value", "weight",
                  "contribution"),
        _gathered(Q.first_evidence(evidence, EVIDENCE), "triggers", "place", "text"),
        _gathered(
            last_events(here, TIMELINE).withColumn("place", -F.col("from_end")), "timeline",
            "place", "event_type", "value", "details", "ts",
        ),
    ]
    if findings is not None:
        parts.append(
            _gathered(Q.first_findings(of_listed(findings), FINDINGS), "findings", "place",
                      "sentence", "label", "probability")
        )
    for part in parts:
        row = row.join(part, KEY, "left")
    return row
