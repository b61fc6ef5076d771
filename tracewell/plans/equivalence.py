"""Are two copies of a dataset the same, down to features and scores?

Events are compared by a hash tree of their cases: buckets, then cases, then rows. Equal buckets end at the first
level, so equal copies join and shuffle no event; rows meet only for cases whose digests differ.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.cohort import count_true
from tracewell.operators.digests import Differences, differing_buckets, differing_keys, signed
from tracewell.operators.scoring import feature_names
from tracewell.schema import KEY
from tracewell.session import materialize

FIELDS = ["age", "gender", "label", "scenario", "label_source"]
EVENT_FIELDS = ["event_id", "event_type", "ts", "value", "details"]

def _paired(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    def side(df, name):
        return df.select(*KEY, F.lit(True).alias(f"in_{name}"),
                         *[F.col(c).alias(f"{name}_{c}") for c in columns])

    return side(left, "a").join(side(right, "b"), KEY, "full")


def _same(columns: list[str]):
    return reduce(
        lambda x, y: x & y,
        [F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")) for c in columns],
        F.lit(True),
    )


def field_mismatches(left: DataFrame, right: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """(case, field, left, right) for every differing field of the shared cases."""
    shared = _paired(left, right, fields).where("in_a and in_b")
    differing = F.filter(
        F.array(
            *[
                F.struct(
                    F.lit(f).alias("field"),
                    F.col(f"a_{f}").cast("string").alias("left"),
                    F.col(f"b_{f}").cast("string").alias("right"),
                )
                for f in fields
            ]
        ),
        lambda x: ~x["left"].eqNullSafe(x["right"]),
    )
    return shared.where(~_same(fields)).select(*KEY, F.inline(differing))


def event_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Events on one side only, with how many more copies that side has.

    Copies are counted as plus and minus one per distinct row, so equal rows
    meet in the map-side aggregate.
    """
    columns = [*KEY, *EVENT_FIELDS]
    return (
        signed(left, right, columns)
        .groupBy(*columns)
        .agg(F.sum("n").alias("surplus"))
        .where(F.col("surplus") != 0)
    )


def moved_events(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cases with an event that both sides hold, at another place of the case."""
    columns = [*KEY, *EVENT_FIELDS]
    placed = signed(left, right, [*columns, "case_ordinal"]).groupBy(*columns, "case_ordinal").agg(F.sum("n").alias("n"))
    return (
        placed.groupBy(*columns).agg(F.sum("n").alias("n"), F.max(F.abs("n")).alias("most"))
        .where("n = 0 AND most > 0").select(*KEY).distinct()
    )


@dataclass
class EventReport:
    """Events of both sides, cases with other events and cases with events at another place."""
    found: Differences
    mismatches: int = 0
    moved: int = 0


def compare_events(left: DataFrame, right: DataFrame) -> EventReport:
    """A case whose events differ by their places alone has moved events; rows decide only for cases whose
    events differ otherwise."""
    found = differing_buckets(left, right, KEY, [*EVENT_FIELDS, "case_ordinal"])
    if not found.buckets:
        return EventReport(found)
    left, right = found.among(left, KEY), found.among(right, KEY)
    cases = materialize(differing_keys(left, right, KEY, EVENT_FIELDS, ["case_ordinal"]), "differing")
    content = cases.where("content").select(*KEY)
    told = cases.agg(count_true(F.col("content")).alias("content"), count_true(~F.col("content")).alias("places")).head()
    moved = told["places"]
    if told["content"]:
        open_ = lambda df: df.alias("e").join(content.alias("c"), _same_key("e", "c"), "left_semi")
        moved += moved_events(open_(left), open_(right)).count()
    return EventReport(found, told["content"], moved)


def _same_key(a: str, b: str):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in KEY])


def equivalence_report(
    cases_a: DataFrame, events_a: DataFrame, features_a: DataFrame, scores_a: DataFrame,
    cases_b: DataFrame, events_b: DataFrame, features_b: DataFrame, scores_b: DataFrame,
    weights_a: DataFrame | None = None, weights_b: DataFrame | None = None,
) -> DataFrame:
    """One row: ids, order, fields, events, features, scores, and weights if they are given.

    A case with features or scores on one side only counts against the copy. Weights
    are tables of (feature, weight). Each part is reduced to one row of counts before the parts are combined.
    """
    names = feature_names(features_a)
    pairs = _paired(cases_a, cases_b, [*FIELDS, "source_ordinal"])
    both = F.col("in_a") & F.col("in_b")
    by_case = pairs.agg(
        count_true(F.col("in_a")).alias("left_cases"),
        count_true(F.col("in_b")).alias("right_cases"),
        count_true(~F.coalesce(both, F.lit(False))).alias("unmatched_cases"),
        count_true(both & ~_same(["source_ordinal"])).alias("moved_cases"),
        count_true(both & ~_same(FIELDS)).alias("field_mismatches"),
    )
    events = compare_events(events_a, events_b)
    features, scores = _paired(features_a, features_b, names), _paired(scores_a, scores_b, ["score"])
    one_sided = count_true(F.col("in_a").isNull() | F.col("in_b").isNull())
    gap = F.max(F.abs(F.col("a_score") - F.col("b_score")))
    one_null = count_true(both & (F.col("a_score").isNull() != F.col("b_score").isNull()))
    by_feature = features.agg(
        F.struct(count_true(both & ~_same(names)).alias("differ"), one_sided.alias("one_sided"))
    ).scalar()
    by_score = scores.agg(
        F.struct(F.coalesce(gap, F.lit(0.0)).alias("gap"), (one_sided + one_null).alias("one_sided"))
    ).scalar()
    weights = F.lit(0).cast("bigint")
    if weights_a is not None and weights_b is not None:
        pairs_w = weights_a.select("feature", F.col("weight").alias("a")).join(
            weights_b.select("feature", F.col("weight").alias("b")), "feature", "full"
        )
        weights = pairs_w.agg(count_true(~F.col("a").eqNullSafe(F.col("b")))).scalar()

    whole = lambda n: F.lit(n).cast("bigint")
    report = by_case.select(
        "*",
        whole(events.found.left_rows).alias("left_events"),
        whole(events.found.right_rows).alias("right_events"),
        whole(events.mismatches).alias("event_mismatches"),
        whole(events.moved).alias("moved_events"),
        by_feature["differ"].alias("feature_mismatches"),
        by_feature["one_sided"].alias("unmatched_features"),
        by_score["gap"].alias("max_score_delta"),
        by_score["one_sided"].alias("unmatched_scores"),
        weights.alias("weight_mismatches"),
    )
    same_ids = F.col("unmatched_cases") == 0
    return report.withColumn("same_ids", same_ids).withColumn(
        "same_order", same_ids & (F.col("moved_cases") == 0)
    ).withColumn(
        "equivalent",
        same_ids
        & (F.col("field_mismatches") == 0)
        & (F.col("event_mismatches") == 0)
        & (F.col("moved_events") == 0)
        & (F.col("feature_mismatches") == 0)
        & (F.col("unmatched_features") == 0)
        & (F.col("max_score_delta") == 0.0)
        & (F.col("unmatched_scores") == 0)
        & (F.col("weight_mismatches") == 0),
    )
