"""Registered queries: scoring, contributions, fits, equivalence, counterfactuals, store."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tracewell.catalog.common import plain
from tracewell.catalog.measures import COVERAGE_SQL, FEATURES_SQL
from tracewell.catalog.registry import query
from tracewell.catalog.sqltext import quoted, sql_iso, sql_list
from tracewell.catalog.timeline import EVIDENCE_PART, features_sql
from tracewell.functions import fixed_values as fixed
from tracewell.operators import cohort
from tracewell.operators import counterfactual as CF
from tracewell.operators import merge
from tracewell.operators import queue as Q
from tracewell.operators import scoring as S
from tracewell.operators import timeline as T
from tracewell.operators.notes import lexicon_features
from tracewell.plans.coverage import kept_coverage
from tracewell.plans.equivalence import equivalence_report, event_mismatches, field_mismatches
from tracewell.plans.nightly import ingest, ingest_and_rank, pending
from tracewell.plans.review import review_queue
from tracewell.schema import KEY
from tracewell.session import materialize, scratch_root, table
from tracewell.sources import csv_tables as R
from tracewell.sources import hospital as H
from tracewell.sources.activity import ACTIVITY_SQL, activity_cases, activity_events
from tracewell.sources.csv_tables import digest, load_tables
from tracewell.sources.raw_extracts import HOSPITAL_SQL, hospital_tables
from tracewell.sources.store import CaseStore
from tracewell.streaming.drops import watch_drops
from tracewell.streaming.waiting import SCORE, STAY, watch_waiting

# Hand-set weights, so scores have an exact counterpart in SQL.
WEIGHTS = {
    "antidote_given": 0.75, "antidote_after_treatment_start": 0.5,
    "context_dependent_reversal_agent": 0.25, "unplanned_icu_transfer": 1.25,
    "repeat_icu_escalation": 0.5, "unplanned_return_to_or": 1.0, "readmission_30d": 0.5,
    "rapid_response_called": 0.75, "transfusion_given": 0.25,
    "abnormal_post_treatment_lab": -0.25, "critical_post_treatment_lab": 0.5,
    "hemoglobin_drop": 1.0, "creatinine_doubled": 0.75, "abnormal_lab_types_count": 0.125,
}
INTERCEPT = -2.5
HAND = S.ScoringModel("logistic", list(WEIGHTS), meanings=fixed.TRIGGER_MEANINGS,
                      weights=WEIGHTS, intercept=INTERCEPT)

_LOGIT = " + ".join([f"({INTERCEPT})"] + [f"{n} * ({w})" for n, w in WEIGHTS.items()])
HAND_SQL = f"""{FEATURES_SQL},
scores AS (SELECT source, case_id, ({_LOGIT})::DOUBLE AS logit,
  1 / (1 + exp(-({_LOGIT})::DOUBLE)) AS score FROM features),
pushes AS ({" UNION ALL ".join(
    f"SELECT source, case_id, '{n}' AS feature, {n} AS value, {w}::DOUBLE AS weight, {n} * {w}::DOUBLE AS contribution, "
    f"{quoted(fixed.TRIGGER_MEANINGS[n])} AS description FROM features WHERE {n} <> 0" for n, w in WEIGHTS.items())})
"""


def features(spark, folder):
    return T.trigger_features(activity_events(spark, folder))


# --- fixed weights -------------------------------------------------------------------
@query("linear_scores", f"WITH {HAND_SQL} SELECT case_id, round(score, 9) AS score FROM scores")
def linear_scores(spark, folder):
    return HAND.score(features(spark, folder)).select("case_id", F.round("score", 9).alias("score"))


@query("linear_contributions",
       f"WITH {HAND_SQL} SELECT case_id, feature, value, weight, contribution, description FROM pushes")
def linear_contributions(spark, folder):
    return HAND.contributions(features(spark, folder)).drop("source")


@query(
    "score_breakdown",
    f"""WITH {HAND_SQL} SELECT s.case_id, {INTERCEPT}::DOUBLE AS baseline_log_odds,
      coalesce(sum(contribution), 0) AS sum_of_contributions, {INTERCEPT}::DOUBLE + coalesce(sum(contribution), 0) AS logit,
      round(max(score), 9) AS probability, true AS reconciles
    FROM scores s LEFT JOIN pushes p USING (source, case_id) GROUP BY s.source, s.case_id""",
)
def score_breakdown(spark, folder):
    rows = HAND.breakdown(features(spark, folder))
    return rows.select(
        "case_id", "baseline_log_odds", "sum_of_contributions", "logit",
        F.round("probability", 9).alias("probability"),
        (F.abs("gap") < 1e-9).alias("reconciles"),
    )


@query(
    "contributions_top",
    f"""WITH {HAND_SQL}, sided AS (SELECT *, CASE WHEN contribution > 0 THEN 'raising' ELSE 'lowering' END AS side FROM pushes)
    SELECT case_id, side, feature, contribution, row_number() OVER (PARTITION BY source, case_id, side
      ORDER BY abs(contribution) DESC, feature)::INTEGER AS place FROM sided QUALIFY place <= 3""",
)
def contributions_top(spark, folder):
    ranked = Q.ranked_contributions(HAND.contributions(features(spark, folder)), 3)
    return ranked.select("case_id", "side", "feature", "contribution", "place")


@query(
    "weight_table",
    f"WITH {FEATURES_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS feature, {quoted(fixed.TRIGGER_MEANINGS[n])} AS meaning, "
        f"{w}::DOUBLE AS log_odds_weight, (SELECT count(*) FROM features WHERE {n} > 0) AS cases"
        for n, w in WEIGHTS.items()
    ),
)
def weight_table(spark, folder):
    wide = features(spark, folder)
    fired = wide.agg(*[F.count_if(F.col(n) > 0).alias(n) for n in WEIGHTS]).unpivot(
        [], list(WEIGHTS), "feature", "cases"
    )
    return HAND.feature_table(spark).join(fired, "feature")


LISTED_SQL = f"""{HAND_SQL}, {EVIDENCE_PART},
queue AS (SELECT c.*, s.score, row_number() OVER (ORDER BY round(s.score, 9) DESC,
    coalesce(discharged_at, TIMESTAMP '9999-12-31'), c.source, c.case_id) AS rank
  FROM a_cases c JOIN scores s USING (source, case_id) WHERE scenario IS DISTINCT FROM 'view'),
listed AS (SELECT * FROM queue WHERE rank <= 50)"""


def rounded_scores(wide):
    """Nine digits, so that equal scores are ties in every engine."""
    return HAND.score(wide).select(*KEY, F.round("score", 9).alias("score"))


@query(
    "review_queue",
    f"""WITH {LISTED_SQL},
    placed AS (SELECT e.*, row_number() OVER (PARTITION BY case_id ORDER BY section, ts NULLS FIRST,
      case_ordinal NULLS FIRST, text) AS place FROM evidence e JOIN listed USING (source, case_id)),
    first_text AS (SELECT case_id, string_agg(text, ' | ' ORDER BY place) AS texts, min_by(text, place) AS first_text
      FROM placed WHERE place <= 10 GROUP BY case_id),
    raising AS (SELECT case_id, string_agg(feature, ',' ORDER BY abs(contribution) DESC, feature) AS raising,
      min_by(feature, p) AS top FROM (SELECT case_id, feature, contribution, row_number() OVER (PARTITION BY case_id
        ORDER BY abs(contribution) DESC, feature) AS p FROM pushes WHERE contribution > 0) WHERE p <= 8 GROUP BY case_id),
    last_ones AS (SELECT case_id, string_agg(value, ',' ORDER BY ts, case_ordinal) AS timeline, max(n) AS event_count FROM (
      SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts DESC, case_ordinal DESC) AS p,
        count(*) OVER (PARTITION BY case_id) AS n FROM a_events) WHERE p <= 12 GROUP BY case_id),
    found AS (SELECT case_id, string_agg(sentence, ' | ' ORDER BY p) AS findings FROM (SELECT *, row_number() OVER (PARTITION BY case_id
        ORDER BY label <> 'unanticipated', probability DESC, case_ordinal) AS p FROM (
          SELECT case_id, case_ordinal, coalesce(value, '') || ' was noted.' AS sentence,
            CASE WHEN case_ordinal % 2 = 0 THEN 'unanticipated' ELSE 'expected_risk' END AS label, (case_ordinal % 7) / 7.0 AS probability FROM a_events))
      WHERE p <= 6 GROUP BY case_id)
    SELECT case_id, rank, round(score, 9) AS score, coalesce(first_text, (
        CASE top {" ".join(f"WHEN '{n}' THEN {quoted(m)}" for n, m in fixed.TRIGGER_MEANINGS.items())} END),
        'Flagged for a second look') AS reason,
      CASE WHEN discharged_at IS NOT NULL THEN greatest(0, floor((epoch_us(TIMESTAMP '2024-02-05 12:00:00')
        - epoch_us(discharged_at)) / 86400e6))::INTEGER END AS waiting_days, event_count, raising, texts, timeline, findings
    FROM listed LEFT JOIN found USING (case_id) LEFT JOIN first_text USING (case_id) LEFT JOIN raising USING (case_id) LEFT JOIN last_ones USING (case_id)""",
)
def review_queue_rows(spark, folder):
    wide = features(spark, folder)
    now = F.lit("2024-02-05 12:00:00").cast("timestamp")
    rows = review_queue(
        activity_cases(spark, folder), activity_events(spark, folder), rounded_scores(wide),
        HAND.contributions(wide), 50, now, reviews(spark, folder), noted(spark, folder), anchor="admission",
    )
    return rows.select(
        "case_id", "rank", "score", "reason", "waiting_days", "event_count",
        F.array_join("raising.feature", ",").alias("raising"),
        F.array_join("triggers.text", " | ").alias("texts"),
        F.array_join("timeline.value", ",").alias("timeline"),
        F.array_join("findings.sentence", " | ").alias("findings"),
    )


def noted(spark, folder):
    """A finding for each event: a sentence with its framing and how sure that is."""
    ordinal = F.col("case_ordinal")
    return activity_events(spark, folder).select(
        *KEY, "case_ordinal", F.lit(0).alias("position"),
        F.concat(F.coalesce("value", F.lit("")), F.lit(" was noted.")).alias("sentence"),
        F.when(ordinal % 2 == 0, "unanticipated").otherwise("expected_risk").alias("label"),
        ((ordinal % 7) / 7.0).alias("probability"),
    )


# --- reviews and pending ----------------------------------------------------------------
REVIEWED = "scenario = 'view'"


def reviews(spark, folder):
    """Cases whose last activity name is `view` stand for the reviewed ones, twice each."""
    once = activity_cases(spark, folder).where(F.col("scenario") == "view").select(*KEY)
    return once.unionByName(once)


@query("reviewed_cases", f"WITH {ACTIVITY_SQL} SELECT case_id FROM a_cases WHERE {REVIEWED}")
def reviewed_cases(spark, folder):
    return Q.reviewed_cases(activity_cases(spark, folder), reviews(spark, folder)).select("case_id")


@query("queue_without_reviewed",
       f"WITH {HAND_SQL} SELECT case_id, round(score, 9) AS score FROM scores JOIN a_cases USING (source, case_id) "
       f"WHERE NOT {REVIEWED}")
def queue_without_reviewed(spark, folder):
    scored = rounded_scores(features(spark, folder))
    return Q.without_reviewed(scored, reviews(spark, folder)).select("case_id", "score")


@query("discharged_unscored",
       f"WITH {ACTIVITY_SQL} SELECT case_id, {sql_iso('discharged_at')} AS discharged_at FROM a_cases "
       f"WHERE discharged_at IS NOT NULL AND NOT {REVIEWED}")
def discharged_unscored(spark, folder):
    scored = reviews(spark, folder)
    return plain(
        Q.oldest_first(Q.discharged_unscored(activity_cases(spark, folder), scored)).select(
            "case_id", "discharged_at"
        )
    )


# --- equivalence -----------------------------------------------------------------------------
def changed_copy(spark, folder):
    """A copy with known differences: one gender recoded, procedure names in capitals,
    escalations removed."""
    cases = activity_cases(spark, folder).withColumn(
        "gender", F.when(F.col("gender") == "F", "f").otherwise(F.col("gender"))
    )
    events = activity_events(spark, folder).where(F.col("value") != "MICU").withColumn(
        "value",
        F.when(F.col("event_type") == "procedure", F.upper("value")).otherwise(F.col("value")),
    )
    return cases, events


_COPY_FEATURES = features_sql("a.by_procedure", "features_b").replace(
    "FROM signals s", "FROM (SELECT * FROM signals WHERE value <> 'MICU') s"
)
EQUIVALENCE_SQL = f"""{HAND_SQL}, {_COPY_FEATURES},
scores_b AS (SELECT source, case_id, 1 / (1 + exp(-({_LOGIT})::DOUBLE)) AS score FROM features_b),
rows_b AS (SELECT source, case_id, event_id, event_type, ts,
    CASE WHEN event_type = 'procedure' THEN upper(value) ELSE value END AS value, details
  FROM a_events WHERE value <> 'MICU'),
diff AS (SELECT *, 1 AS surplus FROM (SELECT source, case_id, event_id, event_type, ts, value, details FROM a_events
    EXCEPT ALL SELECT * FROM rows_b)
  UNION ALL SELECT *, -1 FROM (SELECT * FROM rows_b EXCEPT ALL
    SELECT source, case_id, event_id, event_type, ts, value, details FROM a_events))"""


@query(
    "equivalence_report",
    f"""WITH {EQUIVALENCE_SQL},
    fb AS (SELECT count_if(({" OR ".join(f"a.{n} <> b.{n}" for n in WEIGHTS)})) AS n FROM features a JOIN features_b b USING (source, case_id)),
    sb AS (SELECT max(abs(a.score - b.score)) AS d FROM scores a JOIN scores_b b USING (source, case_id)),
    ids AS (SELECT count(*) AS n FROM a_cases),
    apart AS (SELECT count_if(a.case_id IS NULL OR b.case_id IS NULL) AS n FROM features a FULL JOIN features_b b USING (source, case_id))
    SELECT (SELECT n FROM ids) AS left_cases, (SELECT n FROM ids) AS right_cases, 0::BIGINT AS unmatched_cases,
      0::BIGINT AS moved_cases, (SELECT count(*) FROM a_cases WHERE gender = 'F') AS field_mismatches,
      (SELECT count(*) FROM a_events) AS left_events, (SELECT count(*) FROM rows_b) AS right_events,
      (SELECT count(DISTINCT case_id) FROM diff) AS event_mismatches, (SELECT n FROM fb)::BIGINT AS feature_mismatches,
      0::BIGINT AS moved_events, (SELECT n FROM apart)::BIGINT AS unmatched_features,
      (SELECT n FROM apart)::BIGINT AS unmatched_scores, 0::BIGINT AS weight_mismatches,
      round((SELECT d FROM sb), 9) AS max_score_delta, true AS same_ids, true AS same_order, false AS equivalent""",
)
def equivalence(spark, folder):
    cases_a, events_a = activity_cases(spark, folder), activity_events(spark, folder)
    cases_b, events_b = changed_copy(spark, folder)
    features_a, features_b = T.trigger_features(events_a), T.trigger_features(events_b)
    report = equivalence_report(
        cases_a, events_a, features_a, HAND.score(features_a),
        cases_b, events_b, features_b, HAND.score(features_b),
    )
    return report.withColumn("max_score_delta", F.round("max_score_delta", 9))


@query(
    "equivalence_one_sided",
    f"""WITH {HAND_SQL}, turned AS (SELECT source, case_id FROM a_events WHERE event_type = 'lab'
        AND case_ordinal <> -case_ordinal GROUP BY source, case_id),
    ids AS (SELECT count(*) AS n FROM a_cases),
    lost AS (SELECT count(*) AS n FROM features f JOIN a_cases c USING (source, case_id) WHERE gender <> 'F' OR gender IS NULL)
    SELECT (SELECT n FROM ids) AS left_cases, (SELECT n FROM ids) AS right_cases, 0::BIGINT AS unmatched_cases,
      0::BIGINT AS moved_cases, 0::BIGINT AS field_mismatches, (SELECT count(*) FROM a_events) AS left_events,
      (SELECT count(*) FROM a_events) AS right_events, 0::BIGINT AS event_mismatches,
      (SELECT count(*) FROM turned)::BIGINT AS moved_events, 0::BIGINT AS feature_mismatches,
      (SELECT n FROM lost)::BIGINT AS unmatched_features, 0.0::DOUBLE AS max_score_delta,
      (SELECT n FROM lost)::BIGINT AS unmatched_scores, 1::BIGINT AS weight_mismatches,
      true AS same_ids, true AS same_order, false AS equivalent""",
)
def equivalence_one_sided(spark, folder):
    """A copy without the features and scores of some cases, with labs in another order
    and one weight changed: nothing that both sides hold differs otherwise."""
    cases, events = activity_cases(spark, folder), activity_events(spark, folder)
    features = T.trigger_features(events)
    some = features.join(cases.where("gender = 'F'").select(*KEY), KEY, "left_semi")
    turned = events.withColumn(
        "case_ordinal",
        F.when(F.col("event_type") == "lab", -F.col("case_ordinal")).otherwise(F.col("case_ordinal")),
    )
    weights = spark.createDataFrame(list(WEIGHTS.items()), "feature string, weight double")
    other = weights.withColumn("weight", F.when(F.col("feature") == "hemoglobin_drop", 2.0).otherwise(F.col("weight")))
    return equivalence_report(
        cases, events, features, HAND.score(features), cases, turned, some, HAND.score(some), weights, other,
    )


@query("equivalence_fields",
       f"WITH {ACTIVITY_SQL} SELECT case_id, 'gender' AS field, 'F' AS left, 'f' AS right FROM a_cases WHERE gender = 'F'")
def equivalence_fields(spark, folder):
    return field_mismatches(activity_cases(spark, folder), changed_copy(spark, folder)[0]).drop(
        "source"
    )


@query("equivalence_events",
       f"WITH {EQUIVALENCE_SQL} SELECT case_id, event_id, value, surplus::BIGINT AS surplus FROM diff")
def equivalence_events(spark, folder):
    return event_mismatches(activity_events(spark, folder), changed_copy(spark, folder)[1]).select(
        "case_id", "event_id", "value", "surplus"
    )


# --- counterfactuals ------------------------------------------------------------------------------
_DRAW = "(('0x' || substr(md5('7{tag}:' || source || '|' || case_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"


def _sql_delay(tag: str, span) -> str:
    low, high = span
    return f"started + to_hours(({low} + floor({_DRAW.format(tag=tag)} * {high - low + 1}))::BIGINT)"


def _sql_rows(rows: list) -> str:
    return "[" + ", ".join(f"{{'value': {quoted(a)}, 'details': {quoted(b)}}}" for a, b in rows) + "]"


CHOSEN_SQL = f"""{ACTIVITY_SQL},
hashed AS (SELECT source, case_id, label, md5('7:' || source || '|' || case_id) AS h FROM a_cases WHERE label IS NOT NULL),
sizes AS (SELECT count_if(label) AS p, count_if(NOT label) AS n FROM hashed),
placed AS (SELECT hashed.*, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, p, n FROM hashed, sizes),
chosen AS (SELECT source, case_id, label, h, label AND rn <= floor(p * 0.45::DOUBLE) AS silent,
  label AND rn <= floor(p * 0.15::DOUBLE) AS dark, NOT label AND rn <= floor(n * 0.18::DOUBLE) AS benign FROM placed),
doomed AS (SELECT e.* FROM a_events e JOIN chosen c USING (source, case_id) WHERE silent AND (
    (event_type = 'medication' AND list_contains({sql_list(fixed.SIGNATURE_MEDS)}, value))
    OR (event_type = 'procedure' AND list_contains({sql_list(fixed.SIGNATURE_PROCEDURES)}, value))
    OR (event_type = 'lab' AND dark)))"""
_LABS = [(a, f"{b} {c}") for a, b, c in fixed.EXPLAINED_LABS]
INJECTED_SQL = f"""{CHOSEN_SQL},
base AS (SELECT c.source, c.case_id, row_number() OVER (ORDER BY h) - 1 AS i, started FROM chosen c
  JOIN (SELECT source, case_id, min(ts) AS started FROM a_events GROUP BY ALL) USING (source, case_id) WHERE benign),
injected AS (
  SELECT case_id, 'medication' AS event_type, {_sql_delay('med', fixed.MED_DELAY)} AS ts,
    ({_sql_rows(fixed.EXPLAINED_MEDS)})[i % 10 + 1] AS row FROM base
  UNION ALL SELECT case_id, 'procedure', {_sql_delay('proc', fixed.PROCEDURE_DELAY)},
    ({_sql_rows(fixed.EXPLAINED_PROCEDURES)})[i % 10 + 1] FROM base WHERE {_DRAW.format(tag='proc?')} < 0.85
  UNION ALL SELECT case_id, 'lab', {_sql_delay('lab', fixed.LAB_DELAY)},
    ({_sql_rows(_LABS)})[floor({_DRAW.format(tag='which')} * 5)::BIGINT + 1] FROM base WHERE {_DRAW.format(tag='lab?')} < 0.45)"""


def chosen(spark, folder):
    return CF.chosen_cases(activity_cases(spark, folder), CF.Shares(), 7)


@query("counterfactual_cases", f"WITH {CHOSEN_SQL} SELECT case_id, silent, dark, benign FROM chosen")
def counterfactual_cases(spark, folder):
    return chosen(spark, folder).select("case_id", "silent", "dark", "benign")


@query("counterfactual_stripped", f"WITH {CHOSEN_SQL} SELECT case_id, case_ordinal, value FROM doomed")
def counterfactual_stripped(spark, folder):
    return CF.doomed_events(
        activity_events(spark, folder), chosen(spark, folder), CF.Shares()
    ).select("case_id", "case_ordinal", "value")


@query(
    "counterfactual_injected",
    f"WITH {INJECTED_SQL} SELECT case_id, event_type, {sql_iso('ts')} AS ts, row.value AS value, row.details AS details FROM injected",
)
def counterfactual_injected(spark, folder):
    added = CF.explained_events(activity_events(spark, folder), chosen(spark, folder), 7)
    return plain(added.select("case_id", "event_type", "ts", "value", "details"))


@query(
    "counterfactual_counts",
    f"""WITH {INJECTED_SQL} SELECT count_if(label)::BIGINT AS positives, count_if(NOT label)::BIGINT AS negatives,
      count_if(silent)::BIGINT AS silenced, count_if(dark)::BIGINT AS darkened, count_if(benign)::BIGINT AS benign_triggered,
      (SELECT count(*) FROM doomed) AS rows_deleted, (SELECT count(*) FROM injected) AS rows_inserted FROM chosen""",
)
def counterfactual_counts(spark, folder):
    return CF.apply(activity_cases(spark, folder), activity_events(spark, folder), "run").counts


@query(
    "counterfactual_dry_run",
    f"""WITH {CHOSEN_SQL} SELECT count_if(label)::BIGINT AS positives, count_if(NOT label)::BIGINT AS negatives,
      count_if(silent)::BIGINT AS silenced, count_if(dark)::BIGINT AS darkened, count_if(benign)::BIGINT AS benign_triggered,
      0::BIGINT AS rows_deleted, 0::BIGINT AS rows_inserted FROM chosen""",
)
def counterfactual_dry_run(spark, folder):
    return CF.plan_counts(chosen(spark, folder))


@query(
    "counterfactual_undone",
    f"WITH {ACTIVITY_SQL} SELECT case_id, case_ordinal, event_id, event_type, {sql_iso('ts')} AS ts, value, details FROM a_events",
)
def counterfactual_undone(spark, folder):
    change = CF.apply(activity_cases(spark, folder), activity_events(spark, folder), "run")
    return plain(CF.undo(change.events, change.log).drop("source"))


# --- upkeep -----------------------------------------------------------------------------------------
def hospital(spark, folder):
    return H.conform(hospital_tables(spark, folder))


def open_again(cases):
    """A later delivery: every stay of the older half, closed stays open again."""
    return cases.where(F.col("admitted_at") < "1998-01-01").select(
        *KEY, F.lit(99).alias("age"), "gender", F.lit(None).cast("timestamp").alias("discharged_at"),
        F.lit(1).alias("source_ordinal"),
    )


@query(
    "store_upsert",
    f"""WITH {HOSPITAL_SQL} SELECT case_id, CASE WHEN admitted_at < '1998-01-01' THEN 99 ELSE age END AS age,
      {sql_iso("CASE WHEN admitted_at >= '1998-01-01' THEN discharged_at END")} AS discharged_at FROM h_cases""",
)
def store_upsert(spark, folder):
    cases = hospital(spark, folder)[0]
    stored = cases.select(*KEY, "age", "gender", "discharged_at", F.lit(0).alias("source_ordinal"))
    return plain(
        merge.upsert(stored, open_again(cases)).select("case_id", "age", "discharged_at")
    )


@query(
    "store_append_unseen",
    f"""WITH {HOSPITAL_SQL},
    stored AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_type, event_id) - 1 AS case_ordinal
      FROM h_events WHERE event_type <> 'medication'),
    fresh AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ts, event_type, event_id) AS n
      FROM h_events WHERE event_type = 'medication'),
    ends AS (SELECT case_id, max(case_ordinal) AS e FROM stored GROUP BY case_id)
    SELECT case_id, event_id, coalesce(e, -1) + n AS case_ordinal FROM fresh LEFT JOIN ends USING (case_id)""",
)
def store_append_unseen(spark, folder):
    # read for both sides, so they are conformed once
    events = materialize(hospital(spark, folder)[1], "events")
    stored = H.with_case_ordinals(events.where(F.col("event_type") != "medication"))
    return merge.unseen_events(stored, events, written=True).select("case_id", "event_id", "case_ordinal")


@query(
    "store_replace_events",
    f"""WITH {HOSPITAL_SQL}, older AS (SELECT case_id FROM h_cases WHERE admitted_at < '1998-01-01')
    SELECT case_id, event_id, event_type FROM h_events WHERE case_id NOT IN (SELECT case_id FROM older)
      OR event_type = 'admission'""",
)
def store_replace_events(spark, folder):
    cases, events = hospital(spark, folder)
    older = cases.where(F.col("admitted_at") < "1998-01-01")
    arrivals = events.where(F.col("event_type") == "admission").join(
        older.select(*KEY), KEY, "left_semi"
    )
    return merge.replace_events(events, arrivals, older).select("case_id", "event_id", "event_type")


def fresh_store(spark) -> CaseStore:
    folder = os.path.join(
        scratch_root(spark), spark.sparkContext.applicationId, f"store-{uuid.uuid4().hex}"
    )
    return CaseStore(spark, folder)


@query(
    "nightly_cycle",
    f"""WITH {HOSPITAL_SQL} SELECT count(*) AS total, count_if(discharged_at IS NULL)::BIGINT AS in_house,
      count_if(discharged_at IS NOT NULL)::BIGINT AS discharged, (SELECT count(*) FROM h_events) AS events_stored,
      count_if(discharged_at IS NOT NULL)::BIGINT AS ranked, 0::BIGINT AS left_to_rank, 0::BIGINT AS appended_again FROM h_cases""",
)
def nightly_cycle(spark, folder):
    """A drop is taken in and ranked; the same drop again adds and ranks nothing."""
    store, tables = fresh_store(spark), hospital_tables(spark, folder)
    first, _ = ingest_and_rank(store, tables, HAND)
    again, _ = ingest_and_rank(store, tables, HAND)
    return again.census.select(
        "total", "in_house", "discharged",
        F.lit(first.events_appended).cast("bigint").alias("events_stored"),
        store.read("scores").agg(F.count(F.lit(1))).scalar().alias("ranked"),
        pending(store).agg(F.count(F.lit(1))).scalar().alias("left_to_rank"),
        F.lit(again.events_appended).cast("bigint").alias("appended_again"),
    )


def activity_store(spark, folder) -> CaseStore:
    store = fresh_store(spark)
    store.replace_cases(activity_cases(spark, folder), activity_events(spark, folder))
    return store


def three_drops(spark, folder):
    """Cases and events in three drops: all cases first, without labels or discharge, and the events that are no
    labs; then half of the cases as they are, and the labs; then the other cases as well."""
    cases, events = activity_cases(spark, folder), activity_events(spark, folder)
    half = F.pmod(F.xxhash64(*KEY), F.lit(2))
    open_ = cases.withColumn("label", F.lit(None).cast("boolean")).withColumn("discharged_at", F.lit(None).cast("timestamp"))
    labs = F.col("event_type") == "lab"
    return [(open_, events.where(~labs)), (cases.where(half == 0), events.where(labs)), (cases.where(half == 1), events)]


@query(
    "census_kept",
    f"""WITH {ACTIVITY_SQL} SELECT source, count(*) AS total, count_if(discharged_at IS NULL)::BIGINT AS in_house,
      count_if(discharged_at IS NOT NULL)::BIGINT AS discharged FROM a_cases GROUP BY source""",
)
def census_kept(spark, folder):
    """The census as the commits of three drops have kept it; no case is read for it."""
    store = fresh_store(spark)
    for cases, _ in three_drops(spark, folder):
        store.upsert_cases(cases)
    return store.census()


@query("coverage_kept", f"WITH {COVERAGE_SQL} SELECT * FROM coverage")
def coverage_kept(spark, folder):
    """Coverage kept over three drops: each counts anew the buckets that it touched."""
    store = fresh_store(spark)
    for cases, events in three_drops(spark, folder):
        store.upsert_cases(cases)
        store.append_events(events)
        kept = kept_coverage(store)
    return kept.coverage


@query(
    "store_score_run",
    f"WITH {HAND_SQL} SELECT case_id, round(score, 9) AS score, feature, contribution "
    "FROM scores JOIN pushes USING (source, case_id)",
)
def store_score_run(spark, folder):
    store = activity_store(spark, folder)
    wide = T.trigger_features(store.case_events("activity"))
    store.write_scores(HAND.score(wide), HAND.contributions(wide), "logistic", "hand-set")
    runs = merge.run_contributions(store.read("scores"), store.read("contributions"))
    return runs.select("case_id", F.round("score", 9).alias("score"), "feature", "contribution")


@query(
    "store_reviews",
    f"WITH {ACTIVITY_SQL} SELECT case_id, 2::BIGINT AS n_reviews FROM a_cases WHERE {REVIEWED}",
)
def store_reviews(spark, folder):
    store = activity_store(spark, folder)
    batch = reviews(spark, folder).select(
        *KEY, F.lit("someone").alias("reviewer"), F.lit("unclear").alias("decision"),
        F.lit(None).cast("string").alias("notes"),
    )
    store.record_reviews(batch)
    return store.read("reviews").groupBy("case_id").agg(F.count(F.lit(1)).alias("n_reviews"))


@query("feature_matrix", f"WITH {FEATURES_SQL} SELECT * FROM features")
def feature_matrix(spark, folder):
    return S.feature_matrix(activity_cases(spark, folder), features(spark, folder))


@query(
    "counterfactual_log",
    f"""WITH {INJECTED_SQL} SELECT 'delete' AS action, case_id, value FROM doomed
    UNION ALL SELECT 'insert', case_id, row.value FROM injected""",
)
def counterfactual_log(spark, folder):
    log = CF.apply(activity_cases(spark, folder), activity_events(spark, folder), "run").log
    return log.select("action", "case_id", F.get_json_object("row_json", "$.value").alias("value"))


_RAW = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@query(
    "load_raw_tables",
    " UNION ALL ".join(
        f"SELECT 'raw.{n}' AS table_name, count(*) AS source_rows, count(*) AS target_rows, true AS same, "
        f"true AS same_values, 0::BIGINT AS malformed FROM {n}" for n in _RAW
    ),
)
def load_raw_tables(spark, folder):
    """Every table out to CSV and in again. Arrays go as text, which CSV knows alone."""
    root = fresh_store(spark).root
    paths, schemas, written = {}, {}, []
    for name in _RAW:
        df = table(spark, folder, name)
        df = df.select(*[
            F.to_json(c).alias(c) if kind.startswith("array") else F.col(c) for c, kind in df.dtypes
        ])
        raw, seen = f"raw.{name}", Observation(f"write-{name}")
        paths[raw], schemas[raw] = f"{root}/csv/{name}", df.schema
        (
            df.observe(seen, digest(df.columns).alias("digest")).write.option("header", True).option("escape", '"')
            .option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            .option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(paths[raw])
        )
        written.append((raw, seen.get["digest"]))
    loaded = load_tables(spark, paths, f"{root}/tables", schemas)
    before = spark.createDataFrame(written, "table_name string, before decimal(38,0)")
    return loaded.join(before, "table_name").select(
        "table_name", "source_rows", "target_rows", "same", (F.col("digest") == F.col("before")).alias("same_values"), "malformed",
    )


def _as_csv(df, name: str, compressed: bool) -> str:
    """df in CSV files below a new folder; the folder's root."""
    root = fresh_store(df.sparkSession).root
    writer = df.write.option("header", True).option("escape", '"')
    (writer.option("compression", "gzip") if compressed else writer).csv(f"{root}/{name}.csv" + (".gz" if compressed else ""))
    return root


@query("csv_gz_columns", "SELECT p_partkey, p_name, p_size::BIGINT AS p_size FROM part")
def csv_gz_columns(spark, folder):
    """A table of a compressed extract, by its module and name, with some of its columns."""
    root = _as_csv(table(spark, folder, "part"), "hosp/part", compressed=True)
    rows = R.read_columns(spark, root, "hosp/part", ["p_partkey", "p_name", "p_size"])
    return rows.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "p_name", F.col("p_size").cast("bigint").alias("p_size"))


@query(
    "csv_text_columns",
    "SELECT conv_id::VARCHAR AS conv_id, turn::VARCHAR AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations",
)
def csv_text_columns(spark, folder):
    """Everything as text, from texts with line breaks and quotes in split files."""
    root = _as_csv(table(spark, folder, "conversations").select("conv_id", "turn", "role", "text"), "turns", compressed=False)
    return R.read_text_columns(spark, f"{root}/turns.csv")


@query("warehouse_columns", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def warehouse_columns(spark, folder):
    name = f"orders_{uuid.uuid4().hex}"
    table(spark, folder, "orders").createOrReplaceTempView(name)
    return R.read_warehouse(spark, name, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query(
    "extractor_plugin",
    f"""WITH {FEATURES_SQL}, kinds AS (SELECT source, case_id, count(DISTINCT event_type)::DOUBLE AS n_kinds,
      count_if(value IS NULL)::DOUBLE AS n_unnamed FROM a_events GROUP BY ALL)
    SELECT case_id, {", ".join(WEIGHTS)}, coalesce(n_kinds, 0) AS n_kinds, coalesce(n_unnamed, 0) AS n_unnamed
    FROM features LEFT JOIN kinds USING (source, case_id)""",
)
def extractor_plugin(spark, folder):
    """The features of the built-in extractor beside those of one that is handed in."""
    def kinds(cases, events):
        return events.groupBy(*KEY).agg(
            F.count_distinct("event_type").cast("double").alias("n_kinds"),
            F.count_if(F.col("value").isNull()).cast("double").alias("n_unnamed"))

    watch = lambda cases, events: T.trigger_features(events, cases)
    cases, events = activity_cases(spark, folder), activity_events(spark, folder)
    return S.feature_matrix(cases, *[extract(cases, events) for extract in (watch, kinds)]).drop("source")


@query(
    "stream_drops",
    f"""WITH {HOSPITAL_SQL} SELECT count(*) AS total, count_if(discharged_at IS NULL)::BIGINT AS in_house,
      count_if(discharged_at IS NOT NULL)::BIGINT AS discharged, (SELECT count(*) FROM h_events) AS events_stored,
      count_if(discharged_at IS NOT NULL)::BIGINT AS ranked, 0::BIGINT AS left_to_rank, true AS scores_explained
    FROM h_cases""",
)
def stream_drops(spark, folder):
    """Stays and labs arrive first, then the rest with the stays repeated."""
    store = fresh_store(spark)
    mapped = {r: H.map_columns(df, r) for r, df in hospital_tables(spark, folder).items()}
    inbox = f"{store.root}-inbox"
    for roles in (("stays", "labs"), ("stays", "meds", "transfers")):
        for role in roles:
            rows = mapped[role].withColumn("role", F.lit(role))
            rows.write.mode("append").parquet(inbox)
        watch_drops(
            spark, inbox, store, f"{store.root}-checkpoint", HAND, file_format="parquet"
        ).awaitTermination()
    events = store.case_events()
    # the contributions stored with each score add up to its logit
    sums = store.read("contributions").groupBy("run_id", *KEY).agg(F.sum("contribution").alias("pushed"))
    logit = F.log(F.col("score") / (1 - F.col("score")))
    gaps = store.read("scores").join(sums, ["run_id", *KEY], "left").select(
        (F.lit(INTERCEPT) + F.coalesce("pushed", F.lit(0.0)) - logit).alias("gap"))
    return cohort.stay_census(store.cases()).select(
        "total", "in_house", "discharged",
        events.agg(F.count(F.lit(1))).scalar().alias("events_stored"),
        store.read("scores").agg(F.count(F.lit(1))).scalar().alias("ranked"),
        pending(store).agg(F.count(F.lit(1))).scalar().alias("left_to_rank"),
        (gaps.agg(F.coalesce(F.max(F.abs("gap")), F.lit(0.0))).scalar() < 1e-9).alias("scores_explained"),
    )


@query(
    "stream_waiting",
    f"""WITH {HOSPITAL_SQL}, d AS (SELECT case_id, CAST(regexp_extract(case_id, '[0-9]+$') AS BIGINT) AS k,
      date_trunc('milliseconds', discharged_at) AS out FROM h_cases WHERE discharged_at IS NOT NULL)
    SELECT case_id, {sql_iso("out")} AS discharged_at, {sql_iso("out + INTERVAL 7 DAY")} AS stale_at,
      k % 5 = 0 AND out <= TIMESTAMP '1997-01-01' - INTERVAL 7 DAY AS late
    FROM d WHERE out + INTERVAL 7 DAY <= TIMESTAMP '1999-01-01'
      AND NOT (k % 3 = 0 AND TIMESTAMP '1997-01-01' < out + INTERVAL 7 DAY)""",
)
def stream_waiting(spark, folder):
    """Two runs: early discharges and some scores, then every stay again with those that were withheld.

    A fifth of the stays comes late, a third is scored in the first run, and timers flag what no later file names."""
    store = fresh_store(spark)
    cases, _ = hospital(spark, folder)
    first, second = (F.lit(t).cast("timestamp") for t in ("1997-01-01", "1999-01-01"))
    k = F.regexp_extract("case_id", "[0-9]+$", 0).cast("bigint")
    news = lambda df, kind, at: df.select(*KEY, F.lit(kind).alias("kind"), at.alias("at"), F.when(F.lit(kind == STAY), F.col("discharged_at")).alias("discharged_at"))
    early = cases.where((k % 5 != 0) & (F.col("discharged_at") <= first))
    runs = [
        news(early, STAY, first).unionByName(news(cases.where(k % 3 == 0), SCORE, first)),
        news(cases, STAY, second),
    ]
    flags = f"{store.root}-flags"
    for rows in runs:
        rows.write.mode("append").parquet(f"{store.root}-news")
        watch_waiting(spark, f"{store.root}-news", flags, f"{store.root}-waiting").awaitTermination()
    return plain(spark.read.parquet(flags).select("case_id", "discharged_at", "stale_at", "late"))


@query(
    "key_set_difference",
    """SELECT o_orderkey AS k, 'left' AS only_in FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT DISTINCT l_orderkey, 'right' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""",
)
def key_set_difference(spark, folder):
    return cohort.key_set_difference(
        table(spark, folder, "orders").select(F.col("o_orderkey").alias("k")),
        table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("k")), ["k"],
    )


# --- fits: iterative, rows only ------------------------------------------------------------------------
def trained(spark, folder, kind, report=False):
    """The report is whole, with cross-validation; queries of the model alone do without."""
    return S.train(
        features(spark, folder), activity_cases(spark, folder), kind,
        meanings=fixed.TRIGGER_MEANINGS, cross_validate=report,
    )


def report_frame(spark, report):
    return spark.createDataFrame([(k, str(v)) for k, v in report.items()], "measure string, shown string")


@query("logistic_report")
def logistic_report(spark, folder):
    return report_frame(spark, trained(spark, folder, "logistic", report=True).report)


@query("tree_report")
def tree_report(spark, folder):
    return report_frame(spark, trained(spark, folder, "tree", report=True).report)


@query(
    "logistic_optimum",
    " UNION ALL ".join(f"SELECT '{n}' AS feature, true AS at_the_optimum" for n in ["", *WEIGHTS]),
)
def logistic_optimum(spark, folder):
    """The gradient per row at the fitted weights, taken anew from all labelled cases one by one: the objective is
    convex, so weights where it vanishes are the solution."""
    known = features(spark, folder).join(
        activity_cases(spark, folder).where(F.col("label").isNotNull()).select(*KEY, "label"), KEY)
    model = S.ScoringModel.fit(known, names=list(WEIGHTS))
    n = F.col("n")
    sizes = known.agg(F.count(F.lit(1)).alias("n"), F.count_if("label").alias("p")).first()
    weight = F.when(F.col("label"), sizes["n"] / (2 * sizes["p"])).otherwise(sizes["n"] / (2 * (sizes["n"] - sizes["p"])))
    error = weight * (F.col("score") - F.col("label").cast("double"))
    sums = model.score(known).agg(F.count(F.lit(1)).alias("n"), F.sum(error).alias("__"), *[F.sum(error * F.col(c)).alias(c) for c in WEIGHTS])
    weights = {"__": 0.0, **model.weights}
    rows = F.inline(F.array(*[
        F.struct(F.lit(c.strip("_") if c == "__" else c).alias("feature"), (F.abs((F.col(c) + w) / n) < 1e-8).alias("at_the_optimum"))
        for c, w in weights.items()
    ]))
    return sums.select(rows)


@query(
    "logistic_identity",
    f"WITH {FEATURES_SQL} SELECT case_id, true AS adds_up FROM features",
)
def logistic_identity(spark, folder):
    """Baseline and contributions of the fitted model add up to the logit of each score."""
    rows = trained(spark, folder, "logistic").model.breakdown(features(spark, folder))
    return rows.select("case_id", (F.abs("gap") < 1e-9).alias("adds_up"))


@query("logistic_contributions")
def logistic_contributions(spark, folder):
    return trained(spark, folder, "logistic").model.contributions(features(spark, folder)).drop("source")


@query("logistic_breakdown")
def logistic_breakdown(spark, folder):
    return trained(spark, folder, "logistic").model.breakdown(features(spark, folder)).drop("source")


@query("tree_scores")
def tree_scores(spark, folder):
    return trained(spark, folder, "tree").model.score(features(spark, folder)).select("case_id", "score")


def _tree_sql(rows: str) -> str:
    """The tree of all labelled cases, level by level: every value of every feature as a split."""
    names = list(WEIGHTS)
    long = " UNION ALL ".join(f"SELECT node, {i} AS feature, {n}::DOUBLE AS value, label FROM v{{d}}" for i, n in enumerate(names))
    pure = lambda p, n: f"(({p}) * ({p}) + ({n}) * ({n})) / (({p}) + ({n}))"
    levels = [f"""v0 AS MATERIALIZED (SELECT f.*, label, 1 AS node FROM features f JOIN a_cases USING (source, case_id) WHERE label IS NOT NULL),
    w AS (SELECT count(*)::DOUBLE / (2 * count_if(label)) AS up, count(*)::DOUBLE / (2 * count_if(NOT label)) AS down FROM v0)"""]
    for d in range(S.TREE_DEPTH):
        value = " ".join(f"WHEN {i} THEN {n}::DOUBLE" for i, n in enumerate(names))
        levels.append(f"""g{d} AS (SELECT node, feature, value, count_if(label)::DOUBLE AS p, count_if(NOT label)::DOUBLE AS n
          FROM ({long.replace("{d}", str(d))}) WHERE node >= {2**d} GROUP BY ALL),
        s{d} AS (SELECT *, sum(p) OVER u AS pl, sum(n) OVER u AS nl, lead(value) OVER (PARTITION BY node, feature ORDER BY value) AS nxt,
          sum(p) OVER (PARTITION BY node, feature) AS pa, sum(n) OVER (PARTITION BY node, feature) AS na FROM g{d}
          WINDOW u AS (PARTITION BY node, feature ORDER BY value)),
        c{d} AS (SELECT *, {pure("pl * up", "nl * down")} + {pure("(pa - pl) * up", "(na - nl) * down")} AS score, {pure("pa * up", "na * down")} AS whole
          FROM s{d}, w WHERE pl + nl >= {S.TREE_LEAF} AND (pa + na) - (pl + nl) >= {S.TREE_LEAF}),
        t{d} AS MATERIALIZED (SELECT node, feature, (value + nxt) / 2 AS threshold, score - whole AS gain FROM c{d} WHERE score - whole > 1e-9
          QUALIFY row_number() OVER (PARTITION BY node ORDER BY score DESC, feature, value) = 1),
        v{d + 1} AS MATERIALIZED (SELECT v.* REPLACE (CASE WHEN t.node IS NULL THEN v.node
            WHEN CASE feature {value} END <= threshold THEN 2 * v.node ELSE 2 * v.node + 1 END AS node) FROM v{d} v LEFT JOIN t{d} t ON v.node = t.node)""")
    last = S.TREE_DEPTH
    levels.append(f"leaves AS (SELECT node, count_if(label) * any_value(up) / (count_if(label) * any_value(up) + count_if(NOT label) * any_value(down)) AS risk FROM v{last}, w GROUP BY node)")
    levels.append("splits AS (" + " UNION ALL ".join(f"SELECT * FROM t{d}" for d in range(last)) + ")")
    levels.append(f"""root AS (SELECT count_if(label) * any_value(up) / (count_if(label) * any_value(up) + count_if(NOT label) * any_value(down)) AS risk FROM v{last}, w)""")
    return f"WITH {FEATURES_SQL}, {', '.join(levels)} {rows}"


def whole_tree(spark, folder):
    known = features(spark, folder).join(
        activity_cases(spark, folder).where(F.col("label").isNotNull()).select(*KEY, "label"), KEY)
    return known, S.ScoringModel.fit(known, "tree", names=list(WEIGHTS))


@query("tree_leaf_risks", _tree_sql(f"SELECT case_id, node, round(risk, 9) AS score FROM v{S.TREE_DEPTH} JOIN leaves USING (node)"))
def tree_leaf_risks(spark, folder):
    known, model = whole_tree(spark, folder)
    return model._scored(known).select("case_id", F.col("_leaf").alias("node"), F.round("score", 9).alias("score"))


@query("tree_path_sums", _tree_sql(
    f"SELECT case_id, round(leaves.risk - root.risk, 9) AS sum_of_path_changes FROM v{S.TREE_DEPTH} JOIN leaves USING (node), root"))
def tree_path_sums(spark, folder):
    """Contributions along each case's path add up to its risk less that of the root."""
    known, model = whole_tree(spark, folder)
    rows = model.breakdown(known)
    return rows.select("case_id", (F.round("sum_of_path_changes", 9) + 0.0).alias("sum_of_path_changes"))


@query("tree_importances", _tree_sql(
    "SELECT name AS feature, round(coalesce(sum(gain), 0) / (SELECT sum(gain) FROM splits), 9) AS importance FROM (VALUES "
    + ", ".join(f"({i}, '{n}')" for i, n in enumerate(WEIGHTS)) + ") AS f(i, name) LEFT JOIN splits ON feature = i GROUP BY name"))
def tree_importances(spark, folder):
    _, model = whole_tree(spark, folder)
    return spark.createDataFrame(list(model.weights.items()), "feature string, importance double").withColumn("importance", F.round("importance", 9))


@query("tree_contributions")
def tree_contributions(spark, folder):
    return trained(spark, folder, "tree").model.contributions(features(spark, folder)).drop("source")


@query("cross_validation")
def cross_validation(spark, folder):
    wide = features(spark, folder)
    known = wide.join(
        activity_cases(spark, folder).where(F.col("label").isNotNull()).select(*KEY, "label"), KEY
    ).persist()
    return report_frame(spark, S.cross_validation(known, list(WEIGHTS)))


@query("ablation")
def ablation(spark, folder):
    watch = lambda cases, events: T.trigger_features(events, cases)
    words = lambda cases, events: lexicon_features(events, cases)
    return S.ablation(
        activity_cases(spark, folder), activity_events(spark, folder),
        {"timeline only": [watch], "timeline and word lists": [watch, words]},
    )
