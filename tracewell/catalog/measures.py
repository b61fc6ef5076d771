"""Registered queries: metrics, trust measures, resampling, review queue order."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.catalog.common import plain
from tracewell.catalog.registry import query
from tracewell.catalog.sqltext import quoted, sql_iso
from tracewell.catalog.timeline import SIGNALS_SQL, features_sql
from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators import metrics as M
from tracewell.operators import queue as Q
from tracewell.operators import resample as R
from tracewell.operators import timeline as T
from tracewell.operators import trust
from tracewell.operators.ordering import flag_smallest, global_rank
from tracewell.sources.activity import ACTIVITY_SQL, activity_cases, activity_events
from tracewell.sources.scored_orders import SCORED_SQL, scored_orders

SQL_QUEUE = "score DESC, coalesce(discharged_at, TIMESTAMP '9999-12-31') ASC, source, case_id"
LABELLED_SQL = f"{SCORED_SQL}, labelled_rows AS (SELECT * FROM scored WHERE label IS NOT NULL)"


def r6(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in names else F.col(c) for c in df.columns])


# --- trust -------------------------------------------------------------------
FEATURES_SQL = f"{SIGNALS_SQL}, {features_sql('a.by_procedure')}"
_COVER_ARMS = " UNION ALL ".join(
    f"SELECT {quoted(n)} AS trigger, {quoted(m)} AS meaning, {n} > 0 AS fired, label "
    "FROM features JOIN a_cases USING (source, case_id)"
    for n, m in fixed.TRIGGER_MEANINGS.items()
)
COVERAGE_SQL = f"""{FEATURES_SQL}, long AS ({_COVER_ARMS}),
base AS (SELECT count(*) FILTER (WHERE label)::DOUBLE / count(label) AS base_rate FROM a_cases),
counted AS (
  SELECT trigger, meaning, count(*) AS total, count_if(fired)::BIGINT AS cases,
    count_if(fired AND label IS NOT NULL)::BIGINT AS labelled_cases,
    count_if(fired AND coalesce(label, false))::BIGINT AS hits
  FROM long GROUP BY ALL),
coverage AS (
  SELECT trigger, meaning, cases, labelled_cases, cases::DOUBLE / total AS share,
    CASE WHEN labelled_cases > 0 THEN hits::DOUBLE / labelled_cases END AS label_rate,
    CASE WHEN labelled_cases > 0 THEN (hits::DOUBLE / labelled_cases) / base_rate END AS lift,
    base_rate
  FROM counted, base)
"""
LEAKAGE_SQL = f"""{COVERAGE_SQL}, leakage AS (
  SELECT trigger AS feature, labelled_cases AS support, label_rate, lift, 1.0::DOUBLE / base_rate AS max_lift,
    coalesce(lift / (1.0::DOUBLE / base_rate), 0) AS separation,
    labelled_cases >= 30 AND coalesce(lift / (1.0::DOUBLE / base_rate), 0) >= 0.995 AS leaking,
    labelled_cases = 0 AS dead
  FROM coverage)"""
RATES_PART = """rates AS (
  SELECT event_type, value, count(*) AS support, count_if(label)::BIGINT AS positives,
    count_if(label)::DOUBLE / count(*) AS label_rate
  FROM (SELECT DISTINCT source, case_id, event_type, trim(value) AS value FROM a_events
        WHERE event_type IN ('medication', 'procedure') AND trim(value) <> '')
  JOIN a_cases USING (source, case_id) WHERE label IS NOT NULL GROUP BY ALL)"""
RATES_SQL = f"{ACTIVITY_SQL}, {RATES_PART}"


def coverage(spark, folder):
    return trust.trigger_coverage(
        T.trigger_features(activity_events(spark, folder)), activity_cases(spark, folder),
        fixed.TRIGGER_MEANINGS,
    )


def rates(spark, folder):
    return trust.value_label_rates(activity_events(spark, folder), activity_cases(spark, folder))


@query("trigger_coverage", f"WITH {COVERAGE_SQL} SELECT * FROM coverage")
def trigger_coverage(spark, folder):
    return trust.by_lift(coverage(spark, folder))


@query("triggers_dark", f"WITH {COVERAGE_SQL} SELECT trigger FROM coverage WHERE cases = 0")
def triggers_dark(spark, folder):
    return trust.dark_triggers(coverage(spark, folder)).select("trigger")


@query("triggers_weak",
       f"WITH {COVERAGE_SQL} SELECT trigger, lift FROM coverage WHERE cases >= 5 AND lift < 1")
def triggers_weak(spark, folder):
    return trust.weak_triggers(coverage(spark, folder)).select("trigger", "lift")


@query("leakage_by_feature", f"WITH {LEAKAGE_SQL} SELECT * FROM leakage")
def leakage_by_feature(spark, folder):
    return trust.leakage_by_feature(coverage(spark, folder))


@query("value_label_rates", f"WITH {RATES_SQL} SELECT * FROM rates")
def value_label_rates(spark, folder):
    return rates(spark, folder)


@query("giveaway_values",
       f"WITH {RATES_SQL} SELECT * FROM rates WHERE support >= 30 AND label_rate >= 0.12")
def giveaway_values(spark, folder):
    return trust.giveaway_values(rates(spark, folder), min_support=30, purity=0.12)


@query(
    "leakage_verdict",
    f"""WITH {LEAKAGE_SQL}, {RATES_PART},
    g AS (SELECT count(*) AS n FROM rates WHERE support >= 30 AND label_rate >= 0.98)
    SELECT count_if(NOT dead)::BIGINT AS features, count_if(leaking)::BIGINT AS leaking_features,
      count_if(dead)::BIGINT AS dead_features, max(n)::BIGINT AS giveaway_values,
      count_if(leaking) = 0 AND max(n) = 0 AS clean FROM leakage, g""",
)
def leakage_verdict(spark, folder):
    return trust.leakage_verdict(
        trust.leakage_by_feature(coverage(spark, folder)),
        trust.giveaway_values(rates(spark, folder)),
    )


GAIN_SQL = f"""{LABELLED_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY {SQL_QUEUE}) AS rank FROM labelled_rows),
sizes AS (SELECT count(*) AS n, count_if(label) AS p FROM ranked),
steps AS (SELECT s.step::INTEGER AS step, round_even(s.step / 40.0::DOUBLE * n, 0)::BIGINT AS cutoff, n, p
          FROM range(41) s(step), sizes),
hits AS (SELECT rank, count_if(label) OVER (ORDER BY rank) AS seen FROM ranked),
curve AS (SELECT step, cutoff::DOUBLE / n AS review_share, coalesce(seen, 0)::DOUBLE / p AS harm_found
          FROM steps LEFT JOIN hits ON hits.rank = steps.cutoff)"""


@query("gain_curve", f"WITH {GAIN_SQL} SELECT * FROM curve")
def gain_curve(spark, folder):
    return trust.gain_curve(scored_orders(spark, folder), Q.queue_order())


@query("gain_curve_random",
       f"WITH {GAIN_SQL} SELECT step, step / 40.0::DOUBLE AS review_share, step / 40.0::DOUBLE AS harm_found FROM curve")
def gain_curve_random(spark, folder):
    return trust.random_curve(trust.gain_curve(scored_orders(spark, folder), Q.queue_order()))


@query(
    "gain_at_ten_percent",
    f"WITH {GAIN_SQL}, f AS (SELECT harm_found FROM curve WHERE review_share >= 0.1 - 1e-9 ORDER BY step LIMIT 1) "
    "SELECT harm_found, harm_found / 0.1::DOUBLE AS lift_multiple FROM f",
)
def gain_at_ten_percent(spark, folder):
    return trust.lift_at(trust.gain_curve(scored_orders(spark, folder), Q.queue_order()), 0.10)


# --- metrics -------------------------------------------------------------------
@query(
    "ranking_quality",
    f"""WITH {LABELLED_SQL},
    per AS (SELECT score, count_if(label)::DOUBLE AS pos, count_if(NOT label)::DOUBLE AS neg,
                   sum(power(score - label::INT, 2)) AS miss FROM labelled_rows GROUP BY score),
    run AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM per
            WINDOW w AS (ORDER BY score DESC)),
    t AS (SELECT sum(pos) AS p, sum(neg) AS n, sum(pos * (fp - neg + neg / 2)) AS lost,
                 sum(pos * tp / (tp + fp)) AS steps, sum(miss) AS miss FROM run)
    SELECT (p + n)::BIGINT AS cases, p::BIGINT AS positives, round(1 - lost / (p * n), 6) AS roc_auc,
      round(steps / p, 6) AS average_precision, round(p / (p + n), 6) AS pr_baseline,
      round(steps / p / (p / (p + n)), 6) AS pr_lift, round(miss / (p + n), 6) AS brier FROM t""",
)
def ranking_quality(spark, folder):
    quality = M.ranking_quality(scored_orders(spark, folder))
    return r6(quality, "roc_auc", "average_precision", "pr_baseline", "pr_lift", "brier")


_CONFUSION = """count_if(NOT f AND NOT label) AS tn, count_if(f AND NOT label) AS fp,
  count_if(NOT f AND label) AS fn, count_if(f AND label) AS tp"""
_PRF = """coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
  coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
  coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1"""


@query(
    "confusion_at_threshold",
    f"WITH {LABELLED_SQL}, c AS (SELECT {_CONFUSION} FROM (SELECT label, score >= 0.4 AS f FROM labelled_rows)) "
    f"SELECT tn::BIGINT AS tn, fp::BIGINT AS fp, fn::BIGINT AS fn, tp::BIGINT AS tp, {_PRF} FROM c",
)
def confusion_at_threshold(spark, folder):
    return M.confusion(scored_orders(spark, folder))


@query(
    "threshold_sweep",
    f"""WITH {LABELLED_SQL}, cuts AS (SELECT unnest({fixed.SWEEP_CUTS})::DOUBLE AS threshold),
    c AS (SELECT threshold, count_if(f) AS flagged, {_CONFUSION}
          FROM (SELECT threshold, label, score >= threshold AS f FROM labelled_rows, cuts) GROUP BY threshold)
    SELECT threshold, {_PRF}, flagged::BIGINT AS flagged FROM c""",
)
def threshold_sweep(spark, folder):
    return M.threshold_sweep(scored_orders(spark, folder))


RANKED_SQL = f"""{SCORED_SQL},
ranked AS (SELECT *, row_number() OVER (ORDER BY {SQL_QUEUE}) AS rank FROM scored)"""


@query(
    "precision_at_capacity",
    f"""WITH {RANKED_SQL}, ks AS (SELECT unnest({fixed.REVIEW_CAPACITIES})::INTEGER AS k)
    SELECT k AS reviewing_top, count_if(label AND rank <= k)::DOUBLE / k AS precision,
      count_if(label AND rank <= k)::BIGINT AS caught, count_if(label)::BIGINT AS of_total
    FROM ranked, ks GROUP BY k HAVING count(*) >= k""",
)
def precision_at_capacity(spark, folder):
    scored = scored_orders(spark, folder)
    return M.capacity_table(Q.top_of_queue(scored, max(fixed.REVIEW_CAPACITIES)), scored)


@query(
    "queue_yield",
    f"""WITH {RANKED_SQL}, c AS (SELECT count_if(rank <= 100) AS listed, count(*) AS checked,
      count_if(rank <= 100 AND label) AS tagged_on_list, count_if(label) AS tagged_in_all FROM ranked)
    SELECT listed::BIGINT AS listed, checked::BIGINT AS checked, tagged_on_list::BIGINT AS tagged_on_list,
      tagged_in_all::BIGINT AS tagged_in_all, tagged_on_list::DOUBLE / listed AS share_on_list,
      tagged_in_all::DOUBLE / checked AS share_overall FROM c""",
)
def queue_yield(spark, folder):
    scored = scored_orders(spark, folder)
    return M.queue_yield(Q.top_of_queue(scored, 100), scored)


# --- queue ------------------------------------------------------------------------
@query("queue_top",
       f"WITH {RANKED_SQL} SELECT case_id, score, rank FROM ranked WHERE rank <= 100")
def queue_top(spark, folder):
    return Q.top_of_queue(scored_orders(spark, folder), 100).select(
        "case_id", "score", F.col("rank").cast("bigint").alias("rank")
    )


@query("queue_ranked", f"WITH {RANKED_SQL} SELECT case_id, score, rank FROM ranked")
def queue_ranked(spark, folder):
    return global_rank(scored_orders(spark, folder), Q.queue_order()).select(
        "case_id", "score", "rank"
    )


@query("queue_over_threshold", f"WITH {SCORED_SQL} SELECT case_id, score FROM scored WHERE score >= 0.4")
def queue_over_threshold(spark, folder):
    return Q.over_threshold(scored_orders(spark, folder), 0.4).select("case_id", "score")


@query("rankable_cases",
       f"WITH {SCORED_SQL} SELECT case_id, {sql_iso('discharged_at')} AS discharged_at FROM scored "
       "WHERE discharged_at IS NOT NULL")
def rankable_cases(spark, folder):
    return plain(Q.rankable(scored_orders(spark, folder)).select("case_id", "discharged_at"))


@query(
    "score_bands",
    f"WITH {SCORED_SQL} SELECT case_id, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' "
    "ELSE 'low' END AS band, round_even(score * 100, 0)::BIGINT AS shown FROM scored",
)
def score_bands(spark, folder):
    return scored_orders(spark, folder).select(
        "case_id", C.score_band(F.col("score")).alias("band"),
        F.bround(F.col("score") * 100).cast("bigint").alias("shown"),
    )


# --- samples ------------------------------------------------------------------------
PREVALENCE_SQL = f"""{LABELLED_SQL},
hashed AS (SELECT *, md5('7:' || source || '|' || case_id) AS h FROM labelled_rows),
sizes AS (SELECT count_if(label) AS p, count_if(NOT label) AS n FROM hashed),
kept AS (
  SELECT * EXCLUDE (h) FROM (
    SELECT hashed.*, row_number() OVER (PARTITION BY label ORDER BY h) AS rn, p, n FROM hashed, sizes)
  WHERE CASE WHEN p::DOUBLE / (p + n) > 0.1 THEN
      NOT label OR rn <= greatest(1, round_even(n * 0.1::DOUBLE / (1.0::DOUBLE - 0.1), 0))
    ELSE label OR rn <= greatest(1, round_even(p * (1.0::DOUBLE - 0.1) / 0.1::DOUBLE, 0)) END)"""


@query("prevalence_resample", f"WITH {PREVALENCE_SQL} SELECT case_id, label FROM kept")
def prevalence_resample(spark, folder):
    return R.downsample_to_prevalence(scored_orders(spark, folder)).select("case_id", "label")


@query(
    "prevalence_summary",
    f"""WITH {PREVALENCE_SQL}, b AS (SELECT count(*) AS n0, count_if(label) AS p0 FROM labelled_rows),
    a AS (SELECT count(*) AS n1, count_if(label) AS p1 FROM kept)
    SELECT 0.1::DOUBLE AS target_rate, n1 AS kept, n0 - n1 AS dropped, p0::DOUBLE / n0 AS original_rate,
      p1::DOUBLE / n1 AS resulting_rate FROM a, b""",
)
def prevalence_summary(spark, folder):
    cases = scored_orders(spark, folder)
    return R.resample_summary(cases, R.downsample_to_prevalence(cases), 0.10)


@query(
    "stratified_split",
    f"""WITH {LABELLED_SQL}, sizes AS (SELECT count_if(label) AS p, count_if(NOT label) AS n,
      ceil((count(*)) * 0.3::DOUBLE) AS t FROM labelled_rows),
    plan AS (SELECT floor(p * t / (p + n)) + CASE WHEN floor(p * t / (p + n)) + floor(n * t / (p + n)) < t
        AND p * t / (p + n) - floor(p * t / (p + n)) >= 0.5 THEN 1 ELSE 0 END AS tp, t FROM sizes)
    SELECT case_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || source || '|' || case_id))
      <= CASE WHEN label THEN tp ELSE t - tp END AS is_test FROM labelled_rows, plan""",
)
def stratified_split(spark, folder):
    return R.stratified_split(scored_orders(spark, folder)).select("case_id", "label", "is_test")


@query(
    "stratified_folds",
    f"""WITH {LABELLED_SQL} SELECT case_id, label,
    ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || source || '|' || case_id)) - 1) % 5)::INTEGER AS fold
    FROM labelled_rows""",
)
def stratified_folds(spark, folder):
    return R.stratified_folds(scored_orders(spark, folder), 5).select("case_id", "label", "fold")


# Two sources whose cases share ids: the draw must tell them apart.
TWO_SQL = f"""{LABELLED_SQL}, two AS (SELECT source, case_id, label FROM labelled_rows UNION ALL
  SELECT 'again', case_id, NOT label FROM labelled_rows WHERE scenario <> '1-URGENT')"""


def two_sources(spark, folder):
    cases = scored_orders(spark, folder)
    again = cases.where("scenario != '1-URGENT'").select(
        F.lit("again").alias("source"), "case_id", (~F.col("label")).alias("label"))
    return cases.select("source", "case_id", "label").unionByName(again)


@query(
    "prevalence_two_sources",
    f"""WITH {TWO_SQL}, sizes AS (SELECT count_if(label) AS p, count_if(NOT label) AS n FROM two)
    SELECT source, case_id, label FROM (
      SELECT two.*, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || source || '|' || case_id)) AS rn, p, n FROM two, sizes)
    WHERE CASE WHEN p::DOUBLE / (p + n) > 0.1 THEN
      NOT label OR rn <= greatest(1, round_even(n * 0.1::DOUBLE / (1.0::DOUBLE - 0.1), 0))
      ELSE label OR rn <= greatest(1, round_even(p * (1.0::DOUBLE - 0.1) / 0.1::DOUBLE, 0)) END""",
)
def prevalence_two_sources(spark, folder):
    return R.downsample_to_prevalence(two_sources(spark, folder)).select("source", "case_id", "label")


@query(
    "folds_two_sources",
    f"""WITH {TWO_SQL} SELECT source, case_id, label,
    ((row_number() OVER (PARTITION BY label ORDER BY md5('7:' || source || '|' || case_id)) - 1) % 5)::INTEGER AS fold
    FROM two""",
)
def folds_two_sources(spark, folder):
    return R.stratified_folds(two_sources(spark, folder), 5).select("source", "case_id", "label", "fold")


@query(
    "seeded_sample",
    f"""WITH {SCORED_SQL} SELECT case_id, scenario FROM (SELECT *, row_number() OVER (PARTITION BY scenario
    ORDER BY md5('11:' || case_id)) AS rn FROM scored) WHERE scenario IN ('1-URGENT', '2-HIGH') AND
    rn <= CASE scenario WHEN '1-URGENT' THEN 500 ELSE 40 END""",
)
def seeded_sample(spark, folder):
    hashed = scored_orders(spark, folder).withColumn("h", C.seeded_hash(11, F.col("case_id")))
    return (
        flag_smallest(hashed, "h", {"1-URGENT": 500, "2-HIGH": 40}, "scenario")
        .where("chosen").select("case_id", "scenario")
    )
