"""Registered queries: note sentences, word lists, framing, contrast, classifier."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewell.catalog.registry import query
from tracewell.catalog.sqltext import quoted, sql_any, sql_list
from tracewell.functions import fixed_values as fixed
from tracewell.operators import cohort
from tracewell.operators import metrics as M
from tracewell.operators import notes as N
from tracewell.operators import note_model as NM
from tracewell.session import table
from tracewell.sources import sentences
from tracewell.sources.documents import (
    EXPECTED,
    LISTS,
    UNANTICIPATED,
    document_cases,
    document_events,
    labelled_turns,
)

SENTENCES_SQL = """
pieces AS (
  SELECT doc_id::VARCHAR AS case_id,
    list_filter(list_transform(regexp_split_to_array(
        regexp_replace(text, '([.!?;])\\s+', '\\1' || chr(10), 'g'), '\\n+'),
      lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: length(x) > 3) AS parts
  FROM documents),
sentences AS (
  SELECT case_id, unnest(generate_series(0, len(parts) - 1))::INTEGER AS position, unnest(parts) AS sentence
  FROM pieces WHERE len(parts) > 0)
"""
_LISTED = [*LISTS.errors, *LISTS.harms]
LEXICON_SQL = f"""{SENTENCES_SQL},
terms AS (
  SELECT *, lower(sentence) AS s,
    list_filter({sql_list(LISTS.errors)}, lambda t: contains(lower(sentence), t)) AS error_terms,
    list_filter({sql_list(LISTS.harms)}, lambda t: contains(lower(sentence), t)) AS harm_terms
  FROM sentences),
passed AS (
  SELECT case_id, position, sentence, error_terms, harm_terms,
    len(carrying) > 0 AND len(list_filter(carrying, lambda c: NOT {sql_any('c', LISTS.cues)})) = 0 AS negated
  FROM (SELECT *, list_filter(regexp_split_to_array(s, ',|\\bbut\\b|\\bhowever\\b|\\balthough\\b|\\bwhereas\\b'),
          lambda c: {sql_any('c', _LISTED)}) AS carrying FROM terms))
"""


@query("note_sentences", f"WITH {SENTENCES_SQL} SELECT case_id, position, sentence FROM sentences")
def note_sentences(spark, folder):
    return N.note_sentences(document_events(spark, folder)).select(
        "case_id", "position", "sentence"
    )


@query(
    "note_lexicon_pass",
    f"WITH {LEXICON_SQL} SELECT case_id, position, array_to_string(error_terms, '|') AS error_terms, "
    "array_to_string(harm_terms, '|') AS harm_terms, negated FROM passed",
)
def note_lexicon_pass(spark, folder):
    return N.lexicon_pass(N.note_sentences(document_events(spark, folder)), LISTS).select(
        "case_id", "position", F.array_join("error_terms", "|").alias("error_terms"),
        F.array_join("harm_terms", "|").alias("harm_terms"), "negated",
    )


@query(
    "note_lexicon_features",
    f"""WITH {LEXICON_SQL}, f AS (SELECT case_id,
      sum(CASE WHEN negated THEN 0 ELSE len(error_terms) END)::DOUBLE AS e,
      sum(CASE WHEN negated THEN 0 ELSE len(harm_terms) END)::DOUBLE AS h,
      sum(CASE WHEN negated THEN len(error_terms) + len(harm_terms) ELSE 0 END)::DOUBLE AS n
      FROM passed GROUP BY case_id)
    SELECT d.doc_id::VARCHAR AS case_id, coalesce(e, 0) AS note_explicit_error_language,
      coalesce(h, 0) AS note_harm_state_language, coalesce(n, 0) AS note_negated_harm_mentions
    FROM documents d LEFT JOIN f ON f.case_id = d.doc_id::VARCHAR""",
)
def note_lexicon_features(spark, folder):
    return N.lexicon_features(
        document_events(spark, folder), document_cases(spark, folder), LISTS
    ).drop("source")


def _strike_sql(source: str) -> str:
    """Nested selects, one per cue, each striking it from the rest."""
    sql = f"(SELECT *, lower(text) AS rest, 0 AS n FROM {source})"
    for cue in UNANTICIPATED:
        q = quoted(cue)
        sql = (f"(SELECT * EXCLUDE (rest, n), replace(rest, {q}, ' ') AS rest, "
               f"n + contains(rest, {q})::INT AS n FROM {sql})")
    hits = " + ".join(f"contains(rest, {quoted(c)})::INT" for c in EXPECTED)
    return (f"(SELECT * EXCLUDE (rest, n), CASE WHEN n > {hits} THEN 'unanticipated' "
            f"WHEN n < {hits} THEN 'expected_risk' ELSE 'neutral' END AS pred FROM {sql})")


@query("framing_by_cues",
       f"WITH {SENTENCES_SQL}, t AS (SELECT case_id, position, sentence AS text FROM sentences) "
       f"SELECT case_id, position, pred FROM {_strike_sql('t')}")
def framing_by_cues(spark, folder):
    return N.note_sentences(document_events(spark, folder)).select(
        "case_id", "position",
        N.framing_by_cues(F.col("sentence"), UNANTICIPATED, EXPECTED).alias("pred"),
    )


PAIRS_SQL = f"""pairs AS (SELECT conv_id AS pair_id, turn AS side, text,
  CASE WHEN turn % 2 = 0 THEN 'unanticipated' ELSE 'expected_risk' END AS truth FROM conversations),
predicted AS (SELECT pair_id, side, truth, pred FROM {_strike_sql('pairs')})"""


def pairs(spark, folder):
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("pair_id"), F.col("turn").alias("side"), "text",
        F.when(F.col("turn") % 2 == 0, "unanticipated").otherwise("expected_risk").alias("truth"),
        N.framing_by_cues(F.col("text"), UNANTICIPATED, EXPECTED).alias("pred"),
    )


@query(
    "contrast_report",
    f"""WITH {PAIRS_SQL}, p AS (SELECT pair_id, count(*) AS texts, count_if(truth = pred) AS r,
      min(pred) <> max(pred) AS flip FROM predicted GROUP BY pair_id)
    SELECT count(*) AS n_pairs, count_if(r = texts)::BIGINT AS both_correct, count_if(flip)::BIGINT AS flipped,
      sum(r)::DOUBLE / sum(texts) AS accuracy, count_if(r = texts)::DOUBLE / count(*) AS both_correct_rate,
      count_if(flip)::DOUBLE / count(*) AS flip_rate FROM p""",
)
def contrast_report(spark, folder):
    return N.contrast_report(pairs(spark, folder))


@query("contrast_misses",
       f"WITH {PAIRS_SQL} SELECT pair_id, side, truth, pred FROM predicted WHERE truth <> pred")
def contrast_misses(spark, folder):
    return N.contrast_misses(pairs(spark, folder)).select("pair_id", "side", "truth", "pred")


@query(
    "contrast_sentences",
    """WITH p AS (SELECT conv_id, turn // 2 AS pair, max(CASE WHEN turn % 2 = 0 THEN text END) AS a,
      max(CASE WHEN turn % 2 = 1 THEN text END) AS b FROM conversations GROUP BY ALL)
    SELECT conv_id || ':' || pair AS pair_id, 0 AS side, a AS text, 'unanticipated' AS truth FROM p
    UNION ALL SELECT conv_id || ':' || pair, 1, b, 'expected_risk' FROM p""",
)
def contrast_sentences(spark, folder):
    """Every turn: turns 2k and 2k + 1 of a conversation are a pair, an odd last one has a null side."""
    side = lambda n: F.max(F.when(F.col("turn") % 2 == n, F.col("text")))
    pairs = table(spark, folder, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("pair")).agg(
        side(0).alias("unanticipated"), side(1).alias("expected_risk"),
    )
    named = pairs.withColumn("pair_id", F.concat_ws(":", "conv_id", "pair"))
    return sentences.contrast_sentences(named)


@query("framing_confusion",
       f"WITH {PAIRS_SQL} SELECT truth, pred, count(*) AS n FROM predicted GROUP BY ALL")
def framing_confusion(spark, folder):
    return M.class_counts(pairs(spark, folder))


_CLASSES_SQL = "SELECT unnest(" + sql_list(fixed.FRAMING_CLASSES) + ") AS class"


@query(
    "framing_class_report",
    f"""WITH {PAIRS_SQL}, c AS (SELECT class, count_if(truth = class AND pred = class) AS tp,
      count_if(truth <> class AND pred = class) AS fp, count_if(truth = class AND pred <> class) AS fn
      FROM predicted, ({_CLASSES_SQL}) GROUP BY class)
    SELECT class, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision,
      coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall,
      coalesce((2 * tp)::DOUBLE / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fn)::BIGINT AS support FROM c""",
)
def framing_class_report(spark, folder):
    return M.class_report(pairs(spark, folder))


@query(
    "framing_summary",
    f"""WITH {PAIRS_SQL}, folded AS (SELECT *, pair_id % 5 AS fold FROM predicted),
    c AS (SELECT fold, class, count_if(truth = class AND pred = class) AS tp,
      count_if(truth <> class AND pred = class) AS fp, count_if(truth = class AND pred <> class) AS fn
      FROM folded, ({_CLASSES_SQL}) GROUP BY ALL HAVING tp + fp + fn > 0),
    f AS (SELECT fold, avg((2 * tp)::DOUBLE / (2 * tp + fp + fn)) AS m FROM c GROUP BY fold),
    s AS (SELECT truth, count(*) AS n, count_if(truth = pred) AS r FROM predicted GROUP BY truth)
    SELECT sum(n)::BIGINT AS n_samples, sum(r)::DOUBLE / sum(n) AS accuracy,
      max(n)::DOUBLE / sum(n) AS majority_baseline,
      round((SELECT avg(m) FROM f), 6) AS macro_f1_mean, round((SELECT stddev_pop(m) FROM f), 6) AS macro_f1_std
    FROM s""",
)
def framing_summary(spark, folder):
    summary = M.class_summary(
        pairs(spark, folder).withColumn("fold", F.col("pair_id") % 5), fold="fold"
    )
    return summary.withColumn("macro_f1_mean", F.round("macro_f1_mean", 6)).withColumn(
        "macro_f1_std", F.round("macro_f1_std", 6)
    )


TERMS_SQL = f"""
tokens AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{M}}\\p{{N}}_]{{2,}}'),
    lambda t: NOT list_contains({sql_list(fixed.STOP_WORDS)}, t)) AS t FROM documents),
grams AS (
  SELECT doc_id, unnest(t) AS term FROM tokens
  UNION ALL SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 1),
    lambda i: t[i] || ' ' || t[i + 1])) FROM tokens WHERE len(t) >= 2
  UNION ALL SELECT doc_id, unnest(list_transform(generate_series(1, len(t) - 2),
    lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) FROM tokens WHERE len(t) >= 3),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
weighted AS (
  SELECT doc_id, c.term, tf, df, (1 + ln(tf)) * (ln(((SELECT count(*) FROM documents) + 1)::DOUBLE / (df + 1)) + 1) AS raw
  FROM counts c JOIN (SELECT term, count(*) AS df FROM counts GROUP BY term) d ON c.term = d.term)
"""


@query(
    "note_tfidf_profile",
    f"""WITH {TERMS_SQL}, u AS (SELECT *, raw / sqrt(sum(raw * raw) OVER (PARTITION BY doc_id)) AS weight FROM weighted)
    SELECT doc_id, count(*) AS n_terms, sum(tf)::BIGINT AS n_grams, max(df)::BIGINT AS most_shared,
      round(max(weight), 6) AS top_weight, round(sum(weight), 4) AS total_weight FROM u GROUP BY doc_id""",
)
def note_tfidf_profile(spark, folder):
    weights = NM.tfidf(table(spark, folder, "documents"), ["doc_id"], "text")
    return weights.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_terms"), F.sum("tf").alias("n_grams"),
        F.max("df").alias("most_shared"), F.round(F.max("weight"), 6).alias("top_weight"),
        F.round(F.sum("weight"), 4).alias("total_weight"),
    )


@query(
    "note_document_frequency",
    f"WITH {TERMS_SQL} SELECT df, count(DISTINCT term) AS n_terms FROM weighted GROUP BY df",
)
def note_document_frequency(spark, folder):
    weights = NM.tfidf(table(spark, folder, "documents"), ["doc_id"], "text")
    return (
        weights.groupBy("term").agg(F.max("df").alias("df"))
        .groupBy("df").agg(F.count(F.lit(1)).alias("n_terms"))
    )


@query(
    "sources_with_notes",
    "SELECT 'documents' AS source, true AS has_notes UNION ALL SELECT 'activity', false",
)
def sources_with_notes(spark, folder):
    from tracewell.sources.activity import activity_events

    both = document_events(spark, folder).unionByName(activity_events(spark, folder))
    return N.sources_with_notes(both)


@query(
    "held_out_texts",
    """WITH t AS (SELECT text, count_if(p = 1) AS a, count_if(p = 2) AS b FROM (
      SELECT text, 1 AS p FROM documents UNION ALL SELECT text, 2 FROM benchmark) GROUP BY text)
    SELECT count_if(a > 0 AND b > 0)::BIGINT AS overlapping, count_if(a > 1)::BIGINT AS repeated_in_train,
      count_if(b > 1)::BIGINT AS repeated_in_held_out FROM t""",
)
def held_out_texts(spark, folder):
    return cohort.held_out_check(
        table(spark, folder, "documents"), table(spark, folder, "benchmark")
    )


# --- trained classifier: iterative fits, rows only -----------------------------
def framing_model(spark, folder):
    return NM.FramingModel.fit(labelled_turns(spark, folder))


@query("framing_model_optimum", f"SELECT unnest({sql_list(fixed.FRAMING_CLASSES)}) AS class, true AS flat_intercept, true AS flat_terms")
def framing_model_optimum(spark, folder):
    """The gradient vanishes at the fitted weights: the objective is convex, so they are its solution."""
    turns = labelled_turns(spark, folder)
    found = NM.FramingModel.fit(turns).gradient(turns, ["text_id"])
    return found.select("class", (F.abs("intercept") < 1e-5).alias("flat_intercept"), (F.col("steepest") < 1e-5).alias("flat_terms"))


@query(
    "framing_model_rules",
    f"WITH {SENTENCES_SQL} SELECT case_id, count(*) AS n_sentences, true AS known, true AS floored, true AS possible FROM sentences GROUP BY case_id",
)
def framing_model_rules(spark, folder):
    """Of every sentence: one of the classes, neutral below the floor, and a probability that a largest of three can have."""
    model = framing_model(spark, folder)
    labelled = model.label_sentences(N.note_sentences(document_events(spark, folder)))
    p, k = F.col("probability"), len(model.classes)
    return labelled.groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_sentences"), F.every(F.col("label").isin(fixed.FRAMING_CLASSES)).alias("known"),
        F.every((p >= model.min_confidence) | (F.col("label") == "neutral")).alias("floored"),
        F.every((p <= 1) & (p >= 1 / k - 1e-12)).alias("possible"),
    )


@query("framing_model_sentences")
def framing_model_sentences(spark, folder):
    model = framing_model(spark, folder)
    sentences = N.note_sentences(document_events(spark, folder))
    return model.label_sentences(sentences).drop("source")


@query("framing_model_features")
def framing_model_features(spark, folder):
    events, cases = document_events(spark, folder), document_cases(spark, folder)
    framed = framing_model(spark, folder).label_sentences(N.note_sentences(events))
    return N.note_features(events, framed, cases, LISTS).drop("source")


@query("framing_model_findings")
def framing_model_findings(spark, folder):
    events = document_events(spark, folder)
    framed = framing_model(spark, folder).label_sentences(N.note_sentences(events))
    found = N.ordered_findings(N.note_findings(events, framed, LISTS), 6)
    return found.select("case_id", "place", "sentence", "label", "probability", "negated")


@query("framing_model_top_terms")
def framing_model_top_terms(spark, folder):
    return framing_model(spark, folder).top_terms("unanticipated", 12)


@query("framing_model_contrast")
def framing_model_contrast(spark, folder):
    turns = labelled_turns(spark, folder)
    pred = framing_model(spark, folder).predict(turns, ["text_id"], "text")
    joined = turns.join(pred, "text_id").select(
        F.col("conv_id").alias("pair_id"), F.col("turn").alias("side"),
        F.col("label").alias("truth"), "pred",
    )
    return N.contrast_report(joined)
