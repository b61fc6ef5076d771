"""Note language: sentences, word lists, negation, framing by cue words."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.cohort import count_true
from tracewell.schema import KEY

SENTENCE_KEY = [*KEY, "case_ordinal", "position"]
MIN_SENTENCE = 3


@dataclass
class WordLists:
    errors: list[str] = field(default_factory=lambda: list(fixed.PROCESS_FAILURE_TERMS))
    harms: list[str] = field(default_factory=lambda: list(fixed.DETERIORATION_TERMS))
    cues: list[str] = field(default_factory=lambda: list(fixed.NEGATION_CUES))


def split_sentences(text: Column) -> Column:
    """Stripped sentences longer than three characters."""
    pieces = F.transform(F.split(C.text_or_empty(text), fixed.SENTENCE_BREAK), C.strip)
    return F.filter(pieces, lambda s: F.length(s) > MIN_SENTENCE)


def note_sentences(events: DataFrame) -> DataFrame:
    """One row per sentence of every note; whole texts, no shuffle."""
    notes = events.where(F.col("event_type") == "note")
    return notes.select(
        *KEY, "case_ordinal",
        F.posexplode(split_sentences(F.col("details"))).alias("position", "sentence"),
    )


def lexicon_pass(sentences: DataFrame, lists: WordLists | None = None) -> DataFrame:
    """Adds error_terms, harm_terms and negated.

    Negation holds by clause: a sentence is negated only when every clause that
    carries a listed term also carries a cue.
    """
    lists = lists or WordLists()
    lowered = F.lower("sentence")
    listed = [*lists.errors, *lists.harms]
    carrying = F.filter(
        F.split(lowered, fixed.CLAUSE_BREAK), lambda c: C.contains_any(c, listed)
    )
    all_cued = (F.size(carrying) > 0) & F.forall(
        carrying, lambda c: C.contains_any(c, lists.cues)
    )
    return (
        sentences.withColumn("error_terms", C.matched_terms(lowered, lists.errors))
        .withColumn("harm_terms", C.matched_terms(lowered, lists.harms))
        .withColumn(
            "negated",
            F.when(
                (F.size("error_terms") > 0) | (F.size("harm_terms") > 0), all_cued
            ).otherwise(F.lit(False)),
        )
    )


def _lexicon_sums() -> list[Column]:
    errors, harms = F.size("error_terms"), F.size("harm_terms")
    if_not = lambda n: F.sum(F.when(~F.col("negated"), n).otherwise(0)).cast("double")
    negated = F.sum(F.when(F.col("negated"), errors + harms).otherwise(0)).cast("double")
    return [
        if_not(errors).alias("note_explicit_error_language"),
        if_not(harms).alias("note_harm_state_language"),
        negated.alias("note_negated_harm_mentions"),
    ]


LEXICON_FEATURES = list(fixed.NOTE_MEANINGS)[4:]
FRAMING_FEATURES = list(fixed.NOTE_MEANINGS)[:4]


def per_case(cases: DataFrame, features: DataFrame, names: list[str]) -> DataFrame:
    """Cases without notes read as zeros."""
    return cases.select(*KEY).join(features, KEY, "left").fillna(0.0, names)


def lexicon_features(
    events: DataFrame, cases: DataFrame | None = None, lists: WordLists | None = None
) -> DataFrame:
    """Error, harm and negated counts per case, from the word lists alone."""
    features = lexicon_pass(note_sentences(events), lists).groupBy(*KEY).agg(*_lexicon_sums())
    return features if cases is None else per_case(cases, features, LEXICON_FEATURES)


def note_features(
    events: DataFrame, framing: DataFrame, cases: DataFrame | None = None,
    lists: WordLists | None = None,
) -> DataFrame:
    """The seven note features per case.

    framing: one row per sentence with label and probability (see
    note_model.FramingModel.label_sentences). Both halves are summed per case
    before they meet, so no sentence is joined.
    """
    words = lexicon_features(events, lists=lists)
    surprised, expected = F.col("label") == "unanticipated", F.col("label") == "expected_risk"
    best = lambda c: F.coalesce(F.max(F.when(c, F.col("probability"))), F.lit(0.0))
    framed = framing.groupBy(*KEY).agg(
        count_true(surprised).cast("double").alias("note_unanticipated_language"),
        count_true(expected).cast("double").alias("note_expected_risk_language"),
        best(surprised).alias("note_max_unanticipated_prob"),
        (best(surprised) - best(expected)).alias("note_framing_margin"),
    )
    both = framed.join(words, KEY, "full").fillna(0.0, FRAMING_FEATURES + LEXICON_FEATURES)
    return both if cases is None else per_case(cases, both, list(fixed.NOTE_MEANINGS))


def note_findings(
    events: DataFrame, framing: DataFrame, lists: WordLists | None = None
) -> DataFrame:
    """Sentences that carry signal: a framing other than neutral, or a listed term."""
    words = lexicon_pass(note_sentences(events), lists)
    signal = (
        (F.col("label") != "neutral")
        | (F.size("error_terms") > 0)
        | (F.size("harm_terms") > 0)
    )
    return words.join(framing, SENTENCE_KEY).where(signal)


def ordered_findings(findings: DataFrame, n: int | None = None) -> DataFrame:
    """Adds place: unanticipated framing first, then by probability."""
    order = Window.partitionBy(*KEY).orderBy(
        (F.col("label") != "unanticipated").asc(), F.desc("probability"),
        F.asc("case_ordinal"), F.asc("position"),
    )
    placed = findings.withColumn("place", F.row_number().over(order))
    return placed if n is None else placed.where(F.col("place") <= n)


def framing_by_cues(
    text: Column,
    unanticipated: list[str] = fixed.UNANTICIPATED_CUES,
    expected: list[str] = fixed.EXPECTED_CUES,
) -> Column:
    """Framing class from cue words alone; ties are neutral.

    Unanticipated cues are struck from the text in list order as they are
    counted, so "not anticipated" does not count as "anticipated" as well.
    """
    start = F.struct(F.lower(text).alias("rest"), F.lit(0).alias("n"))

    def strike(state, cue):
        return F.struct(
            F.replace(state["rest"], cue, F.lit(" ")).alias("rest"),
            (state["n"] + F.contains(state["rest"], cue).cast("int")).alias("n"),
        )

    def decide(state):
        hits = sum((F.contains(state["rest"], F.lit(c)).cast("int") for c in expected), F.lit(0))
        return (
            F.when(state["n"] > hits, "unanticipated")
            .when(state["n"] < hits, "expected_risk")
            .otherwise("neutral")
        )

    return F.aggregate(F.array(*[F.lit(c) for c in unanticipated]), start, strike, decide)


def contrast_report(predicted: DataFrame) -> DataFrame:
    """Pairs of texts that differ in framing only: (pair_id, side, truth, pred)."""
    right = F.col("truth") == F.col("pred")
    pairs = predicted.groupBy("pair_id").agg(
        F.count(F.lit(1)).alias("texts"),
        count_true(right).alias("right"),
        F.min("pred").alias("least"),
        F.max("pred").alias("most"),
    )
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        count_true(F.col("right") == F.col("texts")).alias("both_correct"),
        count_true(F.col("least") != F.col("most")).alias("flipped"),
        C.ratio(F.sum("right"), F.sum("texts")).alias("accuracy"),
    ).select(
        "*",
        C.ratio(F.col("both_correct"), F.col("n_pairs")).alias("both_correct_rate"),
        C.ratio(F.col("flipped"), F.col("n_pairs")).alias("flip_rate"),
    )


def contrast_misses(predicted: DataFrame) -> DataFrame:
    return predicted.where(F.col("truth") != F.col("pred"))


def has_notes(events: DataFrame) -> bool:
    """Whether any note exists; stops at the first one found."""
    return bool(events.where(F.col("event_type") == "note").limit(1).count())


def sources_with_notes(events: DataFrame) -> DataFrame:
    """The same question for every source, in one pass."""
    return events.groupBy("source").agg(
        F.bool_or(F.col("event_type") == "note").alias("has_notes")
    )
