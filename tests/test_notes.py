import math

import pytest
from pyspark.sql import functions as F

from tracewell.operators import note_model as NM
from tracewell.operators import notes as N

AT = "2026-01-01 00:00:00"


def lexicon(make_events, text):
    return N.lexicon_features(make_events([("c", "note", AT, "Progress", text)])).head()


def test_sentences(spark):
    df = spark.createDataFrame([("One here. Two there!\n\nNo.\n a b c ; last one",), (None,), ("",)], "t string")
    got = [r[0] for r in df.select(N.split_sentences(F.col("t"))).collect()]
    assert got == [["One here.", "Two there!", "a b c ;", "last one"], [], []]


def test_negated_findings_do_not_count_as_harm(make_events):
    f = lexicon(make_events, "No evidence of hemorrhage and sepsis was ruled out. No acute distress.")
    assert f["note_harm_state_language"] == 0.0 and f["note_negated_harm_mentions"] > 0.0


def test_negation_is_clause_scoped(make_events):
    f = lexicon(make_events, "No acute distress, but there is worsening hypoxia this afternoon.")
    assert f["note_harm_state_language"] == 2.0 and f["note_negated_harm_mentions"] == 0.0


def test_term_with_a_clause_word_never_negates(make_events):
    f = lexicon(make_events, "No dose was documented but given.")
    assert f["note_explicit_error_language"] == 1.0 and f["note_negated_harm_mentions"] == 0.0


def test_cues_are_substrings(make_events):
    assert lexicon(make_events, "The sepsis resolved fully.")["note_negated_harm_mentions"] == 1.0
    assert lexicon(make_events, "The nonunion had sepsis.")["note_negated_harm_mentions"] == 1.0


def test_error_language_and_empty_chart(make_events, make_cases):
    events = make_events([("c", "note", AT, "n", "The wrong dose was given because of an order entry problem.")])
    rows = N.lexicon_features(events, make_cases([("c", True), ("x", None)])).collect()
    got = {r["case_id"]: r["note_explicit_error_language"] for r in rows}
    assert got == {"c": 2.0, "x": 0.0}


@pytest.mark.parametrize(
    "text,label",
    [("This was not anticipated.", "unanticipated"), ("Bleeding is an anticipated event.", "expected_risk"),
     ("Vital signs stable.", "neutral"), ("An error in a planned step.", "neutral")],
)
def test_framing_by_cues(spark, text, label):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(N.framing_by_cues(F.col("t"))).head()[0] == label


def test_contrast_report(spark):
    rows = [(1, "unanticipated", "unanticipated"), (1, "expected_risk", "expected_risk"),
            (2, "unanticipated", "neutral"), (2, "expected_risk", "neutral"),
            (3, "unanticipated", "expected_risk"), (3, "expected_risk", "unanticipated")]
    df = spark.createDataFrame(rows, "pair_id int, truth string, pred string")
    r = N.contrast_report(df).head()
    assert (r["n_pairs"], r["both_correct"], r["flipped"], r["accuracy"]) == (3, 1, 2, 2 / 6)
    assert N.contrast_misses(df).count() == 4


def test_has_notes(make_events):
    assert N.has_notes(make_events([("c", "note", AT, "", "x")]))
    assert not N.has_notes(make_events([("c", "lab", AT, "", "x")]))


TEXTS = [
    ("unanticipated", ["Nobody saw the leak coming.", "A clamp slipped and the vessel tore.",
                       "The tube was placed in the wrong lung.", "He should never have bled so much.",
                       "The pump ran ten times too fast.", "The clamp slipped again without warning."]),
    ("expected_risk", ["The family accepted a chance of bleeding.", "Some swelling is usual after this step.",
                       "We told him nausea may follow.", "A leak is a listed hazard of this repair.",
                       "Swelling was foreseen in the plan.", "Nausea may follow as we told the family."]),
    ("neutral", ["Vitals stable overnight.", "Diet advanced as tolerated.", "Walked twice in the hall.",
                 "Lungs clear on exam.", "Vitals stable and lungs clear.", "Diet tolerated in the hall."]),
]


@pytest.fixture(scope="module")
def labelled(spark):
    rows = [(f"{label}-{i}", text, label) for label, texts in TEXTS for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "text_id string, text string, label string")


@pytest.fixture(scope="module")
def model(labelled):
    return NM.FramingModel.fit(labelled)


def python_terms(text):
    import re

    from tracewell.functions.fixed_values import STOP_WORDS
    words = [w for w in re.findall(r"\w\w+", text.lower()) if w not in STOP_WORDS]
    return [" ".join(words[i:i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def test_terms_agree_in_both_forms(spark):
    texts = ["Straße été the été naïve plan", "", "one", "a the", "two words", "x y z"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    long = {}
    for r in NM.ngram_rows(df, ["id"], "text").where("term is not null").collect():
        long.setdefault(r["id"], []).append(r["term"])
    for i, r in enumerate(df.select("id", NM.ngram_array(F.col("text")).alias("t")).orderBy("id").collect()):
        assert sorted(r["t"]) == sorted(long.get(i, [])) == sorted(python_terms(texts[i]))


def python_tfidf(texts):
    counts = [{t: python_terms(x).count(t) for t in python_terms(x)} for x in texts]
    df = {}
    for c in counts:
        for t in c:
            df[t] = df.get(t, 0) + 1
    out = []
    for c in counts:
        w = {t: (1 + math.log(n)) * (math.log((1 + len(texts)) / (1 + df[t])) + 1) for t, n in c.items()}
        length = math.sqrt(sum(v * v for v in w.values()))
        out.append({t: v / length for t, v in w.items()})
    return out


def test_tfidf_against_brute_force(spark):
    texts = [t for _, group in TEXTS for t in group] + ["pump pump pump ran ran"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    want = python_tfidf(texts)
    got = NM.tfidf(df, ["id"], "text").collect()
    assert len(got) == sum(len(w) for w in want)
    assert all(abs(r["weight"] - want[r["id"]][r["term"]]) < 1e-12 for r in got)


def test_fit_reaches_the_optimum(labelled, model):
    """Gradient of the balanced, C = 4 multinomial objective at the solution."""
    import numpy as np

    rows = labelled.orderBy("text_id").collect()
    weights = python_tfidf([r["text"] for r in rows])
    terms = {r["term"]: r["coefs"] for r in model.terms.collect()}
    grad = {t: np.array(terms[t]) for t in terms}
    bias = np.zeros(3)
    for r, w in zip(rows, weights):
        logits = np.array(model.intercepts) + sum(v * np.array(terms[t]) for t, v in w.items())
        p = np.exp(logits - logits.max())
        p /= p.sum()
        error = 4.0 * (p - np.array([c == r["label"] for c in model.classes], float))
        bias += error
        for t, v in w.items():
            grad[t] = grad[t] + v * error
    assert max(abs(g).max() for g in grad.values()) < 1e-3 and abs(bias).max() < 1e-3


def test_probabilities_and_floor(spark, labelled, model):
    probs = model.probabilities(labelled, ["text_id"], "text").collect()
    assert len(probs) == labelled.count()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in probs)
    assert model.predict(labelled, ["text_id"], "text").join(labelled, "text_id").where(
        "pred != label").count() == 0
    odd = spark.createDataFrame([("z", "qqq zzz"), ("e", "")], "text_id string, text string")
    rows = model.label_texts(odd, ["text_id"], "text").collect()
    assert sorted(r["text_id"] for r in rows) == ["e", "z"]
    assert all(r["label"] == "neutral" for r in rows)
    assert model.top_terms("unanticipated", 5).count() == 5 and model.top_terms("none").count() == 0


def test_shuffle_join_equals_broadcast(spark, labelled, model):
    a = model.label_texts(labelled, ["text_id"], "text").select("text_id", "label").persist()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    b = model.label_texts(labelled, ["text_id"], "text").select("text_id", "label")
    assert a.exceptAll(b).count() == 0
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_note_features_and_findings(make_events, make_cases, model):
    events = make_events([
        ("c", "note", AT, "Progress", "The clamp slipped and the vessel tore. Vitals stable overnight."),
        ("d", "lab", AT, "WBC", "5"),
    ])
    sentences = N.note_sentences(events)
    framed = model.label_sentences(sentences)
    rows = {r["case_id"]: r for r in N.note_features(events, framed, make_cases([("c", True), ("d", False)])).collect()}
    assert rows["c"]["note_unanticipated_language"] == 1.0
    assert rows["c"]["note_framing_margin"] == pytest.approx(rows["c"]["note_max_unanticipated_prob"])
    assert set(rows["d"].asDict().values()) == {"test", "d", 0.0}
    found = N.ordered_findings(N.note_findings(events, framed)).collect()
    assert [f["sentence"] for f in found] == ["The clamp slipped and the vessel tore."]


def test_cross_validated_predictions(labelled):
    out = NM.cross_validated_predictions(labelled, 3, max_iter=20)
    assert out.count() == labelled.count() and out.select("text_id").distinct().count() == out.count()
