"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features are densities of lexicon words, their distance to second-person words, rates of
capitals, punctuation and obfuscated words, and the length. There are two lexicons: a short fixed
list, and words and word beginnings that labelled rows show to be toxic.

Labels are read only where crc32(id as text) mod 3 is not 1, from a sample of about FIT_ROWS such
rows (by a hash of the id). The sample has two halves. The learned lexicon of one half gives the features of the
other; trees are grown on the first half and calibrated on the second, so neither step judges
words or scores that it has itself fitted. Rows are scored with the lexicon of both halves.

Every text is read whole and scored in one pass without a shuffle. Language, source, id and label
are never features. Defined cases: null and empty texts are scored as a text without
words; a null id is not held out; a repeated label counts as toxic if one of its rows is; without
labels of both classes every score is the share of toxic labels (0 without labels); other columns
pass through.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 20_000
FIT_PARTITIONS = 2
LEXICON_TERMS = 2_000
LEAST_ROWS = 3          # toxic rows that must hold a learned term
LEAST_SHARE = 0.002     # and their share of all toxic rows
LEAST_RATIO = 8.0       # its rate in toxic rows over that in others
BEGINNINGS = (3, 4, 5, 6, 7, 8)
NEAR = 5
THRESHOLD = 0.7
TREES = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.3, "maxBins": 64, "seed": 7}

# Plain insults and second-person words.
INSULTS = frozenset("""
idiot idiots moron morons stupid dumb trash scum loser losers pathetic worthless disgusting clown
fool jerk bastard pig filth vermin imbecile cretin retard garbage ugly
dumm dummkopf arschloch abschaum widerlich versager idioten trottel
stupide imbécile crétin connard salaud ordure nul dégoûtant
estúpido imbécil basura escoria asqueroso patético inútil perdedor
""".split())
SECOND_PERSON = frozenset("""
you your yours yourself u ur du dich dir dein deine deinen ihr euch tu te toi ton ta tes vous votre
vos tú ti tus usted ustedes vosotros
""".split())
LEET = str.maketrans("0134578@$!|", "oieastbasil")
_EDGE = ".,!?;:\"'()[]{}<>|*#$%&-_"
_MIXED = re.compile(r"[^\W\d_][^\w\s]+[^\W\d_]|[^\W\d_]\d|\d[^\W\d_]")
_JOINED = re.compile(r"[\W_]+")
_PLAIN = re.compile(r"[\w\s]+")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
REMEMBERED = 200_000    # words that a task remembers; beyond that it starts anew

NAMES = (
    "log_words fixed_density fixed_count fixed_distinct word_density word_count word_distinct "
    "beginning_density beginning_count beginning_distinct evidence evidence_density strongest near_second second_density "
    "hidden_density mixed_density capitals shouted punctuation exclamations"
).split()


def terms_of(text: str) -> list[str]:
    return [w.strip(_EDGE) for w in text.lower().split()]


class Features:
    """The features of a text under one lexicon. What a word says is worked out once."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.known: dict[str, tuple | None] = {}

    def word(self, raw: str) -> tuple | None:
        """(insult, second person, own weight, weight of its beginning, mixed, hidden, shouted)."""
        w = raw.lower().strip(_EDGE)
        begins = [b for k in BEGINNINGS if len(w) > k and (b := "^" + w[:k]) in self.lexicon]
        begun = max(map(self.lexicon.get, begins), default=None)
        mixed = bool(_MIXED.search(raw))
        plain = _JOINED.sub("", raw.lower().translate(LEET)) if mixed else ""
        said = (
            w in INSULTS, w in SECOND_PERSON, self.lexicon.get(w), begun, mixed,
            mixed and (plain in INSULTS or plain in self.lexicon), raw.isupper() and len(raw) > 1, w,
        )
        return said if any(x is not None and x is not False for x in said[:-1]) else None

    def __call__(self, text: str) -> list[float]:
        raw, known = text.split(), self.known
        if len(known) > REMEMBERED:
            known.clear()
        n = max(len(raw), 1)
        fixed, word, beginning, best = [], [], [], {}
        mixed = hidden = shouted = 0
        second, hits = [], []
        for i, token in enumerate(raw):
            if token in known:
                said = known[token]
            else:
                said = known[token] = self.word(token)
            if said is None:
                continue
            insult, person, own, begun, is_mixed, is_hidden, is_shouted, w = said
            if insult:
                fixed.append(w)
            if person:
                second.append(i)
            if own is not None:
                word.append(w)
            if begun is not None:
                beginning.append(w)
            if own is not None or begun is not None:
                best[w] = max(own or 0.0, begun or 0.0)
            if insult or w in best:
                hits.append(i)
            mixed += is_mixed
            hidden += is_hidden
            shouted += is_shouted
        near, j = 0, 0
        for i in hits:
            while j < len(second) and second[j] < i - NEAR:
                j += 1
            near += j < len(second) and second[j] <= i + NEAR
        chars = max(len(text), 1)
        signs = len(text) - sum(map(len, _PLAIN.findall(text)))
        evidence = sum(best.values())
        return [
            math.log1p(len(raw)), 100 * len(fixed) / n, float(len(fixed)), float(len(set(fixed))),
            100 * len(word) / n, float(len(word)), float(len(set(word))),
            100 * len(beginning) / n, float(len(beginning)), float(len(set(beginning))),
            evidence, 100 * evidence / n, max(best.values(), default=0.0),
            float(near), 100 * len(second) / n, 100 * hidden / n, 100 * mixed / n,
            len(_CAPITAL.findall(text)) / chars, shouted / n, signs / chars, text.count("!") / n,
        ]


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    return Features(lexicon)(text)


@dataclass
class ToxicityModel:
    """What is applied to a text: lexicon, trees and calibration; `rate` alone without a fit."""

    lexicon: dict[str, float]
    trees: object | None
    calibration: object | None
    rate: float

    def score(self, docs: DataFrame, text_column: str = "text") -> DataFrame:
        """`row` (all columns of docs), `score` and `predicted` (1 from the threshold on)."""
        held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
        if self.trees is None:
            out = held.withColumn("score", F.lit(float(self.rate)))
        else:
            text = F.col("row").getField(text_column)
            out = held.withColumn("features", array_to_vector(_features(docs.sparkSession, self.lexicon)(text, F.lit(0))))
            out = self.trees.transform(out).withColumn("raw", vector_to_array("probability")[1])
            out = self.calibration.transform(out)
            # The trees' own order decides between equal calibrated scores.
            score = F.col("calibrated") * 0.999 + F.col("raw") * 0.001
            out = out.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
        return out.select("row", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def _features(spark, *lexicons: dict[str, float]):
    """Features of a text under the lexicon of the given number."""
    terms = spark.sparkContext.broadcast(lexicons)

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scorers = [Features(lexicon) for lexicon in terms.value]
        for texts, which in batches:
            yield pd.Series([scorers[k](t or "") for t, k in zip(texts, which, strict=True)], dtype=object)

    return run


def held_out(column: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(3)) == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str) -> DataFrame:
    """About FIT_ROWS labelled rows that are not held out: text, label (0 or 1), half (0 or 1)."""
    known = (
        labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & ~held_out(id_column))
        .groupBy(F.col(id_column).cast("bigint").alias("id")).agg(F.max(F.col(label_column).cast("int")).alias("label"))
    )
    count = known.count()
    place = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20))
    if count > FIT_ROWS:
        known = known.where(place < int((1 << 20) * FIT_ROWS / count))
    half = F.pmod(F.xxhash64(F.lit("half"), "id"), F.lit(2)).cast("int").alias("half")
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    # about FIT_ROWS small rows, whatever the size of the tables
    return texts.join(F.broadcast(known), "id").select("text", (F.col("label") > 0).cast("int").alias("label"), half)


def _term_counts(batches):
    """Rows per half, label and term, one count for each text that holds the term."""
    import pyarrow as pa
    from collections import Counter

    for batch in batches:
        found: Counter = Counter()
        for text, label, half in zip(*(batch.column(c).to_pylist() for c in ("text", "label", "half")), strict=True):
            words = {w for w in terms_of(text or "") if len(w) > 2 and any(c.isalpha() for c in w)}
            found.update((half, label, t) for t in words | {"^" + w[:k] for w in words for k in BEGINNINGS if len(w) > k})
            found[half, label, ""] += 1
        keys = list(found)
        yield pa.record_batch(
            [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
             pa.array([k[2] for k in keys], pa.string()), pa.array([found[k] for k in keys], pa.int64())],
            ["half", "label", "term", "n"],
        )


def _lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Learned terms of half 0, half 1 and both, with the logarithm of their ratio."""
    counts = (
        sample.mapInArrow(_term_counts, "half int, label int, term string, n bigint")
        .groupBy("term").agg(*[
            F.sum(F.when((F.col("half") == h) & (F.col("label") == y), F.col("n")).otherwise(0)).alias(f"n{h}{y}")
            for h in (0, 1) for y in (0, 1)
        ])
    ).persist()
    totals = counts.where("term = ''").first()
    out = []
    for halves in ((0,), (1,), (0, 1)):
        toxic = sum((F.col(f"n{h}1") for h in halves), F.lit(0))
        other = sum((F.col(f"n{h}0") for h in halves), F.lit(0))
        all_toxic = sum(totals[f"n{h}1"] for h in halves)
        all_other = sum(totals[f"n{h}0"] for h in halves)
        ratio = ((toxic + 0.5) / (all_toxic + 1)) / ((other + 0.5) / (all_other + 1))
        least = max(LEAST_ROWS, LEAST_SHARE * all_toxic)
        rows = (
            counts.where("term != ''").where((toxic >= least) & (ratio >= min(LEAST_RATIO, 0.5 * (all_other + 1) / 2)))
            .select("term", F.log(ratio).alias("weight"), toxic.alias("n"))
            .orderBy(F.desc("n"), "term").limit(LEXICON_TERMS).collect()
        )
        out.append({r.term: float(r.weight) for r in rows})
    counts.unpersist()
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> ToxicityModel:
    spark = docs.sparkSession
    sample = _sample(docs, labels, id_column, text_column, label_column).persist()
    seen = {(r.half, r.label): r.n for r in sample.groupBy("half", "label").agg(F.count("*").alias("n")).collect()}
    toxic = sum(n for (_, y), n in seen.items() if y)
    if len(seen) < 4:
        sample.unpersist()
        return ToxicityModel({}, None, None, toxic / max(sum(seen.values()), 1))
    first, second, both = _lexicons(sample)
    table = (
        sample.withColumn("features", array_to_vector(_features(spark, second, first)("text", "half")))
        .select("half", "features", F.col("label").cast("double").alias("label")).persist()
    )
    # A bounded sample of short rows: many small jobs go over few partitions.
    table.count()
    rows = table.coalesce(FIT_PARTITIONS).persist()
    trees = GBTClassifier(featuresCol="features", labelCol="label", **TREES).fit(rows.where("half = 0"))
    judged = trees.transform(rows.where("half = 1")).select("label", vector_to_array("probability")[1].alias("raw"))
    calibration = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(judged)
    rows.unpersist()
    table.unpersist()
    sample.unpersist()
    return ToxicityModel(both, trees, calibration, toxic / sum(seen.values()))


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    base = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    model = fit_toxicity(base, labels.withColumnRenamed(id_column, "doc_id"), label_column=label_column)
    out = model.score(base).select(F.col("row.doc_id").alias("doc_id"), "score", "predicted")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """The rows that are not predicted toxic, with all their columns."""
    model = fit_toxicity(docs, labels, id_column, text_column, label_column)
    return model.score(docs, text_column).where("predicted = 0").select("row.*")
