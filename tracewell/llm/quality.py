"""Quality rules: a decision list learned by sequential covering.

Base statistics of a text are built-in expressions over its words and lines. From labelled
rows the learner grows one rule after the other: a conjunction of thresholds that
covers rows of label 0. Growth takes the literal with the best FOIL gain on grouped counts per
quantile bin of each statistic; the rule is pruned back on rows that it was not grown on; rows it covers
leave both sets; the search ends when a pruned rule is no longer precise. The list becomes
one ordered CASE expression, so applying it is a scan without a shuffle.

Labels come from a sample of about FIT_ROWS rows (by a hash of the id), and the driver sees
only counts per bin.

Words are runs of `[^\\x20\\x09-\\x0D]`. Defined cases: null and empty texts have no words and
fail the base rules; rows without a label, an id or a document teach nothing; an id labelled twice
takes its lower label; without rows of both labels the list is empty; repeated rows get equal results; other
columns pass through.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 50_000
BINS = 32
LITERALS = 3
RULES = 8
PRECISION = 0.85        # of a pruned rule, on rows that it was not grown on
LEAST_ROWS = 5          # of label 0 that it covers there
LEAST_WORDS = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHARES = {
    "mean_chars": ("word_chars", 1.0),
    "symbols_per_word": ("n_symbols", 1.0),
    "repeat_share": ("n_repeat_words", 1.0),
    "dup_lines_per_word": ("n_dup_lines", 1.0),
}
FEATURES = (*STATISTICS, *SHARES)


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """`row` (all columns of docs) and the base statistics.

    A window of three words counts as repeated by its 64-bit hash. Hashes are sorted without
    positions first; only texts with a repeated one sort them with positions.
    """
    text = F.coalesce(F.col("row").getField(text_column), F.lit(""))
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", text.alias("text"))
    out = out.select(
        "row",
        F.expr(r"filter(split(text, '[\\x20\\x09-\\x0D]+'), w -> w != '')").alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("bigint").alias("n_symbols"),
    )
    out = out.select(
        "row", "n_symbols",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.expr("""
            IF(size(words) < 3, array(),
               transform(sequence(0, size(words) - 3), i -> xxhash64(get(words, i), get(words, i + 1), get(words, i + 2))))
        """).alias("windows"),
    )
    out = out.withColumn("ordered", F.sort_array("windows"))
    out = out.withColumn("repeats", F.expr("exists(sequence(1, greatest(1, size(ordered) - 1)), i -> get(ordered, i) = get(ordered, i - 1))")).drop("ordered")
    out = out.withColumn("placed", F.expr("IF(repeats, sort_array(transform(windows, (w, i) -> struct(w AS w, i AS i))), NULL)")).drop("windows", "repeats")
    out = out.withColumn("at", F.expr("""
        sort_array(transform(filter(placed, (p, i) -> p.w = get(placed, i - 1).w OR p.w = get(placed, i + 1).w), p -> p.i))
    """)).drop("placed")
    covered = F.expr("aggregate(transform(at, (p, i) -> least(3, coalesce(get(at, i + 1) - p, 3))), 0, (a, b) -> a + b)")
    return out.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint")).select("row", *STATISTICS)


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _feature(name: str) -> Column:
    if name in STATISTICS:
        return F.col(name).cast("double")
    top, scale = SHARES[name]
    return scale * F.col(top) / F.greatest(F.col("n_words"), F.lit(1))


@dataclass(frozen=True)
class Literal:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = _feature(self.feature)
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


@dataclass
class DecisionList:
    """Ordered rules; the first that holds rejects, and a text without one is kept."""

    rules: list[tuple[Literal, ...]] = field(default_factory=list)

    def first(self) -> Column:
        """The first rule that holds, as text; null if none does."""
        out = F.lit(None).cast("string")
        for rule in reversed(self.rules):
            out = F.when(_all(rule), F.lit(" AND ".join(map(str, rule)))).otherwise(out)
        return out

    def rejects(self) -> Column:
        return self.first().isNotNull()


def _all(rule) -> Column:
    return reduce(lambda a, b: a & b, (x.column() for x in rule), F.lit(True))


def gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain of a rule that covers p of p0 wanted and n of n0 other rows."""
    if not p:
        return 0.0
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0)))


def _edges(rows: DataFrame) -> dict[str, list[float]]:
    shares = [i / BINS for i in range(1, BINS)]
    found = rows.select(*[_feature(f).alias(f) for f in FEATURES]).approxQuantile(list(FEATURES), shares, 0.002)
    return {f: sorted(set(e)) for f, e in zip(FEATURES, found, strict=True)}


def _binned(rows: DataFrame, edges: dict[str, list[float]]) -> DataFrame:
    """`bins`: for each feature, how many of its edges lie below the value."""
    place = lambda f: F.aggregate(
        F.array(*[F.lit(float(e)) for e in edges[f]]), F.lit(0), lambda a, e: a + (_feature(f) > e).cast("int")
    ) if edges[f] else F.lit(0)
    return rows.withColumn("bins", F.array(*[place(f) for f in FEATURES]))


def _best(rows: DataFrame, edges, p0: int, n0: int) -> tuple[float, Literal | None, int, int]:
    """The literal with the highest gain among the rows: (gain, literal, wanted, others covered)."""
    counts = rows.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
        F.sum(F.col("bad")).alias("p"), F.sum(1 - F.col("bad")).alias("n")
    ).collect()
    at = {(r.f, r.bin): (r.p, r.n) for r in counts}
    best = (0.0, None, 0, 0)
    for f, name in enumerate(FEATURES):
        low_p = low_n = 0
        for k, edge in enumerate(edges[name]):
            p, n = at.get((f, k), (0, 0))
            low_p, low_n = low_p + p, low_n + n
            for above, cp, cn in ((False, low_p, low_n), (True, p0 - low_p, n0 - low_n)):
                g = gain(cp, cn, p0, n0)
                if g > best[0] + 1e-9:
                    best = (g, Literal(name, above, edge), cp, cn)
    return best


def _sizes(rows: DataFrame) -> tuple[int, int]:
    r = rows.agg(F.coalesce(F.sum("bad"), F.lit(0)).alias("p"), F.coalesce(F.sum(1 - F.col("bad")), F.lit(0)).alias("n")).first()
    return int(r.p), int(r.n)


def _grow(rows: DataFrame, edges) -> list[Literal]:
    p, n = _sizes(rows)
    rule: list[Literal] = []
    while p and n and len(rule) < LITERALS:
        g, literal, p, n = _best(rows, edges, p, n)
        if literal is None:
            break
        rule.append(literal)
        rows = rows.where(literal.column())
    return rule


def _prune(rows: DataFrame, rule: list[Literal]) -> tuple[tuple[Literal, ...], int, int]:
    """The prefix with the best share of wanted rows; the shortest of equals."""
    parts = [rule[:k] for k in range(1, len(rule) + 1)]
    r = rows.agg(*[F.coalesce(F.sum(F.when(_all(x), y)), F.lit(0)) for x in parts for y in (F.col("bad"), 1 - F.col("bad"))]).first()
    best, worth = None, -2.0
    for k, x in enumerate(parts):
        p, n = int(r[2 * k]), int(r[2 * k + 1])
        w = (p - n) / (p + n) if p + n else -1.0
        if w > worth + 1e-9:
            best, worth = (tuple(x), p, n), w
    return best


def learn_rules(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DecisionList:
    """Rules for rows of label 0 among those that pass the base rules."""
    known = (
        labels.where(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(F.col(id_column).cast("bigint").alias("id")).agg(F.min(F.col(label_column).cast("int")).alias("label"))
    )
    count = known.count()
    if count > FIT_ROWS:
        known = known.where(F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < int((1 << 20) * FIT_ROWS / count))
    texts = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    # about FIT_ROWS small rows, whatever the size of the tables
    marked = texts.join(F.broadcast(known), "id")
    cached = statistics(marked).select(
        *STATISTICS, (F.col("row.label") == 0).cast("int").alias("bad"),
        F.pmod(F.xxhash64(F.lit("grow"), F.col("row.id")), F.lit(3)).alias("part"),
    ).persist()
    # The cache keeps this filter above it: pushed down, it would compute the statistics inside themselves.
    rows = cached.where(~base_failed())
    found = DecisionList()
    p, n = _sizes(rows)
    if p and n:
        edges = _edges(rows)
        table = _binned(rows, edges).persist()
        grow, prune = table.where("part != 0"), table.where("part = 0")
        while len(found.rules) < RULES:
            rule = _grow(grow, edges)
            if not rule:
                break
            rule, p, n = _prune(prune, rule)
            if p < LEAST_ROWS or p < PRECISION * (p + n):
                break
            found.rules.append(rule)
            grow, prune = grow.where(~_all(rule)), prune.where(~_all(rule))
        table.unpersist()
    cached.unpersist()
    return found


def judge(docs: DataFrame, rules: DecisionList, text_column: str = "text") -> DataFrame:
    """`row`, the base statistics, base_failed, rule (the first that rejects) and kept."""
    failed = base_failed().alias("base_failed")
    rule = rules.first().alias("rule")
    return statistics(docs, text_column).select("row", *STATISTICS, failed, rule).withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())

