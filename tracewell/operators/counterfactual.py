"""Strip evidence from some labelled cases, add explained evidence to others, undo."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.functions import columns as C
from tracewell.functions import fixed_values as fixed
from tracewell.operators.ordering import flag_smallest, global_rank
from tracewell.operators.resample import class_sizes
from tracewell.schema import EVENTS, KEY
from tracewell.session import materialize

MARK = "injected-"
LOG_COLUMNS = ["run_id", "action", "table_name", *KEY, "row_json"]


@dataclass
class Shares:
    silent: float = fixed.SILENT_SHARE
    dark: float = fixed.DARK_SHARE
    benign: float = fixed.BENIGN_SHARE
    dark_types: list[str] = field(default_factory=lambda: ["lab"])


def chosen_cases(cases: DataFrame, shares: Shares, seed: int) -> DataFrame:
    """Adds silent, dark (a part of silent) and benign, all by seeded hash rank."""
    positives, negatives = class_sizes(cases)
    hashed = cases.where(F.col("label").isNotNull()).withColumn(
        "_hash", C.seeded_hash(seed, F.concat_ws("|", *KEY))
    )
    flagged = flag_smallest(
        hashed, "_hash",
        {True: int(positives * shares.silent), False: int(negatives * shares.benign)},
        "label", "_first",
    )
    flagged = flag_smallest(
        flagged, "_hash", {True: min(int(positives * shares.dark), int(positives * shares.silent))},
        "label", "dark",
    )
    marks = flagged.select(
        *KEY, "label", "_hash", "dark",
        (F.col("_first") & F.col("label")).alias("silent"),
        (F.col("_first") & ~F.col("label")).alias("benign"),
    )
    # Read several times below, and only these columns of it.
    return materialize(marks, "chosen")


def doomed_events(
    events: DataFrame, chosen: DataFrame, shares: Shares,
    meds: list[str] = fixed.SIGNATURE_MEDS, procedures: list[str] = fixed.SIGNATURE_PROCEDURES,
) -> DataFrame:
    """Signature events of silent cases, and all events of the dark types of dark ones."""
    kind, value = F.col("event_type"), F.col("value")
    signature = ((kind == "medication") & value.isin(meds)) | (
        (kind == "procedure") & value.isin(procedures)
    )
    in_dark = kind.isin(shares.dark_types)
    hit = chosen.where("silent").select(*KEY, "dark")
    return (
        events.where(signature | in_dark)
        .join(hit, KEY)
        .where(signature | (in_dark & F.col("dark")))
        .select(*events.columns)
    )


def _delayed(tag: str, seed: int, span: tuple[int, int]) -> Column:
    hours = C.seeded_int(f"{seed}{tag}", F.col("_id"), *span)
    return F.col("started") + F.make_dt_interval(hours=hours)


def explained_events(
    events: DataFrame, chosen: DataFrame, seed: int,
    meds: list = fixed.EXPLAINED_MEDS, procedures: list = fixed.EXPLAINED_PROCEDURES,
    labs: list = fixed.EXPLAINED_LABS,
) -> DataFrame:
    """Signature evidence with an innocent reason for the benign cases.

    Templates go round-robin over the cases in hash order, so none is left out.
    """
    spark = events.sparkSession
    benign = chosen.where("benign").select(*KEY, "_hash")
    numbered = global_rank(benign, [F.col("_hash"), *[F.col(k) for k in KEY]], "_place")
    spans = (
        events.join(benign.select(*KEY), KEY, "left_semi")
        .groupBy(*KEY)
        .agg(F.min("ts").alias("started"), F.max("case_ordinal").alias("last_ordinal"))
    )
    base = (
        numbered.join(spans, KEY)
        .withColumn("_id", F.concat_ws("|", *KEY))
        .withColumn("_index", F.col("_place") - 1)
    )

    def draw(tag: str) -> Column:
        return C.seeded_draw(f"{seed}{tag}", F.col("_id"))

    def templates(rows: list) -> DataFrame:
        return F.broadcast(
            spark.createDataFrame(
                [(i, value, details) for i, (value, details) in enumerate(rows)],
                "slot bigint, value string, details string",
            )
        )

    def stream(rows: list, kind: str, slot: Column, at: Column, keep: Column, offset: int):
        return (
            base.where(keep)
            .withColumn("slot", slot.cast("bigint"))
            .withColumn("ts", at)
            .join(templates(rows), "slot")
            .select(
                *KEY,
                (F.col("last_ordinal") + offset).alias("case_ordinal"),
                F.lit(kind).alias("event_type"), "ts", "value", "details",
            )
        )

    given = stream(
        meds, "medication", F.col("_index") % len(meds),
        _delayed("med", seed, fixed.MED_DELAY), F.lit(True), 1,
    )
    done = stream(
        procedures, "procedure", F.col("_index") % len(procedures),
        _delayed("proc", seed, fixed.PROCEDURE_DELAY),
        draw("proc?") < fixed.SIDE_PROCEDURE_RATE, 2,
    )
    drawn = stream(
        [(name, f"{value} {units}") for name, value, units in labs], "lab",
        F.floor(draw("which") * len(labs)), _delayed("lab", seed, fixed.LAB_DELAY),
        draw("lab?") < fixed.SIDE_LAB_RATE, 3,
    )
    identity = C.content_id(F.col("event_type"), F.col("ts"), F.col("value"), F.col("details"))
    return (
        given.unionByName(done)
        .unionByName(drawn)
        .withColumn("event_id", F.concat(F.lit(MARK), identity))
        .select(*events.columns)
    )


def change_log(deleted: DataFrame, inserted: DataFrame, run_id: str) -> DataFrame:
    """Every deleted and inserted row in full, as JSON."""
    def rows(df: DataFrame, action: str) -> DataFrame:
        return df.select(
            F.lit(run_id).alias("run_id"), F.lit(action).alias("action"),
            F.lit("events").alias("table_name"), *KEY,
            F.to_json(F.struct(*df.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
            .alias("row_json"),
        )

    return rows(deleted, "delete").unionByName(rows(inserted, "insert"))


@dataclass
class Change:
    events: DataFrame
    log: DataFrame
    counts: DataFrame


def plan_counts(
    chosen: DataFrame, log: DataFrame | None = None
) -> DataFrame:
    """What a run touches; without a log, the dry-run numbers."""
    marks = chosen.select("label", "silent", "dark", "benign").withColumn(
        "action", F.lit(None).cast("string")
    )
    if log is not None:
        marks = marks.unionByName(log.select("action"), allowMissingColumns=True)
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0)).alias
    return marks.agg(
        n(F.col("label"))("positives"),
        n(~F.col("label"))("negatives"),
        n(F.col("silent"))("silenced"),
        n(F.col("dark"))("darkened"),
        n(F.col("benign"))("benign_triggered"),
        n(F.col("action") == "delete")("rows_deleted"),
        n(F.col("action") == "insert")("rows_inserted"),
    )


def apply(
    cases: DataFrame, events: DataFrame, run_id: str, shares: Shares | None = None,
    seed: int = 7, earlier_log: DataFrame | None = None, force: bool = False,
) -> Change:
    """Strip and inject. A second run on changed events is refused unless forced,
    and a forced run first undoes the earlier one."""
    shares = shares or Shares()
    if earlier_log is not None and earlier_log.head() is not None:
        if not force:
            raise RuntimeError("already applied; undo it first, or force")
        events = undo(events, earlier_log)
    chosen = chosen_cases(cases, shares, seed)
    deleted = doomed_events(events, chosen, shares)
    inserted = explained_events(events, chosen, seed)
    removed = deleted.select(*KEY, "case_ordinal")
    changed = events.join(removed, [*KEY, "case_ordinal"], "left_anti").unionByName(inserted)
    log = change_log(deleted, inserted, run_id)
    return Change(changed, log, plan_counts(chosen, log))


def undo(events: DataFrame, log: DataFrame) -> DataFrame:
    """The events as they were: injected rows out, deleted rows back."""
    restored = (
        log.where(F.col("action") == "delete")
        .select(
            F.from_json("row_json", EVENTS, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
            .alias("row")
        )
        .select("row.*")
    )
    kept = events.where(~F.coalesce(F.col("event_id"), F.lit("")).startswith(MARK))
    return kept.unionByName(restored.select(*events.columns))
