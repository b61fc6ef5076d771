"""Trigger coverage kept up to date: only buckets of cases that a commit touched are counted again.

Counts lie beside the store, per bucket, with a version: the parts of cases and events that they were made from. A
bucket whose parts are still those keeps its counts; the others are read, counted and written anew. Counts add up
over buckets, so rates follow from them without another look at a case. Two refreshers at once do no harm: what one
overwrites has another version or the same counts.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.functions import fixed_values as fixed
from tracewell.operators.timeline import trigger_features
from tracewell.operators.trust import coverage_counts, coverage_rates
from tracewell.session import materialize
from tracewell.sources.commit_log import State
from tracewell.sources.store import PLACE, CaseStore

COUNTS = ["cases", "known", "hits"]
BASES = ["total", "labelled", "positives"]


@dataclass
class Kept:
    """Rates over all sources, and how many buckets were counted anew for them."""
    coverage: DataFrame
    counted: int
    live: int


def versions(state: State, anchor: str, meanings: dict) -> dict[str, str]:
    """What each bucket with cases is made of: folder to version."""
    cases, events = (state.tables.get(t, {}) for t in ("cases", "events"))
    made_of = lambda f: json.dumps([sorted(cases[f]), sorted(events.get(f, [])), anchor, sorted(meanings)])
    return {f: hashlib.sha1(made_of(f).encode()).hexdigest() for f in cases}


def kept_coverage(store: CaseStore, anchor: str = "procedure", meanings: dict = fixed.TRIGGER_MEANINGS) -> Kept:
    """Coverage of the stored cases as operators.trust.trigger_coverage gives it."""
    state = store.log.state()
    wanted = versions(state, anchor, meanings)
    rows = [(*f.rsplit("/", 1), v) for f, v in wanted.items()]
    live = F.broadcast(store.spark.createDataFrame(rows, "source string, bucket string, version string")
                       .withColumn("bucket", F.col("bucket").cast("int")))
    kept = store.read("coverage").join(live, [*PLACE, "version"], "left_semi")
    known = {f"{r['source']}/{r['bucket']}" for r in kept.select(*PLACE).distinct().collect()}
    stale = set(wanted) - known
    if stale:
        cases = store.placed(store.read_folders("cases", state, stale))
        features = trigger_features(store.read_folders("events", state, stale), cases, anchor)
        fresh = coverage_counts(features, cases, list(meanings), *PLACE).join(live, PLACE)
        kept = materialize(kept.unionByName(fresh.select(*kept.columns)), "coverage")
        # at most sources times buckets times triggers rows
        store.write("coverage", kept.coalesce(1), full=True)
    total = kept.groupBy("trigger").agg(*[F.sum(c).alias(c) for c in (*BASES, *COUNTS)])
    return Kept(coverage_rates(total, meanings), len(stale), len(wanted))
