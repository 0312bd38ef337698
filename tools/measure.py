"""Seconds and Spark jobs of our plans against the step-by-step forms they replace.

The step-by-step forms are what one writes with an action per column, month or
value. Folder from $BENCH_SF_DIR; prints a Markdown table.
"""

from __future__ import annotations

import os
import sys
import time
from datetime import date

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casewatch.operators import counts as N, filters as P, quality as Q, stays as S, upsert as U  # noqa: E402
from casewatch.operators import vaccination as V  # noqa: E402
from casewatch.plans import report as Rep  # noqa: E402
from casewatch.plans.fixtures import AS_OF, load, load_cases  # noqa: E402
from casewatch.plans.registry.indicators import bed_features, feature_cases  # noqa: E402
from casewatch.plans.registry.tables import order_batch  # noqa: E402
from casewatch.session import build_session  # noqa: E402


def profile_by_column(df):
    for name, kind in df.dtypes:
        df.filter(F.col(name).isNull()).count()
        df.select(name).distinct().count()
        df.groupBy(name).count().orderBy(F.desc("count")).limit(50).collect()
        if kind not in ("string",):
            df.agg(F.min(name), F.max(name)).collect()


def overlap_by_month(cases, first: date, last: date):
    month = first
    while month <= last:
        after = date(month.year + month.month // 12, month.month % 12 + 1, 1)
        end = date.fromordinal(after.toordinal() - 1)
        cases.filter(P.stays_overlapping("icu_in", "icu_out", month, end)).count()
        month = after


def report_by_value(cases, beds):
    known = Rep.known_by(cases, AS_OF)
    known.agg(F.max("notified_on")).collect()
    N.cases_per_day(known).collect()
    N.cases_per_month(known, AS_OF).collect()
    S.icu_occupancy_by_state(known, beds).collect()
    N.variation_rate(known, AS_OF).collect()
    for _ in range(3):
        S.icu_admission_rate(known).collect()
    V.vaccination_rate(known).collect()


def upsert_then_count(target, source):
    merged = U.upsert(target, source, ["o_orderkey"])
    before, after = target.count(), merged.count()
    return before, after, after - before


def cases_of(spark, sf_dir):
    lines = load(spark, sf_dir, "lineitem")
    start, first = date(1995, 1, 1), date(2001, 7, 1)
    cases = load_cases(spark, sf_dir)
    features, beds = feature_cases(spark, sf_dir, True), bed_features(spark, sf_dir)
    target, source = order_batch(spark, sf_dir)
    return {
        "profile, 11 columns": (lambda: Q.profile(lines).collect(), lambda: profile_by_column(lines)),
        "overlap, 79 months": (
            lambda: S.overlap_count(cases, start, AS_OF).collect(),
            lambda: overlap_by_month(cases, start, first),
        ),
        "merge audit": (
            lambda: U.upsert_audit(target, source, ["o_orderkey"]).collect(),
            lambda: upsert_then_count(target, source),
        ),
        "report values": (
            lambda: Rep.report_metrics(features, beds, AS_OF).collect(),
            lambda: report_by_value(features, beds),
        ),
    }


def timed(spark, action, label):
    best, jobs = None, 0
    for run in range(3):
        group = f"{label}-{run}"
        spark.sparkContext.setJobGroup(group, label)
        started = time.perf_counter()
        action()
        seconds = time.perf_counter() - started
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        best = seconds if best is None else min(best, seconds)
    return best, jobs


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("measure")
    spark.sparkContext.setLogLevel("ERROR")
    print("| work | ours, s | jobs | step by step, s | jobs |\n|---|---|---|---|---|")
    for label, (ours, steps) in cases_of(spark, sf_dir).items():
        a, b = timed(spark, ours, label + " ours"), timed(spark, steps, label + " steps")
        print(f"| {label} | {a[0]:.2f} | {a[1]} | {b[0]:.2f} | {b[1]} |", flush=True)


if __name__ == "__main__":
    main()
