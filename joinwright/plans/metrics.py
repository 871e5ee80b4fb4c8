"""Where a query's time goes, from Spark's own metrics: phases of its operators, and how evenly its tasks ran."""

from __future__ import annotations

import statistics
import time
import uuid
from collections import defaultdict
from collections.abc import Iterator

from py4j.java_gateway import JavaObject
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import join_pairs, join_summary

# Which metric of which operator makes up a phase; Spark gives these in milliseconds, or in nanoseconds where marked so.
PHASES = {
    "build": (("ShuffledHashJoin", "buildTime"), ("BroadcastExchange", "buildTime")),
    "collect": (("BroadcastExchange", "collectTime"),),
    "broadcast": (("BroadcastExchange", "broadcastTime"),),
    "sort": (("Sort", "sortTime"),),
    "shuffle_write": (("Exchange", "shuffleWriteTime"),),
    "shuffle_wait": (("Exchange", "fetchWaitTime"),),
    "pipelines": (("WholeStageCodegen", "pipelineTime"),),
}
NANOSECONDS = {"shuffleWriteTime"}


def _nodes(plan: JavaObject) -> Iterator[JavaObject]:
    """All operators of a plan that has run, inside adaptive stages too."""
    yield plan
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from _nodes(plan.executedPlan())
        return
    if kind.endswith("QueryStageExec"):
        yield from _nodes(plan.plan())
        return
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def phases(df: DataFrame) -> dict[str, float]:
    """Seconds of each phase, summed over tasks, of a DataFrame that was collected through this object; a reused stage counts once."""
    found: dict[str, float] = defaultdict(float)
    seen = set()
    for node in _nodes(df._jdf.queryExecution().executedPlan()):
        name = node.nodeName().split(" ")[0]
        metrics = node.metrics()
        for phase, sources in PHASES.items():
            for operator, metric in sources:
                if name == operator and metrics.contains(metric):
                    m = metrics.apply(metric)
                    if m.id() not in seen:
                        seen.add(m.id())
                        found[phase] += max(m.value(), 0) / (1e9 if metric in NANOSECONDS else 1e3)
    return dict(found)


def task_skew(spark: SparkSession, group: str) -> float:
    """The longest task's run time over the median task's, in the stage of a job group where that is greatest; 1 if no stage has two tasks."""
    context, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    tracker, worst = context.statusTracker(), 1.0
    for stage in {k for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for k in info.stageIds}:
        tasks = store.taskList(stage, 0, 10_000)
        each = [tasks.apply(i).taskMetrics() for i in range(tasks.size())]
        took = [m.get().executorRunTime() for m in each if m.isDefined()]
        if len(took) > 1:
            worst = max(worst, max(took) / max(statistics.median(took), 1))
    return worst


def measured(df: DataFrame) -> dict:
    """Runs df (a result of few rows) and returns its rows, wall seconds, phases and task skew."""
    spark, group = df.sparkSession, f"measured-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "measured")
    try:
        t = time.perf_counter()
        rows = [tuple(r) for r in df.collect()]
        seconds = time.perf_counter() - t
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return {"rows": rows, "seconds": seconds, "phases": phases(df), "task_skew": task_skew(spark, group)}


def retrieval(r: DataFrame, s: DataFrame, how: str) -> dict:
    """Seconds of a late-materialising strategy: of the join index alone, of all, and what fetching the rows adds."""
    index = measured(join_pairs(r, s, how).agg(F.count("*"), F.bit_xor("s_row_id")))
    whole = measured(join_summary(r, s, how))
    return {"index": index["seconds"], "total": whole["seconds"], "retrieve": max(whole["seconds"] - index["seconds"], 0.0), "rows": whole["rows"]}
