"""Connected components: what a round costs, and components of components in near-duplicates."""

import random

from letterloom.llm import neardup
from letterloom.llm.components import components

HELD = {"spark.sql.shuffle.partitions": "20", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_steps_of_a_round_share_one_distinct(spark):
    """Tasks, not time: 442 with 20 partitions when each step was made distinct by itself, 304 since."""
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    edges = spark.createDataFrame([(100 * s, 100 * s + k) for s in range(4) for k in range(1, 30)] + [(129, 201)], "a long, b long").coalesce(1)
    old = {k: spark.conf.get(k) for k in HELD}
    try:
        for k, v in HELD.items():
            spark.conf.set(k, v)
        sc.setJobGroup("components", "components")
        got = {r["node"]: r["root"] for r in components(edges).collect()}
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == {100 * s + k: {0: 0, 1: 100, 2: 100, 3: 300}[s] for s in range(4) for k in range(30)}
    stages = {s for j in tracker.getJobIdsForGroup("components") for s in tracker.getJobInfo(j).stageIds}
    tasks = sum(i.numCompletedTasks for i in map(tracker.getStageInfo, stages) if i)
    assert tasks < 360


def test_stars_joined_across_are_one_component_with_the_smallest_id(spark):
    """A chain of texts, each near the next only, with copies: ids fall along it, so roots change when components are joined."""
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**9)}" for _ in range(1600)]
    rows = [(1000 - k, " ".join(words[20 * k:20 * k + 300])) for k in range(30)] + [(5000 + k, " ".join(words[20 * k:20 * k + 300])) for k in range(30)]
    rows += [(1, " ".join(f"v{k}" for k in range(300))), (2, " ".join(f"v{k}" for k in range(290)))]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: 1 if i < 3 else 971 for i, _ in rows}
