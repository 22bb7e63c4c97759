"""Waves of graphs with cycles, missing tasks, long chains and none at all."""

from __future__ import annotations

import random

from tidemark.operators.waves import waves

TASKS, NEEDS = "g string, task long", "g string, task long, need long"


def plain(tasks: set, needs: set) -> dict:
    done: dict = {}
    while True:
        fresh = {t: max((done[g, n] + 1 for g, u, n in needs if (g, u) == t), default=0) for t in tasks - set(done) for g in (t[0],) if all((g, n) in done for h, u, n in needs if (h, u) == t)}
        if not fresh:
            return {t: done.get(t) for t in tasks}
        done |= fresh


def found(spark, tasks, needs):
    got = waves(spark.createDataFrame(sorted(tasks), TASKS), spark.createDataFrame(sorted(needs), NEEDS), ["g"]).collect()
    assert all((r.status == "ok") == (r.wave is not None) for r in got) and len(got) == len(tasks)
    return {(r.g, r.task): r.wave for r in got}


def test_random_graphs_with_cycles_and_missing_tasks(spark):
    draw = random.Random(1)
    tasks = {(f"g{k}", i) for k in range(12) for i in range(9)}
    needs = {(f"g{k}", i, j) for k in range(12) for i in range(9) for j in range(-1 if k == 3 else 0, 9) if (j < i or k % 4 == 1) and draw.random() < 0.15}
    got = found(spark, tasks, needs)
    assert got == plain(tasks, needs) and None in got.values()


def test_chain_self_need_and_rows_without_task(spark):
    tasks = {("c", i) for i in range(40)} | {("s", 1), ("s", 2), ("e", 1)}
    needs = {("c", i, i - 1) for i in range(1, 40)} | {("s", 1, 1), ("s", 2, 1), ("x", 5, 6)}
    got = found(spark, tasks, needs)
    assert got == {("c", i): i for i in range(40)} | {("s", 1): None, ("s", 2): None, ("e", 1): 0}


def test_no_tasks(spark):
    assert waves(spark.createDataFrame([], TASKS), spark.createDataFrame([], NEEDS), ["g"]).count() == 0
