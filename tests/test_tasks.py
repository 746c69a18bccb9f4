"""Results of large tables are dealt over more tasks, with the same rows."""

import pytest

from matchlake.plans import careers, reviews, view

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("queries, name", [(careers.Q, "a13_match_summary"), (careers.Q, "g3_player_matches"), (reviews.Q, "g28_strategy_rows"), (reviews.Q, "g29_squad_strategy")])
def test_tasks_grow_with_the_files(spark, monkeypatch, queries, name):
    assert view.tasks(spark, SF) is None
    want = sorted(map(repr, queries[name](spark, SF).collect()))
    monkeypatch.setattr(view, "TASK_BYTES", 10_000)
    n = view.tasks(spark, SF)
    assert 10 < n < 20
    got = queries[name](spark, SF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert f", {n}), REPARTITION_BY_NUM" in plan
    # what joins and sorts whole results is dealt by number, so that no adaptive coalescing makes larger tasks of it
    assert name == "g3_player_matches" or name == "g29_squad_strategy" or "ENSURE_REQUIREMENTS" not in plan.replace("SinglePartition, ENSURE", "")
    assert sorted(map(repr, got.collect())) == want
