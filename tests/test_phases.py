"""Phases of projects are joined a project at a time."""

from quarrymeter.operators import machine


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_phases_are_joined_by_project(spark):
    projects = spark.createDataFrame([("r", f"p{i:02}", "go", 100 - i) for i in range(10)], "repo string, project string, ecosystem string, weight long")
    records = spark.createDataFrame([("r", "p00", "resolve", "passed", None, 10), ("r", "p00", "resolve", "failed", "repository", 40), ("r", "p00", "odd", "failed", "runner", 900)], "repo string, project string, phase string, outcome string, attribution string, seconds long")
    out = machine.run_phases(projects, records, machine.plan_table(spark))
    assert plan_of(out).count("posexplode") == 1
    got = {(r.project, r.phase): (r.status, r.owner, r.seconds) for r in out.collect()}
    assert len(got) == 50
    assert got["p00", "resolve"] == ("failed", "repository", 40)
    assert got["p00", "build"] == ("blocked", "repository", 0)
    assert got["p01", "build"][0] == "not_recorded" and got["p09", "test"][0] == "skipped_budget"
