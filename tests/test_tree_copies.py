"""Trees made from few suppliers: dealt to tasks, texts made once; line counts by the plain rule."""

import re

import pytest
from pyspark.sql import functions as F

from quarrymeter.functions import text
from quarrymeter.plans import catalog, fixtures, repo_catalog  # noqa: F401

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trees_are_dealt_to_several_tasks(spark):
    assert fixtures.tree(spark, SF).rdd.getNumPartitions() >= 3


@pytest.mark.parametrize("name", ["size_distribution", "class_terms"])
def test_texts_are_not_made_again_by_filters(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    made = [line for line in plan.splitlines() if "repeat(" in line]
    assert made and all("Generate explode" in line for line in made)
    assert all(line.count("repeat(") == 1 for line in made)


def test_lines_of_odd_texts(spark):
    rows = ["", " ", "\r", "\r\n\r\n", "a\r\r\nb", " \t\n\x0b\n\x0c x\n \n", "a b\rc", "x\n" * 30, "\n" * 30, " y z\n", "é \r\n è", "  a  \n\n  b", "\n\r"]
    df = spark.createDataFrame([(r,) for r in rows], "x string").coalesce(1)
    for cap in (3, 20, 10_000):
        want = []
        for r in rows:
            lines = re.split(r"\r\n|\r|\n", r)
            want.append(cap if len(lines) >= cap else sum(bool(re.search(r"[^ \t\n\x0b\f\r]", x)) for x in lines))
        assert [r[0] for r in df.select(text.line_count(F.col("x"), cap)).collect()] == want
