"""Both ways to gather a unit's forms, and how many rows they shuffle."""

import random

import pytest
from pyspark.sql import functions as F

from ballotlake.operators.consensus import SCALARS, _gathered, consensus

from .test_collation import FORM, form

FULL = FORM + ", presiding_officer_signed boolean, agent_signatures long"


def forms_of(draw, n, units):
    rows = []
    for i in range(n):
        kind = draw.choice(["party_agent", "party_agent", "observer", "official", "other", None])
        votes = {p: draw.choice([0, 3, 3, 3, 4, None]) for p in draw.sample("ABC", draw.randint(0, 3))}
        whole = form(i, draw.randrange(units) or None, kind, {p: v or 0 for p, v in votes.items()}, draw.choice([None, "P", "Q"]), draw.random() > 0.1, draw.randrange(5))
        rows.append((*whole[:7], None if draw.random() < 0.1 else votes, draw.choice([100, 100, None]), *whole[9:], draw.choice([True, True, False, None]), draw.choice([1, 2, None])))
    return rows


@pytest.mark.parametrize("tolerance", [0, 1])
def test_gathered_and_merged_units_give_the_same(spark, tolerance):
    forms = spark.createDataFrame(forms_of(random.Random(4), 700, 180), FULL)
    found = [sorted(str(r) for r in consensus(forms, tolerance=tolerance, gathered=most).collect()) for most in (10**6, 3, 0)]
    assert len(found[0]) > 150 and found[0] == found[1] == found[2]


def records(spark):
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_a_form_is_shuffled_once_or_twice(spark):
    n = 2_000
    forms = spark.createDataFrame([form(i, i // 4, "observer", {"A": i % 3, "B": 2, "C": 1}) for i in range(n)], FORM)
    before = records(spark)
    assert len(consensus(forms).collect()) == n // 4
    assert records(spark) - before <= 3 * n


def test_values_are_sorted_without_a_comparator(spark):
    """A comparator is evaluated for each comparison; with a structure for each value it took most of the consensus' time."""
    forms = spark.createDataFrame([form(i, i // 4, "observer", {"A": i % 3, "B": 2}) for i in range(8)], FORM).withColumn("own", F.lit(True))
    units = _gathered(forms, [f for f in SCALARS if f in forms.columns])
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    assert "sort_array" in plan and "lambda left" not in plan
    assert {r.pu: (r.gap.valid, [(v.name, v.gap, v.median) for v in r.voted]) for r in units.collect()}[0][1] == [("A", 2, 1), ("B", 0, 2)]
