"""Values mapped by tables: as by literal maps, under every policy, with frequent values and without a broadcast."""

import pytest

from millrace.operators import joins, pipeline
from millrace.plans.mapping import ConfigurationError, Mapping, Step, check

PAIRS = {"A": "1", "a": "2", "Yes": "y", "No ": "n", "b c": "3"}
VALUES = ["A", " a ", "YES", "no", "B C", "zz", "", " ", None] + ["yes"] * 200


@pytest.mark.parametrize("few", [joins.FEW_VALUES, 0])
@pytest.mark.parametrize("more", [{}, {"case_insensitive": False}, {"passthrough_unknown": True}])
@pytest.mark.parametrize("policy", ["error", "use_default"])
def test_a_table_maps_as_a_literal_map_does(spark, monkeypatch, few, more, policy):
    monkeypatch.setattr(pipeline, "look_up", lambda *a: joins.look_up(*a, few=few))
    df = spark.createDataFrame([(i, v, "x") for i, v in enumerate(VALUES)], "n int, v string, value string").repartition(3)
    walk = spark.createDataFrame(list(PAIRS.items()) + [(None, "q")], "source_value string, target_value string")
    steps = lambda p: (Step("trim", {}), Step("map_values", p | more))
    got, want = (
        pipeline.pipeline_columns(df, [Mapping("t", "f", ("v",), steps(p), policy=policy, default="d")], True, {"v": "v"}, {"w": walk}).select("n", "v", "value", "_p0").orderBy("n").collect()
        for p in ({"crosswalk": "w"}, {"mapping": PAIRS})
    )
    assert got == want and len(got) == len(VALUES)


def test_crosswalks_given_twice_and_missing(spark):
    df = spark.createDataFrame([("k",), ("K",)], "v string")
    walk = spark.createDataFrame([("k", "2"), ("k", "1"), ("K", "9")], "source_value string, target_value string")
    got = joins.look_up(df, df["v"], walk, True, "t").collect()
    assert sorted(map(tuple, got)) == [("K", "9"), ("k", "1")]
    assert joins.look_up(df, df["v"], walk.limit(0), True, "t").where("t is null").count() == 2
    m = Mapping("t", "f", ("v",), (Step("map_values", {"crosswalk": "w"}),))
    assert check(m, None, ["v"]) == [] and check(Mapping("t", "f", ("v",), (Step("map_values", {}),)), None, ["v"])
    with pytest.raises(ConfigurationError):
        pipeline.pipeline_columns(df, [m], False, {"v": "v"})
