"""Pins of upstream packages: values of made cases, and that what grows with the packages is not broadcast."""

from docgraph.operators import packages
from docgraph.plans import registry


def test_pins_of_made_packages(spark):
    modules = spark.createDataFrame([(0, 0), (1, 1), (2, 5), (3, 5), (4, 6)], "module int, package int")
    ranks = spark.createDataFrame([(0, 0), (1, 1), (5, 2), (6, 2)], "package int, rank int")
    deps = spark.createDataFrame([(3, 2), (4, 3), (4, 99)], "module int, dep int")
    scopes = packages.module_scopes(modules, deps, ranks)
    assert sorted(map(tuple, scopes.collect())) == [(0, 0), (1, 0), (1, 1), (2, 0), (2, 1), (2, 2), (3, 0), (3, 1), (3, 2), (3, 3), (4, 0), (4, 1), (4, 3), (4, 4)]
    pairs = packages.upstream_packages(scopes, modules)
    wanted = spark.createDataFrame([(5, 0, "m"), (6, 5, "m"), (6, 1, "gone"), (7, 1, "m")], "package int, dep int, mask string")
    index = spark.createDataFrame([(0, None, 9), (0, "m", 4), (5, None, 8), (5, "m", 3), (1, None, 7)], "package int, mask string, ver int")
    got = packages.upstream_pins(pairs, wanted, index)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 9), (5, 0, 4), (5, 1, 7), (6, 0, 9), (6, 1, 7), (6, 5, 3)]


def test_no_version_is_broadcast(spark, sf_dir):
    """Spark takes the versions of all packages for as small as the suppliers' file; at 360,000 suppliers they are 25 million."""
    plan = registry.QUERIES["upstream_pins"](spark, sf_dir)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
