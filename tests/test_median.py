"""The upper median against brute force, and no task that holds a key."""

from waynet.operators import raster


def test_upper_median_of_keys_of_all_sizes(spark):
    rows = [("hot", float(k % 701 - 3)) for k in range(5000)] + [("one", 4.5), ("none", 0.0), ("two", 1.0), ("two", 2.0), (None, 7.0), (None, 9.0), (None, 8.0)]
    expected = {}
    for key in {k for k, _ in rows}:
        values = sorted(v for k, v in rows if k == key and v > 0)
        if values:
            expected[key] = values[len(values) // 2]
    found = raster.upper_median(spark.createDataFrame(rows, "dataset string, heat double"), "dataset", "heat")
    assert dict(map(tuple, found.collect())) == expected


def test_upper_median_ranks_no_key_in_one_window(spark):
    rows = spark.range(100).selectExpr("'hot' AS dataset", "CAST(id + 1 AS double) AS heat")
    plan = raster.upper_median(rows, "dataset", "heat")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(dataset" not in plan
