"""How the raw tables are read at size."""

from flightlens import fixtures


def test_large_flights_are_joined_without_a_sort(spark, rows, tmp_path, monkeypatch):
    """Both tables were sorted whole in each task."""
    lines = rows("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string", *[(None if k == 5 else k % 7, k, k % 3, 1 + k % 4, float(k), "ARN"[k % 3]) for k in range(40)])
    orders = rows("o_orderkey long, o_orderpriority string, o_orderdate timestamp_ntz", *[(k, "1-URGENT", None) for k in (0, 1, 2, 2, 3, 9, None)])
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    plain = fixtures.load(spark, str(tmp_path), "fx_flights")
    monkeypatch.setattr(fixtures, "HASHED_BYTES", 0)
    flights = fixtures.load(spark, str(tmp_path), "fx_flights")
    plan = flights._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "Sort " not in plan
    assert plain.count() == flights.count() == 30 and plain.exceptAll(flights).count() == 0
