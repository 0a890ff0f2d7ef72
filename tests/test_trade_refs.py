from pyspark.sql import functions as F

from waymark.sources import tables


def test_a_task_joins_a_bounded_number_of_lines(spark, monkeypatch):
    monkeypatch.setattr(tables, "LINES", 1000, raising=False)
    for sf, lines in (("sf0.001", 6_000), ("sf0.01", 60_000)):
        refs = tables.trade_refs(spark, f"/root/testdata/{sf}")
        counts = [r["count"] for r in refs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(counts) == tables.table(spark, f"/root/testdata/{sf}", "lineitem").count() > 0.9 * lines and max(counts) < 3000, counts
