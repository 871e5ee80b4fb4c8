import datetime
import os
import sys

import pytest
from pyspark.sql import functions as F

from joinwright.functions import brand_number, next_pow_2, wrap64_add, wrap64_sum
from joinwright.operators import STRATEGIES, first_per_key, join_pairs, join_summary, max_partition, partition_by_radix, salted_join, split_join, strategy
from joinwright.plans import registry, workloads
from joinwright.plans.tpch import q14, q19
from joinwright.sources import LINEITEM, PART, read_fixed, read_tbl, write_fixed, write_tbl

REL = "key bigint, row_id bigint"


def rel(spark, *rows):
    return spark.createDataFrame(list(rows), REL)


def test_registry_has_every_name():
    assert len(STRATEGIES) == 51 + 3
    with pytest.raises(ValueError):
        strategy("no_such")


def test_all_strategies_agree(spark):
    r, s = workloads.generate(spark, workloads.Workload("uniform", 64, 256, width=32))
    for name in ("nphj_sc", "phj_radix_bc", "phj_asymm_radix_hr", "ptr_nphj_sc", "ptr_phj_radix_bw_reg_lp", "nphj_lp", "merge"):
        got = join_summary(r, s, name).first()
        assert (got.matched_cnt, got.check_sum) == (256, 4 * 64 * 65 // 2 + 256 * 257 // 2)


def test_broadcast_falls_back_beyond_its_limit(spark):
    r, s = rel(spark, (1, 1)), rel(spark, (1, 2))
    plan = join_pairs(r, s, "nphj_sc", broadcast_limit=0)._jdf.queryExecution().toString()
    assert "Broadcast" not in plan and "ShuffledHashJoin" in plan


@pytest.mark.parametrize("how", ["nphj_sc", "ptr_nphj_sc"])
def test_rows_of_compressed_files_are_counted_before_a_broadcast(spark, tmp_path, how):
    from joinwright.operators.joins import estimated_bytes

    spark.range(20_000).select((F.col("id") % 10).alias("key"), F.col("id").alias("row_id")).write.parquet(str(tmp_path / "r"))
    r, s = spark.read.parquet(str(tmp_path / "r")), rel(spark, (3, 7))
    limit = 1 << 20
    assert estimated_bytes(r) < limit
    assert "BroadcastHashJoin" not in join_pairs(r, s, how, broadcast_limit=limit)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in join_pairs(r, s, how)._jdf.queryExecution().executedPlan().toString()
    got = join_summary(r, s, how, broadcast_limit=limit).first()
    assert (got.matched_cnt, got.check_sum) == (2000, sum(range(3, 20_000, 10)) + 2000 * 7)


def test_large_sides_are_merged_and_rows_fetched_without_a_broadcast(spark, monkeypatch):
    from joinwright.operators import joins, late_materialised_join

    r, s = rel(spark, *((k % 50, k) for k in range(500))), rel(spark, (3, 7))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    rows = late_materialised_join(r, s)
    assert "BroadcastHashJoin" not in plan(rows) and rows.count() == 10
    monkeypatch.setattr(joins, "HASH_LIMIT", 400 * joins.TABLE_ROW)
    merged = join_summary(r, s, "ptr_nphj_sc", broadcast_limit=0)
    assert not {x for x in ("BroadcastHashJoin", "ShuffledHashJoin") if x in plan(merged)}
    assert merged.first()[:] == (10, sum(range(3, 500, 50)) + 10 * 7)


@pytest.mark.parametrize("how", ["broadcast", "shuffle_hash", "merge", "phj_radix_lp", "ptr_phj_radix_bc"])
def test_edges(spark, how):
    none = spark.createDataFrame([], REL)
    some = rel(spark, (0, 1), (None, 2), (5, 3))
    assert join_summary(none, some, how).first()[:] == (0, 0)
    assert join_summary(some, none, how).first()[:] == (0, 0)
    assert join_summary(some, rel(spark, (7, 1)), how).first()[:] == (0, 0)
    got = join_summary(some, rel(spark, (0, 10), (None, 11)), how).first()
    assert (got.matched_cnt, got.check_sum) == (1, 11)


def test_multiplicity(spark):
    r = rel(spark, (1, 5), (1, 3), (2, 9))
    s = rel(spark, (1, 100), (1, 200))
    assert join_summary(r, s, "phj_radix_bc").first().matched_cnt == 4
    got = join_summary(r, s, "phj_radix_lp").first()
    assert (got.matched_cnt, got.check_sum) == (2, 306)
    assert sorted(map(tuple, first_per_key(r).collect())) == [(1, 3), (2, 9)]


def test_checksum_wraps(spark):
    big = (1 << 63) - 1
    got = spark.createDataFrame([(big, big)] * 3, "a bigint, b bigint").agg(wrap64_sum("a", "b").alias("c")).first().c
    assert got == (6 * big) % (1 << 64)


def test_addition_wraps(spark):
    values = [0, 1, -1, 5_000_000, (1 << 32) - 1, 1 << 32, registry.BIG, (1 << 63) - 1, -(1 << 63)]
    rows = [(a, b) for a in values for b in values]
    got = spark.createDataFrame([*rows, (None, 1)], "a bigint, b bigint").select("a", "b", wrap64_add(F.col("a"), F.col("b")).alias("c")).collect()
    assert all((r.c is None) if r.a is None else ((r.c - r.a - r.b) % (1 << 64) == 0) for r in got)


def test_wraparound_join_takes_ids_beyond_the_range(spark, tmp_path):
    ids = [1, 775_807, 775_808, 5_000_000]
    spark.createDataFrame([(i,) for i in ids], "c_custkey bigint").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(i + 1, i) for i in ids], "o_orderkey bigint, o_custkey bigint").write.parquet(str(tmp_path / "orders.parquet"))
    got = registry.QUERIES["join_wraparound"](spark, str(tmp_path)).first()
    assert tuple(got) == (4, sum(2 * i + 1 + 2 * registry.BIG for i in ids) % (1 << 64))


def test_checksum_leaves_out_rows_with_nulls(spark):
    assert spark.createDataFrame([(1, 2), (None, 5), (7, None)], "a bigint, b bigint").agg(wrap64_sum("a", "b").alias("c")).first().c == 3


def test_salted_join_broadcasts_hot_keys_alone(spark, monkeypatch):
    from joinwright.operators import skew

    r = spark.range(50).select(F.col("id").alias("key"), F.col("id").alias("row_id"))
    s = spark.range(5000).select((F.col("id") % 40).alias("key"), F.col("id").alias("row_id"))
    want = sorted(map(tuple, join_pairs(r, s).collect()))
    out = salted_join(r, s, salts=4, hot_rows=10)
    assert sorted(map(tuple, out.collect())) == want
    assert "BroadcastHashJoin" in out._jdf.queryExecution().toString()
    monkeypatch.setattr(skew, "HOT_KEYS", 3)
    assert sorted(map(tuple, salted_join(r, s, salts=4, hot_rows=10).collect())) == want


def test_radix_strategies_place_by_radix(spark):
    r, s = workloads.generate(spark, workloads.Workload("uniform", 64, 256))
    plans = [join_pairs(r, s, n)._jdf.queryExecution().executedPlan().toString() for n in ("phj_radix_bc", "phj_asymm_radix_bc")]
    assert all(p.count("Exchange shufflepartitionidpassthrough") == 2 and p.count("Exchange") == 2 for p in plans)
    assert "ShuffledHashJoin" in plans[0] and "SortMergeJoin" in plans[1]


def test_skew_joins(spark):
    r = spark.range(50).select(F.col("id").alias("key"), F.col("id").alias("row_id"))
    s = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 60).cast("bigint").alias("key"), F.col("id").alias("row_id"))
    want = sorted(map(tuple, join_pairs(r, s).collect()))
    assert sorted(map(tuple, salted_join(r, s, salts=4, hot_rows=100).collect())) == want
    assert sorted(map(tuple, split_join(r, s).collect())) == want


def test_radix_placement(spark):
    df = partition_by_radix(spark.range(100).select(F.col("id").alias("key")), "key", 3).withColumn("at", F.spark_partition_id())
    assert all(r.at == r.key % 8 for r in df.collect())
    assert max_partition(spark.range(100).select(F.col("id").alias("key")), "key", 3).first().max_n == 13


def test_workload_closed_forms(spark):
    W = workloads.Workload
    sums = lambda w: join_summary(*workloads.generate(spark, w)).first()
    for r in (1024, 4096, 16384):
        got = sums(W("uniform", r, 16384))
        assert (got.matched_cnt, got.check_sum) == (16384, (16384 // r) * r * (r + 1))
    assert sums(W("selectivity", 1024, 16384, selectivity=0.6)).matched_cnt == 16 * int(0.6 * 1024)
    assert sums(W("sparsity", 1024, 16384, sparsity=0.25)).matched_cnt == 16384
    w = W("duplicates", 1024, 16384)
    counts = [x["count"] for x in workloads.generate(spark, w)[0].groupBy("key").count().collect()]
    assert sums(w).matched_cnt == 16 * sum(c * c for c in counts)
    w = W("zipf", 1024, 16384, theta=1.25)
    assert sums(w).matched_cnt == 16384
    for theta in (1.05, 1.25, 1.5, 1.75):
        keys = workloads.generate(spark, W("zipf", 1024, 1 << 18, theta=theta))[1].groupBy("key").count().orderBy(F.desc("count")).limit(3).collect()
        total = workloads.zeta(1024, theta)
        for rank, x in enumerate(keys, 1):
            assert abs(x["count"] / (1 << 18) - rank**-theta / total) < 0.02 * rank**-theta / total + 0.001
    gray = workloads.generate(spark, W("zipf_gray", 1024, 1 << 16, theta=0.5))[1].groupBy("key").count().orderBy("key").collect()
    assert abs(gray[0]["count"] / (1 << 16) - 1 / workloads.zeta(1024, 0.5)) < 0.002 and max(x.key for x in gray) <= 1024
    with pytest.raises(ValueError):
        workloads.generate(spark, W("none", 1, 1))


def test_scalars(spark):
    got = spark.createDataFrame([(1, "Brand#12"), (5, "Brand#7"), (1024, "Brand#34")], "n bigint, b string").select(next_pow_2("n"), brand_number("b")).collect()
    assert [tuple(r) for r in got] == [(1, 12), (8, 7), (1024, 34)]


def test_q14_boundaries(spark):
    days = [(1, "1995-08-31"), (1, "1995-09-01"), (2, "1995-09-30"), (3, "1995-10-01"), (4, "1995-09-15")]
    lineitem = spark.createDataFrame([(k, 100.0, 0.1, datetime.datetime.fromisoformat(d)) for k, d in days], "l_partkey bigint, l_extendedprice double, l_discount double, l_shipdate timestamp_ntz")
    part = spark.createDataFrame([(1, "PROMO BRUSHED TIN"), (2, "STANDARD PROMO"), (3, "PROMO"), (4, "PROMO")], "p_partkey bigint, p_type string")
    got = q14(lineitem, part).first()
    assert (got.matched_cnt, got.numerator, got.denominator) == (3, 180.0, 270.0)


def test_q19_branches(spark):
    lines = [(k, q, m) for k in (1, 2, 3, 4) for q in (1.0, 10.0, 11.0, 20.0, 25.0, 30.0, 31.0) for m in ("AIR", "AIR REG", "REG AIR")]
    lineitem = spark.createDataFrame([(k, q, 100.0, 0.0, m, "DELIVER IN PERSON") for k, q, m in lines], "l_partkey bigint, l_quantity double, l_extendedprice double, l_discount double, l_shipmode string, l_shipinstruct string")
    part = spark.createDataFrame([(1, "Brand#12", 5, "SM BOX"), (2, "Brand#23", 10, "MED BAG"), (3, "Brand#34", 15, "LG PKG"), (4, "Brand#12", 6, "SM BOX")], "p_partkey bigint, p_brand string, p_size int, p_container string")
    want = sum(m != "REG AIR" and (k == 1 and 1 <= q <= 11 or k == 2 and 10 <= q <= 20 or k == 3 and 20 <= q <= 30) for k, q, m in lines)
    got = q19(lineitem, part).first()
    assert (got.matched_cnt, got.revenue) == (want, want * 100.0)


def test_tbl_round_trip(spark, tmp_path):
    part = spark.createDataFrame([(1, "a b", "m", "Brand#12", "PROMO", 3, "SM BOX", 1.5, "x")], PART)
    write_tbl(part, str(tmp_path / "p"))
    assert read_tbl(spark, str(tmp_path / "p"), PART).collect() == part.collect()
    (tmp_path / "l.tbl").write_text("1|2|3|4|5|6.5|0.1|0|N|O|1995-09-01|1995-09-02|1995-09-03|NONE|AIR|c|\n")
    assert read_tbl(spark, str(tmp_path / "l.tbl"), LINEITEM).first().l_shipdate == datetime.date(1995, 9, 1)


def test_fixed_round_trip(spark, tmp_path):
    r, _ = workloads.generate(spark, workloads.Workload("uniform", 100, 100, width=32))
    write_fixed(r.repartition(3), str(tmp_path / "r"), 32)
    assert len(os.listdir(tmp_path / "r")) == 3
    got = read_fixed(spark, str(tmp_path / "r"), 32)
    assert sorted((x.key, x.row_id, bytes(x.payload)) for x in got.collect()) == sorted((x.key, x.row_id, bytes(x.payload)) for x in r.collect())


def test_fixed_files_are_split_and_checked(spark, tmp_path):
    import numpy as np

    rows = np.zeros(300_000, [("key", "<u8"), ("row_id", "<u8"), ("payload", "V8")])
    rows["key"], rows["row_id"] = np.arange(300_000) * 3, np.arange(300_000)
    (tmp_path / "one.bin").write_bytes(rows.tobytes())
    spark.sparkContext._jsc.hadoopConfiguration().set("mapreduce.input.fileinputformat.split.maxsize", "1000000")
    got = read_fixed(spark, str(tmp_path / "one.bin"), 24)
    spark.sparkContext._jsc.hadoopConfiguration().unset("mapreduce.input.fileinputformat.split.maxsize")
    assert got.rdd.getNumPartitions() > 1
    assert tuple(got.agg(F.count("*"), F.sum("key"), F.sum("row_id"), F.max(F.length("payload"))).first()) == (300_000, 3 * 300_000 * 299_999 // 2, 300_000 * 299_999 // 2, 8)
    (tmp_path / "big.bin").write_bytes(b"\xff" * 16)
    with pytest.raises(Exception, match="2\\^63"):
        read_fixed(spark, str(tmp_path / "big.bin")).collect()
    with pytest.raises(Exception, match="null"):
        write_fixed(rel(spark, (1, None)), str(tmp_path / "n"))
    write_fixed(rel(spark), str(tmp_path / "none"))
    assert read_fixed(spark, str(tmp_path / "none")).count() == 0


def test_phases_and_task_skew(spark):
    from joinwright.plans.metrics import measured, retrieval

    r, s = workloads.generate(spark, workloads.Workload("uniform", 1024, 65536))
    plain = measured(join_summary(r, s, "phj_radix_bc"))
    assert plain["rows"][0][0] == 65536 and plain["seconds"] > 0 and plain["task_skew"] >= 1
    assert {"build", "shuffle_write"} <= plain["phases"].keys()
    assert "sort" in measured(join_summary(r, s, "merge"))["phases"]
    assert "broadcast" in measured(join_summary(r, s, "nphj_sc"))["phases"]
    unique = s.withColumn("row_id", F.monotonically_increasing_id())
    apart = retrieval(r, unique, "ptr_phj_radix_bc")
    assert apart["rows"][0][0] == 65536 and 0 < apart["index"] and apart["retrieve"] <= apart["total"]


def test_running_summary(spark, tmp_path):
    from joinwright.streaming import running_summary

    r, s = workloads.generate(spark, workloads.Workload("uniform", 16, 64))
    s.repartition(4).write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("key bigint, row_id bigint").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    q = running_summary(r, stream).writeStream.format("memory").queryName("running").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert tuple(spark.table("running").first()) == tuple(join_summary(r, s).first())


def test_entry_works_without_the_training_data_operators(monkeypatch):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    for name in [m for m in sys.modules if m.startswith("joinwright.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "joinwright.llm", None)  # as if it, or what it needs, were missing
    assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) == set(registry.SQL)
