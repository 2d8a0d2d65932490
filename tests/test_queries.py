"""Every registered query of the engine against its SQL, and the contract of the entry module without the folder llm."""

from __future__ import annotations

import subprocess
import sys

import pytest

from millrace.plans import ORACLE_SQL, QUERIES

from .compare import oracle, spark_rows


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == oracle(sf_dir, ORACLE_SQL[name])


def test_entry_imports_without_the_optional_folder(tmp_path):
    import shutil

    from .conftest import ROOT

    shutil.copytree(ROOT / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)})


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(5).count() == 5


def shuffled(df) -> int:
    """Rows that the exchanges of a frame wrote when it was collected."""

    def walk(node) -> int:
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        below, here = node.children(), node.metrics().get("shuffleRecordsWritten")
        return (here.get().value() if here.isDefined() else 0) + sum(walk(below.apply(i)) for i in range(below.size()))

    return walk(df._jdf.queryExecution().executedPlan())


def test_slot_hopping_shuffles_plays_and_not_their_windows(spark, sf_dir):
    df = QUERIES["slot_hopping"](spark, sf_dir)
    df.collect()
    plays = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert plays <= shuffled(df) <= 1.3 * plays


def test_slot_hopping_matches_sql_on_ties_nulls_and_block_borders(spark, tmp_path):
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    put = lambda df, t: pq.write_table(df.toArrow(), str(tmp_path / f"{t}.parquet"))
    put(spark.createDataFrame([(1, " a "), (2, "A"), (3, "b")], "n_nationkey int, n_name string"), "nation")
    put(spark.createDataFrame([(i, i % 3 + 1) for i in range(9)], "s_suppkey long, s_nationkey int"), "supplier")
    # few sessions, so that plays of one meet in panes and windows, at every distance from a block's border; the earliest are before 1970
    rows = spark.range(3000).select(
        (F.col("id") % 40).alias("l_orderkey"), F.col("id").alias("l_partkey"), (F.col("id") % 9).alias("l_suppkey"), (F.col("id") * 7 % 1500).cast("int").alias("l_linenumber"),
        F.when(F.col("id") % 7 != 0, F.col("id") % 1000 + 0.25).alias("l_extendedprice"), F.when(F.col("id") % 5 != 0, F.col("id") % 10 / 100).alias("l_discount"), F.when(F.col("id") % 11 != 0, F.lit(0.03)).alias("l_tax"),
        F.expr("timestamp_ntz'1969-12-31 12:00:00' + make_dt_interval(cast(id % 2 as int), 0, 0, 0.5 * (id % 3))").alias("l_shipdate"))
    rows = rows.unionAll(rows.limit(50)).unionAll(rows.where("l_partkey % 7 = 0").withColumn("l_shipdate", F.expr("timestamp_ntz'1996-02-29 23:59:59.999999'")))
    put(rows, "lineitem")
    names, got = spark_rows(QUERIES["slot_hopping"](spark, str(tmp_path)))
    assert (names, got) == oracle(str(tmp_path), ORACLE_SQL["slot_hopping"])
    assert len(got) > 1000 and any(None in r for r in got)
