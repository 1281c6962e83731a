"""Queries that a local master would let pass: executors in processes of their own."""

import os
import subprocess
import sys
import textwrap

from millrace.sources import readers, writers


def test_database_tables_on_a_cluster(sf, tmp_path):
    """The database has to be seen by every executor, not by the driver alone."""
    script = textwrap.dedent(f"""
        from millrace.plans import registry
        from millrace.session import build_session

        spark = build_session(master="local-cluster[2,1,1024]", **{{"spark.checkpoint.dir": "file://{tmp_path}/shared", "spark.executor.memory": "600m"}})
        rows = registry.load()[0]["database_tables"](spark, "{sf}").collect()
        nation, region = (spark.read.parquet(f"{sf}/{{n}}.parquet") for n in ("nation", "region"))
        want = nation.where("n_nationkey % 2 = 0").join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name")
        assert sorted(map(tuple, rows)) == sorted(map(tuple, want.collect())) and rows
        spark.stop()
    """)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))} | {"PYTHONPATH": root}
    done = subprocess.run([sys.executable, "-c", script], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]


def test_derby_archive_keeps_odd_values(spark, tmp_path):
    rows = spark.sql("""SELECT id AS k, CASE id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'a"b'',c' WHEN 2 THEN '' ELSE 'é\\nz' END AS s,
        nullif(id, 2) * 5000000000 AS big, id / 3D AS f, id = 1 AS yes, timestamp_seconds(id * 100000) AS at, CAST(id AS DECIMAL(9, 2)) AS d FROM range(2005)""")
    url = writers.derby_archive({"odd": rows, "nothing": rows.where("k < 0")}, f"{tmp_path}/odd.jar")
    got = readers.jdbc_tables(spark, url, ["odd", "nothing"])
    assert sorted(map(tuple, got["odd"].collect()), key=str) == sorted(map(tuple, rows.collect()), key=str)
    assert got["nothing"].count() == 0 and got["nothing"].columns == rows.columns
