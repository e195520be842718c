"""Results files of many parts."""

from pyspark.sql import functions as F

from blockloom import more_queries, queries
from blockloom.sources import logs


def test_a_results_folder_is_read_in_order_of_names(spark, tmp_path):
    """Spark reads the largest file first; the last row of a key is still that of the last file."""
    more = ",".join(["0"] * 11)
    for k, lines in enumerate((3, 1, 400)):
        (tmp_path / f"part-0000{k}.txt").write_text("".join(f"{key},{k}-{at},{more}\n" for at in range(lines) for key in ("a", f"b{k}")))
    (tmp_path / "part-00003.txt").write_text(f"a,last,{more}\n")
    got = {r["image_id"]: r["run"] for r in logs.baseline(spark, str(tmp_path), ["image_id", "run"]).collect()}
    assert got == {"a": "last", "b0": "0-2", "b1": "1-0", "b2": "2-399"}


def test_the_baseline_file_is_written_by_more_than_one_task(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(more_queries, "saved", lambda *a, f=more_queries.saved: kept.append(f(*a)) or kept[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.QUERIES["baseline_file"](spark, "/root/testdata/sf0.001")
        orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
        want = orders.groupBy(F.col("o_custkey").cast("string").alias("k")).agg(F.max("o_orderkey").cast("string").alias("v"))
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
        assert spark.read.text(kept[0]).select(F.col("_metadata.file_path")).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
