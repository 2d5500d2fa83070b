"""Sessions built elsewhere: settings are pinned and Python functions reach the workers."""

import subprocess
import sys
from pathlib import Path

import pandas as pd
from pyspark.sql import functions as F

from marketloom import session

ROOT = Path(__file__).resolve().parents[1]

SCRIPT = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as entry
print("rows", entry.queries()["compare_forms"](spark, "/root/testdata/sf0.001").count())
print("zone", spark.conf.get("spark.sql.session.timeZone"))
"""


def test_plain_session_from_another_folder(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "rows 150" in out.stdout and "zone UTC" in out.stdout, out.stderr[-2000:]


def test_scratch_root_follows_the_session(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    if before is None:
        assert session.scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    else:
        assert session.scratch_root(spark) == before.rstrip("/")


def test_python_workers_get_small_batches_of_texts(spark):
    @F.pandas_udf("struct<rows: int, chars: int>")
    def size(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"rows": [len(texts)] * len(texts), "chars": [int(texts.str.len().sum())] * len(texts)})

    def largest(rows, width):
        texts = session.pin(spark).range(0, rows, 1, 1).select(F.repeat(F.lit("a"), width + F.col("id").cast("int") % 2).alias("t"))
        return texts.select(size("t").alias("s")).agg(F.max("s.rows"), F.max("s.chars")).first()

    assert largest(5000, 10)[0] <= 1000
    assert largest(900, 100_000)[1] <= (16 << 20) + 100_001
