
from __future__ import annotations

import json
import os
import subprocess
import sys
import tempfile
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
from marketloom.plans import REGISTRY  # noqa: E402
from tools.check import TABLES  # noqa: E402


def spark_times(folder: str) -> dict[str, float]:
    env = {**os.environ, "BENCH_SF_DIR": folder}
    out = subprocess.run([sys.executable, str(ROOT / "bench.py")], env=env, capture_output=True, text=True, check=True).stdout
    return json.loads(out.strip().splitlines()[-1])["queries"]


def sql_time(folder: str, sql: str) -> float:
    con = duckdb.connect(config={"temp_directory": tempfile.mkdtemp(prefix="baseline-"), "max_temp_directory_size": "5GB"})
    for table in TABLES:
        con.execute(f"create view {table} as select * from '{folder}/{table}.parquet'")
    started = time.perf_counter()
    con.execute(f"create temp table result as {sql}")
    return time.perf_counter() - started


def main() -> None:
    data = Path("/root/testdata")
    small, large = spark_times(str(data / "sf0.01")), spark_times(str(data / "sf0.1"))
    for name, seconds in large.items():
        sql = REGISTRY[name].sql
        duck = f"{sql_time(str(data / 'sf0.1'), sql):.2f}" if sql else "—"
        print(f"| {name} | {small[name]:.2f} | {seconds:.2f} | {duck} |", flush=True)


if __name__ == "__main__":
    main()
