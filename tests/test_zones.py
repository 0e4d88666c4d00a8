"""Collection from a driver whose time zone is not the session's."""

import os
import subprocess
import sys

import pytest

_RUN = """
import sys
from pyspark.sql import functions as F
from lagscope.operators.points import PointSpec
from lagscope.session import get_session
from lagscope.streaming.collector import Source, collect_once, collected_points
from lagscope.streaming.positions import WatermarkTable

folder = sys.argv[1]
spark = get_session("local[2]", 2, **{"spark.ui.enabled": "false", "spark.checkpoint.dir": folder + "/shared"})
for kind in ("timestamp", "timestamp_ntz"):
    rows = spark.range(12).select(F.col("id").alias("ID"), F.expr(f"cast(timestamp_seconds(1700000000 + id * 3600) AS {kind})").alias("T"))
    positions = WatermarkTable(spark, f"{folder}/{kind}/pos")
    for most in (5, 11):
        df = rows.filter(f"ID <= {most}")
        collect_once(spark, [Source("s", lambda s: df, "T", PointSpec.of("m", "T", ["ID"], ["ID"]))], positions, f"{folder}/{kind}/out")
    lines = [r.line for r in collected_points(spark, f"{folder}/{kind}/out", "s")[0].collect()]
    print("POINTS", kind, len(lines), len(set(lines)))
"""


@pytest.mark.parametrize("zone", ["Asia/Shanghai", "America/New_York"])
def test_no_row_is_lost_or_repeated(zone, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {**os.environ, "TZ": zone, "PYTHONPATH": root}
    out = subprocess.run([sys.executable, "-c", _RUN, str(tmp_path)], env=env, capture_output=True, text=True, timeout=200)
    assert [x.split()[1:] for x in out.stdout.splitlines() if x.startswith("POINTS")] == [["timestamp", "12", "12"], ["timestamp_ntz", "12", "12"]], out.stderr[-2000:]
