"""The shared folder for intermediate tables."""

import os
import subprocess
import sys


def test_local_folder_where_none_is_named(tmp_path):
    # In a session of its own without the setting, as a user's is.
    code = "from pyspark.sql import SparkSession\nfrom lodestone.sources import scratch\ns = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate()\nassert scratch.kept(s.range(2), 'y').count() == 2 and scratch.folder(s) == scratch.folder(s)\nprint('fine')"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if not k.startswith(("PYSPARK", "SPARK"))} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    assert "fine" in subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=240).stdout
