"""Runs queries in a session of its own, from a folder where workers cannot import this repository."""

import os
import subprocess
import sys
import textwrap
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def run(tmp_path, body: str) -> str:
    """What ``body`` prints; it finds ``spark`` and the entry module as ``entry``."""
    script = textwrap.dedent("""
        import sys
        sys.path.insert(0, {repo!r})
        from pyspark.sql import SparkSession
        spark = (
            SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "3g")
            .config("spark.sql.session.timeZone", "UTC").config("spark.local.dir", {here!r}).config("spark.checkpoint.dir", "file://" + {here!r} + "/shared").getOrCreate()
        )
        import __spark_entry__ as entry

        def importable(parts):
            import importlib.util
            for _ in parts:
                pass
            yield importlib.util.find_spec("tidemark") is not None

        assert spark.sparkContext.parallelize([1], 1).mapPartitions(importable).collect() == [False]
    """).format(repo=str(REPO), here=str(tmp_path))
    path = tmp_path / "script.py"
    path.write_text(script + textwrap.dedent(body))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(path)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0, done.stderr[-3000:]
    return done.stdout
