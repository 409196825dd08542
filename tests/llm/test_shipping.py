"""Executor functions and models need no copy of the package where they run."""

import os
import subprocess
import sys
import textwrap

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_models_reach_workers_without_the_package(tmp_path):
    """The driver alone finds the package, by a path that its workers do not have."""
    code = f"""
        import sys
        sys.path.insert(0, {ROOT!r})
        from pyspark.sql import SparkSession
        from patternloom.llm import quality, toxicity
        spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
        docs = spark.createDataFrame([(i, "vile slur awful" if i % 2 else "calm plain words") for i in range(40)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(40)], "doc_id long, toxic int, quality int")
        assert toxicity.toxicity(docs, labels).count() == 40
        assert quality.quality(docs, labels).where("score between 0 and 1").count() == 40
        print("whole")
    """
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert done.stdout.strip().endswith("whole"), done.stderr[-2000:]
