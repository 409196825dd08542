import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sample_lines():
    """Twenty service lines: 14 requests, 3 pool warnings, 3 timeouts."""
    info = [45, 32, 55, 28, 312, 41, 38, 47, 1847, 29, 33, 44, 51, 37]
    octets = [15, 16, 15, 17, 15, 16, 18, 15, 16, 15, 19, 16, 15, 20]
    status = [200, 200, 200, 200, 500, 200, 200, 200, 503, 200, 200, 200, 200, 200]
    rows = [f"INFO [abc{{}}def] Request from 10.0.1.{o} completed in {d}ms status={s}" for o, d, s in zip(octets, info, status)]
    warn = [f"WARN [abc{{}}def] Connection pool exhausted, waiting {d}ms" for d in (230, 180, 1400)]
    error = [f"ERROR [abc{{}}def] Timeout connecting to {ip}:5432 after {d}ms" for ip, d in (("10.0.1.15", 5000), ("10.0.2.8", 5002), ("10.0.1.16", 4998))]
    order = rows[:3] + warn[:1] + rows[3:6] + error[:1] + rows[6:7] + warn[1:2] + rows[7:9] + error[1:2] + rows[9:10] + warn[2:] + rows[10:12] + error[2:] + rows[12:]
    return [f"2024-01-15T14:22:0{1 + i // 5}.{1 + i % 5}00Z {text.format(123 + i)}" for i, text in enumerate(order)]
