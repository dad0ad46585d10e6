import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    ckpt = tempfile.mkdtemp(prefix="lodestar-test-ckpt-")
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.host", "127.0.0.1")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.checkpoint.dir", ckpt)
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from lodestar.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


@pytest.fixture(scope="session")
def harbours(spark):
    """A hundred and sixty short notes: a few shared words, some rare ones, and a name that only one note has."""
    import random
    rng = random.Random(160)
    goods = "salt timbur tunna net sigling farmur korn ull".split()
    rows = []
    for i in range(160):
        words = rng.choices(goods, weights=[9, 7, 5, 4, 3, 2, 1, 1], k=rng.randint(4, 25))
        rows.append((i, f"hofn-{i % 11}", f"Skip{i * 17 % 160}nafn og {' '.join(words)} til hafnar"))
    return spark.createDataFrame(rows, "doc_id long, source string, text string")
