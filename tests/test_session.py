import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from loglattice import session
from loglattice.functions.vectors import unit_rows
from loglattice.operators.documents import line_chunks


class Conf(dict):
    def get(self, key, default=None):
        return dict.get(self, key, default)


class FakeSpark:
    def __init__(self, master, **conf):
        self.conf = Conf(conf)
        self.sparkContext = type("Context", (), {"master": master, "applicationId": "app"})


def test_scratch_lies_in_the_folder_the_cluster_names():
    spark = FakeSpark("spark://x", **{"spark.checkpoint.dir": "hdfs:///shared/"})
    first, second = session.scratch_path(spark, "t"), session.scratch_path(spark, "t")
    assert first.startswith("hdfs:///shared/t-") and first != second


def test_scratch_is_local_for_local_sessions_only():
    local = FakeSpark("local[2]")
    assert session.scratch_path(local, "a").rsplit("/", 1)[0] == session.scratch_path(local, "b").rsplit("/", 1)[0]
    with pytest.raises(ValueError):
        session.scratch_path(FakeSpark("spark://x"), "a")


def test_prepare_pins_utc(spark):
    other = spark.newSession()
    other.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    assert session.prepare(other).conf.get("spark.sql.session.timeZone") == "UTC"


def test_path_exists(spark, tmp_path):
    assert session.path_exists(spark, str(tmp_path))
    assert not session.path_exists(spark, str(tmp_path / "no"))
    assert not session.path_exists(spark, str(tmp_path / "no*"))


def test_worker_functions_need_no_package_on_the_executor(tmp_path):
    """What is sent to a Python worker runs where `loglattice` is unknown."""
    blob = tmp_path / "fn.pkl"
    blob.write_bytes(cloudpickle.dumps((line_chunks, unit_rows)))
    code = (
        "import pickle, sys\n"
        f"chunks, unit = pickle.load(open({str(blob)!r}, 'rb'))\n"
        "print(chunks('a\\nb', 500, 50), unit([[3, 4]]).tolist(), 'loglattice' in sys.modules)"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=60, check=True)
    assert done.stdout.strip().endswith("['a\\nb'] [[0.6, 0.8]] False")
