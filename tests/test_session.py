"""Sessions without the settings that this machine's defaults have."""

import os
import subprocess
import sys

import pytest

ALONE = """
from tesserae.session import forget, materialise, session, shared_dir
spark = session("local[2]", 2)
assert spark.conf.get("spark.checkpoint.dir", None) is None
first = materialise(spark.range(5), "numbers")
assert first.count() == 5 and shared_dir(spark) == shared_dir(spark) and shared_dir(spark).startswith("file:///")
assert materialise(first, "again").count() == 5
forget(first)
try:
    first.count()
except Exception:
    print("forgotten")
"""


def run_alone(code, tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": root}
    return subprocess.run([sys.executable, "-c", code], env=env, capture_output=True, text=True, timeout=300)


def test_a_local_session_without_a_shared_folder(tmp_path):
    done = run_alone(ALONE, tmp_path)
    assert done.returncode == 0 and "forgotten" in done.stdout, done.stderr[-2000:]


def test_pages_are_read_where_executors_lack_the_package(tmp_path):
    done = run_alone(f"""
import os, sys
os.environ.pop("PYTHONPATH")  # the workers do not see what the driver does
os.chdir({str(tmp_path)!r})
from tesserae.session import session
from tesserae.plans.registry import REGISTRY
print("rows", REGISTRY["collect_counts"].run(session("local[2]", 2), "/root/testdata/sf0.001").count())
""", tmp_path)
    assert done.returncode == 0 and "rows 400" in done.stdout, done.stderr[-2000:]


@pytest.mark.parametrize("name", ["ads_sample", "verbatim_grounding"])
def test_queries_run_without_settings(name, tmp_path):
    done = run_alone(f"""
from tesserae.session import session
from tesserae.plans.registry import REGISTRY
print("rows", REGISTRY["{name}"].run(session("local[2]", 2), "/root/testdata/sf0.001").count())
""", tmp_path)
    assert done.returncode == 0 and "rows " in done.stdout, done.stderr[-2000:]
