"""Workers that cannot see the package's folder get it from the driver."""

import os
import subprocess
import sys
from pathlib import Path

SCRIPT = """
import sys
sys.path.insert(0, {root!r})
from wayfield.session import local_session, ship
from wayfield.operators import maps
spark = local_session(2, 2)
ship(spark)
points = spark.range(50).selectExpr("'A' room", "id / 50 sx", "id / 50 sy", "id / 50 tx", "id / 50 ty")
print("NODES", maps.kernel_mapping_exact(points, ["room"], 5, 0.0, 1.0, 0.1).count())
spark.stop()
"""


def test_another_working_folder(tmp_path):
    root = str(Path(__file__).resolve().parents[1])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", SCRIPT.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "NODES 25" in run.stdout, run.stderr[-2000:]
