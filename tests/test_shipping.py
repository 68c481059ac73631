"""What is sent to tasks must load where this package is not installed."""

import base64
import os
import subprocess
import sys

import pyspark
from pyspark import cloudpickle

from lectern.operators.search import _Best


def test_task_code_loads_without_the_package(tmp_path):
    def job():
        import numpy as np

        best = _Best(np.array([[1.0, 0.0]]), 1)
        best.add(np.array(["a", "b"], dtype=object), np.array([[0.0, 1.0], [1.0, 0.0]]))
        return best.item.tolist()

    payload = base64.b64encode(cloudpickle.dumps(job)).decode()
    code = f"import base64, pickle; print(pickle.loads(base64.b64decode('{payload}'))())"
    spark_home = os.path.dirname(os.path.dirname(pyspark.__file__))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": spark_home}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert out.stdout.strip() == "[['b']]", out.stderr
