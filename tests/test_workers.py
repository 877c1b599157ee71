import os
import subprocess
import sys

from pyspark import cloudpickle

from palisade.streaming.processor import WindowProcessor


def test_worker_code_needs_no_installed_package(tmp_path):
    """What is shipped to Python workers loads where the package cannot be imported."""
    shipped = tmp_path / "processor"
    shipped.write_bytes(cloudpickle.dumps(WindowProcessor(600_000, 5, "arrival_seq", None)))
    code = (
        "import pickle, sys\n"
        "p = pickle.load(open(sys.argv[1], 'rb'))\n"
        "assert 'palisade' not in sys.modules\n"
        "members = type(p).handleInputRows.__globals__['Members'](p.window_ms)\n"
        "print(members.observe('a', 0), members.observe('b', 600_000),"
        " members.observe('c', 600_001))\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code, str(shipped)], cwd=tmp_path, env=env,
                          capture_output=True, text=True, timeout=120)
    assert done.stdout.split() == ["1", "2", "2"], done.stderr
