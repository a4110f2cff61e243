import json
import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_line_with_the_query():
    env = {**os.environ, "BENCH_QUERIES": "score_level", "BENCH_CPUS": "2", "BENCH_SF_DIR": "/root/testdata/sf0.001",
           "MIRADOR_DRIVER_MEMORY": "2g"}
    r = subprocess.run([sys.executable, os.path.join(ROOT, "bench.py")], env=env, capture_output=True, text=True, timeout=300)
    assert r.returncode == 0, r.stderr[-2000:]
    out = json.loads(r.stdout.strip().splitlines()[-1])
    assert list(out["queries"]) == ["score_level"] and out["queries"]["score_level"] > 0
    assert out["unit"] == "sec" and "failed" not in out
