import json
import os
import subprocess
import sys
from pathlib import Path


def test_bench_prints_one_line_of_json():
    root = Path(__file__).resolve().parents[1]
    env = os.environ | {"BENCH_SF_DIR": "/root/testdata/sf0.001", "BENCH_CPUS": "2", "BENCH_RUNS": "1", "BENCH_ONLY": "cdc_updates,lookup_type1"}
    out = subprocess.run([sys.executable, "bench.py"], cwd=root, env=env, capture_output=True, text=True, check=True).stdout.strip().splitlines()
    said = json.loads(out[-1])
    assert len(out) == 1 and set(said["queries"]) == {"cdc_updates", "lookup_type1"} and not said["failed"]
