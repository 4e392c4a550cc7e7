"""Workers need no copy of the package: every operator and the pipeline run from another folder."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[2]


def test_all_queries_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from loyalscope import get_session
from loyalscope.llm.queries import QUERIES
import corpus_pipeline
spark = get_session(cores=4)
for name, query in [*QUERIES.items(), ("pipeline", corpus_pipeline.run)]:
    assert query(spark, "/root/testdata/sf0.001").collect(), name
    print("ran", name, flush=True)
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert done.returncode == 0 and done.stdout.count("ran ") == 14, done.stdout + done.stderr[-2000:]
