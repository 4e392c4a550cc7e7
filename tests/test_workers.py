"""Python workers need no copy of the package: functions travel by value."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def test_python_pass_from_another_folder(tmp_path):
    script = tmp_path / "run.py"
    script.write_text(f"""
import sys
sys.path.insert(0, {str(REPO)!r})
from loyalscope import get_session
from loyalscope.plans.registry import QUERIES
rows = QUERIES["recovery_transitions"](get_session(cores=2), "/root/testdata/sf0.001").collect()
assert rows and sum(r.transitions for r in rows) > 0
""")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
