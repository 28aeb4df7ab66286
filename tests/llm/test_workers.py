"""Queries on workers that have no copy of the package."""

from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from __spark_entry__ import queries
from hourtally import build_session
conf = {{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.host": "127.0.0.1", "spark.checkpoint.dir": "checkpoint"}}
spark = build_session("workers", "local[4]", **conf)
for name in {names!r}:
    print(name, queries()[name](spark, {sf!r}).count())
"""


@pytest.mark.parametrize("names", [["op1_toxicity_fm", "op3_rans_files", "op4_language_centroids", "op7_recurrent_lm", "op9_wordpiece_counts", "op10_bpe_trie", "op11_phrase_stripes", "op12_personal_data", "op13_burst_trie"], ["pipeline"]])
def test_workers_need_no_package(sf_dir, tmp_path, names):
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = SCRIPT.format(repo=str(REPO), names=names, sf=sf_dir)
    ran = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=environment, capture_output=True, text=True, timeout=900)
    assert ran.returncode == 0, ran.stderr[-3000:]
    assert [line.split()[0] for line in ran.stdout.splitlines()] == names
