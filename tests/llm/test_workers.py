"""Operators that run Python on executors work where the package is not
installed: a driver with the package on its path only, started elsewhere."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

pytest.importorskip("logmart.llm")

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from logmart.llm import decontaminate, embedding_dedup, importance_resample, periodic_runs
from logmart.session import build_session
spark = build_session(master="local[2]", shuffle_partitions=2, driver_memory="1g")
item = "Which river runs through the old town of the north? The long grey river Alba runs there today."
text = "some words before it " + item.lower() + " and many words after it that say nothing"
docs = spark.createDataFrame([(1, text), (2, "nothing to see here at all " * 5)], "doc_id long, text string")
items = spark.createDataFrame([(7, item)], "item_id long, text string")
assert [(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()] == [(1, 7)]
assert [len(r.runs) for r in periodic_runs.collapse(docs).orderBy("doc_id").collect()] == [0, 1]
assert importance_resample.resample(docs, items, percent=100, shortest=1).where("rank is not null").count() == 2
v = spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 4.1], 1)], "vec_id long, embedding array<float>, label int")
assert [r.component_id for r in embedding_dedup.near_duplicates(v).collect()] == [1, 1]
print("all", "right")
"""


def test_workers_without_the_package(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SCRIPT, ROOT], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all right" in out.stdout, out.stderr[-3000:]
