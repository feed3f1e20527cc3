"""What a Python worker keeps between tasks."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

CODE = r"""
import re
import numpy as np, pyarrow as pa
from siftwell.llm import ngramjoin

def anonymous():
    return int(re.search(r"\nAnonymous:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024

def batches(n):
    draw = np.random.default_rng(1)
    for k in range(n):
        texts = [" ".join(map(str, draw.integers(0, 1 << 40, 150))) for _ in range(6000)]
        sink = pa.BufferOutputStream()
        batch = pa.RecordBatch.from_arrays([pa.array(range(6000), pa.int64()), pa.array(texts)], ["doc_id", "text"])
        with pa.ipc.new_stream(sink, batch.schema) as out:
            out.write_batch(batch)
        del texts, batch
        yield pa.ipc.open_stream(sink.getvalue()).read_next_batch()

def task(n):
    return sum(b.num_rows for run in (ngramjoin._profile(5), ngramjoin._sets(5)) for b in run(batches(n)))

task(0)
before = anonymous()
rows = task(4)
assert rows >= 48000, rows
print(anonymous() - before)
"""


@pytest.mark.skipif(not sys.platform.startswith("linux"), reason="reads /proc")
def test_a_worker_gives_back_what_a_task_took():
    root = Path(__file__).resolve().parents[2]
    got = subprocess.run([sys.executable, "-c", CODE], cwd=root, capture_output=True, text=True, timeout=120)
    assert not got.returncode, got.stderr
    assert float(got.stdout) < 60, got.stdout
