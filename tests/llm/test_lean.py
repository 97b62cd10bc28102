import subprocess
import sys

#: Runs the scan of near_duplicates as a worker does, and prints how many MB the process has more after it.
WORKER = """
import re
import numpy as np
import pyarrow as pa
from pagewright.llm import similar


class Rows:
    def mapInArrow(self, run, schema):
        return run


def batches():
    for k in range(3):
        texts = [f"{k} {i} word{i % 97} " * 130 for i in range(10_000)]
        ids = pa.array(range(10_000), pa.int64())
        yield pa.record_batch([ids, ids, pa.array(texts)], ["doc_id", "th", "text"])


def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon: +([0-9]+)", f.read())[1]) / 1024


before = held()
rows = sum(b.num_rows for b in similar._scan(Rows(), 5, np.zeros(0, np.uint64))(batches()))
print(rows, held() - before)
"""


def test_a_worker_keeps_little_memory_of_a_task():
    found = subprocess.run([sys.executable, "-c", WORKER], capture_output=True, text=True, check=True, timeout=300).stdout.split()
    assert int(found[0]) == 30_000
    assert float(found[1]) < 70
