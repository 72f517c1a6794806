"""What the text operators hold at once in a task."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from wardlight.llm import near_dup


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_shingles_of_a_large_batch_stay_small():
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(3_000)) for _ in range(20)] * 18
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["key", "text"])
    run = near_dup.sketches(SimpleNamespace(mapInArrow=lambda run, schema: run), 5)
    rows = []
    assert peak_mb(lambda: rows.extend(b.num_rows for b in run([batch]))) < 100
    assert sum(rows) == len(texts)


def test_a_large_region_is_counted_in_parts():
    n = 200_000
    sketch = np.zeros((n, near_dup.HASHES), np.uint8)
    sketch[:, 30:] = np.arange(n)[:, None] >> 10
    ids, ones = np.arange(n), np.ones(n, np.int64)
    assert peak_mb(lambda: near_dup.neighbours(ids, sketch, ones, ids, near_dup.HASHES, 80, False)) < 100
