"""What the batch helpers leave behind in a worker."""

import os
import sys
from pathlib import Path

import pyarrow as pa

from tillwise.llm.tables import map_batches


def resident_mb(pid):
    return int(Path(f"/proc/{pid}/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20


def test_a_task_gives_its_memory_back(spark):
    """Freed blocks between small ones that stay: the C library alone would keep them."""

    def work(batches):
        for batch in batches:
            blocks, sys.stays = zip(*[(bytes([1]) * 100_000, bytes([1]) * 5000) for _ in range(3000)])
            held = int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE") / 2**20
            del blocks
            yield pa.RecordBatch.from_pylist([{"pid": os.getpid(), "held": held}] * len(batch))

    (row,) = map_batches(spark.range(1).coalesce(1), work, "pid long, held double").collect()
    assert resident_mb(row.pid) < row.held - 200
