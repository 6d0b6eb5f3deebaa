"""What Python workers hold between tasks."""

import numpy as np
import pyarrow as pa

from corrillo.llm import common


def test_workers_give_freed_memory_back(spark):
    def run(batches):
        def resident():
            with open("/proc/self/status") as lines:
                return next(int(x.split()[1]) // 1024 for x in lines if x.startswith("RssAnon"))

        common.rows_of("mb long", [])  # as every operator does
        for _ in batches:
            np.ones(30 << 20, np.uint8)  # the C library's own bound is above this size from now on
            before = resident()
            blocks, kept = [], []
            for _ in range(100):
                blocks.append(np.ones(2 << 20, np.uint8))
                kept.append(bytearray(5000))
            most = resident()
            blocks.clear()
            yield pa.RecordBatch.from_pydict({"used": [most - before], "left": [resident() - before]})

    row = spark.range(1).coalesce(1).mapInArrow(run, "used long, left long").first()
    assert row["used"] >= 190 and row["left"] < 20
