import os
import re
import sys

import pyarrow as pa

from millrace.functions.shipping import map_arrow


def test_a_waiting_worker_holds_nothing_of_its_last_task(spark):
    def held():
        with open("/proc/self/smaps_rollup") as f:
            return int(re.search(r"Anonymous:\s+(\d+)", f.read())[1]) >> 10

    def told(pieces, batches):
        for _ in batches:
            pass
        before = held()
        parts = [bytes(1000) for _ in range(pieces)]
        sys.kept = parts[-1:]  # the end of the heap stays in use, so that free() alone returns nothing
        most = held()
        del parts
        yield pa.RecordBatch.from_pydict({"pid": pa.array([os.getpid()], pa.int64()), "before": pa.array([before], pa.int64()), "most": pa.array([most], pa.int64())})

    def ask(pieces):
        return map_arrow(spark.range(1).coalesce(1), lambda batches: told(pieces, batches), "pid long, before long, most long").collect()[0]

    large = ask(150_000)
    assert large["most"] - large["before"] > 120
    again = next(x for x in (ask(0) for _ in range(40)) if x["pid"] == large["pid"])
    assert again["before"] - large["before"] < 60
