"""Print the final adaptive plan of a registered query after running it, with scan and reuse counts."""

import os
import re
import sys
import time

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), ".."))

from quotalens.queries import QUERIES, load_all  # noqa: E402
from quotalens.session import local_session  # noqa: E402

load_all()
spark = local_session(8, 8)
show = "-q" not in sys.argv
for name in [a for a in sys.argv[1:] if a != "-q"]:
    QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    start = time.perf_counter()
    df.collect()
    took = time.perf_counter() - start
    text = df._jdf.queryExecution().executedPlan().toString()
    final = text.split("== Initial Plan ==")[0]
    if show:
        print(final)
    counts = {w: len(re.findall(rf"\b{w}\b", final)) for w in
              ("FileScan", "Exchange", "ReusedExchange", "ReusedQueryStage", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin",
               "BroadcastNestedLoopJoin", "CartesianProduct", "Window")}
    print(name, f"{took:.1f}s", counts)
spark.stop()
