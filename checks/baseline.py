"""Time the SQL of the headline queries in DuckDB, on tables it has loaded itself.

    python -m checks.baseline [folder]

Prints one JSON line in the layout of ``bench.py``; ``load`` builds the mapped tables.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from bench import HEADLINE, timed
from checks import oracle
from checks.compare import connect

MAPPED = ["store", "line", "product", "cust", "purchase", "inventory", "popularity", "customer_visits"]


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    connection = connect(folder)
    connection.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")

    start = time.perf_counter()
    for name in MAPPED:
        connection.execute(f"CREATE TABLE {name} AS {oracle.MAPPING} SELECT * FROM {name}")
    seconds = {"load": time.perf_counter() - start}
    for name in HEADLINE:
        sql = oracle.on_loaded_tables(name)
        connection.execute(sql).fetchall()
        seconds[name] = statistics.median(timed(lambda: connection.execute(sql).fetchall()) for _ in range(3))
    result = {
        "metric": "total time of load and headline queries, DuckDB",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": {name: round(value, 3) for name, value in seconds.items()},
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
