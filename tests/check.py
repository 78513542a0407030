"""Developer run: python -m tests.check [sf] [name …]; prints time, rows and the outcome per query."""

from __future__ import annotations

import sys
import time

import __spark_entry__ as entrypoint
from tests.compare import differences, duck
from vestigia.session import local_session


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    wanted = sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(folder)
    oracle = entrypoint.oracle_sql()
    bad = 0
    for name, fn in entrypoint.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = differences(spark, con, folder, fn, oracle[name])
                state = "same" if problem is None else f"DIFF {problem}"
            else:
                state = f"rows-only {len(fn(spark, folder).collect())}"
        except Exception as exc:  # noqa: BLE001
            state = f"FAIL {str(exc)[:600]}"
        bad += state.startswith(("DIFF", "FAIL"))
        if wanted or state != "same" or time.time() - start > 4:
            print(f"{name:28s} {time.time() - start:6.2f}s {state}", flush=True)
    print("bad:", bad)
    spark.stop()


if __name__ == "__main__":
    main()
