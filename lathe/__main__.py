"""python -m lathe QUERY FOLDER [OUT]: shows a query's rows over a folder of tables, or writes them as Parquet; without arguments lists the queries."""

from __future__ import annotations

import sys

from lathe.plans.registry import QUERIES
from lathe.session import build_session, release_scratch


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in QUERIES:
        print("\n".join(sorted(QUERIES)))
        return int(bool(args))
    spark = build_session()
    out = QUERIES[args[0]](spark, args[1])
    out.write.parquet(args[2]) if len(args) > 2 else out.show(50, truncate=False)
    release_scratch(spark)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
