"""Run named queries against their oracles: ``python -m callwright.plans.check [sf_dir] [names...]``."""
from __future__ import annotations

import json
import sys
import time

from ..session import local_session
from .catalog import ORACLES, QUERIES
from .compare import compare, duck_connect


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    names = argv[1:] or list(QUERIES)
    spark = local_session()
    con = duck_connect(sf_dir)
    bad = 0
    for name in names:
        t0 = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            if name in ORACLES:
                res = compare(df, ORACLES[name], con)
            else:
                res = {"rows_spark": df.count(), "ok": True, "oracle": "rows-only"}
        except Exception as e:  # report and continue
            res = {"ok": False, "error": f"{type(e).__name__}: {str(e)[:600]}"}
        res["sec"] = round(time.time() - t0, 2)
        bad += not res["ok"]
        print(name, json.dumps(res, default=str, ensure_ascii=False)[:1500], flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")


if __name__ == "__main__":
    main(sys.argv[1:])
