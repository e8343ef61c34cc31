"""Print the formatted physical plan of named queries: ``python -m callwright.plans.explain [sf_dir] name...``."""
from __future__ import annotations

import sys

from ..session import local_session
from .catalog import QUERIES


def main(argv):
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    for name in argv[1:]:
        print(f"===== {name}")
        QUERIES[name](spark, sf_dir).explain("formatted")


if __name__ == "__main__":
    main(sys.argv[1:])
