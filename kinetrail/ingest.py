"""python -m kinetrail.ingest POSITIONS OUT [--nojump]: sort a trajectory by frame and atom, and build its jump table."""

from __future__ import annotations

import argparse
import logging

from .cache import checksum, save_jumps, setlevel
from .session import get_session


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("positions")
    parser.add_argument("out")
    parser.add_argument("--nojump", action="store_true", help="also write the jump table")
    parser.add_argument("--debug", action="store_true")
    given = parser.parse_args(arguments)
    setlevel(logging.DEBUG if given.debug else logging.INFO)
    spark = get_session("kinetrail-ingest")
    rows = spark.read.parquet(given.positions)
    rows.repartitionByRange("frame", "atom").sortWithinPartitions("frame", "atom").write.mode("overwrite").parquet(f"{given.out}/positions.parquet")
    if given.nojump:
        save_jumps(spark.read.parquet(f"{given.out}/positions.parquet"), f"{given.out}/jumps.parquet", checksum(given.positions))


if __name__ == "__main__":
    main()
