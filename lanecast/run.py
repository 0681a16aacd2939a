"""Spark job: read the sources, write every table, then every report.

    spark-submit --py-files lanecast.zip lanecast/run.py --csv <folder> --out <folder>
"""

from __future__ import annotations

import argparse

from lanecast.plans import DERIVED, REPORTS, Marts
from lanecast.plans.display import as_printed
from lanecast.session import build_session, drop_frozen
from lanecast.settings import MARKETPLACE, TPCH
from lanecast.sources import TpchSources, read_landed, read_marketplace_csv


def run(marts: Marts, out: str, reports: list[str] | None = None) -> None:
    """Tables go to ``out/tables``, reports as printed to ``out/reports``.

    Intermediates are deleted at the end.
    """
    marts.publish(f"{out}/tables")
    every = {**REPORTS, **DERIVED}
    for name in reports or [r for r in every if r not in Marts.TABLES]:
        rounded = as_printed(name, every[name](marts))
        rounded.write.mode("overwrite").parquet(f"{out}/reports/{name}")
    marts.close()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv", help="folder of marketplace CSV files")
    source.add_argument("--landed", help="folder written by sources.land")
    source.add_argument("--tpch", help="folder of TPC-H-like Parquet tables")
    parser.add_argument("--out", required=True, help="target folder on shared storage")
    parser.add_argument("--reports", nargs="*", help="names; all by default")
    args = parser.parse_args(argv)

    spark = build_session("lanecast")
    if args.tpch:
        sources, settings = TpchSources(spark, args.tpch), TPCH
    elif args.landed:
        sources, settings = read_landed(spark, args.landed), MARKETPLACE
    else:
        sources, settings = read_marketplace_csv(spark, args.csv), MARKETPLACE
    run(Marts(sources, settings, store=args.out), args.out, args.reports)
    drop_frozen(spark)


if __name__ == "__main__":
    main()
