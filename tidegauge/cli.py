"""Command line: grade, inspect, compare, metrics and adapters."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidegauge", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    g = sub.add_parser("grade", help="grade a file, a folder of files or a tree of episodes")
    g.add_argument("path")
    g.add_argument("--report", help="folder for the tables; .json and .csv choose the format")
    g.add_argument("--fail-on", default="blocked", choices=("blocked", "unknown", "review"))
    i = sub.add_parser("inspect", help="summary of a saved report, and whether its tables agree")
    i.add_argument("path")
    c = sub.add_parser("compare", help="compare the results of two reports")
    c.add_argument("old")
    c.add_argument("new")
    sub.add_parser("metrics", help="list the metrics")
    sub.add_parser("adapters", help="list the readers of files")
    a = p.parse_args(argv)
    from .operators import contracts, integrity, motion, timing, vision  # noqa: F401
    from .operators.registry import listed
    from .plans import grade as G

    if a.what == "metrics":
        print("\n".join(f"{m.name:28} {m.level:8} {m.family}" for m in listed()))
        return 0
    if a.what == "adapters":
        from .sources import tabular, walk  # noqa: F401

        failed = walk.load_plugins()
        print("\n".join([*sorted(walk.ADAPTERS), *(f"failed: {f}" for f in failed)]))
        return 0
    spark = SparkSession.builder.appName("tidegauge").getOrCreate()
    if a.what == "compare":
        diff = G.compare(spark.read.parquet(f"{a.old}/results"), spark.read.parquet(f"{a.new}/results"))
        diff.groupBy("state").count().orderBy("state").show()
        return 0
    if a.what == "inspect":
        saved = G.load(spark, a.path)
        print(saved.card())
        wrong = G.disagreements(saved).orderBy("rule", "episode_id", "address").collect()
        print("\n".join(f"{w.rule}: {w.episode_id} {w.address}" for w in wrong))
        return int(bool(wrong))
    graded = G.grade(spark, a.path)
    print(graded.card())
    if a.report:
        graded.write(a.report)
    return G.exit_code(graded.decisions, a.fail_on)


if __name__ == "__main__":
    sys.exit(main())
