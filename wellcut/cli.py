"""Command line: ``python -m wellcut.cli MincutOnly|CM ...``."""

from __future__ import annotations

import argparse

from pyspark import SparkConf, SparkContext

from wellcut.functions.criterion import SIMPLE, Criterion
from wellcut.operators.community import ALGORITHMS
from wellcut.operators.refine import cc, cm, wcc, wcc_rounds
from wellcut.session import get_spark
from wellcut.sources.io import load, write_clusters
from wellcut.telemetry import Recorder, logger, totals


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="wellcut")
    sub = p.add_subparsers(dest="command", required=True)
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--edgelist", required=True)
    both.add_argument("--num-processors", type=int, default=1, help="local threads, where no master is set (spark-submit sets one)")
    both.add_argument("--output-file", required=True)
    both.add_argument("--connectedness-criterion", default="1log_10(n)")
    both.add_argument("--log-level", type=int, default=1, choices=[0, 1, 2])
    both.add_argument("--header", action="store_true", help="the edge list's first line is a header")
    both.add_argument("--no-output-header", action="store_true")
    m = sub.add_parser("MincutOnly", parents=[both])
    m.add_argument("--existing-clustering", required=True)
    m.add_argument("--log-header", required=True, help="logs go to <header>_0.log and <header>_ops.log")
    m.add_argument("--compat-first-line-skip", action="store_true", help="lose the first edge")
    m.add_argument("--mode", choices=["task", "rounds"], default="task")
    c = sub.add_parser("CM", parents=[both])
    c.add_argument("--algorithm", choices=ALGORITHMS, default="leiden-cpm")
    c.add_argument("--resolution", type=float, default=0.01)
    c.add_argument("--existing-clustering", default="")
    c.add_argument("--start-with-clustering", action="store_true", help="the existing clustering is where refinement starts; implied by --existing-clustering")
    c.add_argument("--log-file", required=True)
    return p


def _master() -> str | None:
    """The master that spark-submit, the environment or a running session has set."""
    SparkContext._ensure_initialized()
    running = SparkContext._active_spark_context
    return running.master if running else SparkConf().get("spark.master", None)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    log = logger(f"{args.log_header}_0.log" if args.command == "MincutOnly" else args.log_file, args.log_level)
    criterion = Criterion.parse(args.connectedness_criterion)
    spark = get_spark("wellcut", master=None if _master() else f"local[{args.num_processors}]")
    steps = Recorder()
    weighted = args.command == "CM"
    with steps.step("load", "read"):
        edges, clusters, dictionary = load(spark, args.edgelist, args.existing_clustering or None, weighted, args.header, getattr(args, "compat_first_line_skip", False))
    log.info("read %s", args.edgelist)
    with steps.step("refine", args.command):
        if args.command == "CM":
            out = cm(edges, clusters, args.algorithm, args.resolution, args.connectedness_criterion)
        elif criterion.kind == SIMPLE:
            out = cc(edges, clusters)
        elif args.mode == "rounds":
            out, rows = wcc_rounds(edges, clusters, args.connectedness_criterion)
            steps.rows += rows
        else:
            out = wcc(edges, clusters, args.connectedness_criterion)
    with steps.step("write", "write"):
        write_clusters(out, args.output_file, dictionary, header=not args.no_output_header, number=False)
    log.info("wrote %s", args.output_file)
    if args.command == "MincutOnly":
        with open(f"{args.log_header}_ops.log", "w") as f:
            for r in [*steps.rows, *(t.asDict() for t in totals(steps.frame(spark)).collect())]:
                f.write(f"{r}\n")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
