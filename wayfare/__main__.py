"""Jobs from the command line: python -m wayfare JOB --out FOLDER [...]; prints the job's table."""

from __future__ import annotations

import argparse


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="wayfare")
    parser.add_argument("job", choices=["build", "features", "baselines", "ranker", "experiment", "drift"])
    parser.add_argument("--out", required=True, help="folder of the tables; shared by driver and executors")
    parser.add_argument("--events", help="build: CSV of raw events")
    parser.add_argument("--properties", nargs="+", help="build: CSV parts of the property log")
    parser.add_argument("--tree", help="build: CSV of the category tree")
    parser.add_argument("--core", nargs=2, type=int, default=(5, 5), help="build: least rows of users and items")
    parser.add_argument("--caps", nargs=2, type=int, help="build: most users and items")
    parser.add_argument("--control", default="popularity")
    parser.add_argument("--treatment", default="item_cf")
    parser.add_argument("--master")
    a = parser.parse_args(argv)

    from wayfare.plans import jobs
    from wayfare.session import session
    from wayfare.sources import tables as T

    spark = session(master=a.master)
    if a.job == "build":
        if not (a.events and a.properties and a.tree):
            parser.error("build needs --events, --properties and --tree")
        out = jobs.build_dataset(spark, T.read_events(spark, a.events), T.read_item_properties(spark, *a.properties), T.read_category_tree(spark, a.tree), a.out, *a.core, tuple(a.caps) if a.caps else None)
    elif a.job == "features":
        out = jobs.build_features(spark, a.out).groupBy("split").count()
    elif a.job == "baselines":
        out = jobs.train_baselines(spark, a.out)
    elif a.job == "ranker":
        out = jobs.train_ranker(spark, a.out)
    elif a.job == "experiment":
        out = jobs.run_experiment(spark, a.out, a.control, a.treatment)
    else:
        out = jobs.monitor_drift(spark, a.out)
    out.show(50, truncate=False)


if __name__ == "__main__":
    main()
