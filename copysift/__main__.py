"""python -m copysift ROOT: a report on a project as YAML."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from copysift.config import Query
from copysift.plans.engine import Engine, text_report


def main() -> None:
    given = argparse.ArgumentParser(prog="copysift")
    given.add_argument("root", nargs="?", default=".")
    given.add_argument("--top", type=int, default=20)
    given.add_argument("--order-by", choices=["severity", "frequency"], default="severity")
    given.add_argument("--min-confidence", choices=["low", "moderate", "high", "certain"], default="low")
    args = given.parse_args()
    engine = Engine(SparkSession.builder.appName("copysift").getOrCreate(), args.root)
    engine.refresh(force=True)
    engine.index()
    print(text_report(engine.detect(Query(top=args.top, order_by=args.order_by, min_confidence=args.min_confidence))))


if __name__ == "__main__":
    main()
