"""Command line: ``train-linear`` and ``predict-linear`` with the familiar options.

Run under ``spark-submit`` (or plain ``python -m glmframe`` for a local
session). Option names and defaults follow the original commands; every
option maps onto a keyword argument of ``glmframe.plans``.
"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from glmframe.plans.commands import model_report, predict, train
from glmframe.session import ensure_checkpoint_dir


def _read_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("--input", required=True, help="matrix CSV to read: a file, a folder or a glob")
    p.add_argument("--max-features", type=int, default=0, help="keep this many leading features (0: all)")
    p.add_argument("--ignore", default="", help="columns to leave out, separated by commas")
    p.add_argument("--target", default="Y", help="column that holds the label (empty: there is none)")
    p.add_argument("--debug", action="store_true", help="log at debug level")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="glmframe")
    sub = top.add_subparsers(dest="command", required=True)
    tr = sub.add_parser("train-linear", help="fit a logistic (or linear) regression model")
    _read_options(tr)
    tr.add_argument("--out", default="", help="folder for the fitted model")
    tr.add_argument("--kind", default="logistic", choices=["logistic", "linear"])
    tr.add_argument("--num-iterations", type=int, default=200)
    tr.add_argument("--step-size", type=float, default=1.0, help="has no effect; kept so that old calls still parse")
    tr.add_argument("--reg-param", type=float, default=1.0)
    tr.add_argument("--scale", action="store_true", help="train on centred and scaled features, with an intercept")
    pr = sub.add_parser("predict-linear", help="use a model to make predictions")
    _read_options(pr)
    pr.add_argument("--model", required=True, help="folder of a saved model")
    pr.add_argument("--row-labels", default="", help="column that names each row in the output")
    pr.add_argument("--out", default="", help="folder for the predictions")
    pr.add_argument("--test", action="store_true", help="compare predictions with the labels")
    pr.add_argument(
        "--align", default="name", choices=["name", "position"],
        help="Match data columns to the model by feature name (default) or by position",
    )
    return top


def main(argv: list[str] | None = None) -> int:
    argv = list(sys.argv[1:] if argv is None else argv)
    args = parser().parse_args(argv)
    logging.basicConfig(level=logging.DEBUG if args.debug else logging.INFO, format="--> %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)
    spark = SparkSession.builder.appName(f"glmframe: {args.command}").getOrCreate()
    ensure_checkpoint_dir(spark)
    max_features = args.max_features or None
    if args.command == "train-linear":
        res = train(
            spark, args.input, out=args.out, kind=args.kind, num_iterations=args.num_iterations,
            reg_param=args.reg_param, target=args.target, ignore=args.ignore, max_features=max_features,
            arguments=tuple(argv), scale=args.scale,
        )
        print(f"Input: {res.rows:,} rows, {res.model_width:,} features, {res.partitions:,} partitions")
        print(f"Label 1 on {res.positives:,} of {res.rows:,} rows ({res.positive_percent:f}%)")
        ranking, zeros = model_report(spark, res.model)
        for row in ranking.orderBy("rank").select("line").toLocalIterator():
            print(row["line"])
        z = zeros.first()
        print(f"Zero weight: {z['zero']:,} of {z['total']:,} features ({z['percent'] or 0.0:f}%)")
        if args.out:
            print(f"Saved under {args.out}")
    else:
        out = predict(
            spark, args.input, args.model, out=args.out, target=args.target, ignore=args.ignore,
            max_features=max_features, row_labels=args.row_labels, test=args.test, align_mode=args.align,
        )
        if args.test:
            acc = out.first()
            print(f"Accuracy: {acc['correct']:,} / {acc['rows']:,} = {acc['accuracy'] or 0.0:f}")
        elif not args.out:
            print("No --out given: predictions were computed but not written.")
        if args.out:
            print(f"Saved under {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
