"""Command line: featurise a dataset's labelled nodes, then boost over folds, in one session.

python -m kgloom run --folder DIR --dataset NAME --label COLUMN --item COLUMN [...]
python -m kgloom update --folder DIR --dataset NAME ...
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom import learning, sinks
from kgloom.extract import Extractor, Featurizer, update_experiment
from kgloom.functions import frames, matrix
from kgloom.sources import datasets, rdf


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="kgloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name in ("run", "update"):
        one = commands.add_parser(name)
        one.add_argument("--folder", required=True, help="where the dataset's files lie")
        one.add_argument("--dataset", required=True)
        one.add_argument("--graph", help="the graph's file; default: <dataset>.nt")
        one.add_argument("--format", default="nt", choices=["nt", "ttl", "n3", "xml"])
        one.add_argument("--train", default="trainingSet.tsv")
        one.add_argument("--test", default="testSet.tsv")
        one.add_argument("--label", required=True)
        one.add_argument("--item", required=True)
        one.add_argument("--exclude", nargs="*", default=[], help="predicates that give labels away")
        one.add_argument("--depth", type=int, default=1)
        one.add_argument("--count", action="store_true")
        one.add_argument("--level", action="store_true")
        one.add_argument("--float_rpr", action="store_true")
        one.add_argument("--seed", type=int, default=0)
    run = commands.choices["run"]
    run.add_argument("--difficulty", help="a CSV of item, difficult; default: the nodes' degrees")
    run.add_argument("--experiment", default="boost", choices=[*learning.EXPERIMENTS, "adaboost", "logistic"])
    run.add_argument("--folds", type=int, default=10)
    run.add_argument("--rounds", type=int, default=100)
    run.add_argument("--pre", type=float, default=1.0)
    run.add_argument("--flag", type=int, default=10, help="0: only errors are written")
    run.add_argument("--out", help="where results are written")
    commands.choices["update"].add_argument("--entities", type=int, default=5)
    return out


def _loaded(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame]:
    """The graph and (item, label, part) of the dataset; files that are missing end the run."""
    spec = datasets.DatasetSpec(args.dataset, f"{args.folder}/{args.graph or args.dataset + '.nt'}", args.label, args.item, args.format, f"{args.folder}/{args.train}", f"{args.folder}/{args.test}", tuple(args.exclude))
    if gone := datasets.missing_files(spark, spec.graph, spec.train, spec.test):
        sys.exit(f"missing: {', '.join(gone)}")
    train, test = (datasets.label_table_any(spark, x, spec.item, spec.label) for x in (spec.train, spec.test))
    return rdf.load_graph(spark, spec.graph, spec.kind), datasets.train_and_test(train, test)


def degrees(triples: DataFrame, nodes: DataFrame) -> DataFrame:
    """(item, difficult): how many triples touch each (item) node, as a stand-in for a measured difficulty."""
    ends = triples.select(F.col("s").alias("item")).unionByName(triples.where("NOT is_lit").select(F.col("o").alias("item")))
    found = ends.groupBy("item").agg(F.count("*").cast("double").alias("difficult"))
    return nodes.select("item").distinct().join(found, "item", "left").na.fill(0.0, ["difficult"])


def run(spark: SparkSession, args: argparse.Namespace) -> dict:
    """Extraction, matrix, folds and a learner; gives the summary of the folds."""
    from kgloom.functions.credibility import scaled

    triples, labels = _loaded(spark, args)
    codes = matrix.LabelCodes(labels, "label")
    coded = codes.transform(labels, "code").select(F.col("item").alias("noi"), F.col("item"), "part", F.col("code").alias("label")).dropDuplicates(["noi"])
    nbh = Extractor(triples).neighbourhoods(coded, args.depth, args.exclude)
    cells, names = Featurizer(args.count, args.level, args.float_rpr).fit_transform(nbh)
    if args.out:
        sinks.save_features(cells, coded, f"{args.out}/features")
        sinks.save_matrix(cells, names, f"{args.out}/matrix")
    hard = datasets.difficulty_table(spark, f"{args.folder}/{args.difficulty}") if args.difficulty else degrees(triples, coded)
    rows, _ = learning.vectors(cells, frames.with_difficulty(coded, scaled(hard, "difficult")), names)
    rows = learning.folded(rows.na.fill(0.0, ["difficult"]), args.folds, seed=args.seed)
    classes = frames.classes(coded, "label").count()
    found = learning.cross_validate(rows, learning.trainer(args.experiment, classes, args.rounds, args.pre, args.seed), args.folds, args.pre)
    if args.out:
        sinks.save_folds(found, f"{args.out}/folds", errors_only=args.flag == 0)
    return learning.summary(found)


def update(spark: SparkSession, args: argparse.Namespace) -> dict:
    triples, labels = _loaded(spark, args)
    nodes = labels.select(F.col("item").alias("noi")).distinct()
    got = update_experiment(Extractor(triples), nodes, args.depth, args.entities, args.exclude, args.seed, args.count, args.level)
    return {k: v for k, v in got.items() if k not in ("before", "after")}


def main(argv: list[str] | None = None) -> dict:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("kgloom").getOrCreate()
    out = {"run": run, "update": update}[args.command](spark, args)
    print(json.dumps(out))
    return out


if __name__ == "__main__":
    main()
