"""Command line: python -m matchloom.plans.cli train|predict|finetune|sample|validate|package ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from ..operators import sampling, tuning, validate
from ..sources import tsv
from . import linkage


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="matchloom")
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("train")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--knn", default="auto", choices=["auto", "exact", "ivf"])
    p.add_argument("--iterations", type=int, default=300, help="trees of the classifier")
    p.add_argument("--step", type=float, default=0.05, help="weight of each tree")
    p.add_argument("--embedder", help="folder that finetune wrote")
    p = sub.add_parser("finetune")
    p.add_argument("--data-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--epochs", type=int, default=3)
    p.add_argument("--batch-size", type=int, default=32)
    p = sub.add_parser("predict")
    p.add_argument("--test-dir", required=True)
    p.add_argument("--out-dir", required=True)
    p.add_argument("--model-path")
    p.add_argument("--embedder", help="folder that finetune wrote; the one that train had")
    p.add_argument("--countries", default="all")
    p.add_argument("--profile", default="train_like", choices=["train_like", "predict_like"])
    p.add_argument("--knn", default="auto", choices=["auto", "exact", "ivf"])
    p.add_argument("--part-files", action="store_true", help="results in one file a task, in place of one file")
    p.add_argument("--split-input", action="store_true", help="the default; kept for older calls")
    p.add_argument("--whole-files", action="store_true", help="a task per file, in place of a task per split")
    p = sub.add_parser("sample")
    for name in ("--full-train-dir", "--full-test-dir", "--out-train-dir", "--out-test-dir"):
        p.add_argument(name, required=True)
    p.add_argument("--n-train", type=int, default=10_000)
    p.add_argument("--n-test", type=int, default=3_000)
    p = sub.add_parser("validate")
    p.add_argument("-m", "--matching", required=True)
    p.add_argument("-c", "--candidate")
    p.add_argument("-t", "--test-dir", required=True)
    p.add_argument("--check-ids", action="store_true")
    p = sub.add_parser("package")
    for name in ("--team-name", "--root-dir", "--output-tsv-dir", "--zip-dest-dir"):
        p.add_argument(name, required=True)
    a = top.parse_args(argv)
    if a.command == "package":
        print(linkage.package_run(a.team_name, a.root_dir, a.output_tsv_dir, a.zip_dest_dir))
        return 0
    spark = SparkSession.builder.appName("matchloom").getOrCreate()
    load = tuning.Projection.read(spark, a.embedder).load if getattr(a, "embedder", None) else None
    if a.command == "train":
        linker, ceiling = linkage.train_files(spark, a.data_dir, a.out_dir, load, knn=a.knn, iterations=a.iterations, step=a.step)
        ceiling.orderBy("overall", "country").show(truncate=False)
        print(linker.threshold, linker.stats)
    elif a.command == "finetune":
        print(linkage.tune_files(spark, a.data_dir, a.out_dir, a.epochs, a.batch_size).facts)
    elif a.command == "predict":
        linkage.predict_files(spark, a.test_dir, a.out_dir, a.model_path, a.countries, load, profile=a.profile, knn=a.knn, single=not a.part_files, multi_line=a.whole_files)
    elif a.command == "sample":
        train = {"truth": tsv.read_tsv(spark, f"{a.full_train_dir}/train_ground_truth.tsv", tsv.TRUTH)}
        train |= {f"s{k}": tsv.read_tsv(spark, f"{a.full_train_dir}/train_source{k}.tsv", tsv.RECORD) for k in (1, 2, 3)}
        test = {f"s{k}": tsv.read_tsv(spark, f"{a.full_test_dir}/test_source{k}.tsv", tsv.RECORD) for k in (1, 2, 3)}
        small, small_test = sampling.create_sample(train, test, a.n_train, a.n_test)
        tsv.write_tsv(small.pop("truth"), f"{a.out_train_dir}/train_ground_truth.tsv", single=True)
        for k, rows in small.items():
            tsv.write_tsv(rows, f"{a.out_train_dir}/train_source{k[1]}.tsv", single=True)
        for k, rows in small_test.items():
            tsv.write_tsv(rows, f"{a.out_test_dir}/test_source{k[1]}.tsv", single=True)
    else:
        found = validate.validate(spark, a.matching, a.candidate, a.test_dir, a.check_ids).cache()
        found.show(100, truncate=False)
        return validate.exit_code(found)
    return 0


if __name__ == "__main__":
    sys.exit(main())
