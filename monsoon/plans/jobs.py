"""Command line: train, predict and the train-then-predict chain, run with spark-submit.

    spark-submit monsoon/plans/jobs.py train --use-case UC1 --root /data/climate --model-dir /models
    spark-submit monsoon/plans/jobs.py predict --model /models/UC1_weather_clf_latest --root ... --out ...
"""

from __future__ import annotations

import argparse

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession

from monsoon.plans import score, train
from monsoon.plans.train import Trained
from monsoon.sources.artifacts import load_artifact
from monsoon.sources.config import load_contract, model_config
from monsoon.sources.sinks import write_anomalies, write_predictions
from monsoon.sources.tables import Catalog


def train_use_case(
    catalog: Catalog, use_case: str, cfg: dict | None = None, model_dir: str | None = None, rules: dict | None = None
) -> Trained:
    """Train one use case from the catalog's tables."""
    use_case = use_case.upper()
    cfg = cfg or model_config(use_case)
    if use_case == "UC1":
        return train.train_weather(catalog.bmkg(), cfg, model_dir, rules)
    if use_case == "UC2":
        try:
            cover = catalog.worldcover()
        except AnalysisException as missing:  # land cover is an optional extra; any other failure is one
            if missing.getCondition() not in {"PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND"}:
                raise
            train.log.warning("no land-cover table, training without it")
            cover = None
        return train.train_climate(catalog.nasa_power(), cfg, cover, model_dir)
    if use_case == "UC3":
        return train.train_anomaly(catalog.bmkg(), cfg, model_dir, rules)
    if use_case == "UC4":
        return train.train_grid(catalog.era5(), cfg, model_dir)
    if use_case == "UC5":
        return train.train_disaster(catalog.bnpb_disaster(ordered=False), catalog.nasa_power(), cfg, model_dir)
    raise ValueError(f"unknown use case '{use_case}'")


def predict_use_case(catalog: Catalog, use_case: str, artifact: str, out: str, idempotent: bool = False) -> int:
    """Score a table with a stored model and append the result; returns the rows written."""
    model, about = load_artifact(catalog.spark, artifact)
    use_case = use_case.upper()
    if use_case == "UC1":
        scored = score.predict_weather_rows(catalog.bmkg(), model, about)
        return write_predictions(scored, out, idempotent, ["id"] if idempotent else [])
    if use_case == "UC3":
        return write_anomalies(score.check_anomalies(catalog.bmkg(), model), out, "bmkg_forecast")
    raise ValueError(f"no batch prediction for use case '{use_case}'")


def weather_chain(catalog: Catalog, model_dir: str, out: str, cfg: dict | None = None) -> int:
    """Train the weather classifier, then score the table with it and append the predictions."""
    trained = train_use_case(catalog, "UC1", cfg, model_dir)
    return predict_use_case(catalog, "UC1", trained.artifact, out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="monsoon")
    parser.add_argument("action", choices=["train", "predict", "chain"])
    parser.add_argument("--use-case", default="UC1")
    parser.add_argument("--config", help="model settings (YAML or JSON)")
    parser.add_argument("--contract", help="settings file with a contract section")
    parser.add_argument("--source", default="parquet", choices=["parquet", "json", "jdbc"])
    parser.add_argument("--root", default="", help="folder of the tables")
    parser.add_argument("--json-lines", action="store_true", help="one JSON object per line, read in parallel")
    parser.add_argument("--jdbc-url", default="")
    parser.add_argument("--id-bounds", nargs=2, type=int, metavar=("LOW", "HIGH"), help="ids to read a database in parallel by")
    parser.add_argument("--partitions", type=int, default=32, help="parallel reads of a database table")
    parser.add_argument("--model-dir", default="./models")
    parser.add_argument("--model", help="stored model for predict")
    parser.add_argument("--out", help="result table")
    parser.add_argument("--idempotent", action="store_true", help="skip keys the result table already holds")
    args = parser.parse_args(argv)

    spark = spark or SparkSession.builder.appName("monsoon").getOrCreate()
    jdbc = {"url": args.jdbc_url} if args.jdbc_url else {}
    bounds = tuple(args.id_bounds) if args.id_bounds else None
    catalog = Catalog(
        spark, args.source, args.root, jdbc, json_lines=args.json_lines, id_bounds=bounds, partitions=args.partitions
    )
    use_case = args.use_case.upper()
    if use_case not in train.ARTIFACTS:
        raise SystemExit(f"unknown use case '{args.use_case}'")
    if args.action != "train" and not args.out:
        raise SystemExit("--out is needed")
    rules = load_contract(args.contract) if args.contract else None
    cfg = model_config(use_case, args.config)
    if args.action == "train":
        trained = train_use_case(catalog, use_case, cfg, args.model_dir, rules)
        print(trained.artifact)
        return 0
    if args.action == "chain":
        print(weather_chain(catalog, args.model_dir, args.out, cfg))
        return 0
    model = args.model or f"{args.model_dir}/{train.ARTIFACTS[use_case]}"
    print(predict_use_case(catalog, use_case, model, args.out, args.idempotent))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
