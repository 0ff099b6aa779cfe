"""Command line: train, score, measure; or answer requests line by line in one session."""

from __future__ import annotations

import json
import shlex
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.functions.metrics import coverage_of, evaluate
from terrace.params import Params
from terrace.plans.model import Model
from terrace.plans.trainer import Trainer
from terrace.sources.blobs import predictions_blob, read_dataset
from terrace.sources.synthetic import uniform_rows

END = "__END__"  # fixed value: the line after each reply
OTHER = {"data", "save-model", "load-model", "dump-pred", "profile-out", "serve", "latency-bench", "throughput-bench", "label"}


def run(spark: SparkSession, tokens: list[str], say=print) -> dict:
    """One request: read --data (a folder of blobs, or Parquet with a column split), train or --load-model, score the test rows, report; returns what was reported."""
    params, rest = Params.from_flags(tokens)
    if set(rest) - OTHER:
        raise ValueError(f"unknown flags: {sorted(set(rest) - OTHER)}")
    if "data" not in rest:
        raise ValueError("--data is missing")
    data, label = read(spark, rest["data"]), rest.get("label", "y")
    test = data.where("split = 'test'")
    began = time.perf_counter()
    if "load-model" in rest:
        model = Model.load(spark, rest["load-model"])
    else:
        features = [c for c in data.columns if c not in ("row_id", label, "split")]
        named = tuple(features[int(c)] if c.isdigit() else c for c in params.categorical)
        params = Params(**{**params.__dict__, "categorical": named})
        model = Trainer(params, features, label, "row_id" if "row_id" in data.columns else None).fit(data.where("split = 'train'"))
    train_s, began = time.perf_counter() - began, time.perf_counter()
    scored = model.transform(test).persist()
    scored.count()
    pred_ms = (time.perf_counter() - began) * 1000
    found = evaluate(scored, model.objective, "score", label)
    said = {"objective": model.objective, "train_s": train_s, "pred_ms": pred_ms, **found}
    say("RESULT " + " ".join(f"{k}={v:.6f}" if isinstance(v, float) else f"{k}={v}" for k, v in said.items()))
    if model.params.pgbm:
        row = model.predict_interval(test).agg(F.avg("sigma").alias("sigma"), coverage_of(F.col(label), F.col("score"), F.col("sigma")).alias("coverage")).first()
        said |= {"mean_sigma": row.sigma, "coverage": row.coverage}
        say(f"INTERVAL mean_sigma={row.sigma:.4f} coverage={100 * row.coverage:.1f}%")
    importance = model.importance(spark).collect()
    total = sum(r.gain for r in importance)
    for r in importance[:8]:
        if r.gain > 0:
            say(f"  {r.feature} gain={r.gain:.2f} ({100 * r.gain / max(total, 1e-9):.1f}%) splits={r.splits}")
    if "save-model" in rest:
        model.save(spark, rest["save-model"])
    if "dump-pred" in rest:
        with open(rest["dump-pred"], "wb") as f:
            f.write(predictions_blob(scored))
    if "profile-out" in rest:
        with open(rest["profile-out"], "w") as f:
            json.dump({"total_ns": int(sum(model.profile.values()) * 1e9), "categories": {k: int(v * 1e9) for k, v in model.profile.items()}}, f)
    for flag, sizes in (("latency-bench", (1, 1024, 262_144)), ("throughput-bench", (1_000_000, 16_000_000))):
        if rest.get(flag) in ("1", "true"):
            for n in sizes:
                say(f"{flag.split('-')[0].upper()} rows={n} seconds={seconds_to_score(spark, model, n):.6f}")
    scored.unpersist()
    return said


def seconds_to_score(spark: SparkSession, model: Model, n: int) -> float:
    """Seconds to score n made-up rows that lie nowhere before."""
    rows = uniform_rows(spark, n, len(model.features)).toDF("row_id", *model.features)
    began = time.perf_counter()
    model.transform(rows).agg(F.sum("score")).collect()
    return time.perf_counter() - began


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(".parquet") else read_dataset(spark, path)


def serve(spark: SparkSession, lines, say=print) -> None:
    """Each line is a request (flags parted by tabs, or as in a shell); the reply is OK and the report, or ERROR and why, then a line __END__. QUIT ends. A bad request doesn't end the session."""
    for line in lines:
        line = line.rstrip("\n")
        if line == "QUIT":
            return
        said: list[str] = []
        try:
            run(spark, line.split("\t") if "\t" in line else shlex.split(line), said.append)
            say("OK " + " | ".join(said))
        except Exception as e:
            say(f"ERROR {type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")
        say(END)


def main(tokens: list[str] | None = None) -> None:
    tokens = sys.argv[1:] if tokens is None else tokens
    spark = SparkSession.builder.appName("terrace").getOrCreate()
    if tokens[:1] == ["--serve"]:
        serve(spark, sys.stdin, lambda x: print(x, flush=True))
    else:
        run(spark, tokens)


if __name__ == "__main__":
    main()
