"""Datasets of little-endian 32-bit float blobs, predictions of that form, and models in the one-file binary form."""

from __future__ import annotations

import json
import struct
from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrace.operators.encoding import TargetEncoder
from terrace.params import Params
from terrace.plans.model import Model

# Fixed values of the file forms.
FILES = {"train": ("x_train.bin", "y_train.bin"), "test": ("x_test.bin", "y_test.bin")}
COUNTS = {"train": "n_train", "test": "n_test"}
MODEL_MAGIC, MODEL_VERSION = b"RWD1", 1
ROWS_A_SLICE = 1 << 16


def read_meta(spark: SparkSession, path: str) -> dict:
    """meta.json of a dataset folder, from any store that Spark reads."""
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/meta.json", wholetext=True).collect()))


def read_blob(spark: SparkSession, path: str, width: int, names: list[str]) -> DataFrame:
    """row_id and `width` float columns of a row-major blob. A file is one row of one task, held whole there (2 GB at most) and cut into slices: larger data belongs in Parquet."""
    records = spark.read.format("binaryFile").load(path)

    def run(batches):
        for b in batches:
            for start, content in zip(b.column(0).to_pylist(), b.column(1)):
                raw = np.frombuffer(content.as_buffer(), "<f4")
                if raw.size % width:
                    raise ValueError(f"{path} doesn't hold whole rows of {width} numbers")
                rows = raw.reshape(-1, width)
                for i in range(0, len(rows), ROWS_A_SLICE):
                    part = rows[i : i + ROWS_A_SLICE]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(part)) + start + i), *(pa.array(part[:, j].astype(float)) for j in range(width))], names=["row_id", *names])

    kinds = ", ".join(["row_id long", *(f"`{n}` double" for n in names)])
    return records.select(F.lit(0).cast("long").alias("start"), "content").mapInArrow(run, kinds)


def read_dataset(spark: SparkSession, path: str, features: list[str] | None = None) -> DataFrame:
    """row_id, f0, f1, ..., y, split (train or test) of a dataset folder; sizes are held against meta.json."""
    meta = read_meta(spark, path)
    names = features or [f"f{i}" for i in range(meta["n_features"])]
    if len(names) != meta["n_features"]:
        raise ValueError(f"{len(names)} names for {meta['n_features']} features")
    out = None
    for split, (x, y) in FILES.items():
        rows = read_blob(spark, f"{path}/{x}", len(names), names).join(read_blob(spark, f"{path}/{y}", 1, ["y"]), "row_id", "full")
        found, bad = rows.agg(F.count("*"), F.count_if(F.col("y").isNull() | F.col(names[0]).isNull() if names else F.col("y").isNull())).first()
        if found != meta[COUNTS[split]] or bad:
            raise ValueError(f"{split}: {found} rows, {bad} without a partner; meta.json says {meta[COUNTS[split]]}")
        rows = rows.select("row_id", *names, "y").withColumn("split", F.lit(split))
        out = rows if out is None else out.union(rows)
    return out


def write_predictions(scored: DataFrame, path: str, score: str = "score", row_id: str = "row_id") -> None:
    """Parquet (row_id, score) in ranges of row_id."""
    scored.select(row_id, score).repartitionByRange(row_id).sortWithinPartitions(row_id).write.mode("overwrite").parquet(path)


def predictions_blob(scored: DataFrame, score: str = "score", row_id: str = "row_id") -> bytes:
    """Little-endian 32-bit floats in the order of row_id, brought to the driver row block by row block: for results that one file holds."""
    return b"".join(np.float32(r[0]).astype("<f4").tobytes() for r in scored.orderBy(row_id).select(score).toLocalIterator())


def model_bytes(model: Model, features: list[str] | None = None) -> bytes:
    """A model in the one-file binary form; encoder entries are ordered by key, so equal models give equal bytes."""
    features = features or model.features
    out = BytesIO()
    encoder = model.encoder if model.encoder and model.encoder.features else None
    number = lambda *v: out.write(struct.pack(f"<{len(v)}I", *v))
    array = lambda a, kind: (number(a.size), out.write(np.ascontiguousarray(a).astype(kind).tobytes()))
    out.write(MODEL_MAGIC)
    number(MODEL_VERSION, len(features), model.n_trees, model.feature.shape[1], int(model.objective == "logistic"))
    out.write(struct.pack("<ffQ", model.base, encoder.mean if encoder else 0.0, encoder.buckets if encoder else 0))
    names = encoder.features if encoder else []
    number(len(names), *(features.index(c) for c in names))
    array(model.feature, "<u4")
    array(model.threshold, "<f4")
    array(model.leaf, "<f4")
    rows = encoder.rows() if encoder else []
    number(len(names))
    for c in names:
        own = [(k, v) for f, k, v in rows if f == c]
        number(len(own))
        out.write(b"".join(struct.pack("<qf", k, v) for k, v in own))
    return out.getvalue()


def model_of_bytes(spark: SparkSession, raw: bytes, features: list[str] | None = None) -> Model:
    """A model from the one-file binary form. It has no gains and no variances. Hashed categories are refused: their buckets depend on constants of the writer."""
    at = 0

    def take(form: str):
        nonlocal at
        values = struct.unpack_from("<" + form, raw, at)
        at += struct.calcsize("<" + form)
        return values

    def array(kind: str) -> np.ndarray:
        nonlocal at
        (n,) = take("I")
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    if raw[:4] != MODEL_MAGIC:
        raise ValueError("not a model in the binary form")
    at = 4
    version, n_features, trees, depth, logistic = take("5I")
    if version != MODEL_VERSION:
        raise ValueError(f"version {version} of the binary form isn't known")
    base, mean, buckets = take("ffQ")
    if buckets:
        raise ValueError("a model with hashed categories can't be taken over")
    (n,) = take("I")
    categorical = list(take(f"{n}I"))
    feature, threshold, leaf = array("<u4").astype(np.int64).reshape(trees, depth), array("<f4").astype(float).reshape(trees, depth), array("<f4").astype(float).reshape(trees, -1)
    names = features or [f"f{i}" for i in range(n_features)]
    (n,) = take("I")
    rows = [(names[categorical[i]], *take("qf")) for i in range(n) for _ in range(take("I")[0])]
    encoder = TargetEncoder.of_rows(spark, [names[c] for c in categorical], mean, rows) if categorical else None
    objective = "logistic" if logistic else "l2"
    return Model(names, objective, base, feature, threshold, leaf, np.zeros((trees, depth)), np.zeros_like(leaf), encoder, Params(n_trees=trees, depth=depth, objective=objective, categorical=tuple(names[c] for c in categorical)))
