"""Sources and sinks."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindling.operators.curves import Curves
from kindling.operators.fit import FrozenHeadModel
from kindling.operators.scoring import MODEL_BYTES, DenseNet, FrozenBlock
from kindling.sources.weights import SavedModel, build

TILE_BYTES = 4 << 20  # weights of one row of a saved model


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Parquet scan (S1). A missing path fails with Spark's PATH_NOT_FOUND error; no data is invented.

    Selecting ``columns`` here (or later) lets Catalyst prune the scan's ReadSchema.
    """
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Comparison table to CSV with a header and no index column (S3)."""
    df.write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, run_id: str | None = None) -> None:
    """Run report (S4): metric rows appended as JSON lines, tagged with the run id."""
    out = df.withColumn("run_id", F.lit(run_id)) if run_id is not None else df
    out.write.mode("append").json(path)


def save_model(model, path: str) -> None:
    """Persist a fitted model (S5): Spark ML models and pipelines as Spark writes them; a ``FrozenHeadModel``,
    ``FrozenBlock``, ``DenseNet`` or ``Curves`` as tiles of its weights ``(part, start, block)`` with a small description, and the fitted head."""
    if isinstance(model, DenseNet):
        parts = {f"{k}.{n}": a for k, (w, b, _) in enumerate(model.layers) for n, a in (("w", w), ("b", b))}
        _save_weights(parts, {"kind": "DenseNet", "acts": [a for _, _, a in model.layers]}, path)
    elif isinstance(model, Curves):
        parts = {f"{j}.{n}": a for j, kw in enumerate(zip(model.knots, model.shapes)) for n, a in zip(("x", "y"), kw)}
        _save_weights(parts, {"kind": "Curves", "features": model.features, "bias": model.bias}, path)
    elif isinstance(model, FrozenBlock):
        parts = {n: a for n, a in vars(model).items() if n != "act"}
        _save_weights(parts, {"kind": "FrozenBlock", "act": model.act}, path)
    elif isinstance(model, FrozenHeadModel):
        block = getattr(model.block, "value", model.block)  # a block that tasks open is read once here
        parts = {n: a for n, a in vars(block).items() if n != "act"}
        _save_weights(parts, {"kind": "FrozenHeadModel", "act": block.act, "features": model.features,
                              "key": model.key}, path)
        model.head.write().overwrite().save(f"{path}/head")
    else:
        model.write().overwrite().save(path)


def _tiles(parts: dict, tile_bytes: int = TILE_BYTES):
    """(part, start, block) of each run of at most ``tile_bytes`` of a part's weights in row order."""
    for name, a in parts.items():
        flat = np.ascontiguousarray(a, dtype="<f8").reshape(-1)
        step = max(1, tile_bytes // 8)
        for start in range(0, max(flat.size, 1), step):
            yield name, start, flat[start:start + step].tobytes()


def _save_weights(parts: dict, about: dict, path: str) -> None:
    """One binary row per tile of weights, in a folder of its own; the description, written last, names the folder that
    counts. A save that is ended in between leaves the model that was there."""
    spark = SparkSession.getActiveSession()
    folder = f"weights-{uuid.uuid4().hex}"
    old = _about(spark, path)
    names, starts, blocks = zip(*_tiles(parts))
    tiles = pa.table({"part": pa.array(names), "start": pa.array(starts, pa.int64()), "block": pa.array(blocks, pa.binary())})
    spark.createDataFrame(tiles).write.parquet(f"{path}/{folder}")
    about = about | {"shapes": {n: list(np.shape(a)) for n, a in parts.items()}, "weights": folder}
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
    if old and old.get("weights"):
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{old['weights']}")
        fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(fs_path, True)


def _about(spark: SparkSession, path: str) -> dict | None:
    """The description of the model saved at ``path``; None if there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return json.loads(spark.read.text(f"{path}/about").first().value)


def _load_weights(spark: SparkSession, path: str) -> tuple[dict, dict]:
    about = _about(spark, path)
    parts = {n: np.zeros(int(np.prod(shape, dtype=np.int64)), "<f8") for n, shape in about["shapes"].items()}
    for r in spark.read.parquet(f"{path}/{about['weights']}").toLocalIterator():  # a tile at a time
        block = np.frombuffer(r.block, "<f8")
        parts[r.part][r.start:r.start + len(block)] = block
    return about, {n: a.reshape(about["shapes"][n]) for n, a in parts.items()}


def saved_model(path: str, max_bytes: int = MODEL_BYTES) -> SavedModel:
    """The saved network or block at ``path`` as an address that tasks open: the driver reads its description only.

    Saving to the same path again removes the tiles of the model before, so a job that still runs on it would fail: give each
    model a path of its own."""
    spark = SparkSession.getActiveSession()
    about = _about(spark, path)
    if about is None:
        raise FileNotFoundError(f"no saved weights at {path}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{about['weights']}")
    uri = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    return SavedModel(uri, about, max_bytes)


def load_model(path: str, in_tasks: bool = False):
    """Load a model saved by :func:`save_model` (S5); the class comes from what was saved with it.

    With ``in_tasks`` networks and frozen blocks stay where they are and the tasks open them (:func:`saved_model`)."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.util import DefaultParamsReader

    spark = SparkSession.getActiveSession()
    about = _about(spark, path)
    if about is None:
        return DefaultParamsReader.loadParamsInstance(path, spark)
    if in_tasks and about["kind"] != "Curves":
        block = saved_model(path)
    else:
        about, parts = _load_weights(spark, path)
        if about["kind"] == "Curves":
            n = range(len(about["features"]))
            return Curves(about["features"], [parts[f"{j}.x"] for j in n], [parts[f"{j}.y"] for j in n], about["bias"])
        block = build(about, parts)
    if about["kind"] == "FrozenHeadModel":
        return FrozenHeadModel(block, PipelineModel.load(f"{path}/head"), about["features"], about["key"])
    return block
