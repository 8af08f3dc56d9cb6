"""Scoring a streaming source with the same stateless operators as the batch jobs.

The scaler transform (P10) is a projection with literal parameters and the
network scorer (N8) is a ``mapInArrow`` pass; both are row-local, so they apply
unchanged to a ``readStream`` DataFrame with no state, watermark or shuffle. No
streaming-specific semantics (windows, late data) exist in the experiment, so
none are added here.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame

from kindling.operators.prepare import assemble, scaler_transform
from kindling.operators.scoring import batch_score
from kindling.session import ensure_checkpoint_dir


def score_stream(stream: DataFrame, params: dict, features: Sequence[str], model, key: str,
                 label: str | None = None, model_name: str = "model") -> DataFrame:
    """Scale ``features`` with fitted parameters, assemble them and score every row."""
    arr = assemble(scaler_transform(stream, params, features), features, "_x")
    return batch_score(arr, "_x", model, key=key, model_name=model_name, label=label)


def start_scoring(scored: DataFrame, path: str, query_name: str = "kindling_scores", trigger_once: bool = True):
    """Write scored rows to parquet at ``path`` (append mode, exactly-once via the sink's
    checkpoint, kept under the session's shared checkpoint folder)."""
    root = ensure_checkpoint_dir(scored.sparkSession)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("checkpointLocation", os.path.join(root, "streams", query_name))
              .option("path", path).queryName(query_name))
    writer = writer.trigger(availableNow=True) if trigger_once else writer
    return writer.start()
