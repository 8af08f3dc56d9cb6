"""Saved weights that tasks open themselves (N7, N8): the driver never holds or sends the model.

A model saved by ``save_model`` is a folder of tiles on shared storage. A ``SavedModel`` is only its address and its
description; the first batch that a Python worker scores reads the tiles, later batches and tasks of that worker use
what is kept. A worker that is lost takes nothing with it: the next one reads the folder again.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np

from kindling.operators.scoring import MODEL_BYTES, DenseNet, FrozenBlock

_OPEN: OrderedDict = OrderedDict()  # folder → (bytes, model) of this process, last used last


def filesystem(uri: str):
    """pyarrow's file system and the path in it, of a qualified folder name as Hadoop writes it."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:"):].lstrip("/")
    scheme, rest = uri.split(":", 1)
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}")


def read_parts(uri: str, shapes: dict) -> dict:
    """The arrays of a folder of tiles ``(part, start, block)``, a few tiles in memory beside them."""
    import pyarrow.dataset as ds

    where, path = filesystem(uri)
    parts = {n: np.zeros(math.prod(shape), "<f8") for n, shape in shapes.items()}
    read = dict.fromkeys(parts, 0)
    for batch in ds.dataset(path, filesystem=where, format="parquet").to_batches(batch_size=4, batch_readahead=1, fragment_readahead=1):
        for name, start, block in zip(*(batch.column(c) for c in ("part", "start", "block"))):
            values = np.frombuffer(block.as_buffer(), "<f8")
            parts[name.as_py()][start.as_py():start.as_py() + len(values)] = values
            read[name.as_py()] += len(values)
    short = [n for n, a in parts.items() if read[n] != a.size]
    if short:
        raise OSError(f"the saved weights in {uri} lack values of {short}")
    return {n: a.reshape(shapes[n]) for n, a in parts.items()}


def build(about: dict, parts: dict):
    """The network or frozen block that the description and the arrays state."""
    if about["kind"] == "DenseNet":
        return DenseNet([(parts[f"{k}.w"], parts[f"{k}.b"], act) for k, act in enumerate(about["acts"])])
    return FrozenBlock(**parts, act=about["act"])


@dataclass(frozen=True)
class SavedModel:
    """Address of a saved ``DenseNet``, ``FrozenBlock`` or frozen head's block, to be given to ``batch_score`` or
    ``with_frozen_features`` in place of the model.

    ``max_bytes`` bounds what one Python worker keeps, over all models it has opened through this class; the model that
    was used longest ago goes first. A model larger than that is refused on the driver, before any task starts."""

    uri: str
    about: dict
    max_bytes: int = MODEL_BYTES

    open_in_task = True

    def __post_init__(self):
        if self.kind not in ("DenseNet", "FrozenBlock", "FrozenHeadModel"):
            raise ValueError(f"a saved {self.kind} has no weights for tasks to open")
        if self.nbytes > self.max_bytes:
            raise ValueError(f"the model has {self.nbytes} bytes of weights; a worker keeps at most {self.max_bytes}")

    @property
    def kind(self) -> str:
        return self.about["kind"]

    @property
    def nbytes(self) -> int:
        return 8 * sum(math.prod(s) for s in self.about["shapes"].values())

    @property
    def width(self) -> int:
        return self.about["shapes"]["0.w" if self.kind == "DenseNet" else "wv"][0]

    @property
    def value(self):
        """The model itself, in the process that asks; named like a broadcast's value."""
        if self.uri not in _OPEN:
            while _OPEN and sum(n for n, _ in _OPEN.values()) + self.nbytes > self.max_bytes:
                _OPEN.popitem(last=False)
            _OPEN[self.uri] = self.nbytes, build(self.about, read_parts(self.uri, self.about["shapes"]))
        _OPEN.move_to_end(self.uri)
        return _OPEN[self.uri][1]
