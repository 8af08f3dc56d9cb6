"""Hard-negative mining by angular triangle filtering.

Every vector stores its norm and its angles to a few reference directions (chosen once from a bounded sample; they
only decide how much is filtered, never the result). For an anchor at angle ``x`` and a row at angle ``y`` to the same
direction, the angle between the two lies in ``[|x - y|, min(x + y, 2 pi - x - y)]``: the cosine of that interval times
both norms bounds the score from both sides. Angles are widened by ``SLACK``, more than all rounding in them, so the bounds are
safe; only rows whose bounds overlap what an anchor looks for get integer scoring.

Rows are dealt at random into blocks of about ``BLOCK_ROWS`` rows, so no label or repeated vector makes a block large. In a block,
rows lie in the order of their nearest direction and the angle to it: what an anchor needs of a direction is one slice,
found by two binary searches. The anchors visit every block as a stream behind the block's rows (the stated query set
against all rows), and leave at most a few rows per block and anchor. Twice: for the positives, whose bound is the worst
of those already found, and for the negatives, whose bounds are the windows of all positives of the anchor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindling.session import cut_lineage

BLOCK_ROWS = 8192
TOGETHER = 128  # anchors scored together
REFERENCES = 12
SAMPLE_ROWS = 2048  # the documented bound of the sample for the reference directions: the rows of the smallest hashes
SLACK = 2e-6  # radians; an arc cosine of a rounded quotient is off by less than 4e-7
EXACT = float(1 << 52)  # products of norms below this have exact float64 scores
NO_ID = np.iinfo(np.int64).max  # order of a null id: last
NONE = np.iinfo(np.int64).min  # score of no row

_ROWS = "mark boolean, row long, vec_id long, label string, vec binary, wide boolean, norm double, angles binary"


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of length 1 (zero rows stay zero) and the norms."""
    top = np.abs(v).max(axis=1, initial=0.0)
    scaled = v / np.where(top > 0, top, 1.0)[:, None]
    size = np.sqrt((scaled * scaled).sum(axis=1))
    with np.errstate(over="ignore"):
        return scaled / np.where(size > 0, size, 1.0)[:, None], top * size


def pick_directions(sample: np.ndarray, n: int = REFERENCES) -> np.ndarray:
    """Up to ``n`` unit vectors of the sample, each the farthest from those before it."""
    unit, norm = _unit(sample)
    unit = unit[norm > 0]
    if len(unit) == 0:
        return np.zeros((1, sample.shape[1]))
    picked = [0]
    nearest = unit @ unit[0]
    while len(picked) < min(n, len(unit)):
        k = int(nearest.argmin())
        picked.append(k)
        nearest = np.maximum(nearest, unit @ unit[k])
    return unit[picked]


def _matrix(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each component, shorter vectors filled up with zeros, and which rows are whole: a vector
    that is there, without a null or non-finite component."""
    there = lists.is_valid().to_numpy(zero_copy_only=False)
    size = np.where(there, lists.value_lengths().fill_null(0).to_numpy(), 0).astype(np.int64)
    flat = lists.flatten()  # leaves null lists out
    value = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
    with np.errstate(over="ignore", invalid="ignore"):
        value = np.floor(scale * value)
    out = np.zeros((len(size), int(size.max(initial=0))))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(value)) - np.repeat(np.cumsum(size) - size, size)] = value
    whole = there & np.isfinite(out).all(axis=1)
    return np.where(whole[:, None], out, 0.0), whole


def _prepare(directions: np.ndarray, scale: int):
    """(mark, vec_id, label, vector) to the rows of ``_ROWS``."""
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            v, whole = _matrix(batch.column(3), scale)
            keep = np.flatnonzero(whole)
            v = v[keep]
            unit, norm = _unit(v)
            width = max(v.shape[1], directions.shape[1])
            wider = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
            angles = np.arccos(np.clip(wider(unit) @ wider(directions).T, -1, 1))
            wide = (np.abs(v) >= 1 << 31).any(axis=1)
            vec = [x.astype("<f8" if w else "<i4").tobytes() for x, w in zip(v, wide.tolist())]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array(row + np.arange(len(keep))), batch.column(1).take(at), batch.column(2).take(at),
                 pa.array(vec, pa.binary()), pa.array(wide), pa.array(norm), pa.array([a.tobytes() for a in angles.astype("<f8")], pa.binary())],
                names=["mark", "row", "vec_id", "label", "vec", "wide", "norm", "angles"])
            row += len(keep)
    return prepare


class _Part:
    """Rows of a batch as arrays."""

    def __init__(self, batch: pa.RecordBatch | pa.Table):
        column = lambda name: batch.column(name).combine_chunks() if isinstance(batch, pa.Table) else batch.column(name)
        self.row = column("row").to_numpy()
        ids = column("vec_id")
        self.no_id = ids.is_null().to_numpy(zero_copy_only=False)
        self.id = np.where(self.no_id, NO_ID, ids.fill_null(0).to_numpy())
        self.label = column("label").to_pylist()
        self.norm = column("norm").to_numpy()
        self.angles = np.frombuffer(b"".join(column("angles").to_pylist()), "<f8").reshape(len(self.row), -1)
        raw, wide = column("vec").to_pylist(), column("wide").to_pylist()
        parts = [np.frombuffer(x, "<f8" if w else "<i4") for x, w in zip(raw, wide)]
        self.vec = np.zeros((len(parts), max(map(len, parts), default=0)))
        if len({len(p) for p in parts}) == 1 and not any(wide):
            self.vec[:] = np.frombuffer(b"".join(raw), "<i4").reshape(len(parts), -1)
        else:
            for i, p in enumerate(parts):
                self.vec[i, :len(p)] = p

    def reorder(self, order: np.ndarray) -> None:
        for name in ("row", "no_id", "id", "norm", "angles", "vec"):
            setattr(self, name, getattr(self, name)[order])
        self.label = [self.label[i] for i in order.tolist()]


class _Block(_Part):
    """A block of rows in the order of (nearest direction, angle to it), with the runs of the directions."""

    def __init__(self, table: pa.Table):
        super().__init__(table)
        cell = self.angles.argmin(axis=1)
        self.reorder(np.lexsort((self.angles[np.arange(len(cell)), cell], cell)))
        cell = np.sort(cell)
        codes: dict = {}
        self.code = np.array([codes.setdefault(x, len(codes)) for x in self.label], np.int64)
        self.codes = codes
        edge = np.flatnonzero(np.diff(cell, prepend=-1, append=len(self.angles) + cell.max(initial=0) + 1))
        self.runs = [(int(cell[i]), i, j) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]


def _arc(x: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x, -1.0, 1.0))


def run_slices(block: _Block, run: tuple[int, int, int], angles: np.ndarray, norms: np.ndarray, low: np.ndarray,
               high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """[from, to) of the rows of one run whose score with each anchor may lie in [low, high] (float, may be infinite)."""
    cell, i, j = run
    least, most = block.norm[i:j].min(), block.norm[i:j].max()
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        # score <= |a| n cos(gap): with n the largest norm for a positive bound, the smallest for a negative one
        reach = np.where(low > 0, low / (norms * most), low / (norms * least))
        reach = np.where(np.isnan(reach), np.where(low > 0, np.inf, -np.inf), reach)
        wide = np.where(reach > 1 + 1e-9, -1.0, _arc(reach) + SLACK)  # the largest gap that still reaches low; -1: none
        # score >= |a| n cos(sum): the other way round
        floor = np.where(high >= 0, high / (norms * least), high / (norms * most))
        floor = np.where(np.isnan(floor), np.where(high >= 0, np.inf, -np.inf), floor)
        far = np.where(floor < -1 - 1e-9, np.inf, _arc(floor) - SLACK)  # the least sum that still falls to high
    theta = block.angles[i:j, cell]
    x = angles[:, cell]
    first = np.searchsorted(theta, np.maximum(x - wide, far - x) - SLACK, side="left")
    last = np.searchsorted(theta, np.minimum(x + wide, 2 * np.pi - far - x) + SLACK, side="right")
    # the other directions bound the whole run
    lo, hi = block.angles[i:j].min(axis=0), block.angles[i:j].max(axis=0)
    gap = np.maximum(np.maximum(lo - angles, angles - hi), 0.0).max(axis=1)
    small, large = angles + lo, angles + hi
    fold = np.where((small <= np.pi) & (large >= np.pi), np.pi, np.maximum(np.minimum(small, 2 * np.pi - small),
                                                                           np.minimum(large, 2 * np.pi - large))).min(axis=1)
    none = (wide < 0) | (gap > wide + SLACK) | (fold < far - SLACK)
    return np.where(none, 0, first) + i, np.where(none, 0, np.maximum(first, last)) + i


def integer_scores(a: np.ndarray, a_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: float64 where all partial sums are exact, else Python's integers, held to the
    64-bit range."""
    width = max(a.shape[1], v.shape[1])
    a, v = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, v))
    if a_norm.max(initial=0) * v_norm.max(initial=0) < EXACT:
        return (a @ v.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    exact = whole(a) @ whole(v).T if a.size and v.size else np.zeros((len(a), len(v)), object)
    return np.clip(exact, NONE + 1, NO_ID).astype(np.int64)


def best_of(group: np.ndarray, score: np.ndarray, ids: np.ndarray, row: np.ndarray, limit: int) -> np.ndarray:
    """Places of the first ``limit`` of each group: highest score, then smallest id, then smallest row."""
    order = np.lexsort((row, ids, -score, group))
    g = group[order]
    head = np.flatnonzero(np.diff(g, prepend=-1))
    place = np.arange(len(g)) - np.repeat(head, np.diff(np.append(head, len(g))))
    return order[place < limit]


class _Best:
    """The best rows found so far: ``limit`` per group, as parallel arrays."""

    def __init__(self, groups: int, limit: int):
        self.limit = limit
        self.group, self.score, self.id, self.row, self.at = (np.zeros(0, np.int64) for _ in range(5))
        self.bound = np.full(groups, NONE, np.int64)  # score that a further row must reach

    def add(self, group, score, ids, row, at) -> None:
        new = [np.concatenate(x) for x in zip((self.group, self.score, self.id, self.row, self.at), (group, score, ids, row, at))]
        keep = best_of(*new[:4], self.limit)
        self.group, self.score, self.id, self.row, self.at = (x[keep] for x in new)
        full = np.flatnonzero(np.bincount(self.group, minlength=len(self.bound)) == self.limit)
        least = np.full(len(self.bound), NO_ID, np.int64)
        np.minimum.at(least, self.group, self.score)
        self.bound[full] = least[full]


def _candidates(score: np.ndarray, wanted: np.ndarray, bound: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, column) of the wanted scores that can be among an anchor's first ``limit``, all ties included."""
    s = np.where(wanted, score, NONE)
    if s.shape[1] > limit:
        bound = np.maximum(bound, np.partition(s, s.shape[1] - limit, axis=1)[:, s.shape[1] - limit])
    return np.nonzero(wanted & (s >= bound[:, None]))


def _scan(block: _Block, part: _Part, low: np.ndarray, high: np.ndarray, take) -> None:
    """Call ``take(anchors, columns, scores, inside)`` for the overlapping slices; ``low`` may rise in between."""
    for run in block.runs:
        first, last = run_slices(block, run, part.angles, part.norm, low(), high)
        live = np.flatnonzero(last > first)
        live = live[np.argsort(first[live], kind="stable")]
        for k in range(0, len(live), TOGETHER):
            some = live[k:k + TOGETHER]
            i, j = int(first[some].min()), int(last[some].max())
            s = integer_scores(part.vec[some], part.norm[some], block.vec[i:j], block.norm[i:j])
            at = np.arange(i, j)[None, :]
            take(some, np.arange(i, j), s, (at >= first[some][:, None]) & (at < last[some][:, None]))


def _positives(limit: int):
    def find(block: _Block, part: _Part, batch: pa.RecordBatch) -> pa.RecordBatch:
        best = _Best(len(part.row), limit)
        own = np.array([block.codes.get(x, -1) for x in part.label], np.int64)

        def take(some, at, s, inside):
            wanted = inside & (block.code[at][None, :] == own[some][:, None]) & (block.row[at][None, :] != part.row[some][:, None])
            a, c = _candidates(s, wanted, best.bound[some], limit)
            best.add(some[a], s[a, c], block.id[at[c]], block.row[at[c]], at[c])

        def low():
            return np.where(best.bound == NONE, -np.inf, best.bound.astype(float))

        _scan(block, part, low, np.full(len(part.row), np.inf), take)
        ids = pa.array(best.id, pa.int64(), mask=block.no_id[best.at])
        return pa.RecordBatch.from_arrays(
            [pa.array(part.row[best.group]), pa.array(part.id[best.group]), pa.array(best.row), ids, pa.array(best.score)],
            names=["anchor", "anchor_id", "positive", "positive_id", "positive_score"])
    return find


def _negatives(limit: int, low_percent: int, high_percent: int):
    def find(block: _Block, part: _Part, batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = batch.column("scores").to_pylist()  # of the anchor's positives, by rank
        width = max(map(len, scores))
        low, high = np.full((len(scores), width), NO_ID, np.int64), np.full((len(scores), width), NONE, np.int64)
        for i, own in enumerate(scores):
            for k, p in enumerate(own):
                low[i, k], high[i, k] = max(-(-low_percent * p // 100), NONE + 1), min(high_percent * p // 100, NO_ID)
        best = _Best(len(scores) * width, limit)
        own = np.array([block.codes.get(x, -1) for x in part.label], np.int64)
        open_ = low <= high
        least = np.where(open_, low, NO_ID).min(axis=1).astype(float)
        most = np.where(open_, high, NONE).max(axis=1).astype(float)
        least[~open_.any(axis=1)] = np.inf

        def take(some, at, s, inside):
            other = inside & (block.code[at][None, :] != own[some][:, None])
            for k in range(width):
                group = some * width + k
                wanted = other & (s >= low[some, k][:, None]) & (s <= high[some, k][:, None])
                a, c = _candidates(s, wanted, best.bound[group], limit)
                best.add(group[a], s[a, c], block.id[at[c]], block.row[at[c]], at[c])

        _scan(block, part, lambda: least, most, take)
        ids = pa.array(best.id, pa.int64(), mask=block.no_id[best.at])
        return pa.RecordBatch.from_arrays(
            [pa.array(part.row[best.group // width]), pa.array((best.group % width + 1).astype(np.int32)), pa.array(best.row), ids,
             pa.array(best.score)], names=["anchor", "k", "negative", "negative_id", "negative_score"])
    return find


def _visit(find):
    """Stream step over rows sorted by (g, kind): gather the rows of a block (kind 0), then send its anchors (kind 1)
    through ``find`` batch by batch. A block is bounded; the anchors are not held."""
    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, held, block = None, [], None
        for batch in batches:
            key = batch.column("g").to_numpy() * 2 + batch.column("kind").to_numpy()
            edge = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                part, now, anchors = batch.slice(i, j - i), int(key[i]) // 2, int(key[i]) % 2 == 1
                if now != g:
                    g, held, block = now, [], None
                if not anchors:
                    held.append(part)
                elif held or block is not None:
                    if block is None:
                        block, held = _Block(pa.Table.from_batches(held)), []
                    for lo in range(0, part.num_rows, 1024):
                        some = part.slice(lo, 1024)
                        yield find(block, _Part(some), some)
    return visit


def _meet(rows: DataFrame, anchors: DataFrame, n: int, find, schema: str) -> DataFrame:
    """All anchors with all blocks of rows; ``anchors`` has the columns of ``rows`` and ``scores``."""
    g = F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("g")
    left = rows.select(F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("g"), F.lit(0).alias("kind"), "*",
                       F.lit(None).cast("array<long>").alias("scores"))
    right = anchors.select(g, F.lit(1).alias("kind"), *rows.columns, "scores")
    return left.unionByName(right).repartition(n, "g").sortWithinPartitions("g", "kind").mapInArrow(_visit(find), schema)


def hard_negatives(vectors: DataFrame, anchor: Column, vector_col: str = "embedding", label_col: str = "label",
                   id_col: str = "vec_id", scale: int = 256, positives: int = 5, negatives: int = 3, low_percent: int = 50,
                   high_percent: int = 95) -> DataFrame:
    """Hard negatives of the rows where ``anchor`` holds: (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the inner product of components floor(``scale`` * x). An anchor's positives are the ``positives`` other
    rows of its label with the highest scores; a positive's negatives are the first ``negatives`` rows of another label
    with ``low_percent`` to ``high_percent`` percent of its score. Equal scores go by smaller id; a null id comes last,
    rows of one id by their place in the table. Rows, not ids, are compared: a copy of a row is another row, and an
    anchor that occurs twice is answered twice. Rows without a label or vector, or with a null or non-finite component
    (or one beyond 10**305), take no part; a shorter vector counts as filled up with zeros, and a zero vector scores 0.
    Scores beyond 64 bits are held at the limit. Anchors without positives, and positives without negatives in their
    window, give no rows; an empty table gives none. Other columns are ignored.
    """
    chosen = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"),
                            F.col(vector_col).alias("v"), F.coalesce(anchor, F.lit(False)).alias("is_anchor"))
    usable = chosen.where("label is not null and v is not null")
    sample = usable.select("v", F.xxhash64("vec_id", "label").alias("h")).orderBy("h").limit(SAMPLE_ROWS).toArrow()
    matrix, whole = _matrix(sample.column("v").combine_chunks() if sample.num_rows else pa.array([], pa.list_(pa.float64())), scale)
    directions = pick_directions(matrix[whole])
    rows = cut_lineage(usable.select("is_anchor", "vec_id", "label", "v").mapInArrow(_prepare(directions, scale), _ROWS))
    total = rows.count()
    n = max(1, -(-total // BLOCK_ROWS))
    anchors = rows.where("mark").drop("mark")
    rows = rows.drop("mark")
    nothing = F.lit(None).cast("array<long>").alias("scores")
    near = _meet(rows, anchors.select("*", nothing), n, _positives(positives),
                 "anchor long, anchor_id long, positive long, positive_id long, positive_score long")
    order = Window.partitionBy("anchor").orderBy(F.col("positive_score").desc(), F.col("positive_id").asc_nulls_last(), "positive")
    near = cut_lineage(near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= positives))
    wanted = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("k", "positive_score"))).alias("p"))
    wanted = anchors.join(wanted.select(F.col("anchor").alias("row"), F.col("p.positive_score").alias("scores")), "row")
    far = _meet(rows, wanted, n, _negatives(negatives, low_percent, high_percent),
                "anchor long, k int, negative long, negative_id long, negative_score long")
    order = Window.partitionBy("anchor", "k").orderBy(F.col("negative_score").desc(), F.col("negative_id").asc_nulls_last(), "negative")
    far = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return far.join(near.select("anchor", "k", "anchor_id", "positive_id", "positive_score"), ["anchor", "k"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

