"""Hard negatives by a Voronoi-partitioned, distributed nearest-neighbour join.

Candidates get one more component that makes all norms equal, anchors a zero in its place, so that the
largest inner product is the smallest distance. Pivots, a bounded sample of the candidates, cut the space
into cells. A candidate goes to the cell of its nearest pivot and is stored in blocks of one cell and
label, in order of its radius (the distance to that pivot); anchors are grouped by cell and label.

Two joins follow. For positives, a summary of the smallest radii of each cell and label bounds how far
the k-th other row of an anchor's label can be; for negatives, the positives' scores bound it on both
sides. By the triangle inequality, a candidate of cell j within t of an anchor that is d from pivot j has a
radius between d - t and d + t, and none is there if the plane between the two pivots is further than t. So
each anchor group has one interval of radii a cell, and only blocks that an interval meets are
replicated to the group, where the join is exact. Bounds are widened by what doubles may be off; they spare
work, never results.

Defined cases: rows with a null id, label or vector, an empty vector, or a null or non-finite component
take no part; only vectors of one dimension are compared; ties go to the smaller id; repeated rows
are candidates each on its own, but a row with the anchor's id never is; of anchor rows that share an id
the one with the smallest label and vector stands for all; fewer candidates give fewer rows; a
negative positive score has no range and gives none; an empty table gives none; other columns are not
read. Scores past a long raise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairlab.llm.common import written
from pairlab.llm.topk import _best, _whole
from pairlab.llm.vectors import finite

#: Candidates that one pivot stands for, about, and pivots at most: what is broadcast doesn't grow with the table.
PIVOT_ROWS, PIVOTS = 4096, 512
#: Bytes of a block of candidates, anchors of a group, and bytes of all anchor groups that may be broadcast.
BLOCK_BYTES, GROUP_ROWS, GROUP_BYTES = 1_000_000, 512, 32_000_000
#: What a bound is widened by, as a share of the norms.
_SLACK = 1e-6

_PLACED = "id long, label long, dim int, cell int, radius double, data binary"
_BLOCKS = "block long, dim int, cell int, label long, low double, high double, ids binary, data binary, near_ids array<long>, near_radii array<double>"
_GROUPS = "group long, dim int, cell int, label long, ids binary, data binary, positive_ids binary, positive_scores binary"


class Cells:
    """Pivots of each dimension, in the space with the levelling component."""

    def __init__(self, sample: list[list[float]], scale: int, norm: float):
        self.scale, self.norm = scale, norm  # norm: at least that of any candidate, or infinite where doubles end
        self.pivots = {}
        by_dim: dict[int, list] = {}
        for vec in sample:
            by_dim.setdefault(len(vec), []).append(vec)
        if np.isfinite(norm):
            for dim, vecs in by_dim.items():
                x = np.unique(np.floor(np.array(vecs) * scale), axis=0)
                self.pivots[dim] = np.c_[x, self.level(x)]

    def level(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.norm**2 - np.square(x).sum(axis=1), 0.0))

    def of(self, dim: int) -> np.ndarray:
        """The pivots of a dimension; one at the origin where the sample has none."""
        return self.pivots.get(dim, np.r_[np.zeros(dim), self.norm if np.isfinite(self.norm) else 0.0][None])

    def distances(self, x: np.ndarray, level: np.ndarray | float) -> np.ndarray:
        """Distance of each row of x, with its levelling component, to each pivot."""
        p = self.of(x.shape[1])
        own = np.square(x).sum(axis=1) + np.square(level)
        inner = x @ p[:, :-1].T + np.multiply.outer(np.broadcast_to(level, len(x)), p[:, -1])
        return np.sqrt(np.maximum(own[:, None] + np.square(p).sum(axis=1) - 2 * inner, 0.0))


def _vectors(batch, at: int = 2):
    """(dimension, places in the batch, matrix) of the vectors of each dimension, a thousand at a time."""
    lists = batch.column(at)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(lists.offsets.to_numpy())
    starts = np.cumsum(sizes) - sizes
    for dim in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dim)
        for lo in range(0, len(rows), 1000):
            part = rows[lo : lo + 1000]
            yield dim, part, flat[starts[part][:, None] + np.arange(dim)]


def _placed(batches, cells: Cells, anchors: bool):
    """Rows (id, label, vec) with the cell of their nearest pivot, their distance to it, and the whole components."""
    for b in batches:
        if not b.num_rows:
            continue
        for dim, rows, raw in _vectors(b):
            x = np.floor(raw * cells.scale)
            if np.isfinite(cells.norm):
                d = cells.distances(x, 0.0 if anchors else cells.level(x))
                cell = d.argmin(axis=1)
                radius = d[np.arange(len(x)), cell]
            else:
                cell, radius = np.zeros(len(x), int), np.zeros(len(x))
            took = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(took), b.column(1).take(took), pa.array(np.full(len(x), dim, np.int32)), pa.array(cell.astype(np.int32)), pa.array(radius), pa.array([v.tobytes() for v in x], pa.binary())],
                names=["id", "label", "dim", "cell", "radius", "data"],
            )


def _runs(batches, keys: list[str], most):
    """Tables of neighbouring rows that are equal in the keys, at most ``most(keys)`` rows each."""
    held: list = []
    size, now = 0, None
    for b in batches:
        cols = [b.column(b.schema.get_field_index(k)).to_pylist() for k in keys]
        rows = list(zip(*cols))
        lo = 0
        while lo < len(rows):
            if now is not None and (rows[lo] != now or size >= most(now)):
                yield now, pa.Table.from_batches(held)
                held, size, now = [], 0, None
            now = rows[lo]
            hi = lo
            while hi < len(rows) and rows[hi] == now and size + hi - lo < most(now):
                hi += 1
            held.append(b.slice(lo, hi - lo))
            size, lo = size + hi - lo, hi
    if held:
        yield now, pa.Table.from_batches(held)


def _number(count: int) -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 32 | count


def _packed_blocks(batches, near: int):
    for n, ((dim, cell, label), t) in enumerate(_runs(batches, ["dim", "cell", "label"], lambda k: max(1, BLOCK_BYTES // (8 * k[0])))):
        ids, radii = t.column("id").to_numpy(), t.column("radius").to_numpy()
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[:near]  # rows are in order of the radius
        yield pa.RecordBatch.from_pylist(
            [{"block": _number(n), "dim": dim, "cell": cell, "label": label, "low": radii[0], "high": radii[-1], "ids": ids.astype(np.int64).tobytes(), "data": b"".join(t.column("data").to_pylist()), "near_ids": ids[first].tolist(), "near_radii": radii[first].tolist()}],
            schema=pa.schema([("block", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("label", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("ids", pa.binary()), ("data", pa.binary()), ("near_ids", pa.list_(pa.int64())), ("near_radii", pa.list_(pa.float64()))]),
        )


def _packed_groups(batches, k: int):
    """Groups of anchors of one cell and label; positives, if there are any, in k columns, and -1 as their score where there are fewer."""
    for n, ((dim, cell, label), t) in enumerate(_runs(batches, ["dim", "cell", "label"], lambda _: GROUP_ROWS)):
        row = {"group": _number(n), "dim": dim, "cell": cell, "label": label, "ids": t.column("id").to_numpy().astype(np.int64).tobytes(), "data": b"".join(t.column("data").to_pylist()), "positive_ids": None, "positive_scores": None}
        if "positives" in t.column_names:
            p_ids, p_scores = np.full((t.num_rows, k), -1, np.int64), np.full((t.num_rows, k), -1, np.int64)
            for i, own in enumerate(t.column("positives").to_pylist()):
                p_ids[i, : len(own)], p_scores[i, : len(own)] = [p["vec_id"] for p in own], [p["score"] for p in own]
            row |= {"positive_ids": p_ids.tobytes(), "positive_scores": p_scores.tobytes()}
        yield pa.RecordBatch.from_pylist([row], schema=pa.schema([("group", pa.int64()), ("dim", pa.int32()), ("cell", pa.int32()), ("label", pa.int64())] + [(c, pa.binary()) for c in ("ids", "data", "positive_ids", "positive_scores")]))


def _doubles(raw: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(raw, np.float64).reshape(-1, dim)


def _needed(cells: Cells, row: dict, within: np.ndarray, beyond: np.ndarray):
    """(cell, low, high): radii of the candidates that are ``within`` some anchor of the group and not ``beyond`` nearer to it."""
    q = _doubles(row["data"], row["dim"])
    if not np.isfinite(cells.norm):
        return [(0, -np.inf, np.inf)] if (within >= 0).any() else []
    pivots = cells.of(row["dim"])
    d = cells.distances(q, 0.0)
    slack = _SLACK * (np.sqrt(np.square(q).sum(axis=1)) + cells.norm + 1)
    t = (within + slack)[:, None]
    home = pivots[row["cell"]]
    apart = np.sqrt(np.square(pivots - home).sum(axis=1))
    plane = np.divide(np.square(d) - np.square(d[:, row["cell"], None]), 2 * apart, out=np.zeros_like(d), where=apart > 0)
    low = np.maximum(np.maximum(d - t, (beyond - slack)[:, None] - d), 0.0)
    high = np.broadcast_to(d + t, d.shape)
    wanted = (plane <= t + slack[:, None]) & (within >= 0)[:, None] & (low <= high)
    low, high = np.where(wanted, low, np.inf).min(axis=0), np.where(wanted, high, -np.inf).max(axis=0)
    return [(int(c), low[c], high[c]) for c in np.flatnonzero(wanted.any(axis=0))]


def _intervals(batches, cells: Cells, reach):
    """The radii that each group needs of each cell; reach(row, q) gives the distances of _needed."""
    for b in batches:
        for row in b.to_pylist():
            found = _needed(cells, row, *reach(row))
            if found:
                c, low, high = zip(*found)
                n = len(c)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["group"]] * n), pa.array([row["dim"]] * n, pa.int32()), pa.array([row["label"]] * n, pa.int64()), pa.array(c, pa.int32()), pa.array(low, pa.float64()), pa.array(high, pa.float64())],
                    names=["group", "dim", "label", "cell", "least", "most"],
                )


_NEEDS = "group long, dim int, label long, cell int, least double, most double"


def _reach_positives(cells: Cells, k: int):
    """The k-th smallest of distance to the pivot plus radius, over the summary's rows of other ids, is no less than the distance of the k-th other row."""

    def reach(row):
        q, ids = _doubles(row["data"], row["dim"]), np.frombuffer(row["ids"], np.int64)
        near = row["nearest"] or []
        within = np.full(len(q), np.inf)
        if np.isfinite(cells.norm) and near:
            d = cells.distances(q, 0.0)
            cell, other, radius = (np.array([x[f] for x in near]) for f in ("cell", "id", "radius"))
            for i in range(len(q)):
                bound = (d[i, cell] + radius)[other != ids[i]]
                if len(bound) >= k:
                    within[i] = np.partition(bound, k - 1)[k - 1]
        return within, np.zeros(len(q))

    return reach


def _reach_negatives(cells: Cells, k: int, low: int, high: int):
    def reach(row):
        q = _doubles(row["data"], row["dim"])
        scores = np.frombuffer(row["positive_scores"], np.int64).reshape(len(q), k)
        some = (scores >= 0).any(axis=1)
        if not np.isfinite(cells.norm):
            return np.where(some, np.inf, -1.0), np.zeros(len(q))
        least = np.where(scores >= 0, scores, np.iinfo(np.int64).max).min(axis=1) * (low / high)
        base = np.square(q).sum(axis=1) + cells.norm**2
        within = np.sqrt(np.maximum(base - 2 * least, 0.0))
        beyond = np.sqrt(np.maximum(base - 2.0 * scores.max(axis=1), 0.0))
        return np.where(some, within, -1.0), beyond

    return reach


def _both(row: dict):
    q_ids, ids = np.frombuffer(row["g_ids"], np.int64), np.frombuffer(row["ids"], np.int64)
    q, c = _whole(_doubles(row["g_data"], row["dim"]), 1), _whole(_doubles(row["data"], row["dim"]), 1)
    if q.dtype != c.dtype:
        q, c = q.astype(object), c.astype(object)
    return q_ids, ids, q @ c.T


def _longs(values) -> pa.Array:
    return pa.array(np.array([int(v) for v in values], np.int64))


def _join_positives(batches, k: int):
    for b in batches:
        for row in b.to_pylist():
            q_ids, ids, s = _both(row)
            r, j = np.nonzero(q_ids[:, None] != ids[None, :])
            best = _best(r, s[r, j], ids[j], k)
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[r[best]]), pa.array(ids[j[best]]), _longs(s[r[best], j[best]])], names=["anchor_id", "vec_id", "score"])


def _join_negatives(batches, k: int, n_positives: int, low: int, high: int):
    for b in batches:
        for row in b.to_pylist():
            q_ids, ids, s = _both(row)
            p_ids, p_scores = (np.frombuffer(row[c], np.int64).reshape(-1, n_positives) for c in ("g_positive_ids", "g_positive_scores"))
            other = q_ids[:, None] != ids[None, :]
            for at in range(n_positives):
                p = p_scores[:, at].astype(object) if s.dtype == object else p_scores[:, at].astype(np.float64)
                # Whole numbers: low * p <= high * s exactly where s is at least the ceiling of low * p / high.
                least = np.array([-((-low * int(v)) // high) for v in p_scores[:, at]], s.dtype)
                r, j = np.nonzero((p_scores[:, at] >= 0)[:, None] & other & (s >= least[:, None]) & (s <= p[:, None]))
                if len(r):
                    best = _best(r, s[r, j], ids[j], k)
                    r, j = r[best], j[best]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q_ids[r]), pa.array(np.full(len(r), at, np.int32)), pa.array(p_ids[r, at]), pa.array(p_scores[r, at]), pa.array(ids[j]), _longs(s[r, j])],
                        names=["anchor_id", "nth", "positive_id", "positive_score", "negative_id", "negative_score"],
                    )


def _replicated(needs: DataFrame, blocks: DataFrame, groups: DataFrame, same_label: bool) -> DataFrame:
    """Each anchor group (columns g_*) beside each block that one of its intervals meets."""
    about = blocks.select("block", "dim", "cell", F.col("label").alias("own_label"), "low", "high")
    labels = F.col("label") == F.col("own_label") if same_label else F.col("label") != F.col("own_label")
    pairs = needs.join(about, ["dim", "cell"]).filter(labels & (F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most"))).select("group", "block")
    g = groups.select("group", *[F.col(c).alias(f"g_{c}") for c in ("ids", "data", "positive_ids", "positive_scores")])
    size = g.agg(F.sum(F.octet_length("g_data") + F.octet_length("g_ids") * 12)).first()[0] or 0
    return pairs.join(blocks.select("block", "dim", "ids", "data"), "block").join(F.broadcast(g) if size <= GROUP_BYTES else g, "group")


def _grouped(anchors: DataFrame, k: int) -> DataFrame:
    order = ["dim", "cell", "label", "id"]
    return written(anchors.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _packed_groups(it, k), _GROUPS), "anchor-groups")


def hard_negatives(
    rows: DataFrame, is_anchor: Column, label: Column | str = "label", *, id_col: str = "vec_id", vec_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: int = 256
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are the ``positives`` other rows of its label with the highest scores; a positive's negatives
    the ``negatives`` rows of other labels with the highest scores s of low * p <= high * s <= high * p, where p is the
    positive's score. A score is the inner product of floor(scale * component).
    """
    label = F.col(label) if isinstance(label, str) else label
    named = rows.select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.col(vec_col).cast("array<double>").alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    valid = named.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vec")))

    squares = F.aggregate("vec", F.lit(0.0), lambda a, x: a + (F.abs(x) * scale + 1) * (F.abs(x) * scale + 1))
    n, square = valid.agg(F.count(F.lit(1)), F.max(squares)).first()
    norm = float(np.sqrt(square or 0.0))
    norm = norm if norm < 1e150 else np.inf
    # At most PIVOTS rows.
    sample = [r.vec for r in valid.select("vec", "id").orderBy(F.xxhash64("id"), "id", "vec").limit(max(1, min(PIVOTS, n // PIVOT_ROWS))).collect()]
    cells = Cells(sample, scale, norm)

    placed = valid.select("id", "label", "vec").mapInArrow(lambda it: _placed(it, cells, False), _PLACED)
    order = ["dim", "cell", "label", "radius", F.xxhash64("id"), "id"]
    blocks = written(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lambda it: _packed_blocks(it, positives + 1), _BLOCKS), "blocks")

    stated = valid.filter("is_anchor").groupBy("id").agg(F.min(F.struct("label", "vec")).alias("first")).select("id", "first.label", "first.vec")
    anchors = stated.mapInArrow(lambda it: _placed(it, cells, True), _PLACED)
    groups = _grouped(anchors.drop("radius"), positives)

    # The smallest radii of each cell and label, of different ids: one more than are asked for, as an anchor's own row is none.
    nearest = blocks.select("dim", "label", "cell", F.explode(F.arrays_zip("near_ids", "near_radii")).alias("x")).groupBy("dim", "label", "cell", F.col("x.near_ids").alias("id")).agg(F.min("x.near_radii").alias("radius"))
    first = Window.partitionBy("dim", "label", "cell").orderBy("radius", "id")
    nearest = nearest.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= positives + 1)
    nearest = nearest.groupBy("dim", "label").agg(F.collect_list(F.struct("cell", "id", "radius")).alias("nearest"))  # at most PIVOTS * (positives + 1)

    needs = groups.select("group", "dim", "cell", "label", "ids", "data").join(nearest, ["dim", "label"], "left").mapInArrow(lambda it: _intervals(it, cells, _reach_positives(cells, positives)), _NEEDS)
    found = _replicated(needs, blocks, groups, True).mapInArrow(lambda it: _join_positives(it, positives), "anchor_id long, vec_id long, score long")
    best = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= positives)
    told = ranked.groupBy(F.col("anchor_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("k", "vec_id", "score"))).alias("positives"))

    groups = _grouped(anchors.drop("radius").join(told, "id"), positives)
    needs = groups.mapInArrow(lambda it: _intervals(it, cells, _reach_negatives(cells, positives, low, high)), _NEEDS)
    pairs = _replicated(needs, blocks, groups, False)
    found = pairs.mapInArrow(lambda it: _join_negatives(it, negatives, positives, low, high), "anchor_id long, nth int, positive_id long, positive_score long, negative_id long, negative_score long")
    best = Window.partitionBy("anchor_id", "nth").orderBy(F.col("negative_score").desc(), "negative_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
