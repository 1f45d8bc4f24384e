"""Near-duplicate vectors by product quantisation: inverted lists with residual codes, bounds on distances and an exact cosine.

The model is fitted on a sample of at most SAMPLE vectors; the index holds every vector.  Vectors are compared cell by cell, a cell
being a list or some small ones together.  Linked vectors lie within reach of each other on every line, also on the line through the
means of two cells, so most pairs of vectors of two lists are left out by their places there.  For the others the product of the
leading axes, with that of the lengths of what is left, is as large as their cosine or larger; then the distance from what a code
stands for may exceed the reach by the vector's own quantisation error at most.  All three tests are bounds, so no link is lost; what
passes is compared by cosine in double precision.

Vectors are not copied to the lists they are compared with.  A label of at most PIECE bytes is one group of a shuffle.  A larger one
is written once, in pieces, and each pair of its pieces is read from there by one task, so disk grows in proportion to the input."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import FloatType

from .components import connected_components
from .scratch import remove, settled, stored

SAMPLE = 16_384
LIST = 1024
SUBSPACE = 8
CODES = 256
PAIRS = 1 << 15
PIECE = 8 << 20
BLOCK = 1024
ROWS, COLUMNS = 256, 4096
EDGES = 1 << 20
LABELS = 32
TOGETHER = 6


@dataclass(frozen=True)
class Model:
    """Centres of the lists, for each subspace the words that code a residual, and the leading axes; no axes if all are needed."""

    centres: np.ndarray
    books: list[np.ndarray]
    axes: np.ndarray | None = None

    @property
    def cuts(self) -> list[int]:
        return np.cumsum([b.shape[1] for b in self.books])[:-1].tolist()

    def nearest(self, unit: np.ndarray) -> np.ndarray:
        return _nearest(unit, self.centres)

    def encode(self, unit: np.ndarray, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and the distance of each vector from what its codes stand for."""
        parts = np.split(unit - self.centres[lists], self.cuts, axis=1)
        codes = np.stack([_nearest(x, book) for x, book in zip(parts, self.books)], 1).astype(np.uint8)
        return codes, np.linalg.norm(unit - self.stands(lists, codes), axis=1)

    def stands(self, lists: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """What the codes of vectors of these lists stand for."""
        return self.centres[lists] + np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], 1)

    def leading(self, unit: np.ndarray) -> np.ndarray:
        """Columns whose product is never below that of the units: the leading axes and the length of what is left."""
        return unit if self.axes is None else _leading(unit, self.axes.astype(unit.dtype))


def _leading(unit: np.ndarray, axes: np.ndarray) -> np.ndarray:
    lead = unit @ axes
    left = np.maximum(1 - np.einsum("ij,ij->i", lead, lead), 0) + unit.dtype.type(_slack(unit.shape[1]))
    return np.concatenate([lead, np.sqrt(left)[:, None]], 1)


def _slack(width: int) -> float:
    """More than the error of a product of two units in single precision."""
    return max(1e-5, (width + 8) * 2.0 ** -22)


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None], 0)


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre in single precision; no result depends on which of two that are as near it is."""
    x, y = x.astype(np.float32), centres.astype(np.float32)
    half = (y * y).sum(1) / 2
    return np.concatenate([(half - x[a:a + BLOCK] @ y.T).argmin(1) for a in range(0, len(x), BLOCK)])


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _distances(x, centres).argmin(1)
        count = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def _axes(unit: np.ndarray, least: float) -> np.ndarray | None:
    """The number of axes is that with the least cost on the sample, where comparing a pair costs as much as some thousand columns."""
    width = unit.shape[1]
    axes, some = np.linalg.eigh(unit.T @ unit)[1][:, ::-1], unit[:2 * BLOCK]
    best, cost, columns = None, width, 16
    unlike = np.triu(some @ some.T < least, 1)
    while columns < width and len(some) >= CODES:
        lead = _leading(some, axes[:, :columns - 1])
        pairs = np.count_nonzero((lead @ lead.T >= least) & unlike) / max(1, np.count_nonzero(unlike))
        if columns + pairs * 20_000 < cost:
            best, cost = axes[:, :columns - 1], columns + pairs * 20_000
        columns *= 2
    return best


def fit(unit: np.ndarray, lists: int, least: float, seed: int = 42) -> Model:
    rng = np.random.default_rng(seed)
    centres = _means(unit, max(1, lists), rng)
    residual = unit - centres[_distances(unit, centres).argmin(1)]
    cuts = list(range(SUBSPACE, unit.shape[1], SUBSPACE))
    return Model(centres, [_means(part, CODES, rng, 4) for part in np.split(residual, cuts, axis=1)], _axes(unit, least))


def _model(fitted: dict[int, tuple], width: int) -> Model:
    """The model for a length; lengths that the sample lacks have one list around the origin."""
    if width in fitted:
        return Model(*fitted[width])
    return Model(np.zeros((1, width)), [np.zeros((1, min(SUBSPACE, width - i))) for i in range(0, width, SUBSPACE)])


def _units(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vector: Column) -> Column:
    """Not null or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _by_width(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Each length in a column of lists without nulls, the rows that have it, and their values."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    widths = np.diff(ends)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        yield int(width), at, values[ends[at][:, None] + np.arange(width)]


_INDEX = "width int, list int, codes binary, error double, raw binary"


def _indexed(models, kept: int):
    """The first ``kept`` columns as they are; for the last, the vector, its list and codes, and its bytes."""
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def binary(rows: np.ndarray) -> pa.Array:
        rows = np.ascontiguousarray(rows)
        step = rows.shape[1] * rows.itemsize
        return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * np.int32(step)), pa.py_buffer(rows)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, at, raw in _by_width(batch.column(kept)):
                model = _model(models.value, width)
                unit = _units(raw)
                lists = model.nearest(unit)
                codes, error = model.encode(unit, lists)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(i).take(pa.array(at)) for i in range(kept)]
                    + [pa.array(np.full(len(at), width, np.int32)), pa.array(lists.astype(np.int32)), binary(codes), pa.array(error), binary(raw)],
                    names=[*batch.schema.names[:kept], *names])

    return run


def _bytes(column: pa.Array) -> np.ndarray:
    """The bytes of all values of a binary column one after the other."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]


@dataclass(frozen=True)
class Piece:
    """Vectors of one label and length, ordered by their lists."""

    model: Model
    lists: np.ndarray
    cid: np.ndarray
    copies: np.ndarray
    codes: np.ndarray
    error: np.ndarray
    raw: np.ndarray

    KINDS = {"lists": np.int32, "cid": np.int64, "copies": np.int64, "codes": np.uint8, "error": np.float64, "raw": None}

    @classmethod
    def of(cls, model: Model, kind: type, **columns) -> Piece:
        """From the bytes of each column; ``kind`` is that of the components."""
        plain = {name: np.frombuffer(columns[name], cls.KINDS[name] or kind) for name in cls.KINDS}
        n = len(plain["cid"])
        return cls(model, **plain | {name: plain[name].reshape(n, -1) for name in ("codes", "raw")})

    @cached_property
    def unit(self) -> np.ndarray:
        return np.concatenate([_units(self.raw[a:a + BLOCK]).astype(np.float32) for a in range(0, len(self.raw), BLOCK)])

    @cached_property
    def lead(self) -> np.ndarray:
        return self.model.leading(self.unit)

    @cached_property
    def cells(self) -> list[tuple[int, int]]:
        """The first and last row of each list, of lists below LIST some together."""
        ends = [*(np.flatnonzero(np.diff(self.lists)) + 1).tolist(), len(self.lists)]
        cells, start = [], 0
        for end in ends:
            if end - start >= LIST or end == ends[-1]:
                cells.append((start, end))
                start = end
        return cells

    @cached_property
    def means(self) -> list[np.ndarray]:
        return [self.unit[a:b].mean(0, dtype=np.float64) for a, b in self.cells]


def _tiles(a: Piece, i: int, b: Piece, j: int, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows of cell ``i`` and rows of cell ``j`` that can be linked, with their leading columns; each pair once."""
    (r, rows), (c, columns) = a.cells[i], b.cells[j]
    if a is b and i == j:
        for s in range(r, rows, ROWS):
            for t in range(s, columns, COLUMNS):
                yield np.arange(s, min(s + ROWS, rows)), np.arange(t, min(t + COLUMNS, columns)), a.lead[s:min(s + ROWS, rows)], b.lead[t:min(t + COLUMNS, columns)]
        return
    line = a.means[i] - b.means[j]
    length = np.linalg.norm(line)
    line = (line / length if length > 1e-3 else line * 0).astype(np.float32)
    x, y = a.unit[r:rows] @ line, b.unit[c:columns] @ line
    reach += _slack(a.unit.shape[1])
    if x.min() - y.max() > reach:
        return
    p, q = np.argsort(x), np.argsort(-y)
    x, y, p, q = x[p], -y[q], p + r, q + c
    near = np.searchsorted(y, reach - x[::ROWS], "right")
    first, second = a.lead[p[:np.count_nonzero(near) * ROWS]], b.lead[q[:near[0]]]
    for k, n in enumerate(near.tolist()):
        s = slice(k * ROWS, (k + 1) * ROWS)
        for t in range(0, n, COLUMNS):
            yield p[s], q[t:min(t + COLUMNS, n)], first[s], second[t:min(t + COLUMNS, n)]


def _joined(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest that the links (u, v) lead to."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, u, root[v])
        np.minimum.at(root, v, root[u])
        root = root[root]
        if (root == before).all():
            return root


class Links:
    """The links between two pieces, or inside one: with how many copies each vector is linked, and which vectors are connected."""

    def __init__(self, a: Piece, b: Piece, least: float, reach: float):
        self.a, self.b, self.least, self.reach = a, b, least, reach
        self.ids = a.cid if a is b else np.concatenate([a.cid, b.cid])
        self.shift = 0 if a is b else len(a.cid)
        self.slack = _slack(a.raw.shape[1])
        self.linked = np.zeros(len(self.ids), np.int64)
        self.root = np.arange(len(self.ids))
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.n_waiting = self.n_edges = 0

    def find(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each linked vector its id, the copies it is linked with, and the id of a vector that its links lead to."""
        a, b = self.a, self.b
        for i in range(len(a.cells)):
            for j in range(i if a is b else 0, len(b.cells)):
                for rows, columns, x, y in _tiles(a, i, b, j, self.reach):
                    self._tile(rows, columns, x @ y.T)
        self._compare()
        self._connect()
        at = np.flatnonzero(self.linked)
        return self.ids[at], self.linked[at], self.ids[self.root[at]]

    def _tile(self, rows: np.ndarray, columns: np.ndarray, bound: np.ndarray) -> None:
        if bound.max() < self.least - self.slack:
            return
        may = bound >= self.least - self.slack
        if np.count_nonzero(may) * 64 > may.size:  # as in a large group: the cosines of all pairs at once, those near the limit one by one
            cosine = self.a.unit[rows] @ self.b.unit[columns].T
            once = rows[:, None] < columns[None] if self.a is self.b else True
            sure = (cosine >= self.least + self.slack) & once
            may = (cosine >= self.least - self.slack) & ~sure & once
            weights = sure.astype(np.float64)
            self.linked[rows] += (weights @ self.b.copies[columns]).astype(np.int64)
            self.linked[columns + self.shift] += (self.a.copies[rows] @ weights).astype(np.int64)
            q, i = np.nonzero(sure)
            self._edges(rows[q], columns[i] + self.shift)
        q, i = np.nonzero(may)
        q, i = rows[q], columns[i]
        if self.a is self.b:
            q, i = q[q < i], i[q < i]
        self.waiting.append((q, i))
        self.n_waiting += len(q)
        if self.n_waiting >= PAIRS:
            self._compare()

    def _compare(self) -> None:
        """The pairs that wait: first by the codes of one side, then by cosine."""
        q, i = (np.concatenate([x[k] for x in self.waiting]) if self.waiting else np.zeros(0, np.int64) for k in (0, 1))
        self.waiting, self.n_waiting = [], 0
        for s in range(0, len(q), PAIRS):
            self._exactly(q[s:s + PAIRS], i[s:s + PAIRS])

    def _exactly(self, q: np.ndarray, i: np.ndarray) -> None:
        a, b = self.a, self.b
        unit = _units(a.raw[q])
        near = np.linalg.norm(unit - b.model.stands(b.lists[i], b.codes[i]), axis=1) - b.error[i] <= self.reach + 1e-6
        q, i, unit = q[near], i[near], unit[near]
        good = np.einsum("ij,ij->i", unit, _units(b.raw[i])) >= self.least
        q, i = q[good], i[good]
        np.add.at(self.linked, q, b.copies[i])
        np.add.at(self.linked, i + self.shift, a.copies[q])
        self._edges(q, i + self.shift)

    def _edges(self, u: np.ndarray, v: np.ndarray) -> None:
        new = self.root[u] != self.root[v]
        self.edges.append((u[new], v[new]))
        self.n_edges += np.count_nonzero(new)
        if self.n_edges >= EDGES:
            self._connect()

    def _connect(self) -> None:
        if self.edges:
            u, v = (self.root[np.concatenate([x[k] for x in self.edges])] for k in (0, 1))
            self.root = _joined(len(self.root), u, v)[self.root]
            self.edges, self.n_edges = [], 0


def _runs(batches: Iterator[pa.RecordBatch], item: int, most: float) -> Iterator[tuple[str, int, dict[str, np.ndarray]]]:
    """Label, length and columns of each run of rows of one label and length, cut where its vectors have ``most`` bytes."""
    held: list[pa.RecordBatch] = []
    key, size = None, 0

    def taken():
        return *key, {name: np.concatenate([_bytes(b.column(name)) if pa.types.is_binary(b.schema.field(name).type) else b.column(name).to_numpy() for b in held])
                      for name in ("lists", "cid", "copies", "codes", "error", "raw")}

    for batch in batches:
        labels, widths = batch.column("label").dictionary_encode(), batch.column("width").to_numpy()
        places = labels.indices.to_numpy()
        starts = [0, *(np.flatnonzero((np.diff(places) != 0) | (np.diff(widths) != 0)) + 1).tolist(), len(places)] if len(places) else []
        for start, end in zip(starts, starts[1:]):
            this, step = (labels.dictionary[int(places[start])].as_py(), int(widths[start])), int(widths[start]) * item
            if held and this != key:
                yield taken()
                held, size = [], 0
            key = this
            while start < end:
                n = int(min(end - start, max(1, (most - size) // step)))
                held.append(batch.slice(start, n))
                start, size = start + n, size + n * step
                if size + step > most:
                    yield taken()
                    held, size = [], 0
    if held:
        yield taken()


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_FOUND = "cid long, linked long, root long"
_PIECES = "label string, width int, no long, lists binary, cid binary, copies binary, codes binary, error binary, raw binary, part int"


def _found(links: Links) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links.find()], names=["cid", "linked", "root"])


def _inside(models, kind: type, least: float, reach: float):
    """The links of each label, all its rows being in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, width, columns in _runs(batches, np.dtype(kind).itemsize, float("inf")):
            piece = Piece.of(_model(models.value, width), kind, **columns)
            yield _found(Links(piece, piece, least, reach))

    return run


def _packed(kind: type):
    """The rows of a task as pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for i, (label, width, columns) in enumerate(_runs(batches, np.dtype(kind).itemsize, 2 * PIECE)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([label], pa.string()), pa.array([width], pa.int32()), pa.array([part << 32 | i], pa.int64()),
                 *[pa.array([columns[name].tobytes()], pa.binary()) for name in Piece.KINDS], pa.array([part], pa.int32())],
                names=[c.split()[0] for c in _PIECES.split(", ")])

    return run


def _between(models, kind: type, least: float, reach: float):
    """The links of each pair of pieces; a piece with itself is one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, a = None, None
        for batch in batches:
            for row in range(len(batch)):
                value = lambda name: batch.column(name)[row]  # noqa: B023, E731
                side = lambda of: Piece.of(_model(models.value, value("a_width").as_py()), kind, **{name: value(f"{of}_{name}").as_buffer() for name in Piece.KINDS})  # noqa: B023, E731
                first, second = value("a_no").as_py(), value("b_no").as_py()
                if first != known:
                    known, a = first, side("a")
                yield _found(Links(a, a if first == second else side("b"), least, reach))

    return run


def _large(index: DataFrame, sizes: DataFrame, models, kind: type, least: float, reach: float) -> list[DataFrame]:
    """The links of labels of more than PIECE bytes; their number is bounded by the bytes of all vectors."""
    spark, item = index.sparkSession, np.dtype(kind).itemsize
    total = sizes.agg(F.sum(F.col("n") * F.col("width") * item).alias("bytes")).first()["bytes"]
    place = ["label", "width"]
    rows = index.join(F.broadcast(sizes.select(*place)), place, "left_semi")
    dealt = rows.repartitionByRange(int(total // PIECE) + 1, *place, "lists", "cid").sortWithinPartitions(*place, "lists", "cid")
    pieces = settled(dealt.select("label", "width", "lists", "cid", "copies", "codes", "error", "raw").mapInArrow(_packed(kind), _PIECES), "vector-pieces", by="part")
    parts: dict[tuple, list[int]] = {}
    for row in pieces.select(*place, "part").distinct().collect():
        parts.setdefault((row["label"], row["width"]), []).append(row["part"])
    # a task reads some pieces and compares them with some others, so each is read less often; there are still several tasks for a core
    each = int((sum(len(at) ** 2 for at in parts.values()) / 16 / spark.sparkContext.defaultParallelism) ** 0.5)
    each, pairs = min(max(each, 1), TOGETHER), []
    for (label, width), at in sorted(parts.items()):
        own = pieces.where(F.col("part").between(min(at), max(at)) & (F.col("label") == label) & (F.col("width") == width)).drop("label", "part")
        a, b = (own.select(*[F.col(c).alias(f"{side}_{c}") for c in own.columns]) for side in "ab")
        a, b = (x.coalesce(-(-len(at) // each)) for x in (a, b))
        pairs.append(a.join(b.hint("shuffle_replicate_nl"), F.col("a_no") <= F.col("b_no")))
    found, rows_at_once = [], spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1")
    try:
        for k in range(0, len(pairs), LABELS):
            together = reduce(DataFrame.union, pairs[k:k + LABELS])
            found.append(stored(together.mapInArrow(_between(models, kind, least, reach), _FOUND), "vector-links"))
    finally:
        spark.conf.set(_BATCH, rows_at_once)
    remove(pieces)
    return found


def near_vectors(
    vectors: DataFrame, least: float = 0.93, vector: str = "embedding", key: str = "vec_id", label: str = "label", sample: int = SAMPLE
) -> DataFrame:
    """(key, n_links, component_id) for every row of ``vectors``.

    Two rows are linked if their labels are equal and not null, their vectors equally long and the cosine is ``least`` or more.  Null, empty
    and zero vectors and those with null or non-finite components are linked with nothing.  ``n_links`` counts the other rows linked,
    ``component_id`` is the smallest key reachable, the row's own where there is none.  Rows of equal label and vector are one class
    until the end, so copies cost nothing; repeated rows count each.  An empty table gives an empty result; other columns are ignored."""
    spark = vectors.sparkSession
    single = getattr(vectors.select(vector).schema[0].dataType, "elementType", None) == FloatType()
    kind = np.float32 if single else np.float64
    rows = vectors.select(F.col(key).alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<float>" if single else "array<double>").alias("v"))
    rows = rows.withColumn("ok", usable(F.col("v")) & F.col("label").isNotNull())
    rows = rows.select("id", "label", "v", "ok", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    classes = rows.where("ok").groupBy("label", "h1", "h2").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = settled(classes.select(F.monotonically_increasing_id().alias("cid"), "label", "h1", "h2", "id", "copies", "v"), "vector-classes")
    sizes = classes.groupBy("label", F.size("v").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    sizes = stored(sizes, "vector-sizes")
    shape = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("most"), F.max(F.col("n") * F.col("width")).alias("values")).first()
    chance = F.xxhash64("h1", "h2")
    drawn = classes.where(chance <= int(2 ** 64 * min(1, 2 * sample / max(1, shape["n"]))) - 2 ** 63 - 1).orderBy(chance, "cid").limit(sample).select("v").toArrow()
    by_width = {width: raw for width, _, raw in _by_width(drawn.column("v").combine_chunks())} if len(drawn) else {}
    lists = round((shape["most"] or 0) / LIST)
    reach = float(np.sqrt(max(0.0, 2 - 2 * least)))
    fitted = {w: fit(_units(raw), min(lists, max(1, len(raw) // 16)), least) for w, raw in by_width.items()}
    models = spark.sparkContext.broadcast({w: (m.centres, m.books, m.axes) for w, m in fitted.items()})

    plain = classes.columns[:-1]
    schema = ", ".join([*[f"{c} {classes.schema[c].dataType.simpleString()}" for c in plain], _INDEX])
    index = stored(classes.mapInArrow(_indexed(models, len(plain)), schema), "vector-index").withColumnRenamed("list", "lists")
    remove(classes)
    found, small = [], index
    if (shape["values"] or 0) * np.dtype(kind).itemsize > PIECE:
        large = sizes.where(F.col("n") * F.col("width") * np.dtype(kind).itemsize > PIECE)
        small = index.join(F.broadcast(large.select("label", "width")), ["label", "width"], "left_anti")
        found = _large(index, large, models, kind, least, reach)
    small = small.select("label", "width", "lists", "cid", "copies", "codes", "error", "raw").repartition("label", "width").sortWithinPartitions("label", "width", "lists", "cid")
    found.append(settled(small.mapInArrow(_inside(models, kind, least, reach), _FOUND), "vector-links"))
    found = reduce(DataFrame.union, found)
    linked = found.groupBy("cid").agg(F.sum("linked").alias("linked"))
    components = connected_components(found.select("cid", "root"))
    of = index.join(linked, "cid", "left").join(components, F.col("cid") == F.col("node"), "left").select(
        "label", "h1", "h2", "id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "cid").alias("root"))
    least_id = stored(of.groupBy("root").agg(F.min("id").alias("component_id")), "vector-least", shape["n"])
    result = stored(of.join(least_id, "root").select("label", "h1", "h2", "n_links", "component_id"), "vector-result", shape["n"])
    joined = rows.select("id", "ok", F.when(F.col("ok"), F.col("label")).alias("label"), "h1", "h2").join(result, ["label", "h1", "h2"], "left")
    return joined.select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def keep_one_of_each(vectors: DataFrame, key: str = "vec_id", **options) -> DataFrame:
    """``near_vectors`` with ``kept``: the row's key is the smallest of its component."""
    found = near_vectors(vectors, key=key, **options)
    return found.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
