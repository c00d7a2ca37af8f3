"""Spectrum of i times a skew matrix, and a permutation test of its largest eigenvalue.

Matrices stay in coordinate form. Leading eigenpairs come from block Lanczos, in one task for a
matrix of a counted, bounded size and over tables beyond it. Permutations move only the values
that are not 0, by a keyed bijection on the places above the diagonal; each is one small task.
Only the whole spectrum is dense work: of each connected part on its own, folded to twice the nodes
that touch all its cells where that is less; it is refused for a part that keeps more than ``DENSE_NODES``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelag.operators.dense import Blocks, folded_in, spectrum
from tidelag.operators.lanczos import Cells, Held, Spread, largest_value, leading, leading_of_many, long_form
from tidelag.operators.matrix import nodes
from tidelag.sources.shared import staged

#: Nodes that a connected part may keep for a whole spectrum in one task (4 bytes for each pair of them), and rows folded at a time.
DENSE_NODES, FOLDED = 12_000, 1024
#: Nodes of a stream of all places.
MOST_NODES = 4000
#: Cells above the diagonal (12 bytes each, and 16 more while they are permuted) and numbers of vectors (of 8, half of them
#: at a time) of a matrix that one task holds; and cells that the driver gathers and broadcasts, where many small tasks share them.
TASK_CELLS, TASK_NUMBERS, GATHERED = 24_000_000, 200_000_000, 2_000_000
#: Cells of a pack, and places that a permutation moves at a time.
PACK, AT_ONCE = 1 << 19, 1 << 20
#: Rows of packs, some 6 MB each, that travel to a Python worker at once.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
BINS = 40
SAMPLE = 2000
#: Rounds of the bijection on places, and its least bits on each side.
ROUNDS, LEAST_BITS = 8, 3
BLOCK = 8


class Skew:
    """A skew matrix as tables: ``names`` (node, at) in the order of nodes, ``cells`` (r, c, value) with r < c, none 0."""

    def __init__(self, matrix: DataFrame):
        spark = matrix.sparkSession
        matrix = staged(matrix.select("i", "j", "value"), "matrix")
        ordered = nodes(matrix).orderBy("node").rdd.zipWithIndex().map(lambda x: (x[0].node, x[1]))
        self.names = staged(spark.createDataFrame(ordered, "node string, at long"), "matrix-names")
        side = lambda old, new: self.names.select(F.col("node").alias(old), F.col("at").alias(new))
        placed = matrix.where("value <> 0").join(side("i", "r"), "i").join(side("j", "c"), "j").where("r < c")
        self.cells = staged(placed.select("r", "c", "value"), "matrix-cells")
        self.n, self.count = self.names.count(), self.cells.count()
        self.spark, self.packed = spark, None

    def fits(self, vectors: int) -> bool:
        """Whether one task may hold the cells and so many vectors."""
        return self.count <= TASK_CELLS and self.n * vectors <= TASK_NUMBERS

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The cells, at most ``GATHERED`` of them, in the order of their places."""
        if self.count > GATHERED:
            raise ValueError(f"more than {GATHERED} cells are not gathered")
        cells = self.cells.toPandas().sort_values(["r", "c"])
        return cells.r.to_numpy(np.int64), cells.c.to_numpy(np.int64), cells.value.to_numpy(np.float64)

    def narrow(self) -> DataFrame:
        """The cells with places of 32 bits, of which no matrix that fits a task has more."""
        return self.cells.select(F.col("r").cast("int"), F.col("c").cast("int"), "value")

    def packs(self) -> DataFrame:
        """The cells in order, ``PACK`` of them in a row: its first place, its rows and their numbers of cells, columns and values."""
        if self.packed is None:
            ordered = self.narrow().repartitionByRange("r", "c").sortWithinPartitions("r", "c")
            self.packed = staged(ordered.mapInArrow(pack, PACKED), "matrix-packs")
        return self.packed

    def in_task(self, run, schema: str) -> DataFrame:
        """Rows that ``run`` makes of the ``Cells``, in one task; only where they fit. They are written."""
        n = self.n

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if packs := unpacked(batches)[0]:
                for rows in run(joined(packs, n)):
                    yield pa.RecordBatch.from_pandas(rows, preserve_index=False)

        return self.written(self.packs().repartition(1).mapInArrow(whole, schema), "in-task")

    def in_tasks(self, run, tasks: int, schema: str) -> DataFrame:
        """Rows that ``run`` makes of its number, below ``tasks``, and the packs of cells, which each task gets once. They are written."""
        numbers = self.spark.range(64 * tasks).select(F.col("id").cast("int").alias("key"))
        keys = [r.key for r in numbers.groupBy(F.pmod(F.hash("key"), F.lit(tasks)).alias("part")).agg(F.min("key").alias("key")).collect()]  # one for each partition
        keys += [k for k in range(64 * tasks, 65 * tasks)][: tasks - len(keys)]
        number = {k: i for i, k in enumerate(keys)}
        copies = self.packs().withColumn("key", F.explode(F.array(*(F.lit(k) for k in keys)))).repartition(tasks, "key")

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            packs, found = unpacked(batches)
            for key in sorted(found):
                yield pa.RecordBatch.from_pandas(run(number[key], packs), preserve_index=False)

        return self.written(copies.mapInArrow(own, schema), "in-tasks")

    def written(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows``, made of packs that travel a few at once."""
        before = self.spark.conf.get(BATCH)
        try:
            self.spark.conf.set(BATCH, "4")
            return staged(rows, name)
        finally:
            self.spark.conf.set(BATCH, before)


PACKED = "first_r int, first_c int, rows binary, lengths binary, col binary, value binary"
#: First place, rows, their numbers of cells, columns, values.
Pack = tuple[tuple[int, int], np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ordered cells as rows of ``PACKED``."""

    def one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        r, c, value = (np.concatenate([b[x].to_numpy() for b in held]) for x in ("r", "c", "value"))
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        lengths = np.diff(starts, append=len(r)).astype(np.int32)
        row = {"first_r": r[:1], "first_c": c[:1]} | {k: [x.tobytes()] for k, x in (("rows", r[starts]), ("lengths", lengths), ("col", c), ("value", value))}
        return pa.RecordBatch.from_pydict(row, pa.schema([("first_r", pa.int32()), ("first_c", pa.int32()), *((k, pa.binary()) for k in ("rows", "lengths", "col", "value"))]))

    held = []
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= PACK:
            yield one(held)
            held = []
    if held:
        yield one(held)


def unpacked(batches: Iterator[pa.RecordBatch]) -> tuple[list[Pack], set[int]]:
    """The packs in order, once, and the keys that they came with."""
    packs, keys = {}, set()
    for batch in batches:
        for row in batch.to_pylist():
            keys.add(row.get("key"))
            kinds = (("rows", np.int32), ("lengths", np.int32), ("col", np.int32), ("value", np.float64))
            packs.setdefault((row["first_r"], row["first_c"]), [np.frombuffer(row[k], t) for k, t in kinds])
    return [(k, *packs[k]) for k in sorted(packs)], keys


def joined(packs: list[Pack], n: int) -> Cells:
    """The cells of all packs."""
    cells = Cells.empty(n)
    for _, rows, own, c, value in packs:
        cells.add(np.repeat(rows, own), c, value)
    return cells


def in_order(cells: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and values of cells by place."""
    r, c, value = (cells[x].to_numpy() for x in ("r", "c", "value"))
    order = np.lexsort((c, r))
    return r[order], c[order], value[order]


def pairs(s: Skew, top_k: int, seed: int = 0, spread: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """((k, eigval), (at, k, re, im)) of the first ``top_k``, by tables if they do not fit a task or ``spread`` is set."""
    n, k = s.n, min(top_k, s.n)
    vectors = n if 2 * k > n else max(60, 2 * (k + BLOCK) + 6 * BLOCK)
    if (spread if spread is not None else not s.fits(2 * vectors)):
        space = Spread(s.cells, s.names.select("at"), seed)
        values, u = leading(space, n, k, BLOCK)
        listed = s.spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(values)], "k int, eigval double")
        return listed, space.vectors(u)
    if not s.count:
        none = s.names.select("at", F.explode(F.sequence(F.lit(1), F.lit(max(1, k)))).alias("k")).select("at", "k", (F.col("at") == F.col("k") - 1).cast("double").alias("re"), F.lit(0.0).alias("im"))
        return none.select("k", F.lit(0.0).alias("eigval")).distinct(), none

    def run(cells: Cells) -> Iterator[pd.DataFrame]:
        space = Held.over(cells, seed)
        values, u = leading_of_many(space, n, k, BLOCK)
        yield pd.DataFrame({"at": np.int64(-1), "k": np.arange(1, k + 1, dtype=np.int32), "re": values, "im": 0.0})
        yield from space.vectors(u)

    found = s.in_task(run, "at long, k int, re double, im double")
    return found.where("at < 0").select("k", F.col("re").alias("eigval")), found.where("at >= 0")


def largest(matrix: DataFrame | Skew, seed: int = 0) -> float:
    """The largest eigenvalue of i*S; 0 for a matrix without cells."""
    s = matrix if isinstance(matrix, Skew) else Skew(matrix)
    if not s.count or not s.fits(4):
        return float(pairs(s, 1, seed)[0].first().eigval) if s.count else 0.0
    return s.in_task(lambda cells: iter([pd.DataFrame({"value": [largest_value(cells, seed)]})]), "value double").first().value


def largest_of(r: np.ndarray, c: np.ndarray, value: np.ndarray, n: int, seed: int = 0) -> float:
    return largest_value(Cells(r, c, value, n), seed) if len(value) else 0.0


def eigenvalues(matrix: DataFrame, top_k: int | None = None, spread: bool | None = None) -> DataFrame:
    """(rank, eigval), from 1 in descending order: the first ``top_k``, or all, where no connected part keeps more than ``DENSE_NODES``.

    The whole spectrum is that of the connected parts together, each a task's dense work; nodes without cells have 0.
    """
    s = Skew(matrix)
    if top_k is not None:
        return pairs(s, top_k, spread=spread)[0].select(F.col("k").alias("rank"), "eigval") if s.n else s.spark.createDataFrame([], "rank int, eigval double")
    if not s.count:
        return s.names.select((F.col("at") + 1).cast("int").alias("rank"), F.lit(0.0).alias("eigval"))
    labels = parts(s)
    if s.count > TASK_CELLS and (most := s.cells.join(labels.withColumnRenamed("at", "r"), "r").groupBy("part").count().agg(F.max("count")).first()[0]) > TASK_CELLS:
        raise ValueError(f"a connected part has {most} cells, more than {TASK_CELLS}: ask for the first eigenvalues by top_k")
    found = s.cells.join(labels.withColumnRenamed("at", "r"), "r").groupBy("part").applyInPandas(part_spectrum, "eigval double")
    alone = s.names.join(labels, "at", "left_anti").select(F.lit(0.0).alias("eigval"))
    values = staged(found.unionAll(alone), "spectrum").orderBy(F.desc("eigval"))
    return s.spark.createDataFrame(values.rdd.zipWithIndex().map(lambda x: (x[1] + 1, x[0].eigval)), "rank int, eigval double")


def parts(s: Skew) -> DataFrame:
    """(at, part): nodes with cells and the smallest node of their connected part.

    Each round takes the least label among a node and its neighbours, then that label's own label,
    so that rounds grow with the logarithm of a part's width in most graphs.
    """
    both = staged(s.cells.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b")) for a, b in (("r", "c"), ("c", "r")))))), "ties")
    labels = staged(both.groupBy(F.col("a").alias("at")).agg(F.least("at", F.min("b")).alias("part")), "parts")
    while True:
        near = both.join(labels.select(F.col("at").alias("b"), F.col("part").alias("near")), "b").groupBy(F.col("a").alias("at")).agg(F.min("near").alias("near"))
        least = staged(labels.join(near, "at").select("at", F.col("part").alias("old"), F.least("part", "near").alias("part")), "parts")
        jumped = least.join(least.select(F.col("at").alias("part"), F.col("part").alias("next")), "part").select("at", "old", F.least("part", "next").alias("part"))
        jumped = staged(jumped, "parts")
        labels = jumped.select("at", "part")
        if jumped.where("part <> old").isEmpty():
            return labels


def part_spectrum(cells: pd.DataFrame) -> pd.DataFrame:
    """All eigenvalues of i*S for the cells of one connected part."""
    r, c, value = in_order(cells)
    names, at = np.unique(np.concatenate([r, c]), return_inverse=True)
    return pd.DataFrame({"eigval": whole_spectrum(at[: len(r)], at[len(r) :], value, len(names))})


def cover_of(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Whether a node belongs to a set that touches all cells: of each cell the node of more cells (ties by number)."""
    degree = np.bincount(r, minlength=n) + np.bincount(c, minlength=n)
    inside = np.zeros(n, bool)
    inside[np.where(degree[r] >= degree[c], r, c)] = True
    return inside


def whole_spectrum(r: np.ndarray, c: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """All ``n`` eigenvalues of i*S, dense for n nodes or for twice as many as touch all cells.

    With those k nodes first, S = [[A, B], [-B', 0]]; of B' = QR only R (k x k) is kept, as turning the other
    nodes by Q leaves [[A, R'], [-R, 0]] and zeros. R is gathered over blocks of rows of B'.
    """
    inside = cover_of(r, c, n)
    k = int(inside.sum())
    m = min(n, 2 * k)
    if m > DENSE_NODES:
        raise ValueError(f"a connected part keeps {m} nodes, more than {DENSE_NODES}: ask for the first eigenvalues by top_k")
    if m == n:
        blocks = Blocks(n)
        blocks.put(r, c, value)
        return spectrum(blocks)
    order = np.cumsum(inside) - 1
    own, rest = inside[r] & inside[c], inside[r] != inside[c]
    # a cell between a node of the set and one outside, as a row of B'
    flip = inside[c[rest]]
    outer, inner, b = np.where(flip, r[rest], c[rest]), order[np.where(flip, c[rest], r[rest])], np.where(flip, -value[rest], value[rest])
    by = np.argsort(outer, kind="stable")
    outer, inner, b = (np.cumsum(~inside) - 1)[outer[by]], inner[by], b[by]
    kept = np.zeros((k, k))
    for start in range(0, n - k, FOLDED):
        of = slice(*np.searchsorted(outer, [start, start + FOLDED]))
        block = np.zeros((min(FOLDED, n - k - start), k))
        block[outer[of] - start, inner[of]] = b[of]
        folded_in(kept, block)
    blocks = Blocks(m)
    blocks.put(order[r[own]], order[c[own]], value[own])
    blocks.put_below(-kept)
    del kept
    both = np.concatenate([spectrum(blocks), np.zeros(n - m)])
    return np.sort(both)[::-1]


def moments(matrix: DataFrame) -> DataFrame:
    """(n, squares, fourths): the number of eigenvalues of i*S and the sums of their squares and fourth powers.

    These are traces: the squares of all cells, and the closed walks of four steps. A walk is
    counted at its node v of most cells (ties by number): with P(v, k) the paths of two steps over lower
    nodes to a lower one, all walks are 4 P(v, k)^2 and, where v is met twice, 2 (squares of v's lower cells)^2. A cell
    meets no more cells than the lesser of its nodes has, so a hub's pairs of neighbours are never listed.
    """
    s = Skew(matrix)
    both = s.cells.select(F.inline(F.array(*(F.struct(F.col(a).alias("a"), F.col(b).alias("b"), v.alias("value")) for a, b, v in (("r", "c", F.col("value")), ("c", "r", -F.col("value")))))))
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    side = lambda c: degree.select(F.col("a").alias(c), F.struct("d", F.col("a").alias("at")).alias(f"rank_{c}"))
    ranked = staged(both.join(side("a"), "a").join(side("b"), "b"), "ranked-cells")
    down = ranked.where("rank_b < rank_a")
    on = ranked.select(F.col("a").alias("b"), F.col("b").alias("k"), F.col("rank_b").alias("rank_k"), F.col("value").alias("y"))
    paths = down.join(on, "b").where("rank_k < rank_a").groupBy("a", "k").agg(F.sum(F.col("value") * F.col("y")).alias("p"))
    turns = down.groupBy("a").agg(F.sum(F.col("value") * F.col("value")).alias("p"))
    walks = paths.select((4 * F.col("p") * F.col("p")).alias("x")).union(turns.select(2 * F.col("p") * F.col("p"))).agg(F.sum("x").alias("fourths"))
    squares = s.cells.agg((2 * F.sum(F.col("value") * F.col("value"))).alias("squares"))
    return squares.crossJoin(walks).select(F.lit(s.n).cast("long").alias("n"), "squares", "fourths")


def eigenvectors(matrix: DataFrame, top_k: int = 50, spread: bool | None = None) -> DataFrame:
    """(node, k, re, im) of the first ``top_k`` eigenvectors; their phase is arbitrary."""
    s = Skew(matrix)
    if not s.n:
        return s.names.select("node", F.lit(0).alias("k"), F.lit(0.0).alias("re"), F.lit(0.0).alias("im"))
    return pairs(s, top_k, spread=spread)[1].join(s.names, "at").select("node", "k", "re", "im")


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def moved(places: np.ndarray, n_places: int, seed: int, perm_id: int) -> np.ndarray:
    """Where a permutation of 0..n_places-1, named by (seed, perm_id), sends these places.

    A Feistel network permutes the numbers of an even number of bits; who lands beyond the last
    place is sent on until it lands inside, which keeps it a permutation and lists nothing.
    """
    half = np.uint64(max(LEAST_BITS, -(-max(1, n_places - 1).bit_length() // 2)))
    mask = (np.uint64(1) << half) - np.uint64(1)
    keys = np.random.SeedSequence((seed, perm_id)).generate_state(ROUNDS, np.uint64)
    out, open_ = places.astype(np.uint64), np.arange(len(places))
    while len(open_):
        left, right = out[open_] >> half, out[open_] & mask
        for key in keys:
            left, right = right, left ^ (mixed(right + key) & mask)
        out[open_] = left << half | right
        open_ = open_[out[open_] >= n_places]
    return out.astype(np.int64)


def place_of(r: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    """Number of a place above the diagonal, row by row from 0."""
    return r * n - r * (r + 1) // 2 + c - r - 1


def cell_of(place: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.clip(((2 * n - 1 - np.sqrt(np.maximum(0.0, (2.0 * n - 1) ** 2 - 8.0 * place))) / 2).astype(np.int64), 0, max(0, n - 2))
    r -= place < place_of(r, r + 1, n)  # rounding moves it by one at most
    r += place >= place_of(r + 1, r + 2, n)
    return r, place - place_of(r, r + 1, n) + r + 1


def permuted_packs(packs: list[Pack], n: int, seed: int, perm_id: int) -> Cells:
    """The same for packs: places are moved a pack at a time, and put in order a range at a time."""
    total, size = n * (n - 1) // 2, sum(len(p[3]) for p in packs)
    ranges = max(1, size // max(PACK, 2 * n))
    wide, room = -(-total // ranges), size // ranges + 8 * int((size // ranges) ** 0.5) + 64  # places are even: no range holds much more
    held = [(np.empty(room, np.int64), np.empty(room)) for _ in range(ranges)]
    filled = np.zeros(ranges, np.int64)
    for _, rows, own, c, value in packs:
        places = moved(place_of(np.repeat(rows, own).astype(np.int64), c.astype(np.int64), n), total, seed, perm_id)
        part = (places // wide).astype(np.int16)
        order = np.argsort(part, kind="stable")
        places, value, cuts = places[order], value[order], np.searchsorted(part[order], np.arange(ranges + 1))
        for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            at = filled[k]
            filled[k] += high - low
            if filled[k] > len(held[k][0]):
                held[k] = tuple(np.concatenate([x[:at], np.empty(filled[k] + room - at, x.dtype)]) for x in held[k])
            held[k][0][at : filled[k]], held[k][1][at : filled[k]] = places[low:high], value[low:high]
    cells = Cells.empty(n)
    for k in range(ranges):
        places, value = (x[: filled[k]] for x in held[k])
        held[k] = None
        order = np.argsort(places)
        value[:] = value[order]
        r, c = cell_of(places[order], n)
        cells.add(r.astype(np.int32), c.astype(np.int32), value)
    return cells


def permuted(r: np.ndarray, c: np.ndarray, value: np.ndarray, n: int, seed: int, perm_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The values above the diagonal, zeros included, in random places: only those that are not 0 are named."""
    parts = [np.zeros((2, 0), np.int64)]
    for k in range(0, len(r), AT_ONCE):
        places = place_of(r[k : k + AT_ONCE].astype(np.int64), c[k : k + AT_ONCE].astype(np.int64), n)
        parts.append(np.stack(cell_of(moved(places, n * (n - 1) // 2, seed, perm_id), n)))
    return *np.concatenate(parts, axis=1), value


def permuted_cells(s: Skew, seed: int, perm_id: int) -> DataFrame:
    """The same for cells in a table."""
    n = s.n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            r, c, value = permuted(*(batch[x].to_numpy() for x in ("r", "c", "value")), n, seed, perm_id)
            yield pd.DataFrame({"r": r, "c": c, "value": value})

    return s.cells.mapInPandas(run, "r long, c long, value double")


def drawn_from_one_stream(s: Skew, n_perm: int, seed: int) -> list[float]:
    """All permutations from one generator over all places, one after another: for at most ``MOST_NODES`` nodes."""
    if s.n > MOST_NODES:
        raise ValueError(f"one stream lists all places, for at most {MOST_NODES} nodes")
    r, c, value = s.arrays()
    stream, places = np.random.default_rng(seed), np.zeros(s.n * (s.n - 1) // 2)
    places[place_of(r, c, s.n)] = value
    found = []
    for _ in range(n_perm):
        at = np.flatnonzero(drawn := stream.permutation(places))
        found.append(largest_of(*cell_of(at, s.n), drawn[at], s.n))
    return found


def permutation_null(matrix: DataFrame | Skew, n_perm: int = 500, seed: int = 0, rng: str = "per_perm") -> DataFrame:
    """(perm_id, null_maxeig). ``per_perm`` names each permutation by (seed, id); those of a matrix
    that fits a task are spread over tasks, which get its cells by broadcast or, if they are many, by a shuffle;
    others are done one after another over tables.
    ``sequential`` draws all from one stream on the driver."""
    s = matrix if isinstance(matrix, Skew) else Skew(matrix)
    spark, n, schema = s.spark, s.n, "perm_id long, null_maxeig double"
    if rng == "sequential":
        return spark.createDataFrame(list(enumerate(drawn_from_one_stream(s, n_perm, seed))), schema)
    if rng != "per_perm":
        raise ValueError("rng must be per_perm or sequential")
    if not s.fits(4):
        found = []
        for b in range(n_perm):
            space = Spread(permuted_cells(s, seed, b), s.names.select("at"))
            found.append((b, max(0.0, float(leading(space, n, 1, 2)[0][0]))))
            space.drop()
        return spark.createDataFrame(found, schema)
    if s.count > GATHERED:
        tasks = max(1, min(n_perm, spark.sparkContext.defaultParallelism))

        def own(k: int, packs: list[Pack]) -> pd.DataFrame:
            mine = np.arange(k, n_perm, tasks)
            return pd.DataFrame({"perm_id": mine, "null_maxeig": [largest_value(permuted_packs(packs, n, seed, int(b))) for b in mine]})

        return s.in_tasks(own, tasks, schema)
    shared = spark.sparkContext.broadcast(s.arrays())  # at most GATHERED of 24 bytes

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [largest_of(*permuted(*shared.value, n, seed, int(b)), n) for b in batch.perm_id]
            yield pd.DataFrame({"perm_id": batch.perm_id, "null_maxeig": found})

    return spark.range(0, n_perm, numPartitions=max(1, min(n_perm, spark.sparkContext.defaultParallelism * 4))).withColumnRenamed("id", "perm_id").mapInPandas(run, schema)


def permutation_p(null: DataFrame, observed: float) -> DataFrame:
    """(obs_maxeig, exceed, n_perm, p_value) with one added to both counts."""
    counts = null.agg(F.count_if(F.col("null_maxeig") >= observed).alias("exceed"), F.count("*").alias("n_perm"))
    return counts.select(F.lit(observed).alias("obs_maxeig"), "exceed", "n_perm", ((F.col("exceed") + 1) / (F.col("n_perm") + 1)).alias("p_value"))


def histogram(null: DataFrame, bins: int = BINS) -> DataFrame:
    """(bin, n) of equal widths between the extremes of the null."""
    bounds = F.broadcast(null.agg(F.min("null_maxeig").alias("lo"), F.max("null_maxeig").alias("hi")))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.lit(bins - 1), F.floor(bins * (F.col("null_maxeig") - F.col("lo")) / (F.col("hi") - F.col("lo"))))).otherwise(0)
    return null.join(bounds).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def embedding(matrix: DataFrame, sample: int = SAMPLE, seed: int = 0) -> DataFrame:
    """(node, x, y): real parts of the first two eigenvectors, for at most ``sample`` nodes."""
    vectors = eigenvectors(matrix, 2).groupBy("node").agg(F.max(F.when(F.col("k") == 1, F.col("re"))).alias("x"), F.max(F.when(F.col("k") == 2, F.col("re"))).alias("y"))
    return vectors.orderBy(F.xxhash64(F.lit(seed), "node"), "node").limit(sample)


def centrality(matrix: DataFrame, rounds: int = 100, tolerance: float = 1e-10) -> DataFrame:
    """(node, centrality): an extension; power iteration on absolute weights, of length 1, a pass over the cells each round."""
    cells = staged(matrix.select("i", "j", F.abs("value").alias("value")), "centrality-cells")
    held = staged(nodes(cells).select("node", F.lit(1.0).alias("x")), "centrality")
    for _ in range(rounds):
        moved_on = cells.join(held.withColumnRenamed("node", "i"), "i").select(F.col("j").alias("node"), (F.col("value") * F.col("x")).alias("x"))
        new = staged(moved_on.union(held).groupBy("node").agg(F.sum("x").alias("x")), "centrality")
        length = new.agg(F.sqrt(F.sum(F.col("x") * F.col("x")))).first()[0] or 1.0
        new = new.withColumn("x", F.col("x") / length)
        change = new.join(held.withColumnRenamed("x", "old"), "node").agg(F.max(F.abs(F.col("x") - F.col("old")))).first()[0]
        held = new
        if change is None or change < tolerance:
            break
    return held.select("node", F.col("x").alias("centrality"))
