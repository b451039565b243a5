"""Dense vector work in blocks: top-k of a query set and all pairs within groups, as matrix products in Arrow batches.

Neither returns pairs: a block returns the best rows of each query, or counts. Memory is one block pair, whatever the
size of a group; a large group is cut into blocks, and each pair of blocks is a group of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lapwing.sources.shared import stored

#: Bytes of a query set that may be sent to every task.
SENT_BYTES = 32_000_000


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=np.float64)


def best_of(near: np.ndarray, query_ids: np.ndarray, item_ids: np.ndarray, k: int, digits: int = 0) -> pd.DataFrame:
    """The ``k`` largest of each row of scores (-inf: no match), ties (to ``digits`` places) to the smaller id, however many tie."""
    n = near.shape[1]
    least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
    row, column = np.nonzero((near >= least[:, None] - (10.0**-digits if digits else 0)) & (near > -np.inf))
    score, item = near[row, column], item_ids[column]
    order = np.lexsort((item, -(np.round(score, digits) if digits else score), row))
    row, score, item = row[order], score[order], item[order]
    use = np.arange(len(row)) - np.searchsorted(row, row) < k
    return pd.DataFrame({"query_id": query_ids[row[use]], "item_id": item[use], "similarity": score[use]})


class Best:
    """The ``k`` best items so far of each of a set of queries, whatever number of items it meets.

    Products are taken in single precision, a tile at a time. Only what comes within its error of a query's k-th best is decided in double precision, so
    results are exact; ties (to ``digits`` places) go to the smaller id. ``marks`` of queries, with those of the items: ``skus``, where equal ones are no
    match; ``turns``, where an item must come before the query. ``floor``: what a score must reach, to ``digits`` places; one for all queries, or one for each.
    """

    TILE, WIDTH, DECIDED = 1 << 18, 1024, 50_000

    def __init__(self, ids: np.ndarray, q: np.ndarray, k: int, drop_self: bool, digits: int = 0, skus: np.ndarray | None = None, turns: np.ndarray | None = None, floor: float | np.ndarray = -np.inf):
        self.ids, self.q, self.k, self.drop_self, self.digits, self.skus, self.turns = ids, q, k, drop_self, digits, skus, turns
        self.least = np.broadcast_to(np.asarray(floor, np.float64), len(q))
        self.norm = np.linalg.norm(q, axis=1)
        self.items = np.full((len(q), k), np.iinfo(np.int64).max)
        self.scores = np.full((len(q), k), -np.inf)
        self.step = 10.0**-digits if digits else 0.0
        self.low = self.least - self.step  # under this no score counts
        self.near, self.n_near = [], 0  # places of queries and items that may count, to be decided together

    def meet(self, ids: np.ndarray, v: np.ndarray, skus: np.ndarray | None = None, turns: np.ndarray | None = None, some: np.ndarray | None = None) -> None:
        """Holds items against all queries, or the places ``some`` of them."""
        some = np.arange(len(self.q)) if some is None else some
        if not len(ids) or not len(some) or not self.k:
            return
        if self.turns is not None:
            order = np.argsort(turns, kind="stable")
            ids, v, turns, skus = ids[order], v[order], turns[order], None if skus is None else skus[order]
        kind, error = _single(v, float(self.norm[some].max()))
        order = np.argsort(ids, kind="stable") if self.drop_self else None
        named = ids[order] if self.drop_self else None
        for lo in range(0, len(ids), self.WIDTH):
            hi = min(lo + self.WIDTH, len(ids))
            one = np.ascontiguousarray(v[lo:hi].astype(kind).T)
            tile = max(64, self.TILE // (hi - lo))
            for at in range(0, len(some), tile):
                rows = some[at : at + tile]
                if self.turns is not None:
                    upto = np.searchsorted(turns, self.turns[rows], "left") - lo  # items from here on come too late
                    if upto.max() <= 0:
                        continue
                near = self.q[rows].astype(kind) @ one
                if self.turns is not None and upto.min() < hi - lo:
                    near[np.arange(hi - lo)[None, :] >= upto[:, None]] = -np.inf
                if self.skus is not None:
                    near[self.skus[rows, None] == skus[None, lo:hi]] = -np.inf
                if self.drop_self:
                    first, last = (np.searchsorted(named, self.ids[rows], side) for side in ("left", "right"))
                    for i in np.flatnonzero(last > first):
                        own = order[first[i] : last[i]]
                        near[i, own[(own >= lo) & (own < hi)] - lo] = -np.inf
                self._take(rows, near, lo, error * self.norm[rows], ids, v)
        self._decide(ids, v)

    def meet_both(self, other: Best) -> None:
        """Holds the queries of both against each other, as items too: a product is taken once and serves both. Ids are all different, and there are no marks."""
        if not len(self.ids) or not len(other.ids) or not self.k:
            return
        kind, error = _single(other.q, float(self.norm.max()))
        back = _single(self.q, float(other.norm.max()))[1]
        q, v = self.q.astype(kind), other.q.astype(kind)
        tile = max(64, self.TILE // self.WIDTH)
        room = np.empty((tile, self.WIDTH), kind)  # one for all tiles, so that it stays in the cache
        for lo in range(0, len(v), self.WIDTH):
            columns = np.arange(lo, min(lo + self.WIDTH, len(v)))
            one = np.ascontiguousarray(v[columns].T)
            for at in range(0, len(q), tile):
                rows = np.arange(at, min(at + tile, len(q)))
                near = np.matmul(q[at : at + tile], one, out=room.ravel()[: len(rows) * len(columns)].reshape(len(rows), -1))
                self._take(rows, near, lo, error * self.norm[rows], other.ids, other.q)
                other._take(columns, near.T, at, back * other.norm[columns], self.ids, self.q)
        self._decide(other.ids, other.q)
        other._decide(self.ids, self.q)

    def _take(self, rows: np.ndarray, near: np.ndarray, base: int, error: np.ndarray, ids: np.ndarray, v: np.ndarray) -> None:
        """Notes what may count of a tile of products of the queries at ``rows`` with items (ids, v) from the place ``base`` on."""

        def bar_of(low: np.ndarray) -> np.ndarray:
            with np.errstate(over="ignore"):
                return np.maximum(np.nextafter(low.astype(near.dtype), near.dtype.type(-np.inf)), np.finfo(near.dtype).min)

        n, bar = near.shape[1], bar_of(self.low[rows] - error)
        some = np.flatnonzero(near.max(axis=1) >= bar)  # few rows have anything over their bar
        if not len(some):
            return
        rows, near, bar, error = (rows, near, bar, error) if len(some) == len(rows) else (rows[some], near[some], bar[some], error[some])
        over = np.ascontiguousarray(near >= bar[:, None])
        many = np.flatnonzero(np.count_nonzero(over, axis=1) > max(4 * self.k, 32)) if n > self.k else []
        if len(many):  # the k-th of this tile is a floor
            kth = np.partition(near[many], n - self.k, axis=1)[:, n - self.k].astype(np.float64)
            with np.errstate(invalid="ignore"):
                over[many] = near[many] >= np.fmax(bar[many], bar_of(kth - 2 * error[many] - self.step))[:, None]
        over = over.ravel()
        if len(over) % 8:
            hit = np.flatnonzero(over)
        else:  # eight places at once, as few are over
            words = np.flatnonzero(over.view(np.uint64))
            hit = (words[:, None] * 8 + np.arange(8)).ravel()
            hit = hit[over[hit]]
        self.near.append((rows[hit // n], base + hit % n))
        self.n_near += len(hit)
        if self.n_near >= self.DECIDED:
            self._decide(ids, v)

    def _decide(self, ids: np.ndarray, v: np.ndarray) -> None:
        if self.near:
            row, column = (np.concatenate(x) for x in zip(*self.near))
            self.near, self.n_near = [], 0
            for at in range(0, len(row), self.DECIDED):
                i, j = row[at : at + self.DECIDED], column[at : at + self.DECIDED]
                self._settle(i, ids[j], np.einsum("ij,ij->i", self.q[i], v[j]))

    def _settle(self, row: np.ndarray, item: np.ndarray, score: np.ndarray) -> None:
        rounded = np.round(score, self.digits) if self.digits else score
        use = rounded >= np.maximum(self.low[row], self.least[row])
        row, item, score, rounded = row[use], item[use], score[use], rounded[use]
        if not len(row):
            return
        held = np.unique(row)
        kept = self.scores[held].ravel()
        row, item, score = np.concatenate([np.repeat(held, self.k), row]), np.concatenate([self.items[held].ravel(), item]), np.concatenate([kept, score])
        rounded = np.concatenate([np.round(kept, self.digits) if self.digits else kept, rounded])
        order = np.lexsort((item, -rounded, row))
        row = row[order]
        order = order[np.arange(len(row)) - np.searchsorted(row, row) < self.k]
        self.items[held], self.scores[held] = item[order].reshape(-1, self.k), score[order].reshape(-1, self.k)
        self.low[held] = np.maximum(self.low[held], rounded[order].reshape(-1, self.k)[:, -1] - self.step)

    def found(self) -> pd.DataFrame:
        """(query_id, item_id, similarity), the best first."""
        use = self.scores > -np.inf
        return pd.DataFrame({"query_id": np.repeat(self.ids, use.sum(axis=1)), "item_id": self.items[use], "similarity": self.scores[use]}).astype({"query_id": "int64", "item_id": "int64", "similarity": "float64"})


def _single(v: np.ndarray, longest: float) -> tuple[type, float]:
    """The precision in which products of ``v`` with vectors of a norm up to ``longest`` are screened, and their error for a vector of norm 1."""
    top = float(np.linalg.norm(v, axis=1).max())
    kind = np.float32 if top < 1e15 and longest < 1e15 and (top == 0 or longest == 0 or top * longest > 1e-24) else np.float64
    return kind, (v.shape[1] + 4) * float(np.finfo(kind).eps) * top


def _best(
    query_ids: np.ndarray, q: np.ndarray, item_ids: np.ndarray, v: np.ndarray, k: int, drop_self: bool, skus: tuple | None = None,
    turns: tuple | None = None, digits: int = 0,
) -> pd.DataFrame:
    """The best items of each query in a block, ties (to ``digits`` places) to the smaller id. ``skus``: those of queries and items, where equal
    ones are no match; ``turns``: those of queries and items, where an item must come before the query."""
    best = Best(query_ids, q, k, drop_self, digits, skus and skus[0], turns and turns[0])
    best.meet(item_ids, v, skus and skus[1], turns and turns[1])
    return best.found()


NEAR = "query_id long, item_id long, similarity double"


def top_k(queries: DataFrame, items: DataFrame, k: int, drop_self: bool = True, digits: int = 12, other_sku: bool = False, earlier: bool = False, same: bool = False, floor: float = -np.inf, mates: bool = False) -> DataFrame:
    """The ``k`` items (item_id, vec) of largest product for each query (query_id, vec): query_id, rank, item_id, similarity.

    A query set that is small beside ``SENT_BYTES`` goes to the tasks of the item scan, which is not moved; a larger one is packed in blocks, which
    meet blocks of items in a Cartesian product. Ties (to ``digits`` places) go to the smaller item_id. With ``other_sku``,
    both sides have sku_id (long), and items of the query's own are no match; with ``earlier``, both have ``turn`` (long), and only items
    of a smaller one match. ``same``: the queries are the items, which are then packed once; where ids are all different, each two blocks meet once, for both.

    What the caller has no use for may be left out: items under ``floor``, and, with ``mates``, those under the least product of a query with another item of its SKU
    (``items`` has sku_id then), and queries that are the only item of theirs.
    """
    size = queries.agg(F.count("*"), F.countDistinct("query_id")).first()
    n, dim = size[0], max((len(r[0]) for r in queries.filter("vec is not null").select("vec").limit(1).collect()), default=0)
    marks = (["sku_id"] if other_sku else []) + (["turn"] if earlier else [])
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "item_id")
    ranked = lambda near: near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "item_id", "similarity")
    rounded = lambda near: near.withColumn("similarity", F.round("similarity", digits)) if digits else near

    if n * dim * 64 > SENT_BYTES and same and size[1] == n and not marks:
        return rounded(paired(items, k, drop_self, digits, n, floor, mates))
    if n * dim * 64 > SENT_BYTES:
        held = packed(items, "item_id", marks, n_rows=n if same else None)
        asked = held if same else packed(queries, "query_id", marks, n_rows=n)

        def start(ids: np.ndarray, q: np.ndarray, own: dict[str, np.ndarray]) -> Best:
            return Best(ids, q, k, drop_self, digits, own.get("sku_id"), own.get("turn"), floor)

        def meet(best: Best, ids: np.ndarray, v: np.ndarray, own: dict[str, np.ndarray]) -> None:
            best.meet(ids, v, own.get("sku_id"), own.get("turn"))

        near = rounded(crossed(asked, held, marks, start, meet, k, digits))
        return near if size[1] == n else ranked(near.drop("rank"))

    sent = queries.select("query_id", "vec", *marks).toPandas()
    held = queries.sparkSession.sparkContext.broadcast((sent["query_id"].to_numpy(), _matrix(sent["vec"]), {c: sent[c].to_numpy() for c in marks}))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q, own = held.value
        best = Best(ids, q, k, drop_self, digits, own.get("sku_id"), own.get("turn"), floor) if n else None
        for pdf in batches:
            if len(pdf) and n:
                best.meet(pdf["item_id"].to_numpy(), _matrix(pdf["vec"]), *[pdf[c].to_numpy() if c in marks else None for c in ("sku_id", "turn")])
        if n:
            yield best.found()

    return ranked(rounded(items.select("item_id", "vec", *marks).mapInPandas(scan, NEAR)))


#: Rows of a packed block. A block is a file, so tables are read in partitions of a bounded size.
BLOCK_ROWS = 8_192


def _block_rows(n_rows: int | None) -> int:
    return BLOCK_ROWS if n_rows is None else int(min(BLOCK_ROWS, max(1024, n_rows // 12)))


def packed(rows: DataFrame, key: str, marks: Sequence[str] = (), n_rows: int | None = None, floors: Callable | None = None) -> DataFrame:
    """``rows`` (key, vec, and ``marks``, longs) as a stored table of blocks: (block, ids, vecs and the marks, all packed), a file for each. With ``floors``, a block has
    what that gives for its ids, vectors and marks, a double for each row."""
    most = _block_rows(n_rows)
    names = ["ids", "vecs", *marks, *(["floors"] if floors else [])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, part, number = [], 0, TaskContext.get().partitionId() if TaskContext.get() else 0, 0

        def block(n: int) -> tuple[pa.RecordBatch, list, int]:
            whole = pa.Table.from_batches(held).combine_chunks()
            some, rest = whole.slice(0, n), whole.slice(n)
            flat = lambda c: some.column(c).combine_chunks()
            vec = flat("vec")
            vecs = np.frombuffer(b"".join(vec.to_pylist()), np.float64) if pa.types.is_binary(vec.type) else np.ascontiguousarray(vec.flatten().to_numpy(zero_copy_only=False), np.float64)
            out = [flat("id").to_numpy().astype(np.int64).tobytes(), vecs.tobytes(), *[flat(c).to_numpy().astype(np.int64).tobytes() for c in marks]]
            if floors:
                found = floors(np.frombuffer(out[0], np.int64), vecs.reshape(some.num_rows, -1), {c: np.frombuffer(x, np.int64) for c, x in zip(marks, out[2:])})
                out.append(np.asarray(found, np.float64).tobytes())
            columns = [pa.array([(part << 32) + number], pa.int64()), *[pa.array([x], pa.binary()) for x in out]]
            return pa.RecordBatch.from_arrays(columns, names=["block", *names]), rest.to_batches(), rest.num_rows

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            while size >= most:
                out, held, size = block(most)
                number += 1
                yield out
        if size:
            yield block(size)[0]

    kind = "binary" if dict(rows.dtypes)["vec"] == "binary" else "array<double>"  # doubles that are packed already, or not
    some = rows.filter("vec is not null").select(F.col(key).cast("long").alias("id"), F.col("vec").cast(kind).alias("vec"), *[F.col(c).cast("long").alias(c) for c in marks])
    return stored(some.mapInArrow(pack, "block long, " + ", ".join(f"{c} binary" for c in names)), "packed", maxRecordsPerFile=1)


def met(queries: DataFrame, items: DataFrame, query_marks: Sequence[str] = (), marks: Sequence[str] = ()) -> DataFrame:
    """(block, a_ids, a_vecs, b_ids, b_vecs, and the marks): each of the ``packed`` queries with each of the packed items. What is of the query is null but beside the
    first block of items of a task."""
    first = F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the first row of its partition
    b = items.withColumn("number", F.monotonically_increasing_id()).select("number", *[F.col(c).alias(f"b_{c}") for c in ("ids", "vecs", *marks)])
    a = queries.select("block", *[F.col(c).alias(f"a_{c}") for c in ("ids", "vecs", *query_marks)])
    queries.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # a batch holds two blocks
    return a.hint("shuffle_replicate_nl").crossJoin(b).select("block", *[F.when(first, F.col(c)).alias(c) for c in a.columns[1:]], *b.columns[1:])


#: Blocks of a partition that meets others, and the least number of such partitions.
PART_BLOCKS, LEAST_PARTS = 32, 6


def met_once(held: DataFrame, marks: Sequence[str], n_rows: int) -> DataFrame:
    """(a_block, b_block, a_ids, a_vecs, b_ids, b_vecs, and the marks): each two of the ``packed`` blocks of a table of ``n_rows`` once, and each with itself. A Cartesian product
    that moves no copies: a partition of blocks meets another in one task, and they share the pairs between the two tasks in which they do. What is of the first block is null
    but beside the first row of a task that has it; what is of the second is null where the pair belongs to the other task."""
    parts = max(LEAST_PARTS, -(-n_rows // (BLOCK_ROWS * PART_BLOCKS)))
    names = ["ids", "vecs", *marks]
    side = held.coalesce(parts)
    b = side.withColumn("number", F.monotonically_increasing_id()).select("number", F.col("block").alias("b_block"), *[F.col(c).alias(f"b_{c}") for c in names])
    a = side.select(F.col("block").alias("a_block"), *[F.col(c).alias(f"a_{c}") for c in names])
    first = F.col("number").bitwiseAND(F.lit((1 << 33) - 1)) == 0  # the first row of its partition
    low = F.col("a_block") < F.col("b_block")
    own = (F.col("a_block") == F.col("b_block")) | (low == (F.pmod(F.xxhash64(F.least("a_block", "b_block"), F.greatest("a_block", "b_block")), F.lit(2)) == 0))
    held.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "8m")  # a batch holds two blocks
    pairs = a.hint("shuffle_replicate_nl").crossJoin(b).filter(own | first)
    return pairs.select("a_block", "b_block", *[F.when(first, F.col(f"a_{c}")).alias(f"a_{c}") for c in names], *[F.when(own, F.col(f"b_{c}")).alias(f"b_{c}") for c in names])


def pairs_once(batches: Iterator[pa.RecordBatch], marks: dict[str, type]) -> Iterator[tuple[int, int, dict | None, dict | None]]:
    """(a_block, b_block, first, second) of the rows of ``met_once``: ids, vecs and marks of a block where they come with the row, else None."""
    kinds = {"ids": np.int64, "vecs": np.float64} | marks
    for batch in batches:
        a, b = (batch.column(f"{side}_block").to_pylist() for side in "ab")
        for i in range(batch.num_rows):

            def side(x: str) -> dict | None:
                if not batch.column(f"{x}_ids")[i].is_valid:
                    return None
                out = {c: np.frombuffer(batch.column(f"{x}_{c}")[i].as_buffer(), kind) for c, kind in kinds.items()}
                return out | {"vecs": out["vecs"].reshape(len(out["ids"]), -1)}

            yield a[i], b[i], side("a"), side("b")


def crossed(queries: DataFrame, items: DataFrame, marks: Sequence[str], start: Callable, meet: Callable, k: int, digits: int, rings: int = 0) -> DataFrame:
    """(query_id, rank, item_id, similarity) of ``packed`` queries against packed items. A task holds a block of queries, ``start(ids, vecs, marks)``, and ``meet``
    adds a block of items to it; what a block of queries found in each partition of the items is merged, packed too. Nothing but that is shuffled, and a block of
    queries reaches a task once for each partition of items. With ``rings``, a state holds ``k`` for each of so many sets of items side by side, and rows come with ``ring``, for
    each the best of it and those before it. Marks are of the items only, then."""
    own_marks = () if rings else marks
    pairs = met(queries, items, own_marks, marks)

    def longs(batch: pa.RecordBatch, i: int, side: str) -> dict[str, np.ndarray]:
        return {c: np.frombuffer(batch.column(f"{side}_{c}")[i].as_buffer(), np.int64) for c in ("ids", *(own_marks if side == "a" else marks))}

    def vectors(batch: pa.RecordBatch, i: int, name: str, n: int) -> np.ndarray:
        return np.frombuffer(batch.column(name)[i].as_buffer(), np.float64).reshape(n, -1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, best = None, None
        pack = lambda: pa.RecordBatch.from_arrays([pa.array([at]), *[pa.array([x.tobytes()], pa.binary()) for x in (best.ids, best.items, best.scores)]], names=["block", "ids", "items", "scores"])
        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("a_ids")[i].is_valid:
                    if best is not None:
                        yield pack()
                    own = longs(batch, i, "a")
                    at, ids = batch.column("block")[i].as_py(), own.pop("ids").copy()
                    best = start(ids, vectors(batch, i, "a_vecs", len(ids)).copy(), {c: x.copy() for c, x in own.items()})
                own = longs(batch, i, "b")
                ids = own.pop("ids")
                meet(best, ids, vectors(batch, i, "b_vecs", len(ids)), own)
        if best is not None:
            yield pack()

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, out = np.frombuffer(pdf["ids"].iloc[0], np.int64), []
        part = lambda name, kind, n: np.concatenate([np.frombuffer(x, kind).reshape(len(ids), -1)[:, n * k : (n + 1) * k] for x in pdf[name]], axis=1)
        item, score = np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0))
        for n in range(max(rings, 1)):
            item, score = np.concatenate([item, part("items", np.int64, n)], axis=1), np.concatenate([score, part("scores", np.float64, n)], axis=1)
            order = np.lexsort((item, -(np.round(score, digits) if digits else score)), axis=1)[:, :k]
            item, score = np.take_along_axis(item, order, axis=1), np.take_along_axis(score, order, axis=1)
            use = score > -np.inf
            rank = np.broadcast_to(np.arange(1, item.shape[1] + 1, dtype=np.int32), item.shape)
            found = pd.DataFrame({"query_id": np.repeat(ids, use.sum(axis=1)), "rank": rank[use], "item_id": item[use], "similarity": score[use]})
            out.append(found.assign(ring=np.int32(n)) if rings else found)
        return pd.concat(out)

    parts = pairs.mapInArrow(work, "block long, ids binary, items binary, scores binary")
    return parts.groupBy("block").applyInPandas(lambda pdf: merge(pdf), "query_id long, rank int, item_id long, similarity double" + (", ring int" if rings else ""))


#: Items that first floors come from, and the largest SKU whose items give each other floors.
FLOOR_ROWS, MOST_MATES = 4096, 16


def sample_floors(ids: np.ndarray, v: np.ndarray, k: int, drop_self: bool, digits: int) -> Callable:
    """A function of the ids and vectors of queries: what no item that is among a query's ``k`` best can be under, as some items (ids, v) give it."""
    width = 256 if len(v) >= 512 and k < 256 else len(v)
    ids, v = ids[: len(v) // max(width, 1) * width], v[: len(v) // max(width, 1) * width]
    order = np.argsort(ids, kind="stable")

    def floors(own: np.ndarray, q: np.ndarray) -> np.ndarray:
        out = np.full(len(own), -np.inf)
        if not len(own) or len(v) < k + 1 or not np.isfinite(v).all() or not np.isfinite(q).all():
            return out
        norm = np.linalg.norm(q, axis=1)
        kind, error = _single(v, float(norm.max()))
        items, asked = v.astype(kind).T, q.astype(kind)
        place = np.searchsorted(ids[order], own)
        place = np.where(ids[order[np.minimum(place, len(ids) - 1)]] == own, order[np.minimum(place, len(ids) - 1)], -1)
        for at in range(0, len(own), 256):
            near = asked[at : at + 256] @ items
            if drop_self:
                row = np.flatnonzero(place[at : at + 256] >= 0)
                near[row, place[at + row]] = -np.inf
            near = near.reshape(len(near), -1, width).max(axis=1)  # of items far apart: k of the largest are k items
            out[at : at + 256] = np.partition(near, width - k, axis=1)[:, width - k]
        return out - 2 * error * norm - (2 * 10.0**-digits if digits else 0.0)

    return floors


def mate_floors(sku: np.ndarray, v: np.ndarray, digits: int) -> np.ndarray:
    """For each row of a block sorted by SKU the least product with another row of its SKU, infinite where there is none. The first and last SKU of a block may go on in others, and large ones give no floor."""
    out = np.full(len(sku), -np.inf)
    starts = np.flatnonzero(np.concatenate([[True], sku[1:] != sku[:-1]])) if len(sku) else np.zeros(0, np.int64)
    sizes = np.diff([*starts, len(sku)])
    starts, sizes = starts[1:-1], sizes[1:-1]
    norm = np.linalg.norm(v, axis=1)
    for n in np.unique(sizes[sizes <= MOST_MATES]):
        at = starts[sizes == n][:, None] + np.arange(n)
        near = np.einsum("gid,gjd->gij", v[at], v[at])
        near -= 1e-9 * (1 + norm[at][:, :, None] * norm[at][:, None, :]) + (2 * 10.0**-digits if digits else 0.0)
        near[:, np.arange(n), np.arange(n)] = np.inf
        out[at] = near.min(axis=2)
    return np.where(np.isnan(out), -np.inf, out)


def floored(items: DataFrame, k: int, drop_self: bool, digits: int, n_rows: int, floor: float = -np.inf, mates: bool = False) -> DataFrame:
    """``packed`` items (item_id, vec) with floors, which keep what a block finds small from the start."""
    rows = items.filter("vec is not null")
    some = rows.select("item_id", "vec").limit(FLOOR_ROWS).toPandas()
    sampled = sample_floors(some["item_id"].to_numpy(np.int64), _matrix(some["vec"]), k, drop_self, digits) if len(some) else None

    def floors(ids: np.ndarray, v: np.ndarray, marks: dict[str, np.ndarray]) -> np.ndarray:
        found = np.maximum(sampled(ids, v) if sampled else -np.inf, floor)
        return np.maximum(found, mate_floors(marks["sku"], v, digits)) if mates else found

    if mates:  # the items of a SKU side by side
        rows = rows.select("item_id", "vec", F.xxhash64("sku_id").alias("sku")).repartition(max(1, int(n_rows / (0.9 * _block_rows(n_rows)))), "sku").sortWithinPartitions("sku")
    return packed(rows, "item_id", ["sku"] if mates else [], n_rows=n_rows, floors=floors).drop("sku")


class PairedBest:
    """What the blocks of a task of ``met_once`` have found in each other."""

    def __init__(self, k: int, drop_self: bool, digits: int):
        self.k, self.drop_self, self.digits, self.states, self.own = k, drop_self, digits, {}, None

    def _state(self, block: int, side: dict[str, np.ndarray]) -> Best:
        if block not in self.states:
            self.states[block] = Best(side["ids"].copy(), side["vecs"], self.k, self.drop_self, self.digits, floor=side["floors"].copy())
        self.states[block].q = side["vecs"]
        return self.states[block]

    def add(self, batch: pa.RecordBatch) -> None:
        for a, b, first, second in pairs_once([batch], {"floors": np.float64}):
            if first is not None:
                if self.own is not None:
                    self.own.q = None
                self.own = self._state(a, first | {"vecs": first["vecs"].copy()})
            if second is not None and a == b:
                self.own.meet(self.own.ids, self.own.q)
            elif second is not None:
                other = self._state(b, second)
                self.own.meet_both(other)
                other.q = None

    def packed(self) -> Iterator[pa.RecordBatch]:
        """A row of ``PAIRED`` for each block that has found something."""
        for block, best in self.states.items():
            use = best.scores > -np.inf
            places = np.repeat(np.arange(len(best.ids), dtype=np.int32), use.sum(axis=1))
            if len(places):
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in (best.ids, places, best.items[use], best.scores[use])]], names=["block", "ids", "places", "items", "scores"])


PAIRED = "block long, ids binary, places binary, items binary, scores binary"


def merged(pdf: pd.DataFrame, k: int, digits: int) -> pd.DataFrame:
    """(query_id, rank, item_id, similarity) of the rows of ``PAIRED`` of a block."""
    ids = np.frombuffer(pdf["ids"].iloc[0], np.int64)
    place, item, score = (np.concatenate([np.frombuffer(x, kind) for x in pdf[c]]) for c, kind in (("places", np.int32), ("items", np.int64), ("scores", np.float64)))
    order = np.lexsort((item, -(np.round(score, digits) if digits else score), place))
    place, item, score = place[order], item[order], score[order]
    rank = np.arange(len(place)) - np.searchsorted(place, place) + 1
    use = rank <= k
    return pd.DataFrame({"query_id": ids[place[use]], "rank": rank[use].astype(np.int32), "item_id": item[use], "similarity": score[use]})


def paired(items: DataFrame, k: int, drop_self: bool, digits: int, n_rows: int, floor: float = -np.inf, mates: bool = False) -> DataFrame:
    """(query_id, rank, item_id, similarity) of items (item_id, vec), whose ids are all different, against each other. Each two packed blocks meet once, and a product counts for both
    of its items. A task holds what each block has found in it; that is merged, packed too."""
    held = floored(items, k, drop_self, digits, n_rows, floor, mates)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = PairedBest(k, drop_self, digits)
        for batch in batches:
            found.add(batch)
        yield from found.packed()

    parts = met_once(held, ["floors"], n_rows).mapInArrow(work, PAIRED)
    return parts.groupBy("block").applyInPandas(lambda pdf: merged(pdf, k, digits), "query_id long, rank int, item_id long, similarity double")


def _pair_blocks(items: DataFrame, group: str | None, block_rows: int):
    """Rows of items dealt to pairs of blocks (i, j) of each group, grouped."""
    rows = items.withColumn("g", F.col(group).cast("string") if group else F.lit("*"))
    counts = rows.groupBy("g").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("blocks"))
    rows = rows.join(counts, "g").withColumn("block", F.pmod(F.xxhash64("item_id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("g", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *[F.xxhash64(c).alias("sku") for c in rows.columns if c == "sku_id"], "item_id", "vec")
    return rows.groupBy("g", "i", "j")


def _products(key: tuple, pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Products of a block pair's pairs, each pair once, and whether their SKUs are equal."""
    _, i, j = key
    block, sku, v = pdf["block"].to_numpy(), pdf["sku"].to_numpy(), _matrix(pdf["vec"])
    a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
    near, equal = v[a] @ v[b].T, sku[a][:, None] == sku[b][None, :]
    use = np.triu(np.ones_like(equal), 1) if i == j else np.ones_like(equal)
    return near[use], equal[use]


def pair_counts(items: DataFrame, group: str | None, digits: int = 4, block_rows: int = 1024) -> DataFrame:
    """Counts of all pairs of items (item_id, sku_id, vec) of one ``group`` value (all items, for None) by similarity rounded to
    ``digits`` and by whether the SKUs are equal: (category, similarity, label, n)."""

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        near, equal = _products(key, pdf)
        codes, n = np.unique(np.round(near * 10**digits).astype(np.int64) * 2 + equal, return_counts=True)
        return pd.DataFrame({"g": key[0], "similarity": (codes >> 1) / 10**digits, "label": (codes & 1).astype("int32"), "n": n})

    found = _pair_blocks(items, group, block_rows).applyInPandas(count, "g string, similarity double, label int, n long")
    return found.groupBy(F.col("g").alias("category"), "similarity", "label").agg(F.sum("n").alias("n"))


class Counted:
    """Pairs at each of ``thresholds`` or more, by whether their SKUs are equal, of blocks that meet. Products are taken in single precision, and in double where that leaves a
    threshold open. Rows of a block with equal SKU and vector count as one row with their number."""

    TILE, WIDTH, DECIDED = 1 << 18, 1024, 200_000

    def __init__(self, thresholds: Sequence[float]):
        self.thresholds, self.tp, self.fp, self.compared = list(thresholds), [0] * len(thresholds), [0] * len(thresholds), 0

    @staticmethod
    def rows(sku: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sku, vectors, number) of the distinct rows."""
        use = ~np.isnan(v).any(axis=1)  # no product of theirs reaches anything
        sku, v = sku[use], v[use]
        with np.errstate(all="ignore"):
            if len(np.unique(v @ np.cos(np.arange(1, v.shape[1] + 1)))) == len(v):
                return sku, v, np.ones(len(v), np.int64)
        key = np.ascontiguousarray(np.concatenate([sku[:, None], (v + 0.0).view(np.int64)], axis=1))
        _, at, n = np.unique(key.view(np.dtype((np.void, key.shape[1] * 8))).ravel(), return_index=True, return_counts=True)
        return sku[at], v[at], n

    def meet(self, a: tuple, b: tuple | None) -> None:
        """``rows`` of two blocks, or of one with itself."""
        (sku, x, n), (other, y, m) = a, b or a
        if not len(x) or not len(y):
            return
        kind, error = _single(y, float(np.linalg.norm(x, axis=1).max()))
        slack, least = error * float(np.linalg.norm(x, axis=1).max()), min(self.thresholds)
        u, v = x.astype(kind), y.astype(kind)
        tile = max(64, self.TILE // self.WIDTH)
        room = np.empty(tile * self.WIDTH, kind)  # one for all tiles, so that it stays in the cache
        for lo in range(0, len(v), self.WIDTH):
            one = np.ascontiguousarray(v[lo : lo + self.WIDTH].T)
            for at in range(0, min(len(u), lo + one.shape[1]) if b is None else len(u), tile):
                rows = u[at : at + tile]
                near = np.matmul(rows, one, out=room[: len(rows) * one.shape[1]].reshape(len(rows), -1))
                self.compared += near.size
                some = np.flatnonzero(~(near.max(axis=1) < least - slack))
                if len(some):
                    row, column = np.nonzero(~(near[some] < least - slack))
                    for part in range(0, len(row), self.DECIDED):
                        i, j = row[part : part + self.DECIDED], column[part : part + self.DECIDED]
                        self._settle(near[some[i], j].astype(np.float64), at + some[i], lo + j, slack, (sku, x, n), (other, y, m), b is None)
        if b is None:
            self._add(np.einsum("ij,ij->i", x, x), np.ones(len(x), bool), n * (n - 1) // 2)

    def _settle(self, s: np.ndarray, i: np.ndarray, j: np.ndarray, slack: float, a: tuple, b: tuple, alone: bool) -> None:
        if alone:
            use = i < j
            s, i, j = s[use], i[use], j[use]
        for at in range(0, len(s), 50_000):
            part = slice(at, at + 50_000)
            open_ = at + np.flatnonzero(~(np.abs(s[part, None] - np.array(self.thresholds)) > slack).all(axis=1))
            s[open_] = np.einsum("ij,ij->i", a[1][i[open_]], b[1][j[open_]])
        self._add(s, a[0][i] == b[0][j], a[2][i] * b[2][j])

    def _add(self, s: np.ndarray, equal: np.ndarray, pairs: np.ndarray) -> None:
        for k, t in enumerate(self.thresholds):
            self.tp[k] += int(pairs[equal & (s >= t)].sum())
            self.fp[k] += int(pairs[~equal & (s >= t)].sum())


def scanned_counts(items: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """(threshold, tp, fp, compared) in parts to be summed: pairs of items (item_id, sku_id, vec) at each threshold or more, by whether their SKUs are equal. Packed blocks meet
    once each; nothing is shuffled but the counts."""
    rows = items.filter("vec is not null").withColumn("sku", F.xxhash64("sku_id"))
    n = rows.count()
    held = packed(rows, "item_id", ["sku"], n_rows=n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, own = Counted(thresholds), None
        for a, b, first, second in pairs_once(batches, {"sku": np.int64}):
            if first is not None:
                own = Counted.rows(first["sku"], first["vecs"])
            if second is not None:
                found.meet(own, None if a == b else Counted.rows(second["sku"], second["vecs"]))
        k = len(found.thresholds)
        yield pa.RecordBatch.from_pydict({"threshold": pa.array(found.thresholds, pa.float64()), "tp": pa.array(found.tp, pa.int64()), "fp": pa.array(found.fp, pa.int64()), "compared": pa.array([found.compared] * k, pa.int64())})

    return met_once(held, ["sku"], n).mapInArrow(count, "threshold double, tp long, fp long, compared long")


def _forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that links (a, b) join it to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = np.minimum(root, root[root])
        if (before == root).all():
            return root
