"""K-means in exact integers, with a heap of bounds for each cluster.

Vectors stand in blocks. In a block, each cluster has a heap of its vectors, ordered by the gap between a lower bound
of the distance to any other centroid and an upper bound of that to its own. When centroids move, the gaps
of a cluster shrink by no more than the distance that its centroid and the fastest of the others moved. That drift is
added up for each cluster, and a vector enters a heap with its gap plus the drift so far. So only the vectors on top
of a heap whose gap has expired are popped and compared with all centroids; the others need no look.
"""

from __future__ import annotations

import hashlib
import heapq
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from inkstone.llm.common import short_batches
from inkstone.session import use_checkpoints

#: Vectors of one block.
BLOCK = 4096
#: Components beyond this can't be squared and summed in 64 bits.
LARGEST = 1 << 27
#: Up to this size, products and sums of 64 components are exact in double precision.
EXACT = 1 << 22
#: A gap within this of zero counts as expired, since bounds are rounded.
SLACK = 1e-6


@dataclass
class Places:
    """The centroids of a round and how far each cluster's gaps have shrunk since the first."""

    points: np.ndarray
    drift: np.ndarray

    def moved(self, points: np.ndarray) -> Places:
        steps = np.sqrt(((points - self.points).astype(np.float64) ** 2).sum(axis=1)) * (1 + 1e-12)
        most = np.array([np.delete(steps, c).max(initial=0.0) for c in range(len(steps))])
        return Places(points, self.drift + steps + most)


def squared(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances, n x k."""
    if max(np.abs(x).max(initial=0), np.abs(points).max(initial=0)) <= EXACT and x.shape[1] <= 64:
        a, b = x.astype(np.float64), points.astype(np.float64)
        return ((a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)[None, :]).astype(np.int64)
    return np.stack([((x - p) ** 2).sum(axis=1) for p in points], axis=1)


def nearest(x: np.ndarray, at: Places) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, key in its heap) of every vector; ties go to the smaller number."""
    d = squared(x, at.points)
    cluster = d.argmin(axis=1)
    rows = np.arange(len(x))
    own = np.sqrt(d[rows, cluster].astype(np.float64)) * (1 + 1e-12)
    if d.shape[1] == 1:
        return cluster, np.full(len(x), np.inf)
    d[rows, cluster] = np.iinfo(np.int64).max
    other = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - 1e-12)
    return cluster, other - own + at.drift[cluster]


class Block:
    """Some vectors, and for each cluster the heap of (key, place) of its members."""

    def __init__(self, ids: pa.Array, x: np.ndarray, heaps: list[list[tuple[float, int]]]):
        self.ids, self.x, self.heaps = ids, x, heaps
        self.scanned = 0

    @classmethod
    def new(cls, ids: pa.Array, x: np.ndarray, at: Places) -> tuple[Block, np.ndarray]:
        block = cls(ids, x, [[] for _ in at.points])
        return block, block._seat(np.arange(len(x)), at)

    @classmethod
    def load(cls, row: dict) -> Block:
        x = np.frombuffer(row["x"], dtype=row["kind"]).reshape(len(row["ids"]), -1).astype(np.int64)
        keys, places = np.frombuffer(row["keys"], dtype=np.float64).tolist(), np.frombuffer(row["places"], dtype=np.int32).tolist()
        ends = np.cumsum(np.frombuffer(row["sizes"], dtype=np.int32)).tolist()
        pairs = list(zip(keys, places))
        return cls(row["ids"], x, [pairs[a:b] for a, b in zip([0, *ends], ends)])

    def dump(self, delta: np.ndarray) -> dict:
        widest = np.abs(self.x).max(initial=0)
        kind = "int16" if widest < 1 << 15 else "int32"
        pairs = [p for heap in self.heaps for p in heap]
        changed = np.flatnonzero(delta.any(axis=1))
        return {
            "ids": self.ids, "kind": kind, "x": self.x.astype(kind).tobytes(),
            "keys": np.array([k for k, _ in pairs], dtype=np.float64).tobytes(), "places": np.array([i for _, i in pairs], dtype=np.int32).tobytes(),
            "sizes": np.array([len(h) for h in self.heaps], dtype=np.int32).tobytes(),
            "scanned": self.scanned, "delta": [{"cluster": int(c), "sums": delta[c].tolist()} for c in changed],
        }

    def _seat(self, popped: np.ndarray, at: Places) -> np.ndarray:
        """Compare vectors with all centroids and push them; what that adds to each cluster's sums and count (last)."""
        self.scanned = len(popped)
        gain = np.zeros((len(at.points), self.x.shape[1] + 1), dtype=np.int64)
        if not len(popped):
            return gain
        cluster, keys = nearest(self.x[popped], at)
        for c, key, place in zip(cluster.tolist(), keys.tolist(), popped.tolist()):
            heapq.heappush(self.heaps[c], (key, place))
        np.add.at(gain, cluster, np.column_stack([self.x[popped], np.ones(len(popped), dtype=np.int64)]))
        return gain

    def step(self, at: Places) -> np.ndarray:
        """Pop what has expired, seat it anew; the change of sums and counts."""
        loss = np.zeros((len(at.points), self.x.shape[1] + 1), dtype=np.int64)
        popped: list[int] = []
        for c, heap in enumerate(self.heaps):
            limit, first = at.drift[c] * (1 + 1e-9) + SLACK, len(popped)
            while heap and heap[0][0] <= limit:
                popped.append(heapq.heappop(heap)[1])
            own = popped[first:]
            loss[c, :-1], loss[c, -1] = self.x[own].sum(axis=0), len(own)
        return self._seat(np.array(popped, dtype=np.int64), at) - loss


def state_schema(id_type: str) -> str:
    return (
        f"ids array<{id_type}>, kind string, x binary, keys binary, places binary, sizes binary, scanned int, "
        "delta array<struct<cluster:int,sums:array<bigint>>>"
    )


def _batch(rows: list[dict], id_type: pa.DataType) -> pa.RecordBatch:
    sums = pa.list_(pa.struct([("cluster", pa.int32()), ("sums", pa.list_(pa.int64()))]))
    kinds = {"kind": pa.string(), "x": pa.binary(), "keys": pa.binary(), "places": pa.binary(), "sizes": pa.binary(), "scanned": pa.int32(), "delta": sums}
    columns = [pa.ListArray.from_arrays(np.cumsum([0, *(len(r["ids"]) for r in rows)]).astype(np.int32), pa.concat_arrays([r["ids"].cast(id_type) for r in rows]))]
    columns += [pa.array([r[name] for r in rows], type=kind) for name, kind in kinds.items()]
    return pa.RecordBatch.from_arrays(columns, names=["ids", *kinds])


def _loaded(batch: pa.RecordBatch) -> Iterator[Block]:
    names = ["kind", "x", "keys", "places", "sizes"]
    ids = batch.column("ids")
    for k in range(batch.num_rows):
        yield Block.load({"ids": ids[k].values, **{n: batch.column(n)[k].as_py() for n in names}})


def whole_numbers(vectors: pa.Array, dim: int, scale: int) -> np.ndarray:
    flat = np.floor(np.asarray(vectors.flatten(), dtype=np.float64) * scale)
    if len(flat) and np.abs(flat).max() > LARGEST:
        raise ValueError(f"a component times {scale} is beyond {LARGEST}; squared distances would not fit 64 bits")
    return flat.astype(np.int64).reshape(-1, dim)


def digest(point) -> str:
    return hashlib.sha256(",".join(str(int(v)) for v in point).encode()).hexdigest()


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, seed: str = "2",
    id_col: str = "vec_id", vec_col: str = "embedding", folder: str | None = None,
) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector of ``dim`` finite components.

    Components become floor(scale * x). The first centroids are the ``k`` vectors with the least sha256 of ``seed:id``
    (equal hashes in order of the vectors; a null id is written as nothing). Each round assigns all vectors to the
    nearest centroid, ties to the smaller number, and puts every centroid with members at their floored mean.
    Then vectors are assigned once more. Vectors that are null, of another length, or hold null or non-finite
    components are left out; repeated rows are vectors of their own; with fewer than ``k`` vectors all are
    centroids; an empty table gives no row. Components beyond 2^27 after scaling raise ValueError.

    The state of a round is a table of blocks in ``folder`` (a new one below the checkpoint folder by default), from
    which the next round starts. The driver holds the centroids and their sums, k x dim numbers.
    """
    spark = vectors.sparkSession
    short_batches(spark)
    if folder is None:
        use_checkpoints(spark)
        folder = f"{spark.sparkContext.getCheckpointDir()}/centroids-{uuid.uuid4().hex}"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    kept = rows.filter(F.coalesce((F.size("v") == dim) & finite, F.lit(False)))
    id_type = kept.schema["id"].dataType.simpleString()
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(named.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    schema = f"id {id_type}, cluster int, distance bigint"
    if not first:
        out = spark.createDataFrame([], f"{schema}, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
        return out.withColumnRenamed("id", id_col)
    start = whole_numbers(pa.array([r["v"] for r in first], type=pa.list_(pa.float64())), dim, scale)
    at = Places(start, np.zeros(len(start)))

    def enter(places: Places):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, BLOCK):
                    part = batch.slice(begin, BLOCK)
                    block, gain = Block.new(part.column(0), whole_numbers(part.column(1), dim, scale), places)
                    yield _batch([block.dump(gain)], part.schema.field(0).type)

        return run

    def again(places: Places):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _loaded(batch):
                    yield _batch([block.dump(block.step(places))], block.ids.type)

        return run

    def finish(places: Places):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for block in _loaded(batch):
                    block.step(places)
                    own = np.empty(len(block.x), dtype=np.int32)
                    for c, heap in enumerate(block.heaps):
                        own[[place for _, place in heap]] = c
                    far = ((block.x - places.points[own]) ** 2).sum(axis=1)
                    yield pa.RecordBatch.from_arrays([block.ids, pa.array(own), pa.array(far)], names=["id", "cluster", "distance"])

        return run

    sums = [[0] * (dim + 1) for _ in start]
    for turn in range(rounds):
        source = kept.mapInArrow(enter(at), state_schema(id_type)) if turn == 0 else spark.read.parquet(f"{folder}/{turn - 1}").mapInArrow(again(at), state_schema(id_type))
        source.write.parquet(f"{folder}/{turn}")
        changes = spark.read.parquet(f"{folder}/{turn}").select(F.explode("delta").alias("d")).select("d.cluster", F.posexplode("d.sums").alias("part", "value"))
        for r in changes.groupBy("cluster", "part").agg(F.sum(F.col("value").cast("decimal(20,0)")).alias("value")).collect():
            sums[r["cluster"]][r["part"]] += int(r["value"])
        points = at.points.copy()
        for c, own in enumerate(sums):
            if own[-1]:
                points[c] = [s // own[-1] for s in own[:-1]]
        at = at.moved(points)
    last = kept.mapInArrow(enter(at), state_schema(id_type)) if rounds == 0 else spark.read.parquet(f"{folder}/{rounds - 1}")
    last.mapInArrow(finish(at), schema).write.parquet(f"{folder}/result")
    result = spark.read.parquet(f"{folder}/result")
    by_cluster = {r["cluster"]: int(r["s"]) for r in result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}
    total = sum(by_cluster.values())
    facts = [(c, by_cluster[c], total, digest(at.points[c])) for c in sorted(by_cluster)]
    known = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    # one row a centroid
    joined = result.join(F.broadcast(known), "cluster")
    return joined.select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
