"""Skip-gram with negative sampling over node vectors in blocks; nothing that grows with the nodes comes to the driver.

Nodes are dealt to blocks by the hash of their id; a block has a table of centre vectors and one of context vectors, written in chunks of
rows. The pairs of a walk's window are summed to (centre, context, n) and lie in buckets (centre block, context block), packed by thousands in the
order of a hash. An epoch has as many rounds as there are blocks: in round r the task of centre block c trains the bucket (c, c + r), so no two
tasks touch the same block, and each task has two blocks and a stream of pairs in memory. All blocks pass a shuffle in each round, so
there are no more of them than memory or WORKERS ask for. They are written after each epoch, or each WRITE_EVERY rounds of a long one: a run that
was stopped goes on after its last written round.

A pair counts n times in the loss, and its work doesn't grow with n, so a hub's pairs are no more than the nodes it meets. The steps are
row-wise Adagrad over minibatches, whose packs and whose pairs within a pack change places each epoch by seeded draws, and negatives are drawn from the round's context block by count ** 0.75.

Defined results: nodes seen less than min_count times in the walks have no vector; no walks give no rows; rows without a path count as none.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regimen.operators.sample import index_rows
from regimen.sources.tables import TASK_ROWS, delete, exists, join_counted, own_folder, written

#: Bytes of a block's table; nodes in a block if there are fewer than WORKERS blocks; rows in a chunk of its table, pairs in a minibatch and in a pack; rounds between writes.
BLOCK_BYTES, BLOCK_NODES, WORKERS, CHUNK, BATCH, PACK, WRITE_EVERY = 1 << 28, 1 << 18, 4, 1 << 12, 1 << 8, 1 << 16, 4
_CENTRES, _CONTEXTS, _WEIGHTS, _PAIRS = range(4)


def _reach(i: Column, window: int, seed: int) -> Column:
    return 1 + F.pmod(F.xxhash64(F.lit(seed), "_key", i.cast("bigint")), F.lit(window))


def _within(places: Column | str, make: Callable[[Column, Column], Column]) -> Column:
    """What make gives for each two of places (i, reach and more) of which the second is within reach of the first, as rows."""
    others = lambda c: F.filter(places, lambda o: (o["i"] != c["i"]) & (F.abs(o["i"] - c["i"]) <= c["reach"]))
    return F.inline(F.flatten(F.transform(places, lambda c: F.transform(others(c), lambda o: make(c, o)))))


def window_pairs(walks: DataFrame, window: int, seed: int, path: str = "path") -> DataFrame:
    """centre, context, n: how often context stands within a drawn distance of 1 to window places of centre in the paths."""
    keyed = walks.where(F.size(path) > 1).select(F.col(path).alias("_path"), F.xxhash64(*walks.columns).alias("_key"))
    places = keyed.select(F.transform("_path", lambda x, i: F.struct(i.alias("i"), _reach(i, window, seed).alias("reach"), x.alias("id"))).alias("_places"))
    return places.select(_within("_places", lambda c, o: F.struct(c["id"].alias("centre"), o["id"].alias("context")))).groupBy("centre", "context").agg(F.count(F.lit(1)).alias("n"))


def numbered_pairs(walks: DataFrame, placed: DataFrame, window: int, seed: int) -> DataFrame:
    """cb, c, xb, x, n: window_pairs by the blocks and rows of both ends; placed: id, uses, block, at. The places of the paths are numbered, which are fewer than the pairs."""
    rows = written(walks.where(F.size("path") > 1).select("path", F.xxhash64(*walks.columns).alias("_key"), F.monotonically_increasing_id().alias("_row")), "keyed-walks")
    each = rows.select("_row", "_key", F.posexplode("path").alias("i", "id")).select("_row", "i", "id", _reach(F.col("i"), window, seed).cast("int").alias("reach"))
    met = join_counted(each.where("id is not null"), placed.select("id", "block", "at", F.col("uses").alias("n")), ["id"])  # a hub stands in many paths
    paths = met.groupBy("_row").agg(F.collect_list(F.struct("i", "reach", "block", "at")).alias("_places"))
    pairs = paths.select(_within("_places", lambda c, o: F.struct(c["block"].alias("cb"), c["at"].alias("c"), o["block"].alias("xb"), o["at"].alias("x"))))
    return pairs.groupBy("cb", "c", "xb", "x").agg(F.least(F.count(F.lit(1)), F.lit((1 << 31) - 1)).cast("int").alias("n"))


def _kept(df: DataFrame, path: str) -> DataFrame:
    """df as a table at path, computed only if a whole one isn't there from an earlier run."""
    spark = df.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class _Task:
    """The blocks of one bucket and the steps over its pairs."""

    def __init__(self, task: int, dim: int, negatives: int, rate: float, seed: int) -> None:
        self.task, self.dim, self.negatives, self.rate = task, dim, negatives, rate
        self.random = np.random.default_rng([seed, task])
        self.chunks: dict[int, list[np.ndarray]] = {_CENTRES: [], _CONTEXTS: [], _WEIGHTS: []}
        self.tables: dict[int, np.ndarray] | None = None
        self.held: list[np.ndarray] = []

    def chunk(self, kind: int, data: bytes) -> None:
        width = 1 if kind == _WEIGHTS else self.dim + 1  # the last column sums the squares of the row's gradients
        self.chunks[kind].append(np.frombuffer(data, "<f4").reshape(-1, width))

    def ready(self) -> None:
        if self.tables is None:
            width = {_WEIGHTS: 1}
            self.tables = {k: np.concatenate([np.zeros((0, width.get(k, self.dim + 1)), np.float32), *c]) for k, c in self.chunks.items()}
            self.chunks.clear()
            self.until = np.cumsum(self.tables[_WEIGHTS][:, 0].astype(np.float64))

    def pairs(self, rows: np.ndarray) -> None:
        """Trains on rows of (centre, context, n) as soon as a minibatch is there."""
        self.ready()
        self.held.append(rows)
        if sum(map(len, self.held)) >= BATCH:
            rows = np.concatenate(self.held)
            for at in range(0, len(rows) // BATCH * BATCH, BATCH):
                self.step(rows[at : at + BATCH])
            self.held = [rows[len(rows) // BATCH * BATCH :]]

    def step(self, rows: np.ndarray) -> None:
        u, v, d = self.tables[_CENTRES], self.tables[_CONTEXTS], self.dim
        c, x, n = rows[:, 0], rows[:, 1], rows[:, 2].astype(np.float32)
        drawn = np.minimum(np.searchsorted(self.until, self.random.random((len(rows), self.negatives)) * self.until[-1], side="right"), len(v) - 1)
        own, near, far = u[c, :d], v[x, :d], v[drawn, :d]
        g_near = n / (1 + np.exp(np.einsum("ij,ij->i", own, near)))
        g_far = -n[:, None] / (1 + np.exp(-np.einsum("ij,ikj->ik", own, far)))
        self.move(u, c, g_near[:, None] * near + np.einsum("ik,ikj->ij", g_far, far))
        self.move(v, np.concatenate([x, drawn.ravel()]), np.concatenate([g_near[:, None] * own, (g_far[:, :, None] * own[:, None, :]).reshape(-1, d)]))

    def move(self, table: np.ndarray, at: np.ndarray, by: np.ndarray) -> None:
        order = np.argsort(at, kind="stable")
        ends = at[order]
        first = np.flatnonzero(np.concatenate([[True], ends[1:] != ends[:-1]]))
        rows = ends[first]
        total = np.add.reduceat(by[order], first, axis=0)
        table[rows, -1] += (total * total).mean(axis=1)
        table[rows, :-1] += self.rate * total / np.sqrt(table[rows, -1:] + 1e-8)

    def out(self, shift: int, blocks: int) -> Iterator[tuple[int, int, int, bytes]]:
        """side, block, part and data of the chunks as they are after the round."""
        self.ready()
        if self.held and sum(map(len, self.held)):
            self.step(np.concatenate(self.held))
        for side, block in ((_CENTRES, self.task), (_CONTEXTS, (self.task + shift) % blocks)):
            for part, at in enumerate(range(0, len(self.tables[side]), CHUNK)):
                yield side, block, part, self.tables[side][at : at + CHUNK].astype("<f4").tobytes()


def _round(state: DataFrame, weights: DataFrame, pairs: DataFrame, shift: int, blocks: int, epoch: int, dim: int, negatives: int, rate: float, seed: int) -> DataFrame:
    """The state after the buckets (c, c + shift) have been trained, a task each."""
    task = F.when(F.col("side") == _CENTRES, F.col("block")).otherwise(F.pmod(F.col("block") - shift, F.lit(blocks)))
    tables = state.unionByName(weights).select(task.alias("task"), F.col("side").alias("kind"), F.col("part").cast("bigint").alias("place"), "data")
    own = pairs.where(F.col("turn") == shift).select(F.col("cb").alias("task"), F.lit(_PAIRS).alias("kind"), F.xxhash64("piece", "part", F.lit(seed), F.lit(epoch)).alias("place"), "data")
    dealt = tables.unionByName(own).repartitionById(blocks, F.col("task")).sortWithinPartitions("task", "kind", "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Task | None = None

        def done() -> Iterator[pa.RecordBatch]:
            for side, block, part, data in now.out(shift, blocks) if now else ():
                yield pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([block], pa.int32()), pa.array([part], pa.int32()), pa.array([data], pa.binary())], ["side", "block", "part", "data"])

        for batch in batches:
            for task, kind, data in zip(batch.column("task").to_pylist(), batch.column("kind").to_pylist(), batch.column("data")):
                if now is None or now.task != task:
                    yield from done()
                    now = _Task(task, dim, negatives, rate, seed + 1000 * epoch + shift)
                if kind == _PAIRS:
                    rows = np.frombuffer(data.as_buffer(), "<i4").reshape(-1, 3)
                    now.pairs(rows[now.random.permutation(len(rows))])
                else:
                    now.chunk(kind, data.as_py())
        yield from done()

    return dealt.mapInArrow(run, "side int, block int, part int, data binary")


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """turn, cb, piece, part, data: the rows of sorted (turn, cb, piece, c, x, n) by PACK of one bucket and piece."""
    held: list[np.ndarray] = []
    now, part = None, 0

    def out() -> Iterator[pa.RecordBatch]:
        if held:
            data = pa.array([np.concatenate(held).astype("<i4").tobytes()], pa.binary())
            held.clear()
            yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int32()) for v in (*now, part)), data], ["turn", "cb", "piece", "part", "data"])

    for batch in batches:
        keys, rows = (np.stack([np.asarray(batch.column(c)) for c in of], axis=1) for of in (("turn", "cb", "piece"), ("c", "x", "n")))
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
            if a == b:
                continue
            if now != (key := tuple(keys[a].tolist())):
                yield from out()
                now, part = key, 0
            while a < b:
                n = min(b - a, PACK - sum(map(len, held)))
                held.append(rows[a : a + n])
                a += n
                if sum(map(len, held)) == PACK:
                    yield from out()
                    part += 1
    yield from out()


def _first_state(sizes: DataFrame, dim: int, seed: int) -> DataFrame:
    """The chunks before the first round: small centre vectors from seeded draws, context vectors of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, part, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                centres = np.zeros((n, dim + 1), np.float32)
                centres[:, :dim] = (np.random.default_rng([seed, block, part]).random((n, dim)) - 0.5) / math.sqrt(dim)
                yield pa.RecordBatch.from_arrays([pa.array([_CENTRES, _CONTEXTS], pa.int32()), pa.array([block] * 2, pa.int32()), pa.array([part] * 2, pa.int32()), pa.array([centres.tobytes(), np.zeros((n, dim + 1), np.float32).tobytes()], pa.binary())], ["side", "block", "part", "data"])

    return sizes.select("block", "part", "size").mapInArrow(run, "side int, block int, part int, data binary")


def fit(walks: DataFrame, dim: int = 128, window: int = 10, min_count: int = 1, negatives: int = 5, steps: int = 5, rate: float = 0.1, seed: int = 13, block_nodes: int | None = None, path: str | None = None) -> DataFrame:
    """id, vector (array<float>) of every node of the walks, after steps epochs. path: where the state is kept, so that a second call with the same path goes on after the last round that the first one wrote; else a folder of its own."""
    spark: SparkSession = walks.sparkSession
    path = path or f"{own_folder(spark)}/skipgram-{uuid.uuid4().hex}"
    seen = walks.select(F.explode("path").alias("id")).where("id is not null").groupBy("id").agg(F.count(F.lit(1)).alias("uses")).where(F.col("uses") >= min_count)
    seen = _kept(seen, f"{path}/nodes")
    total = seen.count()
    if not total:
        return spark.createDataFrame([], "id string, vector array<float>")
    blocks = -(-total // block_nodes) if block_nodes else max(-(-total * 4 * (dim + 1) // BLOCK_BYTES), min(-(-total // BLOCK_NODES), WORKERS))
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    placed = index_rows(seen.withColumn("block", block), ["block", "id"], "_idx") if not exists(spark, f"{path}/places/_SUCCESS") else None
    if placed is not None:
        placed = written(placed, "placed")
        firsts = placed.groupBy("block").agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("m"))
        placed = join_counted(placed, written(firsts, "blocks"), ["block"], "m").select("id", "uses", "block", (F.col("_idx") - F.col("_first")).cast("int").alias("at"))
        placed.write.mode("overwrite").parquet(f"{path}/places")
    placed = spark.read.parquet(f"{path}/places")

    if not exists(spark, f"{path}/pairs/_SUCCESS"):
        # no more pairs than places within reach, the mean of which is (window + 1) / 2 to each side
        most = placed.agg(F.sum("uses")).first()[0] * (window + 1)
        by, pieces = F.xxhash64("c", "x", F.lit(seed)), -(-most // (blocks * blocks * TASK_ROWS))
        found = numbered_pairs(walks, placed, window, seed)
        found = found.withColumns({"turn": F.pmod(F.col("xb") - F.col("cb"), F.lit(blocks)), "piece": F.pmod(by, F.lit(pieces)).cast("int")})
        dealt = found.repartition("turn", "cb", "piece").sortWithinPartitions("turn", "cb", "piece", by, "c", "x").select("turn", "cb", "piece", "c", "x", "n")
        dealt.mapInArrow(_pack, "turn int, cb int, piece int, part int, data binary").write.mode("overwrite").partitionBy("turn").parquet(f"{path}/pairs")
    pairs = spark.read.schema("cb int, piece int, part int, data binary, turn int").parquet(f"{path}/pairs")
    # chunks of the context counts, and the sizes of all chunks
    part = F.expr(f"at div {CHUNK}").cast("int")
    weigh = F.transform(F.array_sort(F.collect_list(F.struct("at", "uses"))), lambda r: F.pow(r["uses"].cast("double"), 0.75))
    chunks = _kept(placed.groupBy("block", part.alias("part")).agg(weigh.alias("w"), F.count(F.lit(1)).cast("int").alias("size")), f"{path}/weights")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [np.asarray(w.values, np.float32).astype("<f4").tobytes() for w in batch.column("w")]
            yield pa.RecordBatch.from_arrays([pa.array([_WEIGHTS] * batch.num_rows, pa.int32()), batch.column("block"), batch.column("part"), pa.array(data, pa.binary())], ["side", "block", "part", "data"])

    weights = chunks.mapInArrow(packed, "side int, block int, part int, data binary")
    done = lambda r: f"{path}/round-{r:06d}"
    rounds = steps * blocks
    last = next((r for r in range(rounds, 0, -1) if exists(spark, f"{done(r)}/_SUCCESS")), 0)
    if not last:
        _first_state(chunks, dim, seed).write.mode("overwrite").parquet(done(0))
    schema = "side int, block int, part int, data binary"
    state, before = spark.read.schema(schema).parquet(done(last)), last
    for r in range(last, rounds):
        state = _round(state, weights, pairs, r % blocks, blocks, r // blocks, dim, negatives, rate, seed)
        if (r + 1) % min(blocks, WRITE_EVERY) == 0 or r + 1 == rounds:
            state.write.mode("overwrite").parquet(done(r + 1))
            state = spark.read.schema(schema).parquet(done(r + 1))
            drop, before = before, r + 1
            if drop > last:
                delete(spark, done(drop))  # nothing reads it any more
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, p, data in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "data"))):
                table = np.frombuffer(data, "<f4").reshape(-1, dim + 1)[:, :dim]
                n = len(table)
                flat = pa.array(np.ascontiguousarray(table).ravel(), pa.float32())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([b] * n, pa.int32()), pa.array(np.arange(n) + p * CHUNK, pa.int32()), lists], ["block", "at", "vector"])

    final = spark.read.schema("side int, block int, part int, data binary").parquet(done(rounds)).where(F.col("side") == _CENTRES)
    return placed.hint("shuffle_hash").join(final.mapInArrow(vectors, "block int, at int, vector array<float>"), ["block", "at"]).select("id", "vector")
