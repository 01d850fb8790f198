"""Random walks and skip-gram node embeddings."""

from __future__ import annotations

import hashlib
import inspect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.operators import skipgram
from regimen.operators.sample import index_rows
from regimen.sources.tables import bucketed, delete, exists, join_counted, key_sizes, n_partitions, read_json, shared_folder, write_once, written

#: Candidates that a biased walk draws at first; walks that accept none of them, which are few, draw MORE times as many at a time, so that the index is read a few times a step.
TRIES, MORE = 8, 8


def draw(seed: int, step: int, walk: str = "walk", start: str = "start", *more: Column | str) -> Column:
    """32 hash bits for a step of a walk; more: what else tells draws apart."""
    extra = [F.lit(m) if isinstance(m, str) else m.cast("string") for m in more]
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(step)), F.col(walk).cast("string"), F.col(start), *extra)), 1, 8), 16, 10).cast("bigint")


def neighbour_index(edges: DataFrame, asked: int = 1, linked: bool = True) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """What walks join on: places (idx, other), the neighbours of all nodes in the order of (node, other), in buckets by idx; nodes (node, first, degree, n), where a node's neighbours begin; links (a, b), each pair of linked nodes once with a <= b, in buckets, if linked says so.

    A walk joins on the place that it draws, so a hub's many neighbours are many small keys, and the buckets are made once: a step shuffles walks only. asked:
    about how many places a step asks for, for each node, so that a task's share of these is bounded too.
    """
    spark = edges.sparkSession
    known = written(edges.where("src is not null and dst is not null").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "pairs")
    links = None
    if linked:
        n = n_partitions(spark, known.count())
        known = links = bucketed(known.repartition(n, "a", "b").distinct(), ["a", "b"], n, "links")
    one, other = F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other"))
    both = known.select(F.inline(F.when(F.col("a") == F.col("b"), F.array(one)).otherwise(F.array(one, other))))
    placed = index_rows(both, ["node", "other"], distinct=not linked)
    nodes = written(placed.groupBy("node").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("degree")).withColumn("n", F.col("degree")), "degrees")
    n = n_partitions(spark, key_sizes(nodes)[0] + asked * nodes.count())
    return bucketed(placed.select("idx", "other"), ["idx"], n, "places"), nodes, links


def random_walks(edges: DataFrame, num_walks: int = 10, length: int = 20, seed: int = 13, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """start, walk, path: num_walks walks of up to length nodes from every node. p, q are the return and in-out weights of node2vec; 1 and 1 are uniform picks by hash; others are drawn uniformly and accepted by their weight.

    Joins are never broadcast by an estimate: a table of few bytes may have many candidates a row.
    """
    uniform = p == 1.0 and q == 1.0
    places, nodes, links = neighbour_index(edges, num_walks * (1 if uniform else TRIES), linked=not uniform)
    sizes = key_sizes(nodes)
    walks = nodes.select(F.col("node").alias("start"), F.explode(F.sequence(F.lit(0), F.lit(num_walks - 1))).alias("walk"), F.array("node").alias("path"), F.col("node").alias("at"))

    def placed(rows: DataFrame) -> DataFrame:
        """rows with first and degree of at. A node has about as many walks as neighbours, at most num_walks times as many."""
        return join_counted(rows, nodes.withColumnRenamed("node", "at"), ["at"], sizes=sizes)

    def met(rows: DataFrame) -> DataFrame:
        """rows with the neighbour (other) at their idx."""
        return places.join(rows.hint("shuffle_hash"), "idx").drop("idx")

    if uniform:
        for step in range(1, length):
            picked = placed(walks).withColumn("idx", F.col("first") + F.pmod(draw(seed, step), F.col("degree")))
            walks = met(picked).select("start", "walk", F.array_append("path", F.col("other")).alias("path"), F.col("other").alias("at"))
            if step % 5 == 0:
                walks = written(walks, "walks")
        return walks.select("start", "walk", "path")

    top, low, high = max(1.0, 1 / p, 1 / q), min(1.0, 1 / q), max(1.0, 1 / q)
    luck = lambda t: (draw(seed, step, "walk", "start", t, "luck") + 0.5) / float(1 << 32) * top
    place = lambda t: F.col("first") + F.pmod(draw(seed, step, "walk", "start", t, "k"), F.col("degree"))
    moved_to = lambda to: (F.array_append("path", to).alias("path"), to.alias("at"), F.col("at").alias("last"))
    for step in range(1, length):
        if step == 1:  # nothing came before: the first candidate is taken
            walks = met(placed(walks).withColumn("idx", place(F.lit(0)))).select("start", "walk", *moved_to(F.col("other")))
            continue
        waiting, done, tried, batch = written(placed(walks), "walks"), None, 0, TRIES
        while done is None or not waiting.isEmpty():
            # candidates by hash, accepted with their share of the largest weight: no neighbour list is read, and none is drawn after one that any weight accepts
            lucks = waiting.withColumn("lucks", F.transform(F.sequence(F.lit(tried), F.lit(tried + batch - 1)), luck))
            sure = F.coalesce(F.array_position(F.transform("lucks", lambda x: x < min(low, 1 / p)), F.lit(True)), F.lit(0))
            few = lucks.withColumn("lucks", F.when(sure > 0, F.slice("lucks", F.lit(1), sure.cast("int"))).otherwise(F.col("lucks")))
            tries = few.select("start", "walk", "last", "first", "degree", F.posexplode("lucks").alias("try", "luck")).withColumn("try", F.col("try") + tried)
            found = met(tries.select("start", "walk", "last", "try", "luck", place(F.col("try")).alias("idx")))
            weight = F.when(F.col("other") == F.col("last"), 1 / p)
            found = written(found.where(F.col("luck") < F.coalesce(weight, F.lit(high))).withColumn("asked", weight.isNull() & (F.col("luck") >= low)), "candidates")
            # whether the nodes before and after are linked is asked only where it decides
            asked = found.where("asked").withColumns({"a": F.least("last", "other"), "b": F.greatest("last", "other")})
            answered = asked.join(links.hint("merge"), ["a", "b"], "left_semi" if q >= 1 else "left_anti")
            taken = found.where("not asked").select("start", "walk", "try", "other").union(answered.select("start", "walk", "try", "other"))
            taken = taken.groupBy("start", "walk").agg(F.min_by("other", "try").alias("to"))
            both = written(waiting.join(taken.hint("shuffle_hash"), ["start", "walk"], "left"), "taken")
            moved = both.where("to is not null").select("start", "walk", *moved_to(F.col("to")))
            done = moved if done is None else done.union(moved)
            waiting, tried = both.where("to is null").drop("to"), tried + batch
            batch = TRIES * MORE
        walks = done
    return walks.select("start", "walk", "path")


def node2vec(walks: DataFrame, dim: int = 128, window: int = 10, min_count: int = 1, seed: int = 13, steps: int = 5, negatives: int = 5, rate: float = 0.1, block_nodes: int | None = None, path: str | None = None) -> DataFrame:
    """id, vector by skip-gram over the paths, trained in blocks of nodes (skipgram.fit); path keeps the state of a run that may be stopped."""
    return skipgram.fit(walks, dim, window, min_count, negatives, steps, rate, seed, block_nodes, path)


def fingerprint(edges: DataFrame) -> tuple[int, str]:
    """Number of edges and a sum over their hashes, which doesn't depend on their order."""
    n, mark = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return n, str(mark)


def load_or_build(edges: DataFrame, path: str, **params: float) -> DataFrame:
    """node2vec vectors stored under path; built only if there are none of these edges with all of these parameters.

    params are those of random_walks (num_walks, length, seed, p, q) and of node2vec; others are an error, and those left out count with their
    defaults. A store is a folder named by a hash of edges and parameters. Its manifest is written last, and without it nothing is read: a
    build that was stopped is taken up again, from its last whole round of training.
    """
    known = {name: p.default for f in (random_walks, node2vec) for name, p in inspect.signature(f).parameters.items() if name not in ("edges", "walks", "path")}
    if unknown := sorted(set(params) - set(known)):
        raise ValueError(f"unknown parameters {unknown}; known are {sorted(known)}")
    spark, whole = edges.sparkSession, known | params
    n, mark = fingerprint(edges)
    content = {"n_edges": n, "edges": mark, "parameters": whole}
    where = f"{path or shared_folder(spark)}/node2vec-{hashlib.sha256(json.dumps(content, sort_keys=True).encode()).hexdigest()[:32]}"
    if read_json(spark, f"{where}/manifest.json") is None:
        walk = {k: whole[k] for k in ("num_walks", "length", "seed", "p", "q")}
        skip = {k: v for k, v in whole.items() if k not in walk or k == "seed"}
        paths = f"{where}/walks"
        if not exists(spark, f"{paths}/_SUCCESS"):
            random_walks(edges, **walk).write.mode("overwrite").parquet(paths)
        node2vec(spark.read.parquet(paths), **skip, path=f"{where}/training").write.mode("overwrite").parquet(f"{where}/vectors")
        write_once(spark, f"{where}/manifest.json", content)
        delete(spark, f"{where}/training")
        delete(spark, paths)
    return spark.read.parquet(f"{where}/vectors")
