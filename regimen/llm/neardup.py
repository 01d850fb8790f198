"""Near-duplicate documents by one-permutation MinHash.

1. In one pass each text becomes the fingerprint of its set of word shingles and a one-permutation sketch: every shingle falls into
   one bin, the least hash of a bin is its value, empty bins take the value of a bin found by their own probe sequence (optimal
   densification). Rows of bins make bands, and each band is a bucket key. Texts with equal sets are one node from here on.
2. Every bucket gives a star: edges from its least node to each other one. The edges are confirmed on the full shingle sets.
3. Links that miss the stars: where a bucket still holds several components, the nodes outside its largest one are strays. Up to TURNS
   times the strays of a bucket meet one of themselves and one node of the largest component, by turns others. The strays that are
   left meet nodes of other components over their rarest shingles (an exact prefix and position bound), and such pairs are
   confirmed too. Pairs within a component are never made, nor pairs whose parity bits differ in more places than their sets may
   differ in shingles (a bitmap bound, exact as well).
4. Components by alternating large and small stars.

A pair with the least similarity shares no bucket with probability (1 - similarity ** rows) ** bands: 7e-9 for 0.85 with 32 bands of 5.

Buckets, hubs, stars and groups of copies with a large share of all rows are joined on their own or dealt (join_counted, join_salted).

Defined results: a text without words (null, empty, white space) has an empty set and stays alone; rows with one document id are
one document; ids may be of any type that has an order, and the least one names a component; a row without id is linked with
nothing and has no component; no table size or group size is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regimen.llm.base import erase, join_counted, join_salted, written

#: Words remembered by a Python worker; a full memory is emptied.
CACHE_ENTRIES = 400_000
#: Further stars for strays, before rare shingles find the links that are left.
TURNS = 3
#: Words of 64 bits in which the parity of a set is kept.
PARITY_WORDS = 16
#: Steps of an empty bin's probe sequence; with fewer than a hundredth of all bins filled, the lowest filled bin may be taken instead.
PROBES = 1024
#: Rows of a step that a task writes about, where their number is bounded; a step of few rows isn't a task and a file for each partition of a shuffle.
STEP_ROWS = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers (the splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sets of hashed word shingles of texts."""

    def __init__(self, size: int) -> None:
        import xxhash

        digest = xxhash.xxh3_64_intdigest

        class Words(dict):
            def __missing__(self, word: bytes) -> int:
                self[word] = value = digest(word)
                return value

        self.size, self.words, self.fingerprint = size, Words(), xxhash.xxh3_128_digest
        self.factor = mix(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)

    def __call__(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles, sorted; a text of fewer words than a shingle has one."""
        words = text.lower().split() if text else []  # of bytes: A-Z and ASCII white space only
        if len(self.words) > CACHE_ENTRIES:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), np.uint64, len(words))
        if len(h) < self.size:
            return mix(np.array([(h * self.factor[: len(h)]).sum(dtype=np.uint64) + np.uint64(len(h))], np.uint64)) if len(h) else h
        n = len(h) - self.size + 1
        total = h[:n] * self.factor[0]
        for j in range(1, self.size):
            total = total + h[j : j + n] * self.factor[j]
        return np.unique(mix(total))


class Sketcher:
    """One-permutation MinHash with optimal densification, cut into bands."""

    def __init__(self, bands: int, rows: int) -> None:
        bins = bands * rows
        self.bands, self.rows, self.bins = bands, rows, np.uint64(bins)
        self.probe = (mix(np.arange(bins * PROBES, dtype=np.uint64) + np.uint64(1 << 40)) % self.bins).astype(np.int64).reshape(PROBES, bins)
        self.factor = (mix(np.arange(bins, dtype=np.uint64) + np.uint64(1 << 50)) | np.uint64(1)).reshape(bands, rows)

    def __call__(self, shingles: np.ndarray) -> np.ndarray:
        """A 64-bit key for each band."""
        spread = mix(shingles + np.uint64(0x9E3779B97F4A7C15))
        least = np.full(int(self.bins), np.iinfo(np.uint64).max, np.uint64)
        place = (spread % self.bins).astype(np.int64)
        np.minimum.at(least, place, spread)
        filled = np.zeros(int(self.bins), bool)
        filled[place] = True
        empty = np.flatnonzero(~filled)
        if len(empty):
            donor = self.probe[:, empty]
            near = donor[:64]
            first = filled[near].argmax(axis=0)
            chosen = near[first, np.arange(len(empty))]
            far = np.flatnonzero(~filled[chosen])
            if len(far):
                chosen[far] = donor[filled[donor[:, far]].argmax(axis=0), far]
            chosen = np.where(filled[chosen], chosen, place.min())
            least[empty] = least[chosen]
        keys = (least.reshape(self.bands, self.rows) * self.factor).sum(axis=1, dtype=np.uint64)
        return mix(keys + np.arange(self.bands, dtype=np.uint64))


def sketches(docs: DataFrame, size: int, bands: int, rows: int, doc_id: str, text: str) -> DataFrame:
    """_id, n_shingles, set_a, set_b (fingerprint of the set), bands array<bigint>; a row for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, sketcher = Shingler(size), Sketcher(bands, rows)
        for batch in batches:
            counts, prints, keys = [], [], []
            for value in batch.column(1):
                shingles = shingler(value.as_py())
                counts.append(len(shingles))
                prints.append(np.frombuffer(shingler.fingerprint(shingles.tobytes()), np.int64))
                keys.append(sketcher(shingles).view(np.int64) if len(shingles) else np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            both = np.array(prints, np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(counts, np.int64)), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), lists], ["_id", "n_shingles", "set_a", "set_b", "bands"])

    source = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
    return source.mapInArrow(run, f"_id {source.schema['_id'].dataType.simpleString()}, n_shingles bigint, set_a bigint, set_b bigint, bands array<bigint>")


def parity_bits(shingles: np.ndarray) -> np.ndarray:
    """PARITY_WORDS words: a bit is set if an odd number of shingles falls on it. Two sets differ in at least as many shingles as these bits differ."""
    bits = np.bincount((mix(shingles + np.uint64(1 << 60)) % np.uint64(64 * PARITY_WORDS)).astype(np.int64), minlength=64 * PARITY_WORDS) & 1
    return np.packbits(bits.astype(bool)).view(np.int64)


def may_be_similar(a: str, b: str, part: int, whole: int) -> Column:
    """Whether the parity bits p_ and sizes n_ of a and b leave a similarity of part / whole possible."""
    differ = sum((F.bit_count(F.col(f"p_{a}")[i].bitwiseXOR(F.col(f"p_{b}")[i])) for i in range(PARITY_WORDS)), F.lit(0))
    return differ * (part + whole) <= (F.col(f"n_{a}") + F.col(f"n_{b}")) * (whole - part)


def shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """_id, n, shingles array<bigint>, parity array<bigint> from the columns _id and t (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler(value.as_py()) for value in part.column(1)]
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))
                words = pa.array(np.concatenate([parity_bits(s) for s in sets]))
                parity = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * PARITY_WORDS), words)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends).astype(np.int64)), lists, parity], ["_id", "n", "shingles", "parity"])

    return docs.mapInArrow(run, f"_id {docs.schema['_id'].dataType.simpleString()}, n bigint, shingles array<bigint>, parity array<bigint>")


def packed(df: DataFrame, rows: int) -> DataFrame:
    """df in tasks for at most so many rows, one a core at least: neighbouring partitions of its last shuffle go together. For sums and distinct rows; the tables of hash joins would be held together, too."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // STEP_ROWS)))


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """node, component (least node reachable) for the nodes of links (a, b of one type that has an order): large and small stars in turn until only stars around the least node are left. rows: their number, if known."""

    def star(edges: DataFrame, large: bool) -> DataFrame:
        """Edges (v, u) have v > u and are erased. Joins each node's larger (large) or smaller (small) neighbours to the least node among itself and its neighbours."""
        if large:
            both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
            least = both.groupBy("v").agg(F.min("u").alias("m"), F.count_if(F.col("u") > F.col("v")).alias("n")).where("n > 0").select("v", F.least("v", "m").alias("m"), "n")
            least = written(packed(least, 2 * rows), "least")
            moved = join_counted(both.where("u > v"), least, ["v"]).select(F.col("u").alias("v"), F.col("m").alias("u"))
        else:
            least = written(packed(edges.groupBy("v").agg(F.min("u").alias("m"), F.count(F.lit(1)).alias("n")), rows), "least")
            moved = join_counted(edges, least, ["v"]).select("v", "m", "u")
            moved = moved.select("v", F.col("m").alias("u")).union(moved.select(F.col("u").alias("v"), F.col("m").alias("u")))
        moved = written(packed(moved.where("v <> u").distinct(), 2 * rows), "stars")
        erase(edges, least)
        return moved

    def settled(edges: DataFrame) -> bool:
        """Whether all edges are stars around the least node: no node has two smaller neighbours, or a smaller and a larger one."""
        ends = edges.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("up")), F.struct(F.col("u").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
        return packed(ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("n")).where("up > 1 or (up = 1 and n > 1)"), 2 * rows).isEmpty()

    rows = links.count() if rows is None else rows
    edges = written(packed(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("v <> u").distinct(), rows), "links")
    while not settled(edges):
        edges = star(star(edges, True), False)
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component"))


def merged(joined: DataFrame, links: DataFrame) -> DataFrame:
    """The components joined (node, component), erased, after further links (a, b), by components of components: only what the links touch is iterated."""
    n_links = links.count()
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    named = written(nodes.join(joined, "node", "left").select("node", "n", F.coalesce("component", "node").alias("c")), "named")
    ends = links
    for end in "ab":
        ends = join_counted(ends, named.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"), "n"), [end])
    moves = components(ends.select(F.col("c_a").alias("a"), F.col("c_b").alias("b")), n_links)
    sizes = joined.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(moves.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    sizes = written(sizes, "component-sizes")
    kept = join_counted(joined, sizes, ["component"])
    out = written(kept.select("node", F.coalesce("_to", "component").alias("component")).unionByName(moves), "components")
    erase(joined, named, sizes)
    return out


def crossing_pairs(nodes: DataFrame, sets: DataFrame, part: int, whole: int) -> DataFrame:
    """Pairs (a, b) of a stray node and a node of another component that may be similar enough; none that is gets lost.

    nodes: node, component, stray (true or null); sets: _id, n, shingles, parity. The sets are ordered from rare to frequent shingles.
    Sizes n and m need an overlap of c = part * (n + m) / (part + whole), so similar sets have their first common shingle within
    the first n - c + 1 and m - c + 1 places; what an edit brings in is rare and stands before that.
    """
    nodes = nodes.join(sets.select(F.col("_id").alias("node"), "parity"), "node")
    each = sets.select(F.col("_id").alias("node"), "n", F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "shingle").groupBy("node").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("often", "shingle"))).alias("ranked"))
    shortest = F.floor(F.col("n") - (F.col("n") * part + whole - 1) / whole + 1).cast("int") + 1
    heads = written(ranked.select("node", "n", F.slice(F.col("ranked.shingle"), 1, F.greatest(F.least(shortest, F.size("ranked")), F.lit(1))).alias("head")).join(nodes, "node"), "heads")
    table, heads = heads, heads.select("node", "n", "parity", "component", "stray", F.posexplode("head").alias("place", "shingle"))
    left = heads.where("stray").select("shingle", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"), F.col("component").alias("c_a"), F.col("place").alias("at_a"))
    right = heads.select("shingle", F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("parity").alias("p_b"), F.col("component").alias("c_b"), F.col("place").alias("at_b"))
    spare = lambda n, place: (F.col(n) - F.col(place)) * (part + whole) >= (F.col("n_a") + F.col("n_b")) * part
    fits = (left["shingle"] == right["shingle"]) & (F.col("c_a") != F.col("c_b")) & spare("n_a", "at_a") & spare("n_b", "at_b") & (F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part) & may_be_similar("a", "b", part, whole)
    pairs = left.join(right, fits).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    found = written(pairs.distinct(), "pairs")
    erase(table)
    return found


def with_bits(mixed: DataFrame, bits: DataFrame) -> DataFrame:
    """mixed (key, node, component, largest) with the columns of bits (a row per node): these meet a node once, not once in each of its buckets, of which it has one a band at most."""
    own = mixed.groupBy("node", "component").agg(F.collect_list(F.struct("key", "largest")).alias("_own"))
    return own.join(bits, "node").select("node", "component", *[c for c in bits.columns if c != "node"], F.inline("_own"))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: tuple[int, int] = (80, 100), bands: int = 32, rows: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """_id, n_shingles, component_id (least document id reachable over links), kept, for each row of docs.

    Links join documents whose shingle sets have similarity[1] * |intersection| >= similarity[0] * |union|.
    """
    part, whole = similarity
    sketched = written(sketches(docs, size, bands, rows, doc_id, text), "sketches")
    full = sketched.where("n_shingles > 0 and _id is not null")
    n_docs = sketched.count()
    nodes = written(packed(full.groupBy("set_a", "set_b").agg(F.min("_id").alias("node"), F.first("n_shingles").alias("n"), F.count(F.lit(1)).alias("copies"), F.first("bands").alias("bands")), n_docs), "nodes")
    dealt = nodes.select("node", "n", F.explode("bands").alias("key"))
    shared = dealt.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1")
    members = written(join_counted(dealt, written(packed(shared, n_docs * bands), "shared-keys"), ["key"], "m"), "buckets")
    n_members = members.count()

    def sets_of(wanted: DataFrame) -> DataFrame:
        """The full shingle sets of the nodes in the column _want."""
        texts = docs.select(F.col(doc_id).alias("_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("t"))
        wanted = written(packed(wanted.distinct(), min(n_docs, 2 * n_members)), "wanted")
        sets = written(shingle_sets(texts.join(wanted.hint("shuffle_hash"), F.col("_id") == F.col("_want"), "left_semi"), size), "sets")
        erase(wanted)
        return sets

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """The pairs (a, b) whose sets are similar enough, again for each row of a document id."""
        first, second = (sets.select(F.col("_id").alias(x), F.col("n").alias(f"n_{x}"), F.col("shingles").alias(f"s_{x}")) for x in "ab")
        # a hub is in the pairs of all members of its buckets: those pairs are dealt, and its set is repeated
        joined = join_salted(pairs.join(second, "b"), first, "a", "b", pairs).where(F.least("n_a", "n_b") * whole >= F.greatest("n_a", "n_b") * part)
        same = F.size(F.array_intersect("s_a", "s_b"))
        return written(joined.where(same * whole >= (F.col("n_a") + F.col("n_b") - same) * part).select("a", "b"), "confirmed")

    stars = written(packed(members.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), n_members), "pairs")
    sets = sets_of(stars.select(F.col("a").alias("_want")).union(stars.select("b")))
    links = confirmed(stars, sets)
    erase(sets)
    joined = components(links)

    def mixed_buckets(held: DataFrame) -> DataFrame:
        """The rows of held (key, node) in buckets that hold several components, with the largest of these. A bucket of one component stays so."""
        placed = written(held.join(joined, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component")), "placed")
        sizes = placed.groupBy("key", "component").count()
        split = sizes.groupBy("key").agg(F.sum("count").alias("m"), F.count(F.lit(1)).alias("parts"), F.max_by("component", F.struct("count", "component")).alias("largest")).where("parts > 1").drop("parts")
        split = written(packed(split, n_members), "split-keys")
        out = written(join_counted(placed, split, ["key"], "m"), "mixed")
        erase(placed, split)
        return out

    mixed = mixed_buckets(members)
    sets = sets_of(mixed.select(F.col("node").alias("_want")))
    bits = sets.select(F.col("_id").alias("node"), F.col("n").alias("n_a"), F.col("parity").alias("p_a"))
    tested = stars
    for turn in range(TURNS):
        stray, order, at = F.col("component") != F.col("largest"), F.xxhash64("node", F.lit(turn)), F.struct("node", "component", F.col("n_a").alias("n_b"), F.col("p_a").alias("p_b"))
        marked = written(with_bits(mixed, bits), "marked")
        hubs = marked.groupBy("key").agg(F.count_if(stray).alias("m"), F.array(F.min_by(at, F.when(stray, order)), F.min_by(at, F.when(~stray, order))).alias("hubs"))
        hubs = written(packed(hubs, n_members), "hubs")
        met = join_counted(marked.where(stray).select("key", "node", "component", "n_a", "p_a"), hubs, ["key"], "m").select("node", "component", "n_a", "p_a", F.explode("hubs").alias("hub"))
        met = met.where("component <> hub.component").select("*", "hub.n_b", "hub.p_b").where(may_be_similar("a", "b", part, whole))
        fresh = met.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct().join(tested.hint("shuffle_hash"), ["a", "b"], "left_anti")
        fresh = written(fresh, "pairs")
        erase(marked, hubs)
        new = confirmed(fresh, sets)
        if new.isEmpty():
            break
        joined, tested = merged(joined, new), tested.union(fresh)
        before, mixed = mixed, mixed_buckets(mixed.select("key", "node"))
        erase(new, before)
    strays = mixed.where("component <> largest").select("node").distinct().withColumn("stray", F.lit(True))
    others = written(mixed.select("node", "component").distinct().join(strays, "node", "left"), "others")
    sets = sets.join(others.select(F.col("node").alias("_id")), "_id", "left_semi")
    more = confirmed(crossing_pairs(others, sets, part, whole), sets)
    final = joined if more.isEmpty() else merged(joined, more)
    rep = written(nodes.join(final, "node", "left").select("set_a", "set_b", "copies", F.coalesce("component", "node").alias("component_id")), "classes")
    own = join_counted(full.select("_id", "n_shingles", "set_a", "set_b"), rep, ["set_a", "set_b"], "copies").select("_id", "n_shingles", "component_id")
    alone = sketched.where("n_shingles = 0 or _id is null").select("_id", "n_shingles", F.col("_id").alias("component_id"))
    return own.unionByName(alone).withColumn("kept", F.coalesce(F.col("_id") == F.col("component_id"), F.lit(True)))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", **params) -> DataFrame:
    """The rows of docs that stay: of each group of near-duplicates the document with the least id."""
    gone = written(near_duplicates(docs, doc_id=doc_id, **params).where("not kept").select(F.col("_id").alias("_gone")), "near-duplicates")
    return docs.join(gone.hint("shuffle_hash"), docs[doc_id] == gone["_gone"], "left_anti")
