"""Near-duplicate texts by vantage-point trees over fingerprints.

Texts are sets of hashed runs of consecutive words; similarity is the number of
runs that two texts share over the number that at least one has.

Fingerprint: an odd sketch of FP_BITS bits, in which every run flips one bit. The Hamming
distance of two fingerprints never exceeds the size of the symmetric
difference of their sets, and a pair at or above similarity t has a difference of at
most (1 - t) / (1 + t) x (size a + size b). So "Hamming distance within that radius" loses no pair:
it is a true bound, not an estimate, and Hamming distance is a metric, so triangle bounds hold.

Shards: one vantage-point tree over all fingerprints prunes nothing at this radius
(in high dimension nearly all distances lie within it of each other; see the README for
figures). The collection is therefore first cut into overlapping shards by min-hash
bands: every text stands in BANDS shards, and two texts at similarity s share none of them with
probability (1 - s^ROWS)^BANDS, 2e-5 at 0.6 and 3e-11 at 0.75. Within each shard a vantage-point
tree partitions the fingerprints by Hamming distance, and every text queries it with its own
radius, following both branches only where its ball overlaps the boundary. What the tree returns
is verified exactly on the full sets.

Scale: equal sets collapse to one representative before any shard is built, so copies
cost nothing however many there are. Shards of one text vanish before fingerprints are
fetched. A shard above MAX_SHARD texts is cut into blocks; each pair of blocks is a
task of its own, which builds its tree on one block and queries it with the other, so
nothing is capped and no task grows with the shard.

Nulls: rows without text or under ``min_words`` words take no part. A NULL or empty hash or url equals
nothing. Pairs come once, smaller id first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.words import WordHasher, mix, odd_multipliers, shingles, words
from palmleaf.session import spread

BANDS, ROWS = 44, 3
FP_BITS = 512
MAX_SHARD = 512
LEAF = 4
#: Rows of one class in a block.
CLASS_BLOCK = 1_000
_FP_WORDS = FP_BITS // 64


def odd_sketch(items: np.ndarray) -> np.ndarray:
    """FP_BITS bits; each item flips the bit that its hash names."""
    flips = np.bincount((mix(items) >> np.uint64(32)).astype(np.int64) % FP_BITS, minlength=FP_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).view(np.uint64)


_MULT = (odd_multipliers(BANDS * ROWS, 23) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_FLIP = (odd_multipliers(BANDS * ROWS, 29) >> np.uint64(32)).astype(np.uint32)
_BAND_MULT = odd_multipliers(ROWS, 31)


def band_keys(items: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band: a hash of ROWS minima and of the band's number."""
    x = (items >> np.uint64(32)).astype(np.uint32)
    mins = ((x[:, None] ^ _FLIP) * _MULT).min(0).astype(np.uint64)
    keys = (mins.reshape(BANDS, ROWS) * _BAND_MULT).sum(1, dtype=np.uint64)
    return mix(keys + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def radius(threshold: float, a, b):
    """Largest Hamming distance that texts with a and b runs may have at or above the threshold."""
    return np.floor((1 - threshold) / (1 + threshold) * (a + b) + 1e-9)


class VantageTree:
    """A vantage-point tree over fingerprints with their set sizes."""

    def __init__(self, fp: np.ndarray, size: np.ndarray):
        self.fp, self.size = fp, size
        self.root = self._build(np.arange(len(fp)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= LEAF:
            return idx
        v, rest = idx[0], idx[1:]
        d = np.bitwise_count(self.fp[rest] ^ self.fp[v]).sum(1, dtype=np.int64)
        mu = int(np.median(d))
        inner = d <= mu
        if inner.all():  # every distance is the same: no ball separates them
            return idx
        # the largest size in each branch bounds the radius of any query against it
        return v, mu, self._build(rest[inner]), self._build(rest[~inner]), int(self.size[idx].max())

    def query(self, fp: np.ndarray, size: int, threshold: float) -> np.ndarray:
        """Indices of all fingerprints within the radius of their own size and ``size``."""
        hits, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, np.ndarray):
                if len(node):
                    d = np.bitwise_count(self.fp[node] ^ fp).sum(1, dtype=np.int64)
                    hits.append(node[d <= radius(threshold, self.size[node], size)])
                continue
            v, mu, inner, outer, largest = node
            d = int(np.bitwise_count(self.fp[v] ^ fp).sum(dtype=np.int64))
            if d <= radius(threshold, self.size[v], size):
                hits.append(np.array([v]))
            r = radius(threshold, largest, size)
            if d - r <= mu:
                todo.append(inner)
            if d + r > mu:
                todo.append(outer)
        return np.concatenate(hits) if hits else np.empty(0, np.int64)


def _sketches(stories: DataFrame, shingle: int, min_words: int) -> DataFrame:
    """(story_id, set1, set2, n, bands, fp): set1 and set2 name the set of runs."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            rows = []
            for i, text in zip(b["story_id"], b["original_text"]):
                ws = words(text)
                if len(ws) < min_words:
                    continue
                s = shingles(hasher(ws), shingle)
                if not len(s):
                    continue
                one, two = int(s.sum(dtype=np.uint64)), int(mix(s).sum(dtype=np.uint64))
                rows.append((i, one - (1 << 64) if one >> 63 else one, two - (1 << 64) if two >> 63 else two, len(s), band_keys(s).view(np.int64), odd_sketch(s).tobytes()))
            yield pd.DataFrame(rows, columns=["story_id", "set1", "set2", "n", "bands", "fp"])

    rows = stories.where("story_id is not null and original_text is not null").select("story_id", "original_text")
    return spread(rows).mapInPandas(make, "story_id long, set1 long, set2 long, n int, bands array<long>, fp binary")


def _shard_pairs(rep: np.ndarray, n: np.ndarray, fp: np.ndarray, asks: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of one task: a block with itself, or the rows that ask against the tree of the others."""
    own = ~asks
    ids, size = rep[own], n[own]
    index = VantageTree(fp[own], size)
    left, right = [], []
    alone = bool(own.all())
    for i in range(len(rep)) if alone else np.flatnonzero(asks):
        near = index.query(fp[i], n[i], threshold)
        # the sizes alone bound the similarity as well
        near = ids[near[np.minimum(size[near], n[i]) + 1e-9 >= threshold * np.maximum(size[near], n[i])]]
        near = near[near > rep[i]] if alone else near
        left.append(np.minimum(near, rep[i]))
        right.append(np.maximum(near, rep[i]))
    return np.concatenate(left), np.concatenate(right)


def _by_shard(threshold: float):
    """Rows sorted by shard come in batches; a shard that a batch cuts waits for the rest of it."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        key = frame[["key", "i", "j"]].to_numpy()
        edge = np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1
        start, end = np.concatenate(([0], edge)), np.concatenate((edge, [len(key)]))
        rep, n = frame["rep"].to_numpy(), frame["n"].to_numpy().astype(np.int64)
        fp = np.frombuffer(b"".join(frame["fp"]), np.uint64).reshape(-1, _FP_WORDS)
        asks = frame["side"].to_numpy() == 1
        left, right = [], []
        # shards of two texts are trees of one node: all of them at once
        two = start[(end - start == 2)]
        two = two[~asks[two] | ~asks[two + 1]]
        d = np.bitwise_count(fp[two] ^ fp[two + 1]).sum(1, dtype=np.int64)
        two = two[d <= radius(threshold, n[two], n[two + 1])]
        left.append(np.minimum(rep[two], rep[two + 1]))
        right.append(np.maximum(rep[two], rep[two + 1]))
        for a, b in zip(start, end):
            if b - a > 2 and not asks[a:b].all():
                x, y = _shard_pairs(rep[a:b], n[a:b], fp[a:b], asks[a:b], threshold)
                left.append(x)
                right.append(y)
        return pd.DataFrame({"a": np.concatenate(left), "b": np.concatenate(right)}).drop_duplicates()

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            if not len(b):
                continue
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            last = (b["key"] == b["key"].iat[-1]) & (b["i"] == b["i"].iat[-1]) & (b["j"] == b["j"].iat[-1])
            cut = int((~last).sum())
            rest = b.iloc[cut:]
            if cut:
                yield work(b.iloc[:cut])
        if rest is not None and len(rest):
            yield work(rest)

    return stream


def candidates(reps: DataFrame, threshold: float) -> DataFrame:
    """(a, b): representatives whose fingerprints lie within the radius in at least one common shard."""
    keys = reps.select("rep", F.explode("bands").alias("key"))
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    cut = keys.join(sizes, "key").join(reps.select("rep", "n", "fp"), "rep").withColumn("_s", F.ceil(F.col("_n") / MAX_SHARD).cast("int"))
    # blocks i <= j of a shard: block i is the tree, block j asks
    cut = cut.withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_s")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_s") - 1)))
    cut = cut.select("key", F.least("_own", "_o").alias("i"), F.greatest("_own", "_o").alias("j"), F.when(F.col("_own") <= F.col("_o"), 0).otherwise(1).alias("side"), "rep", "n", "fp")
    return cut.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInPandas(_by_shard(threshold), "a long, b long").distinct()


def _sets(stories: DataFrame, shingle: int) -> DataFrame:
    """(story_id, runs): the sorted hashes of a text's runs."""

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = WordHasher()
        for b in batches:
            yield pd.DataFrame({"rep": b["story_id"], "runs": [shingles(hasher(words(t)), shingle).tobytes() for t in b["original_text"]]})

    return stories.select("story_id", "original_text").mapInPandas(make, "rep long, runs binary")


def verified(pairs: DataFrame, stories: DataFrame, shingle: int, threshold: float) -> DataFrame:
    """(a, b, similarity) of the candidates at or above the threshold, on the full sets."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("story_id")).distinct()
    sets = _sets(stories.select("story_id", "original_text").join(ids, "story_id"), shingle)
    both = pairs.join(sets.select(F.col("rep").alias("a"), F.col("runs").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("runs").alias("y")), "b")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            sims = []
            for x, y in zip(f["x"], f["y"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                sims.append(common / (len(x) + len(y) - common))
            f = f[["a", "b"]].assign(similarity=sims)
            yield f[f["similarity"] >= threshold]

    return both.mapInPandas(compare, "a long, b long, similarity double")


def classes(stories: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 50) -> tuple[DataFrame, DataFrame]:
    """(members, links): (story_id, rep) of every text that takes part, and the links
    (a, b, similarity) between different representatives."""
    from palmleaf.session import stage

    sketches = stage(_sketches(stories, shingle, min_words), "sketches")
    firsts = sketches.groupBy("set1", "set2", "n").agg(F.min("story_id").alias("rep"), F.count(F.lit(1)).alias("_c"))
    firsts = stage(firsts, "firsts")
    # a text that stands alone represents itself; only the sets with copies are joined back
    copied = sketches.select("story_id", "set1", "set2", "n").join(firsts.where("_c > 1"), ["set1", "set2", "n"]).select("story_id", "rep")
    members = firsts.where("_c = 1").select(F.col("rep").alias("story_id"), "rep").unionByName(copied)
    reps = sketches.join(firsts.select(F.col("rep").alias("story_id")), "story_id", "left_semi").select(F.col("story_id").alias("rep"), "n", "bands", "fp")
    found = stage(candidates(reps, threshold), "candidates")
    return members, stage(verified(found, stories, shingle, threshold), "links")


def pairs(stories: DataFrame, threshold: float = 0.6, shingle: int = 3, min_words: int = 50) -> DataFrame:
    """(story_id_a, story_id_b) of different urls and different contents, a < b, at or above the threshold.

    Pairs between classes come from the links of their representatives, pairs
    within a class from its members: both are whole, for every copy counts as a row here.
    """
    members, links = classes(stories, threshold, shingle, min_words)
    kept = members.join(links.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), "rep", "left_semi")
    many = members.groupBy("rep").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("rep")
    what = stories.select("story_id", F.xxhash64("url").alias("_u"), F.col("url").isNull().alias("_nu"), F.when(F.col("raw_sha256") != "", F.xxhash64("raw_sha256")).alias("_h"))
    facts = what.join(members.join(many, "rep", "left_semi").unionByName(kept).select("story_id").distinct(), "story_id", "left_semi")
    kept = kept.join(facts, "story_id")
    within = members.join(many, "rep", "left_semi").join(facts, "story_id")
    side = lambda df, x: df.select(*[F.col(c).alias(c + x) for c in df.columns])
    one = side(kept, "_1").join(links, F.col("rep_1") == F.col("a")).join(side(kept, "_2"), F.col("rep_2") == F.col("b"))
    two = _within(within, side)
    differ = (F.col("_nu_1") | F.col("_nu_2") | (F.col("_u_1") != F.col("_u_2"))) & F.coalesce(F.col("_h_1") != F.col("_h_2"), F.lit(True))
    cols = [F.least("story_id_1", "story_id_2").alias("story_id_a"), F.greatest("story_id_1", "story_id_2").alias("story_id_b")]
    return one.where(differ).select(*cols).unionByName(two.where(differ).select(*cols)).distinct()


def _within(rows: DataFrame, side) -> DataFrame:
    """All pairs of rows of one class, whose number is that of the result. A class is cut into blocks of
    CLASS_BLOCK rows, and every two blocks meet under a key of their own, so no class is one task."""
    n = rows.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / CLASS_BLOCK).cast("int").alias("_s"))
    cut = rows.join(n, "rep").withColumn("_b", F.pmod(F.xxhash64("story_id"), F.col("_s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_s") - 1))
    one = side(cut.drop("_s"), "_1").join(n.withColumnRenamed("rep", "rep_1"), "rep_1").withColumn("_o", every).drop("_s")
    two = side(cut.drop("_s"), "_2").join(n.withColumnRenamed("rep", "rep_2"), "rep_2").withColumn("_o", every).drop("_s")
    return one.withColumnRenamed("_o", "_j").join(two.withColumnRenamed("_o", "_i"), (F.col("rep_1") == F.col("rep_2")) & (F.col("_b_1") == F.col("_i")) & (F.col("_b_2") == F.col("_j")) & (F.col("story_id_1") < F.col("story_id_2")))


def groups(stories: DataFrame, threshold: float = 0.8, shingle: int = 5, min_words: int = 1) -> DataFrame:
    """(story_id, group_id, n_links): one row per row with an id, the smallest id of its connected
    component of near-duplicates, and the number of different texts linked to its own.
    A text without words is its own group."""
    from palmleaf.llm.residue import components

    members, links = classes(stories, threshold, shingle, min_words)
    comp = components(links)
    degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links"))
    members = stories.where("story_id is not null").select("story_id").distinct().join(members, "story_id", "left").withColumn("rep", F.coalesce("rep", "story_id"))
    out = members.join(comp.select(F.col("m").alias("rep"), "c"), "rep", "left").join(degree, "rep", "left")
    return out.select("story_id", F.coalesce("c", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
