"""Packing documents into packs of a fixed number of tokens.

Method: large-item matching. Documents above a third of the capacity fit at
most twice into a pack: they are matched greedily, the longest with the longest
partner that still fits. All smaller documents then best-fit into the remaining
gaps, longest first; what fits nowhere opens a new pack. Only a document
longer than a pack is cut: into full packs and a rest that is packed like any other.

Scale: the work is on lengths, of which a pack of C tokens knows only C. Each
shard of at most ``shard_rows`` documents is packed by itself in one task, so no
task depends on the size of the input, and a shard wastes at most its few last
packs. Documents are dealt to shards by a hash of their id: no source, length
or group of copies can make a shard hot.

Nulls: a NULL text or id is no document and gets no pack. An empty text has 0 tokens
and goes into the first pack of its shard. Ties go by the document's id. Ids are expected
to be unique; equal ids are packed as the separate rows that they are.
"""

from __future__ import annotations

import base64
import bisect
import re
from collections import deque
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.session import spread

SHARD_ROWS = 50_000
_ALONE = re.compile(r"(?<=\S) (?=\S)")
_CACHE_LIMIT = 1_000_000


class TokenCounter:
    """Exact token counts of a byte-level BPE vocabulary file.

    The pattern never lets a token cross a single blank between two visible
    characters except as the first character of the next one, so the count of a
    text is the sum over its blank-led pieces; pieces recur and are remembered.
    """

    def __init__(self, vocabulary: str, pattern: str):
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        known, total, lead = self.known, 0, ""
        if len(known) > _CACHE_LIMIT:
            known.clear()
        for piece in _ALONE.split(text):
            piece = lead + piece
            n = known.get(piece)
            if n is None:
                n = len(self.encode(piece))
                if len(piece) < 200:
                    known[piece] = n
            total += n
            lead = " "
        return total


#: The vocabulary file and the pattern of the public 50k byte-level BPE.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """(doc_id, n_tokens) of every document with a text.

    ``vocabulary`` is a rank file on the driver; Spark sends it to the workers.
    """
    if not Path(vocabulary).is_file():
        raise FileNotFoundError(f"no vocabulary file at {vocabulary}; give the path of a rank file")
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = Path(vocabulary).name

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TokenCounter(SparkFiles.get(name), pattern)
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": [counter(t) for t in b["text"]]})

    return spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInPandas(count, "doc_id long, n_tokens long")


class _Gaps:
    """Open packs by the room that they have; best fit is a search among the distinct rooms."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.packs: dict[int, list[int]] = {}

    def add(self, room: int, pack: int) -> None:
        if room not in self.packs:
            bisect.insort(self.rooms, room)
            self.packs[room] = []
        self.packs[room].append(pack)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, pack) with the least room that holds ``size``."""
        i = bisect.bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        pack = self.packs[room].pop()
        if not self.packs[room]:
            del self.packs[room], self.rooms[i]
        return room, pack


def pack_lengths(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """For each length its parts as (pack, tokens, part number).

    Packs are numbered from 0. No pack exceeds ``capacity``, and only a length
    above it has more than one part.
    """
    if capacity < 1:
        raise ValueError("a pack must hold at least one token")
    out: list[list[tuple[int, int, int]]] = [[] for _ in lengths]
    gaps, packs = _Gaps(), 0
    items = []
    for i, n in enumerate(lengths):
        while n > capacity:
            out[i].append((packs, capacity, len(out[i])))
            packs += 1
            n -= capacity
        items.append((n, i))
    items.sort(key=lambda x: (-x[0], x[1]))
    large = [x for x in items if 3 * x[0] > capacity]
    # the longest document takes the longest partner that still fits beside it
    waiting: dict[int, deque[int]] = {}
    for k, (n, _) in enumerate(large):
        waiting.setdefault(n, deque()).append(k)
    sizes = sorted(waiting)
    for n, i in large:
        # longest first, so every document that still waits stands first among those of its length
        if not waiting.get(n) or large[waiting[n][0]][1] != i:
            continue
        waiting[n].popleft()
        out[i].append((packs, n, len(out[i])))
        at = bisect.bisect_right(sizes, capacity - n) - 1
        while at >= 0 and not waiting[sizes[at]]:
            del sizes[at]
            at -= 1
        if at >= 0:
            m, j = large[waiting[sizes[at]].popleft()]
            out[j].append((packs, m, len(out[j])))
            n += m
        gaps.add(capacity - n, packs)
        packs += 1
    for n, i in items[len(large) :]:
        found = gaps.take(n)
        room, pack = found if found else (capacity, packs)
        packs += found is None
        out[i].append((pack, n, len(out[i])))
        gaps.add(room - n, pack)
    return out


def pack(counts: DataFrame, capacities: list[tuple[str, int]], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(pack_name, pack_id, doc_id, part, n_tokens) for every capacity.

    ``pack_id`` is unique within a pack name: shard number x 2^32 + pack of the shard.
    """
    from palmleaf.session import stage

    counts = stage(counts, "token_counts")
    shards = max(1, -(-counts.count() // shard_rows))
    sizes = list(capacities)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "n_tokens"], kind="stable")
        ids, lengths, shard = frame["doc_id"].tolist(), frame["n_tokens"].tolist(), int(frame["_shard"].iloc[0])
        rows = []
        for name, capacity in sizes:
            for doc, parts in zip(ids, pack_lengths(lengths, capacity)):
                rows += [(name, (shard << 32) + p, doc, k, n) for p, n, k in parts]
        return pd.DataFrame(rows, columns=["pack_name", "pack_id", "doc_id", "part", "n_tokens"])

    dealt = counts.withColumn("_shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("long"))
    return dealt.groupBy("_shard").applyInPandas(fill, "pack_name string, pack_id long, doc_id long, part long, n_tokens long")


def report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """(pack_name, n_packs, n_parts, n_tokens, capacity_tokens, fill): how full the packs are."""
    sums = packed.groupBy("pack_name").agg(F.countDistinct("pack_id").alias("n_packs"), F.count(F.lit(1)).alias("n_parts"), F.sum("n_tokens").alias("n_tokens"))
    fill = F.round(F.col("n_tokens") / (F.col("n_packs") * F.col("capacity_tokens")), 6)
    return sums.join(capacities.select("pack_name", "capacity_tokens").distinct(), "pack_name").withColumn("fill", fill)
