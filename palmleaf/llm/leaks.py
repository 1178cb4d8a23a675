"""Evaluation passages leaking into documents.

Method: spaced-seed hashing. Fixed masks select some of the token positions in
a window; two windows that agree on the selected positions have equal hashes
whatever stands at the ignored ones. The hashes of the test items are the
dictionary, the documents stream past it, and each hit is verified: the run of
equal words around the hit, and the longest stretch that tolerates
substitutions.

Exactness: the mask spans MASK_SPAN = 12 words, so any 12 consecutive common
words hit it. A passage shorter than that has a mask of its own length. The tolerant
stretches have a mask of ones as long as the run that every placement of the
substitutions leaves (``tolerant_span``: 4 words at 80 % of 20), so none is missed.

Scale: the dictionary is the stated query set. It is cut into blocks of about ``block_words`` words of
passages (a passage is never cut); each block is broadcast as hashes, 8 bytes a word, and makes one pass over the
documents, so its size is bounded by words whatever the number and length of items is. Documents are
never shuffled. A hot document or item needs no group.

Nulls: a NULL or wordless text or passage leaks nothing. Repeated words, ties
and copies of a passage each give their own rows; no row occurs twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palmleaf.llm.words import WordHasher, mix, odd_multipliers, words
from palmleaf.session import spread

#: Ones are compared, zeros ignored.
MASK = "110110101111"
MASK_SPAN = 12
BLOCK_WORDS = 4_000_000


def _mask_of(n: int) -> str:
    """The mask for passages of n words, n under MASK_SPAN: the first one, cut, with its ends set."""
    m = list(MASK[:n])
    m[0] = m[-1] = "1"
    return "".join(m)


def tolerant_span(n: int, share: float, least: int) -> int:
    """Words of the run that any stretch of a passage of n words holds, if it has ``least`` words (or all n) of which ``share`` agree.

    k substitutions cut the agreeing words into at most k + 1 runs, and the longest is no shorter than their mean.
    """
    spans = []
    for length in range(max(1, min(least, n)), n + 1):
        k = int((1 - share) * length + 1e-9)
        spans.append(-(-(length - k) // (k + 1)))
    return max(1, min(spans))


def _window_hashes(h: np.ndarray, mask: str) -> np.ndarray:
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    mult = odd_multipliers(len(mask), 11)
    total = np.zeros(n, np.uint64)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += h[j : j + n] * mult[j]
    return mix(total)


class _Seeds:
    """The dictionary of one mask over a block of items."""

    def __init__(self, mask: str, rows: list[tuple[int, np.ndarray]]):
        self.mask = mask
        parts = [(_window_hashes(h, mask), i) for i, h in rows]
        keys = np.concatenate([k for k, _ in parts] or [np.empty(0, np.uint64)])
        item = np.concatenate([np.full(len(k), i, np.int64) for k, i in parts] or [np.empty(0, np.int64)])
        pos = np.concatenate([np.arange(len(k)) for k, _ in parts] or [np.empty(0, np.int64)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.item, self.pos = keys[order], item[order], pos[order]
        bits = max(16, int(np.ceil(np.log2(max(1, len(keys)) * 16))))
        self.shift = np.uint64(64 - bits)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[self.keys >> self.shift] = True

    def hits(self, h: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(position in h, item, position in the item)."""
        return zip(*(x.tolist() for x in self._hits(h)))

    def diagonals(self, h: np.ndarray) -> Iterator[tuple[int, int]]:
        """(item, position in h less that in the item) of the hits, each once."""
        p, item, q = self._hits(h)
        if not len(p):
            return iter(())
        both = np.unique((item << 32) + (p - q + (1 << 31)))
        return zip((both >> 32).tolist(), ((both & 0xFFFFFFFF) - (1 << 31)).tolist())

    def _hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = _window_hashes(h, self.mask)
        at = np.flatnonzero(self.maybe[k >> self.shift])
        lo = np.searchsorted(self.keys, k[at], "left")
        n = np.searchsorted(self.keys, k[at], "right") - lo
        x = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        return np.repeat(at, n), self.item[x], self.pos[x]


def _run(doc: np.ndarray, item: np.ndarray, p: int, q: int) -> int:
    """Length of the longest run of equal words on the diagonal of a hit."""
    start = -min(p, q)
    n = min(len(doc) - p, len(item) - q) - start
    same = doc[p + start : p + start + n] == item[q + start : q + start + n]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
    return int((edges[1::2] - edges[::2]).max(initial=0))


def _tolerant(doc: np.ndarray, item: np.ndarray, p: int, q: int, share: float, least: int = 0) -> int:
    """Words of the item in the longest stretch on the diagonal in which at least ``share`` agree; 0 if too few agree for ``least`` words."""
    start = -min(p, q)
    n = min(len(doc) - p, len(item) - q) - start
    same = doc[p + start : p + start + n] == item[q + start : q + start + n]
    if np.count_nonzero(same) < share * least - 1e-9:
        return 0
    s = np.concatenate(([0.0], np.cumsum(same - share)))
    low = np.minimum.accumulate(s)  # the longest stretch with a sum of at least nothing
    high = np.maximum.accumulate(s[::-1])[::-1]
    end = np.searchsorted(-high, 1e-9 - low, "right")
    return int((end - 1 - np.arange(len(s))).max(initial=0))


def leaks(documents: DataFrame, items: DataFrame, min_run: int = 12, tolerant_share: float | None = None, tolerant_words: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents that contain passages of ``items``.

    Without ``tolerant_share``: (doc_id, item_id) where the document holds at
    least ``min_run`` consecutive words of the passage, or all of them if there
    are fewer. With it: (doc_id, item_id, n_words), the longest stretch of at
    least ``tolerant_words`` words (or the whole shorter passage) of which that
    share agrees; every placement of the substitutions is found.
    """
    if min_run < MASK_SPAN:
        raise ValueError(f"min_run must be at least {MASK_SPAN}, the span of the mask")
    spark = documents.sparkSession
    sized = items.where("item_id is not null and passage is not null")
    n_words = sized.agg(F.sum(F.size(F.split("passage", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-n_words // block_words))
    schema = "doc_id long, item_id long" + (", n_words long" if tolerant_share else "")
    out = None
    for b in range(blocks):
        part = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        known = [(int(r[0]), WordHasher()(words(r[1]))) for r in part.select("item_id", "passage").toLocalIterator()]
        shared = spark.sparkContext.broadcast([(i, h) for i, h in known if len(h)])

        def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            hasher = WordHasher()
            rows = shared.value
            by_id = [h for _, h in rows]
            ids = [i for i, _ in rows]
            at = list(enumerate(by_id))
            if tolerant_share:
                spans = [tolerant_span(len(h), tolerant_share, tolerant_words) for h in by_id]
                seeds = [_Seeds("1" * n, [(i, h) for i, h in at if spans[i] == n]) for n in sorted(set(spans))]
            else:
                seeds = [_Seeds(MASK, [(i, h) for i, h in at if len(h) >= MASK_SPAN])]
                for n in sorted({len(h) for h in by_id if len(h) < MASK_SPAN}):
                    seeds.append(_Seeds(_mask_of(n), [(i, h) for i, h in at if len(h) == n]))
            for batch in batches:
                found = {}
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    h = hasher(words(text))
                    for s in seeds:
                        if tolerant_share is None:
                            for p, i, q in s.hits(h):
                                key = (doc, ids[i])
                                if key not in found and _run(h, by_id[i], p, q) >= min(min_run, len(by_id[i])):
                                    found[key] = 0
                        else:
                            for i, d in s.diagonals(h):
                                least = min(tolerant_words, len(by_id[i]))
                                n = _tolerant(h, by_id[i], max(d, 0), max(-d, 0), tolerant_share, least)
                                if n >= least and n > found.get((doc, ids[i]), 0):
                                    found[doc, ids[i]] = n
                frame = pd.DataFrame([(d, i, n) for (d, i), n in found.items()], columns=["doc_id", "item_id", "n_words"])
                yield frame if tolerant_share else frame[["doc_id", "item_id"]]

        got = spread(documents.select("doc_id", "text").where("doc_id is not null and text is not null")).mapInPandas(find, schema)
        out = got if out is None else out.unionByName(got)
    return out


def leaked_documents(found: DataFrame) -> DataFrame:
    """(doc_id, n_items, items): each affected document with the items that leaked into it, in order."""
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.transform(F.array_sort(F.collect_list("item_id")), lambda x: x.cast("string")), ",").alias("items"))
