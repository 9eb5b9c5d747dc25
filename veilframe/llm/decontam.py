"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items that share a run of ``min_match`` tokens (a seed) are
compared: the longest common run of unmarked tokens is marked, again and again, until none
of ``min_match`` tokens is left. Running Karp-Rabin finds it: hashes of all unmarked runs
of one length come from one pass over prefix sums, and the length is halved and bisected
until it is the longest that both sides have. The share of an item's tokens under such
tiles tells whether a document holds it, in whatever order its parts stand.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import per_worker, scratch, slices, staged

#: Tokens of the shortest tile; share of an item's tokens that marks a document.
MIN_MATCH, COVERAGE = 5, 0.5
#: Characters of benchmark items held in memory at once; more are taken in blocks, one after the other.
BLOCK_CHARS = 8_000_000
CACHE_WORDS = 400_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_NOT_WORD = re.compile(r"[\W_]+")


class Tokens(dict):
    """Word as UTF-8 -> hash of its letters and digits in lower case; 0 if it has none."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        plain = _NOT_WORD.sub("", word.decode("utf-8", "replace").lower())
        h = self[word] = xxhash.xxh3_64_intdigest(plain.encode()) | 1 if plain else 0
        return h

    def of(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").split()
        h = np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
        return h[h != 0]


_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base)
    out[0] = 1
    return np.multiply.accumulate(out)


class Runs:
    """Karp-Rabin hashes, modulo 2^64, of the runs of a sequence of tokens, and which tokens are marked."""

    def __init__(self, tokens: np.ndarray, marked: np.ndarray | None = None):
        n = len(tokens)
        self.tokens = tokens
        self.marked = np.zeros(n, bool) if marked is None else marked
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tokens * _powers(_BASE, n)[:n], dtype=np.uint64)])
        self.back = _powers(_BACK, n)

    def hashes(self, size: int) -> np.ndarray:
        n = max(0, len(self.tokens) - size + 1)
        return (self.sums[size : size + n] - self.sums[:n]) * self.back[:n]

    def free(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the runs of ``size`` unmarked tokens."""
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[size:] == before[: len(before) - size]) if size <= len(self.tokens) else np.empty(0, np.int64)
        return at, self.hashes(size)[at]


def longest(doc: Runs, item: Runs, least: int, most: int) -> int:
    """Length of the longest unmarked run that both have, between ``least`` and ``most``; 0 if there is none."""

    def common(size):
        return np.isin(doc.free(size)[1], item.free(size)[1]).any()

    size = most
    while size > least and not common(size):
        most, size = size - 1, max(least, size // 2)
    if size == least and not common(size):
        return 0
    while size < most:
        middle = (size + most + 1) // 2
        if common(middle):
            size = middle
        else:
            most = middle - 1
    return size


def tiles(doc: Runs, item: Runs, size: int) -> int:
    """Marks the tiles of at least ``size`` tokens and returns how many tokens of ``item`` they have.

    Longer tiles come first; of equal ones those that stand earlier in the document, then
    in the item. No token is in two tiles.
    """
    covered, now = 0, len(item.tokens)
    while now := longest(doc, item, size, now):
        at, hashes = item.free(now)
        places: dict[int, list] = {}
        for j, h in zip(at[::-1].tolist(), hashes[::-1].tolist()):
            places.setdefault(h, []).append(j)
        at, hashes = doc.free(now)
        keep = np.isin(hashes, np.fromiter(places, np.uint64, len(places)))
        end, found = 0, 0
        for i, h in zip(at[keep].tolist(), hashes[keep].tolist()):
            if i < end:
                continue
            left = places[h]
            while left and item.marked[left[-1] : left[-1] + now].any():
                left.pop()
            if left and np.array_equal(doc.tokens[i : i + now], item.tokens[left[-1] : left[-1] + now]):
                j = left.pop()
                doc.marked[i : i + now] = item.marked[j : j + now] = True
                end, found = i + now, found + now
            elif not any(places.values()):
                break
        covered += found
        if not found:  # only hashes were equal
            now -= 1
            if now < size:
                break
    return covered


class Benchmark:
    """A block of benchmark items, with the seeds of each sorted by hash."""

    def __init__(self, items: list[tuple], min_match: int):
        tokens = Tokens()
        self.items, keys, owners, sizes = [], [], [], {min_match}
        self.min_match = min_match
        for item_id, text in items:
            h = tokens.of(text)
            if not len(h):
                continue
            size = min(min_match, len(h))
            sizes.add(size)
            keys.append(np.unique(self.seeds(Runs(h), size)))
            owners.append(np.full(len(keys[-1]), len(self.items), np.int32))
            self.items.append((item_id, h))
        join = lambda x, t: np.concatenate(x) if x else np.empty(0, t)
        keys, owners = join(keys, np.uint64), join(owners, np.int32)
        order = np.argsort(keys, kind="stable")
        self.owners = owners[order]
        self.keys, self.first = np.unique(keys[order], return_index=True)
        self.first = np.append(self.first, len(keys))
        self.sizes = sorted(sizes)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[self.keys >> np.uint64(44)] = True

    @staticmethod
    def seeds(runs: Runs, size: int) -> np.ndarray:
        h = (runs.hashes(size) + np.uint64(size)) * _BASE
        return h ^ (h >> np.uint64(32))

    def covered(self, h: np.ndarray, coverage: float = 0.0) -> list[tuple]:
        """(item_id, share of its tokens under tiles) of items that share a seed with a document.

        Items that can reach neither ``coverage`` nor the greatest share may be left out.
        """
        doc, out, best = Runs(h), [], 0.0
        for size in self.sizes:
            r = self.seeds(doc, size)
            at = np.flatnonzero(self.sieve[r >> np.uint64(44)])
            place = np.minimum(np.searchsorted(self.keys, r[at]), len(self.keys) - 1) if len(self.keys) else at[:0]
            hit = self.keys[place] == r[at] if len(place) else np.empty(0, bool)
            at, place = at[: len(place)][hit], place[hit]
            if not len(at):
                continue
            # Owners of the distinct seeds that the document has, however often it has them.
            seeds = np.unique(place)
            owners, mine = self._owners(seeds)
            order = np.argsort(owners, kind="stable")
            starts = np.flatnonzero(np.concatenate([[True], np.diff(owners[order]) != 0]))
            found = []
            for part in np.split(order, starts[1:]):
                item_id, tokens = self.items[owners[part[0]]]
                if min(self.min_match, len(tokens)) != size:
                    continue
                item, shared = Runs(tokens), self.keys[mine[part]]
                left = np.ones(len(tokens), bool)
                _under(left, np.flatnonzero(np.isin(self.seeds(item, size), shared)), size)
                found.append((1 - left.mean(), item_id, item, left, mine[part]))
            for bound, item_id, item, left, shared in sorted(found, key=lambda x: -x[0]):
                if bound <= best and bound < coverage:
                    break
                out_of = np.ones(len(h), bool)
                _under(out_of, at[np.isin(place, shared)], size)
                item.marked = left
                near = _parts(h, out_of, size)
                share = tiles(near, item, size) / len(item.tokens)
                best = max(best, share)
                out.append((item_id, share))
        return out

    def _owners(self, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items with these seeds, and the seed of each."""
        counts = self.first[seeds + 1] - self.first[seeds]
        at = np.repeat(self.first[seeds] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        return self.owners[at], np.repeat(seeds, counts)


def _under(marks: np.ndarray, starts: np.ndarray, size: int) -> None:
    """Takes the marks of the tokens in runs of ``size`` from ``starts`` on away."""
    edge = np.zeros(len(marks) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    marks[np.cumsum(edge[:-1]) > 0] = False


def _parts(tokens: np.ndarray, out_of: np.ndarray, size: int) -> Runs:
    """The tokens that are in seeds, with one marked token after each part of the document."""
    kept = ~out_of
    kept[1:] |= ~out_of[:-1]
    return Runs(tokens[kept], out_of[kept])


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` with contaminated, coverage (of the most covered item) and item_ids (covered enough, sorted).

    Tokens are the letters and digits of white-space separated words, in lower case. An
    item with fewer than ``min_match`` tokens must occur whole; one without tokens, with a
    null text or a null item_id matches nothing; item_id may be of any type that sorts.
    The benchmark's size is measured first: no more than about ``block_chars`` characters
    of it (or one item) are held in memory at once. A larger benchmark is taken in blocks
    that run one after the other, each over all texts; what they find is written, by a
    digest of the text, and joined at the end. With one block no document is moved. Null
    and empty texts have coverage 0. Repeated rows get equal results. Other columns are
    kept, but the three named are replaced. An empty table stays empty.
    """
    items = benchmark.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    ids = T.ArrayType(benchmark.schema["item_id"].dataType)
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // block_chars) or 1
    docs = docs.drop("contaminated", "coverage", "item_ids")
    if blocks == 1:
        out = _compared(docs, items, ids, min_match, coverage)
    else:
        texts = docs.select(_digest().alias("digest"), "text").where("text is not null")
        parts = []
        with scratch() as keep:
            for b in range(blocks):
                mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
                parts.append(staged(_compared(texts, mine, ids, min_match, coverage).where("coverage > 0").select("digest", "coverage", "item_ids").dropDuplicates(["digest"]), "block"))
            found = parts[0]
            for more in parts[1:]:
                found = found.union(more)
            found = keep(staged(found.groupBy("digest").agg(F.max("coverage").alias("coverage"), F.flatten(F.collect_list("item_ids")).alias("item_ids")), "blocks"))
        names = docs.columns
        docs = docs.select(F.struct(*names).alias("doc"), _digest().alias("own")).join(found, F.col("own") == F.col("digest"), "left")
        out = docs.select(*(F.col("doc")[c].alias(c) for c in names), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("item_ids", F.array().cast(ids)).alias("item_ids"))
    return out.withColumn("contaminated", F.size("item_ids") > 0).withColumn("item_ids", F.array_sort(F.array_distinct("item_ids")))


def _digest():
    return F.unhex(F.md5(F.encode(F.col("text"), "UTF-8")))


def _compared(docs: DataFrame, items: DataFrame, ids: T.ArrayType, min_match: int, coverage: float) -> DataFrame:
    """``docs`` with coverage and item_ids, against ``items`` held in memory."""
    block = Benchmark([(r["item_id"], r["text"]) for r in items.collect()], min_match)
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in docs.schema), T.StructField("coverage", T.DoubleType()), T.StructField("item_ids", ids)])
    kind = to_arrow_type(ids)

    def run(batches):
        tokens = per_worker(("tokens",), Tokens)
        for batch in slices(batches):
            best, found = [], []
            for text in batch.column("text").to_pylist():
                shares = block.covered(tokens.of(text), coverage)
                best.append(max((share for _, share in shares), default=0.0))
                found.append([item_id for item_id, share in shares if share >= coverage])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best, pa.float64()), pa.array(found, kind)], names=schema.names)

    return docs.mapInArrow(run, schema)
