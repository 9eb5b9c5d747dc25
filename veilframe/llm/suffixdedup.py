"""Exact repeated substrings by a distributed merge sort of suffixes.

0.  Of equal texts (by a 128-bit digest) only the first takes part; the others repeat it
    throughout.
1.  Each text is cut into anchors: of the n-grams of every ``length``-byte string the one
    with the least hash, so that equal strings have equal anchors. Only anchors whose
    n-gram occurs twice in the corpus go on: the others' strings are unique.
2.  Tasks sort the suffixes at these anchors into runs, a bounded number at a time. Of
    equal neighbourhoods in a run only the first stays; the others are repeats already.
    Runs are front-coded (each suffix by its common prefix with the one before and the
    rest) and exchanged, all suffixes with one n-gram to one task. With more than ``fan``
    such tasks the exchange has two levels, each of about the square root as many
    receivers: runs are merged halfway into longer ones, so that a run never gets short
    however large the corpus is.
3.  There a loser tree merges the runs. It carries the common prefix of every loser with
    the last winner, so that no known prefix is compared again, and yields the common
    prefixes of the merged order. Suffixes whose common prefix is long enough, and whose
    bytes before the anchor agree, hold equal strings; all but the first are repeats.

N-grams with more than ``hot`` occurrences, in however few texts, take another exact way:
their strings are spread by a 128-bit hash, and the first of each is found by an
aggregation. Of strings met shortly before in the same text only the first gets a row.
"""

from __future__ import annotations

import hashlib
import math
import struct

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop, scratch, slices, staged

LENGTH = 100
#: Bytes of an anchor's n-gram.
GRAM = 24
#: Occurrences of an n-gram beyond which its strings are spread by hash.
HOT = 50_000
#: Suffixes in a run (of at most twice ``length`` bytes each); anchors that a merging task gets on average.
RUN, MERGE_ROWS = 50_000, 50_000
#: Merging tasks beyond which the exchange has two levels.
FAN = 256
#: Window starts taken at once from a long text; fewer than 2^24.
SEGMENT = 1 << 18
#: Strings of a hot n-gram that a text remembers.
RECENT = 100_000
#: Rows that a task gathers before it hands them on.
OUT_ROWS = 20_000

_B = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
#: Texts (by digest), runs (task, group), repeats (digest, first and last start) and strings (hash, place) in one table.
_KINDS = "kind int, same binary, k1 long, k2 long, doc_id long, n1 long, n2 long, data binary"
_TEXT, _RUN, _DUP, _ROW = range(4)
#: Numbers that go with a suffix.
_INTS = 6


def gram_hashes(raw: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of every run of ``size`` bytes."""
    h = _poly(raw, size)
    h ^= h >> np.uint64(29)
    h *= _B[1]
    h ^= h >> np.uint64(32)
    return h


def _poly(raw: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hashes modulo 2^64, from those of half the size."""
    if size == 1:
        return raw.astype(np.uint64) + _B[2]
    half = size // 2
    h = _poly(raw, half)
    out = h[: len(h) - half] * np.uint64(pow(int(_B[0]), half, 1 << 64)) + h[half:]
    if size % 2:
        out = out[:-1] * _B[0] + (raw[size - 1 :].astype(np.uint64) + _B[2])
    return out


def anchors(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """``(hash, place, first, last)``: strings starting from first to last have their anchor at place.

    The anchor is the n-gram of least hash within the string, the first of equal ones.
    """
    found = [np.empty((0, 3), np.int64)]
    hashes = [np.empty(0, np.uint64)]
    width = length - gram + 1
    for at in range(0, max(0, len(raw) - length + 1), SEGMENT):
        part = raw[at : at + SEGMENT + length - 1]
        h = gram_hashes(part, gram)
        low = ((h >> np.uint64(24)) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
        size, power = 1, low
        while size * 2 <= width:
            power = np.minimum(power[: len(power) - size], power[size:])
            size *= 2
        n = len(low) - width + 1
        place = (np.minimum(power[:n], power[width - size : width - size + n]) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:] - 1, [n - 1]])
        found.append(np.stack([place[first], first, last], 1) + at)
        hashes.append(h[place[first]])
    rows = np.concatenate(found)
    return np.concatenate(hashes).view(np.int64), rows[:, 0], rows[:, 1], rows[:, 2]


def united(found: list[tuple[bytes, int, int]], length: int) -> list[tuple[bytes, int, int]]:
    """Ranges of starts (digest, first, last), those of a text made one where their strings touch."""
    out: list = []
    for same, lo, hi in sorted(found):
        if out and out[-1][0] == same and lo <= out[-1][2] + length:
            out[-1] = (same, out[-1][1], max(hi, out[-1][2]))
        else:
            out.append((same, lo, hi))
    return out


class Run:
    """Suffixes in order, with what belongs to each: bytes before it, doc_id, digest, place, least distance, task."""

    def __init__(self):
        self.rows = []

    def packed(self, zstd) -> tuple[list, bytes]:
        """Repeats within the run as (digest, first start, last start), and the front-coded rest."""
        self.rows.sort()
        repeats, kept, prior = [], [], None
        for x in self.rows:
            if prior is not None and x[0] == prior[0] and x[1] == prior[1]:
                repeats.append((_digest(x[3], x[4]), x[5] - len(x[1]), x[5] - x[6]))
            else:
                kept.append(x)
                prior = x
        return repeats, encode(kept, zstd)


def neighbour_prefixes(strings: list[bytes]) -> list[int]:
    """Common prefix of each string with the one before, 0 for the first."""
    out = [0] * min(1, len(strings))
    for k in range(1, len(strings), 8192):
        part = strings[k - 1 : k + 8191]
        sizes = np.array(list(map(len, part)))
        width = int(sizes.max()) + 1
        flat = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in part), np.uint8).reshape(len(part), width)
        differ = flat[1:] != flat[:-1]
        differ[:, -1] = True
        out += np.minimum(differ.argmax(axis=1), np.minimum(sizes[1:], sizes[:-1])).tolist()
    return out


def encode(rows: list, zstd) -> bytes:
    """Front coding: common prefix with the suffix before, length of the rest, the rest."""
    n, lcps = len(rows), neighbour_prefixes([x[0] for x in rows])
    rests = [x[0][k:] for x, k in zip(rows, lcps)]
    ints = np.array([x[2:] for x in rows], np.int64).reshape(n, _INTS).T
    parts = [np.array(lcps, np.int32).tobytes(), np.array([len(r) for r in rests], np.int32).tobytes(), np.array([len(x[1]) for x in rows], np.int32).tobytes(), ints.tobytes(), b"".join(rests), b"".join(x[1] for x in rows)]
    return struct.pack("<q", n) + zstd.compress(b"".join(parts))


def decode(data: bytes):
    """suffixes, common prefixes, bytes before, and doc_id, digest (two), place, least distance and task."""
    (n,) = struct.unpack_from("<q", data)
    raw = zstandard.ZstdDecompressor().decompress(data[8:])
    lcps, sizes, befores = np.frombuffer(raw, np.int32, 3 * n).reshape(3, n)
    ints = np.frombuffer(raw, np.int64, _INTS * n, 12 * n).reshape(_INTS, n)
    at, out, prior = (12 + 8 * _INTS) * n, [], b""
    for k, size in zip(lcps.tolist(), sizes.tolist()):
        prior = prior[:k] + raw[at : at + size]
        out.append(prior)
        at += size
    before = []
    for size in befores.tolist():
        before.append(raw[at : at + size])
        at += size
    return out, lcps.tolist(), before, ints


def merge(runs: list[tuple[list[bytes], list[int]]]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merge sorted runs, each of strings and common prefixes with the one before.

    Returns (run, index) in order, and the common prefixes of neighbours. The loser tree
    keeps with each loser its common prefix with the last winner of its node; only equal
    prefixes need a comparison, which starts behind them.
    """
    width = 1
    while width < max(1, len(runs)):
        width *= 2
    at = [0] * width
    now: list = [runs[k][0][0] if k < len(runs) and runs[k][0] else None for k in range(width)]

    def play(a, la, b, lb):
        """(winner, its prefix, loser, its prefix with the winner)."""
        x, y = now[a], now[b]
        if y is None:
            return a, la, b, lb
        if x is None:
            return b, lb, a, la
        if la > lb:
            return a, la, b, lb
        if lb > la:
            return b, lb, a, la
        k, most = la, min(len(x), len(y))
        while k < most and x[k] == y[k]:
            k += 1
        if k == len(x) and (k < len(y) or a < b) or k < most and x[k] < y[k]:
            return a, la, b, k
        return b, lb, a, k

    loser, prefix = [0] * width, [0] * width
    level = [(k, 0) for k in range(width)]
    node = width
    while len(level) > 1:
        node //= 2
        up = []
        for k in range(0, len(level), 2):
            a, la, b, lb = play(*level[k], *level[k + 1])
            loser[node + k // 2], prefix[node + k // 2] = b, lb
            up.append((a, la))
        level = up
    winner, known = level[0]
    order, lcps = [], []
    while now[winner] is not None:
        order.append((winner, at[winner]))
        lcps.append(known)
        at[winner] += 1
        strings, own = runs[winner]
        if at[winner] < len(strings):
            now[winner], known = strings[at[winner]], own[at[winner]]
        else:
            now[winner], known = None, 0
        node = (winner + width) // 2
        cur = winner
        while node:
            cur, known, loser[node], prefix[node] = play(cur, known, loser[node], prefix[node])
            node //= 2
        winner = cur
    return order, lcps


def repeats(lcps: np.ndarray, before: list[bytes], ints: np.ndarray, length: int = LENGTH) -> list[tuple[bytes, int, int]]:
    """(digest, first start, last start) of strings that an earlier place holds too.

    ``ints``: doc_id, digest (two), place and least distance of the sorted suffixes. The
    bytes before are compared by two hashes of 64 bits.
    """
    n = len(before)
    if not n:
        return []
    most = np.array([len(b) for b in before])
    place, least = ints[3], ints[4]
    width = int(most.max())
    # Hash of the d bytes before the place, for every d.
    left = np.zeros((n, width), np.uint8)
    for k, b in enumerate(before):
        if b:
            left[k, : len(b)] = np.frombuffer(b[::-1], np.uint8)
    order = np.lexsort((place, ints[2], ints[1], ints[0]))
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    hashed, again = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
    who, where = [], []
    for d in range(width + 1):
        if d:
            hashed = (hashed + left[:, d - 1].astype(np.uint64) + np.uint64(1)) * _B[0]
            hashed ^= hashed >> np.uint64(31)
            again = (again ^ (left[:, d - 1].astype(np.uint64) + _B[2])) * _B[1]
            again ^= again >> np.uint64(29)
        live = np.flatnonzero((least <= d) & (d <= most))
        if len(live) < 2:
            continue
        group = np.cumsum(lcps < length - d)[live].astype(np.uint64)
        key = (group + np.uint64(1)) * _B[1] ^ hashed[live]
        by = np.lexsort((rank[live], key))
        check = again[live] ^ (group * _B[0])
        same = (key[by][1:] == key[by][:-1]) & (check[by][1:] == check[by][:-1])
        dup = live[by[1:][same]]
        who.append(dup.astype(np.int32))
        where.append(np.full(len(dup), d, np.int16))
    if not who:
        return []
    who, where = np.concatenate(who), np.concatenate(where)
    by = np.lexsort((where, who))
    who, where = who[by], where[by]
    if not len(who):
        return []
    new = np.concatenate([[True], (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)])
    start = np.flatnonzero(new)
    stop = np.concatenate([start[1:], [len(who)]]) - 1
    w = who[start]
    digests = map(_digest, ints[1][w].tolist(), ints[2][w].tolist())
    return list(zip(digests, (place[w] - where[stop]).tolist(), (place[w] - where[start]).tolist()))


_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _keys(docs: DataFrame) -> DataFrame:
    """doc_id, text, same (digest of the text) and order (doc_id, null before all)."""
    if not isinstance(docs.schema["doc_id"].dataType, _INTEGERS):
        raise TypeError("doc_id must be an integer")
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select("doc_id", "text", F.unhex(F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8"))).alias("same"), order.alias("order"))


def _head():
    """First 60 bits of the digest as a number."""
    return F.conv(F.substring(F.hex("same"), 1, 15), 16, 10).cast("long")


_SIGN = 1 << 63


def _numbers(same: bytes) -> tuple[int, int]:
    """A digest as two numbers in the same order."""
    a, b = struct.unpack(">QQ", same)
    return a - _SIGN, b - _SIGN


def _digest(a: int, b: int) -> bytes:
    return struct.pack(">QQ", a + _SIGN, b + _SIGN)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _grams(docs: DataFrame, length: int) -> DataFrame:
    """head (of the text's digest), h and n for each n-gram that is an anchor n times in a text.

    Copies that a task has met shortly before yield nothing again. 60 bits of the digest
    do here: they only tell two texts with a common n-gram apart.
    """

    def run(batches):
        met = set()
        for batch in slices(batches):
            heads, hashes, times = [], [], []
            for same, text in zip(batch.column("same").to_pylist(), batch.column("text").to_pylist()):
                if same in met:
                    continue
                if len(met) > RECENT:
                    met.clear()
                met.add(same)
                h = anchors(np.frombuffer(_bytes(text), np.uint8), length)[0]
                if len(h):
                    h, n = np.unique(h, return_counts=True)
                    heads.append(np.full(len(h), int.from_bytes(same[:8], "big") >> 4, np.int64))
                    hashes.append(h)
                    times.append(n)
            if heads:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (heads, hashes, times)], names=["head", "h", "n"])

    return docs.select("same", "text").mapInArrow(run, "head long, h long, n long")


class _Out:
    """Rows of ``_KINDS`` on their way out."""

    TYPES = (pa.int32(), pa.binary(), *[pa.int64()] * 5, pa.binary())

    def __init__(self):
        self.columns = {name.split()[0]: [] for name in _KINDS.split(", ")}

    def put(self, kind, same=None, k1=0, k2=0, doc_id=None, n1=0, n2=0, data=None):
        for column, v in zip(self.columns.values(), (kind, same, k1, k2, doc_id, n1, n2, data)):
            column.append(v)

    def __len__(self):
        return len(self.columns["kind"])

    def taken(self):
        found = pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(self.columns.values(), self.TYPES)], names=list(self.columns))
        for v in self.columns.values():
            v.clear()
        return found


def _sorted_runs(rows: DataFrame, length: int, tasks: int, wide: int, groups: int) -> DataFrame:
    """Runs, repeats found on the way, strings of hot n-grams and the texts concerned."""

    def run(batches):
        zstd = zstandard.ZstdCompressor(level=1)
        mine = TaskContext.get().partitionId() % groups if TaskContext.get() else 0
        runs: dict[int, Run] = {}
        held, out = 0, _Out()

        def flush():
            found = []
            for task, one in runs.items():
                more, data = one.packed(zstd)
                found += more
                out.put(_RUN, None, task, mine, data=data)
            for same, lo, hi in united(found, length):
                out.put(_DUP, same, n1=lo, n2=hi)
            runs.clear()

        for batch in slices(batches):
            for same, doc_id, text, grams, hot in zip(*(batch.column(c).to_pylist() for c in ("same", "order", "text", "grams", "hot"))):
                raw = _bytes(text)
                k1, k2 = _numbers(same)
                h, place, first, last = anchors(np.frombuffer(raw, np.uint8), length)
                out.put(_TEXT, same, data=zstd.compress(raw))
                for k in np.flatnonzero(np.isin(h, np.array(grams, np.int64))).tolist():
                    p, lo, hi, task = int(place[k]), int(first[k]), int(last[k]), int(h[k]) % tasks
                    runs.setdefault(task % wide, Run()).rows.append((raw[p : hi + length], raw[lo:p], doc_id, k1, k2, p, p - hi, task))
                    held += 1
                    if held >= RUN:
                        flush()
                        held = 0
                    if len(out) > OUT_ROWS:
                        yield out.taken()
                recent: set = set()
                for k in np.flatnonzero(np.isin(h, np.array(hot or [], np.int64))).tolist() if hot else ():
                    again = None
                    for q in range(int(first[k]), int(last[k]) + 1):
                        key = hashlib.blake2b(raw[q : q + length], digest_size=16).digest()
                        if key in recent:
                            if again is None:
                                again = q
                            continue
                        if again is not None:
                            out.put(_DUP, same, n1=again, n2=q - 1)
                            again = None
                        if len(recent) > RECENT:
                            recent.clear()
                        recent.add(key)
                        out.put(_ROW, same, *struct.unpack("<qq", key), doc_id, q)
                    if again is not None:
                        out.put(_DUP, same, n1=again, n2=int(last[k]))
                    if len(out) > OUT_ROWS:
                        yield out.taken()
            yield out.taken()
        flush()
        yield out.taken()

    return rows.mapInArrow(run, _KINDS)


def _merge_runs(table: pa.Table):
    """Suffixes, common prefixes, bytes before and numbers of all runs of a group, merged."""
    parts = [decode(x) for x in table.column("data").to_pylist()]
    order, lcps = merge([(p[0], p[1]) for p in parts])
    offset = np.cumsum([0] + [len(p[0]) for p in parts])
    ints = np.concatenate([p[3] for p in parts], axis=1)[:, [offset[r] + k for r, k in order]]
    return [parts[r][0][k] for r, k in order], lcps, [parts[r][2][k] for r, k in order], ints


def _regrouped(runs: DataFrame) -> DataFrame:
    """Runs of many tasks, merged by group and cut into one longer run for each task."""

    def run(table: pa.Table) -> pa.Table:
        zstd = zstandard.ZstdCompressor(level=1)
        strings, _, before, ints = _merge_runs(table)
        by_task: dict[int, list] = {}
        for s, b, numbers in zip(strings, before, ints.T.tolist()):
            by_task.setdefault(numbers[-1], []).append((s, b, *numbers))
        return pa.table({"task": pa.array(by_task, pa.int64()), "data": pa.array([encode(x, zstd) for x in by_task.values()], pa.binary())})

    return runs.groupBy("k1", "k2").applyInArrow(run, "task long, data binary")


def _merged(runs: DataFrame, length: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        _, lcps, before, ints = _merge_runs(table)
        found = united(repeats(np.array(lcps), before, ints, length), length)
        return pa.table({"same": pa.array([f[0] for f in found], pa.binary()), "lo": pa.array([f[1] for f in found], pa.int64()), "hi": pa.array([f[2] for f in found], pa.int64())})

    return runs.groupBy("task").applyInArrow(run, "same binary, lo long, hi long")


def _united(found: DataFrame, length: int) -> DataFrame:
    """same and spans: the disjoint byte ranges under the strings from lo to hi. One row holds a text's spans, not its strings."""
    doc = Window.partitionBy("same").orderBy("lo")
    rows = found.select("same", "lo", (F.col("hi") + length).alias("hi"))
    rows = rows.withColumn("new", (F.col("lo") > F.coalesce(F.max("hi").over(doc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1))).cast("int"))
    rows = rows.withColumn("span", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.groupBy("same", "span").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return rows.groupBy("same").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))


def dedup_substrings(docs: DataFrame, length: int = LENGTH, hot: int = HOT, fan: int = FAN, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """Spans of the UTF-8 bytes of each text under a ``length``-byte string that starts earlier too.

    One row per row of ``docs(doc_id, text)``: doc_id, n_bytes, spans (half-open byte
    ranges to remove), n_removed, n_spans, kept_sha256 (of the remaining bytes). Earlier is
    a smaller doc_id (null before all) or an earlier start in the same text; overlaps
    count; strings are judged on the input and never cross documents. Null text counts as
    empty. Rows that repeat both doc_id and text are one place and end alike; of rows that
    share a doc_id only, a digest of the text tells which is earlier. doc_id must be of an
    integer type, else a TypeError is raised. Other columns are ignored; an empty table
    gives no rows.
    """
    keyed = _keys(docs)
    with scratch() as keep:
        firsts, cuts = (keep(x) for x in _cuts(keyed, length, hot, fan, merge_rows))
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    whole = keyed.select("doc_id", "same", "order", F.octet_length(raw).cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("whole"))
    whole = whole.join(firsts.select("same", F.col("order").alias("first")), "same").join(cuts, "same", "left")
    # Of texts that are the same only the first takes part; all of the others repeats it.
    copy = (F.col("order") != F.col("first")) & (F.col("n_bytes") >= length)
    none = F.array().cast("array<struct<lo:long,hi:long>>")
    return whole.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))).otherwise(F.coalesce("spans", none)).alias("spans"),
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce(F.size("spans"), F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "whole")).alias("kept_sha256"),
    )


def _cuts(keyed: DataFrame, length: int, hot: int, fan: int, merge_rows: int) -> tuple[DataFrame, DataFrame]:
    """Staged: the least order of each text, and what is cut from each first text."""
    firsts = staged(keyed.groupBy("same").agg(F.min("order").alias("order")), "firsts")
    grams = staged(_grams(keyed, length), "grams")
    twice = grams.groupBy("h").agg(F.min("head").alias("lo"), F.max("head").alias("hi"), F.max("n").alias("most"), F.sum("n").alias("n"))
    twice = staged(twice.where("lo != hi or most > 1").select("h", "n"), "twice")
    wanted = grams.join(twice.select("h", (F.col("n") > hot).alias("is_hot")), "h").groupBy("head")
    wanted = wanted.agg(F.collect_set(F.when(~F.col("is_hot"), F.col("h"))).alias("grams"), F.collect_set(F.when(F.col("is_hot"), F.col("h"))).alias("hot"))
    # Two texts of one head only take each other's n-grams along.
    wanted = staged(wanted.join(firsts.select("same", "order", _head().alias("head")), "head").drop("head"), "wanted")
    total = twice.agg(F.sum("n")).first()[0] or 0
    tasks = max(1, total // merge_rows)
    wide = tasks if tasks <= fan else math.isqrt(tasks - 1) + 1
    groups = 1 if tasks <= fan else -(-tasks // wide)
    any_hot = not twice.where(F.col("n") > hot).isEmpty()
    drop(grams, twice)
    mine = keyed.select("same", "order", "text").join(wanted, ["same", "order"]).dropDuplicates(["same"])
    parts = staged(_sorted_runs(mine, length, tasks, wide, groups), "runs")
    drop(wanted)

    runs = parts.where(F.col("kind") == _RUN)
    if groups > 1:
        runs = staged(_regrouped(runs.select("k1", "k2", "data")), "long_runs")
    else:
        runs = runs.select(F.col("k1").alias("task"), "data")
    found = parts.where(F.col("kind") == _DUP).select("same", F.col("n1").alias("lo"), F.col("n2").alias("hi"))
    found = found.union(_merged(runs, length))
    if any_hot:
        strings = parts.where(F.col("kind") == _ROW).select("k1", "k2", F.struct("doc_id", "same", F.col("n1").alias("at")).alias("place"))
        first = staged(strings.groupBy("k1", "k2").agg(F.min("place").alias("first")), "first")
        later = strings.join(first, ["k1", "k2"]).where("place != first")
        found = found.union(later.select("place.same", F.col("place.at").alias("lo"), F.col("place.at").alias("hi")))
    texts = parts.where(F.col("kind") == _TEXT).select("same", "data").join(_united(found, length), "same")

    def cut(batches):
        for batch in slices(batches):
            kept, sums, shas = [], [], []
            for data, gone in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
                raw = zstandard.ZstdDecompressor().decompress(data)
                edges = [0, *(e for s in gone for e in (s["lo"], s["hi"])), len(raw)]
                digest = hashlib.sha256()
                for a, b in zip(edges[::2], edges[1::2]):
                    digest.update(raw[a:b])
                kept.append(gone)
                sums.append(sum(s["hi"] - s["lo"] for s in gone))
                shas.append(digest.hexdigest())
            kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("same"), pa.array(kept, kind), pa.array(sums, pa.int64()), pa.array(shas, pa.string())], names=["same", "spans", "n_removed", "kept_sha256"])

    return firsts, staged(texts.mapInArrow(cut, "same binary, spans array<struct<lo:long,hi:long>>, n_removed long, kept_sha256 string"), "cuts")


#: The same digest in DuckDB, byte by byte in hexadecimal; doc_id is unique there.
ORACLE = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), starts AS (
  SELECT doc_id, q, substring(h, 2 * q + 1, {2 * LENGTH}) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - {LENGTH - 1})) AS q FROM d WHERE length(h) // 2 >= {LENGTH})
), later AS (
  SELECT doc_id, q FROM (SELECT doc_id, q, row_number() OVER (PARTITION BY s ORDER BY doc_id, q) AS place FROM starts) WHERE place > 1
), islands AS (
  SELECT doc_id, q, sum(fresh) OVER (PARTITION BY doc_id ORDER BY q) AS island FROM (
    SELECT doc_id, q, CASE WHEN q <= lag(q) OVER (PARTITION BY doc_id ORDER BY q) + {LENGTH} THEN 0 ELSE 1 END AS fresh FROM later)
), spans AS (
  SELECT doc_id, min(q) AS lo, max(q) + {LENGTH} AS hi FROM islands GROUP BY doc_id, island
), kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * from_byte + 1, 2 * (lo - from_byte)), '' ORDER BY from_byte) AS k FROM (
    SELECT d.doc_id, d.h, s.lo, coalesce(lag(s.hi) OVER (PARTITION BY d.doc_id ORDER BY s.lo), 0) AS from_byte
    FROM d JOIN (SELECT doc_id, lo, hi FROM spans UNION ALL SELECT doc_id, length(h) // 2, NULL FROM d) s USING (doc_id))
  GROUP BY doc_id
), sums AS (
  SELECT doc_id, sum(hi - lo) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id
)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
"""
