"""Packing by shortest-pack-first over the length histogram.

Documents become token ids, are cut at multiples of the sequence length, and the rests
are packed. Only the histogram of rest lengths (one entry per length below the sequence
length, whatever the corpus size) reaches the driver. There lengths are placed longest
first into the shortest open pack, with counts of equal packing patterns instead of
single packs. Gaps that remain are filled by cutting up the emptiest packs. Every rest
finds its place by its rank among the rests of its length.
"""

from __future__ import annotations

import heapq
import os
import re
import zlib
from array import array
from bisect import bisect_right
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import on_worker, per_worker, slices, staged

SEQUENCE = 2048
END_ID = 1
#: Words met in several batches whose ids a Python worker keeps before it starts afresh; half as many met once, and
#: as many parts of words.
CACHE_WORDS = 600_000
#: Gaps of fewer tokens stay padding: cutting a document for them costs more than it gains.
MIN_FILL = 8
#: Rows that one rank group holds on average.
RANK_GROUP_ROWS = 20_000


#: Latin letters whose lower case and composed form are beyond doubt, then signs that no letter joins.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,!?;:#$%&*|()\[\]{}<>+=/-]*)")


class WordEncoder:
    """Token ids of whole texts, through bounded caches of words; rare words cannot crowd out common ones.

    The tokenizer drops white space and no token spans it, so a text's ids are those of
    its words in a row.
    """

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.dtype = np.dtype("<u4" if self.wide else "<u2")
        self.cache: dict[bytes, bytes] = {}
        self.once: dict[bytes, bytes] = {}
        self.stems: dict[bytes, bytes] = {}
        self.signs: dict[bytes, bytes] = {b"": b""}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.cache_words = cache_words

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each UTF-8 text, packed as ``dtype``."""
        split = [t.split() for t in texts]
        cache, once = self.cache, self.once
        found = [list(map(cache.get, words)) for words in split]
        gaps = [[k for k, x in enumerate(row) if x is None] for row in found]
        missing = {words[k] for words, row in zip(split, gaps) for k in row}
        again = missing.intersection(once)
        ids = {w: once.pop(w) for w in again}
        if len(cache) + len(ids) > self.cache_words:
            cache.clear()
        cache.update(ids)
        new = self._new(missing.difference(again))
        if len(once) + len(new) > self.cache_words // 2:
            once.clear()
        once.update(new)
        ids.update(new)
        for words, row, gap in zip(split, found, gaps):
            for k in gap:
                row[k] = ids[words[k]]
        return list(map(b"".join, found))

    def _new(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of new words. Most are letters with signs after them: two known parts, in any case."""
        ids, stems = {}, self.stems
        if len(stems) > self.cache_words:
            stems.clear()
        later, odd, known = [], [], stems.get
        for w in words:
            stem = w.rstrip(b".,")
            if stem.isalpha():
                sign, stem = w[len(stem) :], stem.lower()
            elif m := _PLAIN.fullmatch(w.decode("utf-8", "replace")):
                stem, sign = m.group(1).lower().encode(), m.group(2).encode()
            else:
                odd.append(w)
                continue
            x = known(stem)
            if x is None:
                later.append((w, stem, sign))
            else:
                ids[w] = x + self._sign(sign) if sign else x
        fresh = list({x for _, x, _ in later}.difference(stems))
        for k in range(0, len(fresh), 2048):
            stems.update(zip(fresh[k : k + 2048], self._stems(fresh[k : k + 2048])))
        ids.update((w, stems[x] + self._sign(y)) for w, x, y in later)
        ids.update(zip(odd, self._each(odd)))
        return ids

    def _sign(self, sign: bytes) -> bytes:
        if sign not in self.signs:
            self.signs[sign] = self._each([sign])[0]
        return self.signs[sign]

    def _stems(self, stems: list[bytes]) -> list[bytes]:
        """The ids of words of lower-case letters only, which are tokenized as one text and cut at the word ends."""
        ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(stems).decode()], add_special_tokens=False)[0].ids, self.dtype)
        ends = np.flatnonzero(self.ends_word[ids]) + 1
        if len(ends) != len(stems):
            return self._each(stems)
        raw, cut = ids.tobytes(), (ends * self.dtype.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *cut], cut)]

    def _each(self, words: list[bytes]) -> list[bytes]:
        kind, out = "I" if self.wide else "H", []
        for k in range(0, len(words), 4096):
            part = [w.decode("utf-8", "replace") for w in words[k : k + 4096]]
            out += [array(kind, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]
        return out


def _crc(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def tokenized(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Per row of ``docs``: its key, token count, crc of each full piece and the ids of the rest."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("full_crcs", T.ArrayType(T.LongType())),
            T.StructField("rest_len", T.IntegerType()),
            T.StructField("rest_ids", T.BinaryType()),
        ]
    )

    def run(batches):
        encode = per_worker(("word_encoder", tokenizer_path), lambda: WordEncoder(on_worker(tokenizer_path)))
        end = np.array([END_ID], encode.dtype).tobytes()
        for batch in slices(batches):
            rows = defaultdict(list)
            for raw in encode([t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]):
                ids = np.frombuffer(raw + end, encode.dtype)
                cut = len(ids) // sequence * sequence
                rows["n_tokens"].append(len(ids))
                rows["full_crcs"].append([_crc(ids[k : k + sequence]) for k in range(0, cut, sequence)])
                rows["rest_len"].append(len(ids) - cut)
                rows["rest_ids"].append(ids[cut:].tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(rows["n_tokens"], pa.int64()),
                    pa.array(rows["full_crcs"], pa.list_(pa.int64())),
                    pa.array(rows["rest_len"], pa.int32()),
                    pa.array(rows["rest_ids"], pa.binary()),
                ],
                names=[f.name for f in schema],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _shifted(segments, by):
    return [(length, rank + by, start, size) for length, rank, start, size in segments]


def shortest_pack_first(histogram: dict[int, int], sequence: int = SEQUENCE) -> list:
    """Packing patterns ``(tokens, count, segments)`` for ``{length: count}``.

    A segment ``(length, rank, start, size)`` puts tokens start .. start + size of the
    rest with rank ``rank + k`` among those of ``length`` into the pattern's k-th pack.
    """
    heap: list = []
    tie = 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            tie += 1
            if heap and heap[0][0] + length <= sequence:
                tokens, _, count, segments = heapq.heappop(heap)
                m = min(left, count)
                if count > m:
                    heapq.heappush(heap, (tokens, -tie, count - m, _shifted(segments, m)))
                    tie += 1
                heapq.heappush(heap, (tokens + length, -tie, m, [*segments, (length, rank, 0, length)]))
                left, rank = left - m, rank + m
            else:
                heapq.heappush(heap, (length, -tie, left, [(length, rank, 0, length)]))
                left = 0
    return [(tokens, count, segments) for tokens, _, count, segments in heap]


class Plan:
    """Where each rest goes, in tables whose size depends on the sequence length only.

    Packs of one pattern have consecutive numbers. The emptiest patterns give up their
    packs: their tokens, pack after pack, form one stream that runs through the gaps of
    the other packs and then through extra packs, the last ones of sizes that are powers
    of two. A token's place follows from its position in the stream.
    """

    def __init__(self, histogram: dict[int, int], sequence: int = SEQUENCE, min_fill: int = MIN_FILL):
        patterns = sorted(shortest_pack_first(histogram, sequence), key=lambda p: -p[0])
        open_from = next((k for k, p in enumerate(patterns) if sequence - p[0] >= min_fill), len(patterns))
        keep, give = patterns[:open_from], patterns[open_from:]
        gaps = 0
        while give and sum(t * n for t, n, _ in give[1:]) >= gaps + (sequence - give[0][0]) * give[0][1]:
            gaps += (sequence - give[0][0]) * give[0][1]
            keep.append(give.pop(0))
        if give:
            tokens, count, segments = give[0]
            m = (sum(t * n for t, n, _ in give) - gaps) // sequence
            m = min(m, count)
            if m:
                keep.append((tokens, m, segments))
                give[0] = (tokens, count - m, _shifted(segments, m))
        self.spans = defaultdict(list)
        self.gap_from, self.gaps = [], []
        packs = stream = 0
        for k, (tokens, count, segments) in enumerate(keep):
            self._place(segments, count, packs, 0, None)
            if k >= open_from:
                self.gap_from.append(stream)
                self.gaps.append((sequence - tokens, packs, tokens))
                stream += (sequence - tokens) * count
            packs += count
        given = 0
        for tokens, count, segments in give:
            self._place(segments, count, given, 0, tokens)
            given += tokens * count
        left, size = max(0, given - stream), sequence
        while left:
            if count := left // size:
                self.gap_from.append(stream)
                self.gaps.append((size, packs, 0))
                stream, packs, left = stream + count * size, packs + count, left % size
            size //= 2
        self.packs = packs
        self.marks = {}
        for length, rows in self.spans.items():
            rows.sort()
            self.marks[length] = [r[0] for r in rows]

    def _place(self, segments, count, first, offset, stride):
        for length, rank, _, size in segments:
            self.spans[length].append((rank, first, offset, stride))
            offset += size

    def pieces(self, length: int, rank: int) -> list[tuple[int, int, int, int]]:
        """``(start, size, pack, offset)`` of the rest with this rank among those of its length."""
        rank_from, first, offset, stride = self.spans[length][bisect_right(self.marks[length], rank) - 1]
        if stride is None:
            return [(0, length, first + rank - rank_from, offset)]
        out, start, at = [], 0, first + (rank - rank_from) * stride + offset
        while start < length:
            k = bisect_right(self.gap_from, at) - 1
            gap, pack, used = self.gaps[k]
            j, inside = divmod(at - self.gap_from[k], gap)
            size = min(gap - inside, length - start)
            out.append((start, size, pack + j, used + inside))
            start, at = start + size, at + size
        return out


def pack(docs: DataFrame, tokenizer_path: str, sequence: int = SEQUENCE) -> DataFrame:
    """Pack every row of ``docs(doc_id, text)`` into sequences of ``sequence`` tokens.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    Null text counts as empty, so the row is its end id alone; null and repeated doc_ids
    are packed like others, each row by itself; other columns are ignored; an empty table
    gives no pieces. Text that spells a special token is encoded as plain text.
    """
    rows = staged(tokenized(docs, tokenizer_path, sequence).withColumn("_row", F.monotonically_increasing_id()), "tokens")
    total = rows.count()
    groups = max(256, total // RANK_GROUP_ROWS)
    slim = rows.select("_row", "rest_len", F.size("full_crcs").alias("n_full")).withColumn("grp", F.pmod(F.xxhash64("_row"), F.lit(groups)))
    counts = slim.groupBy("rest_len", "grp").agg(F.count("*").alias("n"), F.sum("n_full").alias("n_full"))
    histogram = {r["rest_len"]: r["n"] for r in counts.groupBy("rest_len").agg(F.sum("n").alias("n")).collect() if r["rest_len"]}
    plan = Plan(histogram, sequence)

    before = Window.partitionBy("rest_len").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("rest_len", "grp", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"))
    full = counts.groupBy("grp").agg(F.sum("n_full").alias("n_full"))
    full = full.select("grp", F.coalesce(F.sum("n_full").over(Window.orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("full_from"))
    in_group = Window.partitionBy("grp").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    slim = (
        slim.withColumn("full_before", F.coalesce(F.sum("n_full").over(in_group), F.lit(0)))
        .withColumn("rank", F.row_number().over(Window.partitionBy("grp", "rest_len").orderBy("_row")) - 1)
        .join(full, "grp")
        .join(ranks, ["grp", "rest_len"])
        .select("_row", (F.col("rank") + F.col("rank_from")).alias("rank"), (F.col("full_before") + F.col("full_from") + plan.packs).alias("full_from"))
    )
    kind = docs.schema["doc_id"].dataType
    names = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").to_pylist()
            out = {k: [] for k in ["doc_id", *names]}
            cols = [batch.column(c).to_pylist() for c in ("n_tokens", "full_crcs", "rest_len", "rest_ids", "rank", "full_from")]
            for doc_id, n_tokens, crcs, rest, raw, rank, full_from in zip(ids, *cols):
                found = [(k * sequence, sequence, crc, full_from + k, 0) for k, crc in enumerate(crcs)]
                if rest:
                    tokens = np.frombuffer(raw, f"<u{len(raw) // rest}")
                    cut = len(crcs) * sequence
                    found += [(cut + s, size, _crc(tokens[s : s + size]), *place) for s, size, *place in plan.pieces(rest, rank)]
                for row in found:
                    out["doc_id"].append(doc_id)
                    for name, v in zip(("start", "length", "ids_crc32", "sequence_id", "offset"), row):
                        out[name].append(v)
                    out["doc_tokens"].append(n_tokens)
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], batch.schema.field("doc_id").type)] + [pa.array(out[n], pa.int64()) for n in names], names=["doc_id", *names])

    return rows.join(slim, "_row").select("doc_id", "n_tokens", "full_crcs", "rest_len", "rest_ids", "rank", "full_from").mapInArrow(run, schema)
