"""Near-duplicates: universal hash minima with banding, verification, connected components."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import drop, per_worker, scratch, sendable, slices, staged
from .components import components

#: Minima in a band.
BAND_ROWS = 5
#: Chance to miss a link of just the threshold's similarity.
MISS = 1e-6
#: Word hashes and signatures that a Python worker keeps.
CACHE_WORDS, CACHE_SETS = 250_000, 2_000
#: Centres that each bucket's members are held against, before the pairs left are listed.
STAR_ROUNDS = 2
#: Members of buckets in which pairs are listed outright; the others' pairs go through a prefix filter.
SMALL_BUCKET = 8

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M2
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, words: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a text.

    ASCII letters are lower-cased; a shorter text's whole sequence is its one shingle;
    without words the set is empty.
    """
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, found), np.uint64, len(found))
    n = min(words, len(found))
    out = np.full(len(found) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * _M3 + h[k : k + len(out)] + _M1)
    return np.unique(out)


def band_count(similarity: float, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)) if similarity < 1 else 1


class Signer:
    """Band keys of a set: each combines ``rows`` minima of universal hashes a*x + b mod 2^64."""

    def __init__(self, bands: int, rows: int = BAND_ROWS):
        r = np.random.default_rng(20240607)
        self.a = r.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = r.integers(0, 1 << 63, bands * rows, np.uint64)
        self.shape = (bands, rows)

    def __call__(self, values: np.ndarray) -> np.ndarray:
        minima = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(values), 2048):  # parts that stay in the cache
            part = values[k : k + 2048]
            work = np.empty_like(part)
            for i in range(len(self.a)):
                np.multiply(part, self.a[i], out=work)
                work += self.b[i]
                if (m := work.min()) < minima[i]:
                    minima[i] = m
        minima = minima.reshape(self.shape)
        out = np.arange(1, self.shape[0] + 1, dtype=np.uint64) * _M1
        for k in range(self.shape[1]):
            out = _mixed(out * _M3 + minima[:, k])
        return out


def _signed(docs: DataFrame, words: int, bands: int) -> DataFrame:
    """doc_id, n_shingles, set_key and band keys of each row."""
    schema = T.StructType(
        [
            T.StructField("doc_id", docs.schema["doc_id"].dataType),
            T.StructField("n_shingles", T.LongType()),
            T.StructField("set_key", T.BinaryType()),
            T.StructField("bands", T.ArrayType(T.LongType())),
        ]
    )

    def run(batches):
        hashes, sign, known = per_worker(("word_hashes",), _WordHashes), Signer(bands), {}
        for batch in slices(batches):
            sizes, keys, signatures = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, words, hashes)
                key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
                if key is not None and key not in known:
                    if len(known) > CACHE_SETS:
                        known.clear()
                    known[key] = sign(s).view(np.int64)
                sizes.append(len(s))
                keys.append(key)
                signatures.append(known.get(key))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(signatures, pa.list_(pa.int64()))], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """set_key and shingle hashes of each row."""

    def run(batches):
        hashes = per_worker(("word_hashes",), _WordHashes)
        for batch in slices(batches):
            raw = [shingles(t, words, hashes).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x) for x in raw], pa.binary()), pa.array(raw, pa.binary())], names=["set_key", "shingles"])

    return docs.select("text").mapInArrow(run, "set_key binary, shingles binary")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches):
        for batch in slices(batches):
            keep = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = np.sort(np.concatenate([a, b]))
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(both) - common))
            found = batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))
            if found.num_rows:
                yield found

    joined = sets.select(F.col("set_key").alias("v"), F.col("shingles").alias("b")).join(pairs, "v")
    joined = joined.join(sets.select(F.col("set_key").alias("u"), F.col("shingles").alias("a")), "u")
    return joined.select("u", "v", "a", "b").mapInArrow(run, "u binary, v binary")


def _prefix_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of ``members(set_key, component)`` of different components that may be similar enough.

    Exact: with the shingles of every set ordered by rarity, similar sets share one among
    their first (1 - t) of all, and where they first meet, enough must be left of both for
    the overlap that the threshold asks. Shingles of a single set lead nowhere. Most
    members that share a shingle are of one component there and are not paired.
    """

    def run(batches):
        for batch in slices(batches):
            for m, component, raw in zip(*(batch.column(c).to_pylist() for c in ("set_key", "component", "shingles"))):
                s = np.frombuffer(raw, np.int64)
                n = len(s)
                yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.binary()), pa.array([component] * n, pa.binary()), pa.array(np.full(n, n)), pa.array(s)], names=["x", "component", "size", "token"])

    rows = members.join(sets, "set_key").select("set_key", "component", "shingles").mapInArrow(run, "x binary, component binary, size long, token long")
    rows = staged(rows, "tokens")
    often = staged(rows.groupBy("token").agg(F.count("*").alias("df")), "often")
    rows = rows.join(often, "token").withColumn("at", F.row_number().over(Window.partitionBy("x").orderBy("df", "token")) - 1)
    rows = staged(rows.where((F.col("df") > 1) & (F.col("at") < F.col("size") - F.ceil(F.col("size") * percent / 100) + 1)), "prefixes")
    by_token = rows.groupBy("token", "component").agg(F.count("*").alias("n")).groupBy("token").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count("*").alias("k"))
    by_token = staged(by_token.where("k > 1").select("token", "main"), "by_token")
    rows = staged(rows.join(by_token, "token"), "mixed")
    few = rows.where("component != main").select("token", F.col("x").alias("y"), F.col("component").alias("of"), F.col("size").alias("size_y"), F.col("at").alias("at_y"))
    overlap = F.least(F.col("size") - F.col("at"), F.col("size_y") - F.col("at_y"))
    near = (100 + percent) * overlap >= percent * (F.col("size") + F.col("size_y"))
    return rows.join(few, "token").where((F.col("component") != F.col("of")) & near).select("x", "y")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """Components of rows of ``docs(doc_id, text)`` linked by 100 * common >= percent * union.

    One row per row of ``docs``: doc_id, n_shingles, component_id (least doc_id of its
    component), kept (doc_id = component_id).

    Rows with the same shingle set are one class from the start. Classes that share a
    band key are candidates: in each bucket all members are held against one centre, and
    links are confirmed on full sets. Buckets whose members ended up in one component are
    finished, since further links in them change nothing; the rest gets another centre.
    In what is left then every pair of different components is tested that an exact prefix
    filter does not rule out. So no link that matters is lost, and groups of copies cost
    tests in proportion to their size.

    Null and empty texts have an empty set and link with nothing. A null doc_id takes
    part by its text: its component_id is the least id among the others, or null, and it
    is kept if that is null. Repeated rows share one component and are all kept if it is
    theirs. Other columns are ignored; an empty table gives no rows.
    """
    with scratch() as keep:
        rows, labels = _labelled(docs, words, percent)
        keep(rows), keep(labels)
    out = rows.join(labels, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _labelled(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Staged: doc_id, n_shingles and set_key of each row, and component_id by set_key."""
    signed = staged(_signed(docs, words, band_count(percent / 100)), "signed")
    rows = staged(signed.select("doc_id", "n_shingles", "set_key"), "rows")
    classes = staged(signed.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "classes")
    drop(signed)
    every = staged(classes.select("set_key", F.posexplode("bands").alias("band", "h")).select("set_key", F.xxhash64("band", "h").alias("bucket")), "members")
    reps = staged(classes.select("set_key", "rep"), "reps")
    drop(classes)
    shared = staged(every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    members = weighed = staged(every.join(shared, "bucket"), "shared_members")
    drop(every, shared)

    # Written first, so that the texts are moved only if their ids are too many to be sent to all.
    wanted = staged(members.select("set_key").distinct().join(reps, "set_key").select("rep").distinct(), "wanted")
    texts = docs.select("doc_id", "text").join(sendable(wanted), F.col("doc_id").eqNullSafe(F.col("rep")), "left_semi").select("text")
    sets = staged(_sets(texts, words).dropDuplicates(["set_key"]), "sets")
    drop(wanted)

    def tested(pairs: DataFrame) -> DataFrame:
        pairs = staged(pairs.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "pairs")
        found = staged(_verified(sendable(pairs), sets, percent), "verified")
        drop(pairs)
        return found

    def joined(links: DataFrame) -> DataFrame:
        """Components of the links found so far; the tables of the rounds go."""
        with scratch() as keep:
            return keep(staged(components(links), "components"))

    # A bucket's centre is its member with most company: buckets of one group mostly share it, and so their tests.
    weights = members.groupBy("set_key").agg(F.sum("n").alias("weight"))
    centres = staged(members.join(weights, "set_key").groupBy("bucket").agg(F.max_by("set_key", F.struct("weight", "set_key")).alias("y")), "centres")
    links = tested(members.join(centres, "bucket").where("set_key != y").select(F.col("set_key").alias("x"), "y"))
    members = members.select("bucket", "set_key")
    found, before = joined(links), weighed
    for k in range(STAR_ROUNDS):
        named = members.join(found.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
        split = named.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("n"), F.min_by(F.struct("set_key", "component"), F.xxhash64("set_key", F.lit(k))).alias("c"))
        split = staged(split.where("lo != hi").select("bucket", "n", F.col("c.set_key").alias("y"), F.col("c.component").alias("of")), "split")
        if split.isEmpty():
            break
        named = staged(named.join(split, "bucket"), "open")
        drop(before, split)
        members, before = named.select("bucket", "set_key"), named
        if k < STAR_ROUNDS - 1:
            # Another centre: the member that is least by a hash of the round.
            pairs = named.where("component != of").select(F.col("set_key").alias("x"), "y")
        else:
            named = named.select("bucket", "set_key", "component", "n")
            small = named.where(F.col("n") <= SMALL_BUCKET)
            other = small.select("bucket", F.col("set_key").alias("y"), F.col("component").alias("of"))
            pairs = small.join(other, "bucket").where("component < of").select(F.col("set_key").alias("x"), "y")
            large = named.where(F.col("n") > SMALL_BUCKET).select("set_key", "component").distinct()
            pairs = pairs.union(_prefix_pairs(large, sets, percent))
        links = links.union(tested(pairs))
        drop(found)
        found = joined(links)

    named = reps.join(found.select(F.col("node").alias("set_key"), "component"), "set_key", "left").withColumn("component", F.coalesce("component", "set_key"))
    least = staged(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    return rows, staged(named.join(least, "component").select("set_key", "component_id"), "labels")


def oracle(words: int, percent: int) -> str:
    """The same components in DuckDB, over all pairs of documents that share a shingle; doc_id is unique there."""
    shingle = " || ' ' || ".join(f"w[i + {k}]" for k in range(words))
    return f"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \\x09-\\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {words} THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - {words} + 2), lambda i: {shingle}) END) AS s
  FROM split
), sizes AS (
  SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= {percent} * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id, doc_id AS root FROM documents UNION SELECT b.y, r.root FROM reach r JOIN both_ways b ON b.x = r.doc_id
), least AS (
  SELECT doc_id, min(root) AS component_id FROM reach GROUP BY doc_id
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM documents JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
