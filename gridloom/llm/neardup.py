"""Near-duplicate documents by circulant MinHash.

A document is the set of its distinct shingles of ``words`` words.  One random
permutation maps shingles to places of a ring, a second one gives every place a
value; coordinate k of the signature is the smallest value over the document's
places shifted k steps around the ring.  Each coordinate stands for the shingle
that gave it (its full hash), bands of coordinates make buckets, and documents
that share a bucket are linked if the exact Jaccard similarity of their full
sets reaches the threshold.

Documents with equal sets are one class, compared once.  In each bucket the
class that meets most others is compared with all others.  What these links leave
in different components is compared pair by pair, but only where a link is still
possible: two sets have no more in common than either has shingles that occur in
other components at all, and a copy with many changes has few of these.  So the
work follows the links that are open, not the size of a group of copies.

Defined results: words are runs of bytes other than ASCII white space, A-Z
lower-cased; a text with fewer words than a shingle is one shingle; a null or
wordless text has an empty set and is linked with nothing; a component is named
by the smallest id in it (null if it has none); rows with equal ids are judged
one by one and are all kept if that id names their component; an empty table
gives an empty result; a kept column named as a result column gives way to it.

A pair at the threshold is missed if no band agrees: (1 - 0.85 ** 4) ** 20, less
than one in two million.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, held, map_texts, row_key, small, task, text_blocks
from .graph import components


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    #: Two sets are linked if percent * union <= 100 * intersection.
    percent: int = 85
    bands: int = 20
    rows: int = 4
    #: Places of the ring, as a power of two.
    ring_bits: int = 20
    seed: int = 20_251
    #: Keys or buckets up to this many are broadcast; more are joined by shuffle.
    broadcast_keys: int = 500_000
    #: Members of a bucket that one task compares with all others of it.
    share: int = 256


_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of a 64-bit hash: a permutation of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(words: list[bytes]) -> np.ndarray:
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_set(text: bytes | None, size: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(words))
    with np.errstate(over="ignore"):
        total = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            total = mix(total + h[i : len(h) - n + 1 + i] * _MULTIPLIERS[i % 5] + np.uint64(i))
    return np.unique(total)


class Circulant:
    """Signatures of sorted shingle hashes."""

    def __init__(self, p: MinHash):
        self.p, self.k = p, p.bands * p.rows
        ring = np.random.default_rng(p.seed).permutation(1 << p.ring_bits).astype(np.uint32)
        self.place_of = np.empty(1 << p.ring_bits, np.uint32)
        self.place_of[ring] = np.arange(1 << p.ring_bits, dtype=np.uint32)
        # The ring is opened and its start repeated, so that all shifts of a place lie side by side.
        self.values = np.lib.stride_tricks.sliding_window_view(np.concatenate([ring, ring[: self.k]]), self.k)
        self.shift = np.uint64(64 - p.ring_bits)
        self.steps = np.arange(self.k, dtype=np.int64)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """For each shift the shingle with the smallest value (of several in one place the smallest hash)."""
        places = (shingles >> self.shift).astype(np.int64)
        least = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for i in range(0, len(places), 2048):
            np.minimum(least, self.values[places[i : i + 2048]].min(axis=0), out=least)
        back = (self.place_of[least].astype(np.int64) - self.steps) % (1 << self.p.ring_bits)
        return shingles[np.searchsorted(places, back)]

    def bands(self, shingles: np.ndarray) -> np.ndarray:
        s = self.signature(shingles).reshape(self.p.bands, self.p.rows)
        with np.errstate(over="ignore"):
            out = np.arange(1, self.p.bands + 1, dtype=np.uint64)
            for i in range(self.p.rows):
                out = mix(out * _MULTIPLIERS[0] + s[:, i])
        return out.view(np.int64)


@held
def circulant(p: MinHash) -> Circulant:
    return Circulant(p)


def signatures(docs: DataFrame, text: str, keep: list[str], p: MinHash) -> DataFrame:
    """``keep`` columns with n_shingles, the set's digest and its bands (null for an empty set)."""

    def work():
        c = circulant(p)

        def f(texts):
            sizes, digests, bands = [], [], []
            for t in texts:
                s = shingle_set(t, p.words)
                sizes.append(len(s))
                digests.append(blake2b(s, digest_size=16).digest() if len(s) else None)
                bands.append(c.bands(s) if len(s) else None)
            return [sizes, digests, bands]

        return f

    return map_texts(docs, text, keep, [("n_shingles", "long"), ("digest", "binary"), ("bands", "array<long>")], work)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


def verified(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """The pairs (a, b) of digests whose sets are similar; ``texts`` has one text for each digest."""
    with_a = pairs.join(texts.select(F.col("digest").alias("a"), F.col("text").alias("ta")), "a")
    both = with_a.join(texts.select(F.col("digest").alias("b"), F.col("text").alias("tb")), "b").select("a", "ta", "b", F.col("tb").alias("__text"))
    size, percent = p.words, p.percent
    out = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None
        for batch in batches:
            for part, tb in text_blocks(batch, "__text"):
                a, b, ta = part.column("a").to_pylist(), part.column("b").to_pylist(), part.column("ta")
                yes = []
                for i, name in enumerate(a):
                    if name != last:
                        last, kept = name, shingle_set(ta[i].as_py().encode(), size)
                    if _similar(kept, shingle_set(tb[i], size), percent):
                        yes.append(i)
                yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in yes], pa.binary()), pa.array([b[i] for i in yes], pa.binary())], names=["a", "b"])

    return both.mapInArrow(task(run), out)


def close_sizes(x: str, y: str, p: MinHash):
    """Sizes that allow the similarity."""
    return 100 * F.least(x, y) >= p.percent * F.greatest(x, y)


def common_counts(rest: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """(digest, c): how many of each class's shingles are also in a class of another component of ``rest`` (digest, component).

    No class of another component has more of its shingles than these.
    """

    def work():
        return lambda batch: [[shingle_set(t, p.words).view(np.int64) for t in batch]]

    sets = map_texts(rest.join(texts, "digest"), "text", ["digest", "component"], [("shingles", "array<long>")], work)
    rows = sets.select("digest", "component", F.explode("shingles").alias("shingle"))
    common = rows.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("shingle")
    return rows.join(common, "shingle").groupBy("digest").agg(F.count(F.lit(1)).alias("c"))


def texts_of(docs: DataFrame, text: str, keys: DataFrame, p: MinHash) -> DataFrame:
    """(digest, text): one text for each row of ``keys`` (digest, key)."""
    few = small(keys, p.broadcast_keys)
    found = docs.select(docs["key"], F.col(f"`{text}`").alias("text")).join(F.broadcast(keys) if few else keys, "key")
    return found.select("digest", "text").dropDuplicates(["digest"])


def _mixed(members: DataFrame, linked: DataFrame, p: MinHash, scratch: Scratch) -> DataFrame:
    """Members (digest, bucket, ...) with their component, of the buckets that hold several components."""
    named = members.join(linked.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    mixed = scratch.keep(named.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("bucket"))
    return named.join(F.broadcast(mixed) if small(mixed, p.broadcast_keys) else mixed, "bucket")


def _dealt(left: DataFrame, right: DataFrame, p: MinHash) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part``: the left members of a large bucket are dealt to parts, each of which has all right ones."""
    parts = right.groupBy("bucket").agg(F.ceil(F.count(F.lit(1)) / p.share).cast("int").alias("parts")).where("parts > 1")
    few = small(parts, p.broadcast_keys)
    parts = F.broadcast(parts) if few else parts
    of = F.pmod(F.xxhash64("digest_a"), F.coalesce("parts", F.lit(1))).cast("int")
    left = left.join(parts, "bucket", "left").withColumn("part", of).drop("parts")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    return left, right.join(parts, "bucket", "left").withColumn("part", every).drop("parts")


def _open(left: DataFrame, rest: DataFrame, p: MinHash, once: bool = False) -> DataFrame:
    """Pairs (a, b) of a bucket in different components that may still be similar; with ``once``, a < b from their first shared bucket."""
    right = rest.select("bucket", *[F.col(c).alias(f"{c}_b") for c in ("digest", "component", "n", "c", *["bands"] * once)])
    most = F.least("c_a", "c_b")
    near = (F.col("component_a") != F.col("component_b")) & (100 * most >= p.percent * (F.col("n_a") + F.col("n_b") - most))
    if once:
        near = (F.col("digest_a") < F.col("digest_b")) & near & (F.array_intersect("bands_a", "bands_b")[0] == F.col("bucket"))
    if once:
        left, right = _dealt(left, right, p)
        return left.join(right, ["bucket", "part"]).where(near).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))
    return left.join(right, "bucket").where(near).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"))


def _linked(links: DataFrame, linked: DataFrame, pairs: DataFrame, texts: DataFrame, p: MinHash, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links and components with those of the pairs that are similar."""
    pairs = scratch.keep(pairs.distinct())
    if pairs.isEmpty():
        return links, linked
    links = scratch.keep(links.unionByName(verified(pairs, texts, p)))
    return links, components(links, scratch)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """One row for each document: key, doc_id, n_shingles, component_id and kept."""
    scratch = Scratch(docs.sparkSession, "neardup")
    named = docs.select(F.col(f"`{doc_id}`").alias("id"), row_key(doc_id, text).alias("key"), F.col(f"`{text}`").alias("text"))
    signed = scratch.keep(signatures(named, "text", ["id", "key"], p))
    classes = scratch.keep(
        signed.where(F.col("digest").isNotNull())
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.min("key").alias("key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    )
    members = classes.select("digest", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    shared = scratch.keep(members.join(sizes, "bucket"))
    # A bucket is led by its class that meets most others in all of its buckets: the middle of a group of copies.
    weights = shared.groupBy("digest").agg(F.sum("m").alias("weight"))
    leads = shared.join(weights, "digest").groupBy("bucket").agg(F.max(F.struct("weight", "digest", "n")).alias("lead"))
    shared = scratch.keep(shared.join(leads.select("bucket", F.col("lead.digest").alias("lead"), F.col("lead.n").alias("lead_n")), "bucket"))
    texts = scratch.keep(texts_of(named, "text", classes.join(shared.select("digest").distinct(), "digest").select("digest", "key"), p))
    # First the leading class of each bucket against all others of it.
    stars = scratch.keep(shared.where((F.col("digest") != F.col("lead")) & close_sizes("n", "lead_n", p)).select(F.col("lead").alias("a"), F.col("digest").alias("b")).distinct())
    links = scratch.keep(verified(stars, texts, p))
    linked = components(links, scratch)
    # What is left in other components of the same bucket, where the shingles they have in common allow a link.
    rest = scratch.keep(_mixed(shared.where("digest <> lead").select("digest", "n", "bucket"), linked, p, scratch))
    able = common_counts(rest.select("digest", "component").distinct(), texts, p)
    rest = scratch.keep(rest.join(able, "digest").where(100 * F.col("c") >= p.percent * F.col("n")))
    # Again one class against all others of a bucket, now the one with the smallest share of shingles of its own.
    middles = rest.groupBy("bucket").agg(F.max(F.struct((F.col("c") / F.col("n")).alias("share"), "digest", "component", "n", "c")).alias("m"))
    middles = scratch.keep(middles.select("bucket", *[F.col(f"m.{c}").alias(f"{c}_a") for c in ("digest", "component", "n", "c")]))
    # One class for each bucket: rows of a large bucket stay where they are.
    middles = F.broadcast(middles) if small(middles, p.broadcast_keys, F.lit(128)) else middles
    links, linked = _linked(links, linked, _open(middles, rest, p).select("a", "b"), texts, p, scratch)
    # And what is still open, pair by pair; common shingles only get fewer as components grow.
    rest = scratch.keep(_mixed(rest.drop("component"), linked, p, scratch))
    # Each pair comes from the first bucket that both share: there either one led, and they were compared, or both are here.
    rest = rest.join(classes.select("digest", "bands"), "digest")
    left = rest.select("bucket", *[F.col(c).alias(f"{c}_a") for c in ("digest", "component", "n", "c", "bands")])
    links, linked = _linked(links, linked, _open(left, rest, p, once=True), texts, p, scratch)
    whole = classes.select("digest", "rep").join(linked.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    names = whole.groupBy("component").agg(F.min("rep").alias("component_id"))
    verdicts = scratch.keep(whole.join(names, "component").select("digest", "component_id"))
    scratch.only(signed, verdicts)
    own = signed.select("id", "key", "n_shingles", "digest").join(verdicts, "digest", "left")
    own = own.withColumn("component_id", F.when(F.col("digest").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return own.select("key", F.col("id").alias(doc_id), "n_shingles", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: MinHash = MinHash()) -> DataFrame:
    """One document of each group, with all its columns; of rows with equal ids and texts one stays."""
    judged = near_duplicates(docs, doc_id, text, p).select(F.col("key").alias("__key"), "kept")

    def keyed(keys: DataFrame, how: str) -> DataFrame:
        few = small(keys, p.broadcast_keys)
        return docs.join(F.broadcast(keys) if few else keys, row_key(doc_id, text) == F.col("__key"), how)

    gone = judged.where("not kept").select("__key").distinct()
    again = judged.where("kept").groupBy("__key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("__key")
    if again.isEmpty():
        return keyed(gone, "left_anti")
    once = keyed(again, "inner").dropDuplicates(["__key"]).drop("__key")
    return keyed(gone.unionByName(again), "left_anti").unionByName(once)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("key")
