"""Benchmark decontamination by winnowing, in DataFrame functions only.

Training and test texts are cut into words; each keeps the smallest hash of
``gram`` words in every sliding window, so any shared span of ``window`` words
shares a fingerprint.  Fingerprints are joined, each match is extended word by
word on both sides, and a run as long as a window (or as a whole shorter item)
marks its words as hit.  Items shorter than a window share no fingerprint for sure
and are looked up by all grams of their own length; no item changes the width of
the windows.

Hashes are taken over texts lower-cased by Unicode rules, which only merges more
candidates; the words compared in extension are lower-cased in A-Z alone.

Defined results: a null or empty text has no words and no hits; repeated rows
each get their row; items without words match nothing and items with a null id
mark words but are not listed; empty tables give no hits or no rows; other input
columns don't matter.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key, small

#: Fixed value: what lies between words (A-Z, here still in their case, belong to words).
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Winnowing:
    window: int = 10
    gram: int = 5
    #: Item fingerprints up to this many are broadcast; more are joined by shuffle.
    broadcast_fingerprints: int = 100_000
    #: Contaminated documents up to this many are broadcast when they are removed.
    broadcast_keys: int = 500_000


#: Bits of a hash by which fingerprints that no item has are left out early.
_BITS = 17


def _slot(hash_: Column) -> Column:
    return hash_.bitwiseAND(F.lit((1 << _BITS) - 1).cast("long")).cast("int")


def _let(value: Column, body) -> Column:
    """``body`` with ``value`` bound once, so that it is computed once for each row."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _BETWEEN), "")


def _az_lower(word: Column) -> Column:
    return F.translate(word, string.ascii_uppercase, string.ascii_lowercase)


def _grams(hashes: Column, size: int) -> Column:
    """Hashes of all runs of ``size`` words, from the hashes of the words."""
    n = F.size(hashes) - size + 1
    grams = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(size)]))
    return F.when(n > 0, grams).otherwise(F.array().cast("array<bigint>"))


def _sliding(values: Column, width: int, better, body) -> Column:
    """``body`` of the best (least or greatest) of every ``width`` neighbouring values, by doubling; a window cut off by the end has the best of what it has."""

    def wider(best: Column, size: int) -> Column:
        step = min(size, width - size)
        if not step:
            return body(best)
        return _let(F.zip_with(best, F.slice(best, step + 1, 1 << 30), better), lambda b: wider(b, size + step))

    return wider(values, 1)


def fingerprints(words: Column, gram: int, width: int, short: list[int]) -> Column:
    """array<struct<pos, len, kind, hash>>: the winnowed grams (of kind 0), and all grams of the short lengths (their kind)."""

    def entry(i: Column, size: int, h: Column, kind: int) -> Column:
        return F.struct(i.alias("pos"), F.lit(size).alias("len"), F.lit(kind).alias("kind"), h.alias("hash"))

    none = F.array().cast("array<struct<pos:int,len:int,kind:int,hash:bigint>>")

    def winnowed(g: Column) -> Column:
        windows = F.size(g) - width + 1
        edge = F.array_repeat(F.lit(-(1 << 63)).cast("long"), width - 1)

        def selected(greatest: Column) -> Column:
            at = F.filter(F.sequence(F.lit(0), F.size(g) - 1), lambda i: F.get(g, i) == F.get(greatest, i))
            return F.transform(at, lambda i: entry(i, gram, F.get(g, i), 0))

        def by_window(least: Column) -> Column:
            # A gram is kept if it is the smallest of some window, so if the largest of its windows' minima is its hash.
            return _let(F.concat(edge, F.slice(least, 1, windows), edge), lambda m: _sliding(m, width, lambda a, b: F.greatest(a, b), selected))

        return F.when(windows > 0, _sliding(g, width, lambda a, b: F.least(a, b), by_window)).otherwise(none)

    def every(size: int):
        return lambda g: F.transform(g, lambda h, i: entry(i, size, F.xxhash64(h, F.lit(size)), size))

    def both(hashes: Column) -> Column:
        out = [_let(_grams(hashes, gram), winnowed)]
        out += [_let(_grams(hashes, n), every(n)) for n in short]
        return F.concat(*out) if len(out) > 1 else out[0]

    return _let(F.transform(words, lambda w: F.xxhash64(F.lower(w))), both)


def contamination(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", item_id="item_id", item_text="text", params: Winnowing = Winnowing()) -> DataFrame:
    """One row for each document: key, doc_id, n_words, n_hit, n_items, items (sorted strings) and contaminated."""
    window, gram = params.window, params.gram
    items = bench.select(F.col(f"`{item_id}`").cast("string").alias("item"), words_of(F.col(f"`{item_text}`")).alias("iw")).withColumn("n", F.size("iw")).where("n > 0")
    # Only which of the lengths below a window occur: a bounded list.
    lengths = sorted(r.n for r in items.where(F.col("n") < window).select("n").distinct().collect())
    short = [n for n in lengths if n < window]
    width, reach = window - gram + 1, window - gram
    spread = range(-reach, window)
    side = items.select("item", "iw", F.least("n", F.lit(window)).alias("need"), "n", F.explode(fingerprints(F.col("iw"), gram, width, short)).alias("f"))
    side = side.where((F.col("f.len") == F.col("n")) | ((F.col("f.kind") == 0) & (F.col("n") >= window))).select(
        F.col("f.hash").alias("hash"), F.col("f.kind").alias("kind"), "item", "need", F.array(*[_az_lower(F.get("iw", F.col("f.pos") + t)) for t in spread]).alias("around")
    )
    few = small(side, params.broadcast_fingerprints, 64 + F.octet_length(F.array_join("around", " ")) + 16 * len(spread))
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), row_key(doc_id, text).alias("key"), words_of(F.col(f"`{text}`")).alias("words"))
    # Every document also sends one row of its own, which matches nothing and carries its number of words.
    none = F.array().cast("array<string>")
    own = F.array(F.struct(F.lit(-1).alias("pos"), F.lit(-1).alias("kind"), F.xxhash64("key").alias("hash"), none.alias("near")))
    marked = fingerprints(F.col("words"), gram, width, short)
    if few:
        # Fingerprints whose hash no item has in its last bits can't meet one in the join.
        held = bytearray(1 << _BITS)
        for r in side.select(_slot(F.col("hash")).alias("slot")).distinct().collect():
            held[r.slot] = 1
        marked = F.filter(marked, lambda f: F.substring(F.lit(bytes(held)), _slot(f["hash"]) + 1, 1) == F.lit(b"\x01"))
    # A fingerprint takes its neighbours along, so that no row carries all words.  Slices start at 1 and end with the text.
    found = F.transform(
        marked,
        lambda f: F.struct(
            f["pos"].alias("pos"),
            f["kind"].alias("kind"),
            f["hash"].alias("hash"),
            F.slice("words", F.greatest(f["pos"] - (reach - 1), F.lit(1)), F.least(f["pos"], F.lit(reach)) + window).alias("near"),
        ),
    )
    rows = rows.select("id", "key", F.size("words").alias("size"), F.explode(F.concat(own, found)).alias("f"))
    rows = rows.select("id", "key", "size", *[F.col(f"f.{c}").alias(c) for c in ("pos", "kind", "hash", "near")])
    near = lambda t: F.when(F.col("pos") + t >= 0, F.get("near", F.least("pos", F.lit(reach)) + t))
    size = F.col("size")
    matched = rows.join(F.broadcast(side) if few else side, ["hash", "kind"], "left").where((F.col("pos") < 0) | F.col("need").isNotNull())
    same = F.concat(*[F.when(_az_lower(near(t)) == F.get("around", F.lit(t + reach)), "1").otherwise("0") for t in spread])
    matched = matched.select("id", "key", "item", "need", "pos", F.when(F.col("pos") < 0, size).alias("size"), F.when(F.col("pos") >= 0, same).alias("same"))
    matched = matched.withColumn("left", F.length(F.regexp_extract(F.substring("same", 1, reach), "1*$", 0))).withColumn("right", F.length(F.regexp_extract(F.substring("same", reach + 1, window), "^1*", 0)))
    hit = (F.col("pos") >= 0) & (F.col("left") + F.col("right") >= F.col("need"))
    run = F.struct((F.col("pos") - F.col("left")).alias("from"), (F.col("pos") + F.col("right")).alias("to"))
    grouped = (
        matched.where((F.col("pos") < 0) | hit)
        .groupBy("key", "id")
        .agg(
            F.max("size").cast("long").alias("n_words"),
            F.sum(F.when(F.col("pos") < 0, 1)).alias("copies"),
            F.collect_set(F.when(hit, run)).alias("runs"),
            F.collect_set(F.when(hit, F.col("item"))).alias("items"),
        )
    )
    # The union of a document's runs, in their order: words beyond the furthest end so far are new.
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    add = lambda acc, r: F.struct(F.greatest(acc["end"], r["to"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), r["to"] - F.greatest(acc["end"], r["from"]))).alias("n"))
    return grouped.select(
        "key",
        F.col("id").alias(doc_id),
        "n_words",
        F.aggregate(F.array_sort("runs"), zero, add)["n"].cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.array_sort("items").alias("items"),
        (F.size("runs") > 0).alias("contaminated"),
        F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
    ).drop("copy")


def remove_contaminated(docs: DataFrame, bench: DataFrame, doc_id="doc_id", text="text", params: Winnowing = Winnowing(), **names) -> DataFrame:
    """The documents without a hit, with all their columns."""
    scratch = Scratch(docs.sparkSession, "decontam")
    bad = scratch.keep(contamination(docs, bench, doc_id, text, params=params, **names).where("contaminated").select(F.col("key").alias("__bad")).distinct())
    few = small(bad, params.broadcast_keys)
    return docs.join(F.broadcast(bad) if few else bad, row_key(doc_id, text) == F.col("__bad"), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    found = contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0))),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
h AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw USING (n, s)),
p AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS o FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
