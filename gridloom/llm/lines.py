"""Line deduplication by a deletion-neighbourhood join.

A line is its sequence of words (A-Z lower-cased).  Two lines repeat each other
if they have the same words or, from ``fuzzy_words`` words on, if one inserted,
deleted or replaced word makes them equal; below five words one edit is more than
a fifth of a line, so these must be equal.  A line is removed if an earlier one
(by id, text hash and line number) repeats it, whether that one is removed or
not; so the result doesn't depend on any order of work.

Each distinct line emits every variant with one word deleted as a hashed key.
Equal variants with the same place deleted are one replacement apart; a variant
that equals a whole line is one insertion apart.  So the earliest line of each key
decides for all others, pairs are never listed, and one earliest partner of each
line is verified by its edit distance.  Before that, lines that share neither
the first nor the last half of their words with another one, as any two within
the bound do, are left out.

Defined results: a null text has no lines and stays null; lines with fewer than
``min_words`` words always stay; rows with equal ids and texts count as one
document and keep the same lines; an empty table gives an empty result; a column
named as a result column gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, small, task, text_blocks


@dataclass(frozen=True)
class Lines:
    min_words: int = 1
    fuzzy_words: int = 5
    #: Documents with lines to look up or remove are broadcast up to this many, else joined by shuffle.
    broadcast_documents: int = 300_000


def _key(label: bytes, words: list[bytes]) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(label + b" ".join(words)) - (1 << 63)


def half_keys(words: list[bytes], least: int) -> list[int]:
    """Keys of the halves of a line, as of a line of its own length and as of one with a word less.

    Two lines one word apart share a key at the same place or the one two further on.
    """
    out = []
    for m in (len(words), len(words) - 1):
        if m >= least:
            h = m // 2
            out += [_key(b"L%d " % m, words[:h]), _key(b"R%d " % m, words[len(words) - (m - h) :])]
    return out


def within_one(a: list[bytes], b: list[bytes]) -> bool:
    """Whether the edit distance of two word sequences is 1 at most."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :] or a == b


def occurrences(docs: DataFrame, p: Lines) -> DataFrame:
    """(id, k, no, line, halves) of every line with enough words; docs has id, k and text."""
    out = T.StructType.fromDDL("id long, k long, no int, line binary, halves array<long>")
    out = T.StructType([docs.schema["id"], *out.fields[1:]])
    least, fuzzy = p.min_words, p.fuzzy_words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                rows, numbers, names, halves = [], [], [], []
                for i, t in enumerate(texts):
                    for no, line in enumerate(t.lower().split(b"\n")) if t else ():
                        words = line.split()
                        if len(words) >= least:
                            rows.append(i)
                            numbers.append(no)
                            names.append(xxhash.xxh3_128_digest(b" ".join(words)))
                            halves.append(half_keys(words, fuzzy))
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(at), part.column("k").take(at), pa.array(numbers, pa.int32()), pa.array(names, pa.binary()), pa.array(halves, pa.list_(pa.int64()))],
                    names=["id", "k", "no", "line", "halves"],
                )

    return docs.mapInArrow(task(run), out)


def _looked_up(docs: DataFrame, wanted: DataFrame, p: Lines, how: str) -> DataFrame:
    """docs joined with ``wanted`` (id, k and more), by broadcast where it is counted to be small."""
    few = small(wanted, p.broadcast_documents, 64 + 24 * F.size(wanted.columns[-1]))
    wanted = wanted.withColumnsRenamed({"id": "__id", "k": "__k"})
    return docs.join(F.broadcast(wanted) if few else wanted, docs["id"].eqNullSafe(F.col("__id")) & (docs["k"] == F.col("__k")), how).drop("__id", "__k")


def _variants(texts: DataFrame) -> DataFrame:
    """(v, at, rank): hashes of the words without the word at ``at`` (-1: of all words), where the shared halves allow it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for part, lines in text_blocks(batch, "words"):
                v, at, rank = [], [], []
                for line, r, left, right in zip(lines, part.column("rank").to_pylist(), part.column("left").to_pylist(), part.column("right").to_pylist()):
                    words = line.split(b" ")
                    n = len(words)
                    v.append(digest(line))
                    at.append(-1)
                    rank.append(r)
                    # With the first half shared, the differing word is in the second one, and the other way round.
                    places = range(0 if right else (n - 1) // 2, n if left else n // 2 + 1)
                    for i in places:
                        v.append(digest(b" ".join(words[:i] + words[i + 1 :])))
                        at.append(i)
                        rank.append(r)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(v, np.uint64).view(np.int64)), pa.array(at, pa.int32()), pa.array(rank, pa.int64())], names=["v", "at", "rank"])

    return texts.select("rank", "words", "left", "right").mapInArrow(task(run), "v long, at int, rank long")


def _line_texts(docs: DataFrame) -> DataFrame:
    """(rank, words, left, right) of the wanted lines of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                cols: list[list] = [[], [], [], []]
                for t, wanted in zip(texts, part.column("wanted").to_pylist()):
                    lines = t.lower().split(b"\n")
                    for x in wanted:
                        for c, y in zip(cols, (x["rank"], b" ".join(lines[x["no"]].split()), x["left"], x["right"])):
                            c.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.bool_(), pa.bool_()))], names=["rank", "words", "left", "right"])

    return docs.select("text", "wanted").mapInArrow(task(run), "rank long, words binary, left boolean, right boolean")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The ranks whose line is within the bound of its partner's."""
    both = pairs.join(texts.select("rank", "words"), "rank").join(texts.select(F.col("rank").alias("partner"), F.col("words").alias("other")), "partner").select("rank", "words", "other")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, lines in text_blocks(batch, "words"):
                near = [r for r, a, b in zip(part.column("rank").to_pylist(), lines, part.column("other").to_pylist()) if within_one(a.split(b" "), b.split(b" "))]
                yield pa.RecordBatch.from_arrays([pa.array(near, pa.int64())], names=["rank"])

    return both.mapInArrow(task(run), "rank long")


def repeated_lines(docs: DataFrame, scratch: Scratch, p: Lines = Lines()) -> DataFrame:
    """(id, k, gone): the numbers of the lines to remove from each document; docs has id, k and text."""
    found = scratch.keep(occurrences(docs, p))
    position = F.struct("id", "k", "no")
    lines = scratch.keep(found.groupBy("line").agg(F.min(position).alias("first"), F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves")))
    # Halves at places 0 and 2 are first halves, at 1 and 3 last halves.
    halves = lines.where(F.size("halves") > 0).select("line", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.min("line").alias("x"), F.max("line").alias("y")).where("x <> y").select("half")
    sides = halves.join(shared, "half").groupBy("line").agg(F.max(F.col("side") % 2 == 0).alias("left"), F.max(F.col("side") % 2 == 1).alias("right"))
    near = lines.select("line", "first").join(sides, "line")
    # Sorted by position, so that ranks are in the order of positions.
    near = scratch.keep(near.orderBy("first").withColumn("rank", F.monotonically_increasing_id()))
    wanted = near.groupBy(F.col("first.id").alias("id"), F.col("first.k").alias("k")).agg(F.collect_list(F.struct(F.col("first.no").alias("no"), "rank", "left", "right")).alias("wanted"))
    texts = scratch.keep(_line_texts(_looked_up(docs, wanted, p, "inner")).dropDuplicates(["rank"]))
    variants = scratch.keep(_variants(texts))
    common = variants.groupBy("v").agg(F.min("rank").alias("x"), F.max("rank").alias("y")).where("x <> y").select("v")
    variants_shared = scratch.keep(variants.join(common, "v"))
    cut, whole = variants_shared.where("at >= 0"), variants_shared.where("at < 0")
    replaced = cut.join(cut.groupBy("v", "at").agg(F.min("rank").alias("partner")), ["v", "at"])
    inserted = cut.join(whole.groupBy("v").agg(F.min("rank").alias("partner")), "v")
    deleted = whole.join(cut.groupBy("v").agg(F.min("rank").alias("partner")), "v")
    pairs = replaced.select("rank", "partner").unionByName(inserted.select("rank", "partner")).unionByName(deleted.select("rank", "partner"))
    pairs = pairs.where("partner < rank").groupBy("rank").agg(F.min("partner").alias("partner"))
    repeats = scratch.keep(near.join(_verified(pairs, texts), "rank").select("line", F.lit(True).alias("near")))
    judged = lines.select("line", "first", "times").join(repeats, "line", "left").where("times > 1 or near")
    gone = found.select("id", "k", "no", "line").join(judged, "line").where(F.col("near") | ~position.eqNullSafe(F.col("first")))
    gone = scratch.keep(gone.groupBy("id", "k").agg(F.collect_set("no").alias("gone")))
    scratch.only(gone)
    return gone


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", p: Lines = Lines()) -> DataFrame:
    """All columns with the text cut down to its first lines, and n_lines and n_removed."""
    scratch = Scratch(docs.sparkSession, "lines")
    narrow = docs.select(F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("k"), F.col(f"`{text}`").alias("text"))
    gone = repeated_lines(narrow, scratch, p)
    rest = [c for c in docs.columns if c.lower() not in {"n_lines", "n_removed"}]
    wide = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{text}`").alias("k"))
    wide = _looked_up(wide, gone, p, "left")
    lines = F.split(F.col("row")[text], "\n", -1)
    stay = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "gone"), lambda i: F.get(lines, i))
    new = F.when(F.col("gone").isNull(), F.col("row")[text]).otherwise(F.array_join(stay, "\n"))
    return wide.select(
        *[new.alias(c) if c == text else F.col("row")[c].alias(c) for c in rest],
        F.when(F.col("row")[text].isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


SQL = r"""
WITH t AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (
  SELECT doc_id, no, doc_id * 1000000 + no AS pos, len(w) AS n, array_to_string(w, ' ') AS k, w
  FROM (SELECT doc_id, no, regexp_extract_all(translate(ls[no], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS no FROM t)) WHERE len(w) >= 1),
d AS (SELECT k, any_value(n) AS n, any_value(w) AS w, min(pos) AS pos FROM l GROUP BY k),
v AS (
  SELECT k, pos, i, array_to_string(list_concat(w[:i - 1], w[i + 1:]), ' ') AS v
  FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM d WHERE n >= 5)),
near AS (
  SELECT v.k FROM v JOIN (SELECT v, i, min(pos) AS m FROM v GROUP BY v, i) USING (v, i) WHERE m < v.pos
  UNION SELECT v.k FROM v JOIN d f ON v.v = f.k AND f.n >= 5 WHERE f.pos < v.pos
  UNION SELECT f.k FROM d f JOIN v ON v.v = f.k WHERE f.n >= 5 AND v.pos < f.pos),
gone AS (
  SELECT doc_id, no FROM l JOIN d USING (k) WHERE l.pos > d.pos OR k IN (SELECT k FROM near)),
g AS (SELECT doc_id, count(*) AS n_removed, list(no) AS nos FROM gone GROUP BY doc_id),
c AS (
  SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
         CASE WHEN ls IS NULL THEN NULL ELSE array_to_string([ls[i] FOR i IN range(1, len(ls) + 1) IF nos IS NULL OR NOT list_contains(nos, i)], chr(10)) END AS s
  FROM t LEFT JOIN g USING (doc_id))
SELECT doc_id, n_lines, n_removed, length(s)::BIGINT AS n_chars, md5(s) AS text_md5 FROM c
"""
