"""Language-model scores by prediction with partial matching.

Training texts are cut into lower-cased words.  A byte-context trie counts, for
every place in the stream of words, the next byte after the up to ``order`` bytes
before it (contexts run across words, or start at the word's start if
``across_words`` is false).  A byte is coded in the longest context
seen; if that context has not seen it, an escape is coded and the next shorter
context is used without the bytes already excluded; after the empty context come
all bytes alike.  The escape of a context is estimated by its distinct bytes.
Words end in a space, and one further symbol where a word may start ends the
text, so the scores of all texts are a probability distribution.

The trie is whole: every node of the training texts counts.  It is a table, as is
the code length of each node that any text holds, found by joining each context
with its shorter ones by shuffle.  The commonest nodes and words, with a bound on
their number, are broadcast as a cache; all others are joined by shuffle.

Defined results: a null text is an empty one, of the end alone; repeated rows are
scored one by one and train one by one; a null id trains (as the text "null");
an empty table gives an empty result; other input columns don't matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, task, text_blocks

#: The space ends a word; a line feed marks a text's (or a word's) start in contexts and, as a symbol, the end of the text.
SPACE, MARK = 0x20, 0x0A
#: Bytes that words hold, the space and the end.
ALPHABET = 256 - 6 + 2


@dataclass(frozen=True)
class Model:
    #: Bytes of context, 6 at most: a node and its length are one long.
    order: int = 4
    #: Whether contexts hold the end of the word before.
    across_words: bool = True
    #: Nodes and words seen less than once in 2**cache_bits symbols or tokens aren't broadcast, nor are words of more bytes than these.
    cache_bits: int = 20
    cache_word: int = 64
    #: Entries a task counts before it hands them on.
    memo: int = 600_000


#: Bytes of the stream that a task has windows of at once.
PIECE = 1 << 20


def stream(text: bytes | None) -> bytes:
    """A text's words, each with the space that ends it, between a mark and the end."""
    return b"".join([b"\n", *(w + b" " for w in text.lower().split()), b"\n"]) if text else b"\n\n"


def windows(texts: list[bytes | None], order: int, across: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each symbol of the texts' streams its node (its longest context and itself) and its text's number, by pieces.

    A node is a long: a 1, then its bytes.  The shorter contexts' nodes are the ends of these.
    """
    parts = [stream(t) for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
    data = np.frombuffer(b"".join(parts), np.uint8)
    for first in range(0, len(data), PIECE):
        low = max(0, first - order)
        raw = data[low : first + PIECE].astype(np.int64)
        at = np.arange(len(raw))
        here = starts[np.searchsorted(starts, low) : np.searchsorted(starts, low + len(raw))] - low
        begins = np.zeros(len(raw), bool) if across else raw == SPACE
        begins[here] = True
        before = np.where(begins, MARK, raw)
        # Places since the last beginning; none in sight is as far as the order.
        last = np.maximum.accumulate(np.where(begins, at, -order - 1))
        depth = np.minimum(order, at[1:] - last[:-1])
        node = raw[1:].copy()
        for k in range(1, order + 1):
            node[k - 1 :] |= before[: max(0, len(raw) - k)] << 8 * k
        mark = np.int64(1) << 8 * (depth + 1)
        node = node & (mark - 1) | mark
        symbol = np.ones(len(raw), bool)
        symbol[here] = False
        symbol[: first - low] = False
        of = np.searchsorted(starts, at[symbol] + low, "right") - 1
        yield node[symbol[1:]], of


def code_lengths(levels: Iterator[tuple[int, dict[int, int]]], excluded: set[int], wanted: Iterable[int]) -> dict[int, float]:
    """log10 of the probabilities of the wanted symbols; levels are the counts and symbols of a context and its shorter ones, longest first."""
    out, left, p = {}, set(wanted), 0.0
    for total, seen in levels:
        total -= sum(seen[s] for s in excluded if s in seen)
        own = {s: n for s, n in seen.items() if s not in excluded}
        if not own:
            continue
        whole = total + len(own)
        for s in left & own.keys():
            out[s] = p + math.log10(own[s] / whole)
        left -= own.keys()
        if not left:
            return out
        p += math.log10((whole - sum(own.values())) / whole)
        excluded = excluded | own.keys()
    rest = p - math.log10(ALPHABET - len(excluded))
    return out | dict.fromkeys(left, rest)


def impossible(context: bytes) -> set[int]:
    """No word is empty and no text ends inside one."""
    return {SPACE} if context[-1:] in (b"\n", b" ") else {MARK}


class Trie:
    """Scores words one by one. ``contexts`` gives each context's count and those of the bytes kept after it."""

    def __init__(self, contexts: dict[bytes, tuple[int, dict[int, int]]], order: int, memo: int):
        self.contexts, self.order, self.limit = contexts, order, memo
        self.coded: dict[bytes, float] = {}

    def symbol(self, node: bytes) -> float:
        """log10 of the probability of a node's last byte after the context before it."""
        found = self.coded.get(node)
        if found is None:
            if len(self.coded) >= self.limit:
                self.coded.clear()
            context, levels = node[:-1], []
            for i in range(len(node)):
                if context[i:] in self.contexts:
                    levels.append(self.contexts[context[i:]])
            found = self.coded[node] = code_lengths(levels, impossible(context), node[-1:])[node[-1]]
        return found

    def word(self, word: bytes) -> float:
        """log10 of the probability of a word and the space that ends it."""
        s = b"\n" + word + b" "
        return sum(self.symbol(s[max(0, i - self.order) : i + 1]) for i in range(1, len(s)))

    def end(self) -> float:
        return self.symbol(bytes([0x0A, MARK]))


def _counted(df: DataFrame, column: str, limit: int, count) -> DataFrame:
    """(item, n): what ``count(counter, part, values)`` counts in each task, summed."""
    out = T.StructType([T.StructField("item", T.BinaryType()), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def hand_on():
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], names=["item", "n"])
            found.clear()
            return batch

        for batch in batches:
            for part, values in text_blocks(batch, column):
                count(found, part, values)
                if len(found) >= limit:
                    yield hand_on()
        yield hand_on()

    return df.mapInArrow(task(run), out).groupBy("item").agg(F.sum("n").alias("n"))


def _count_words(found: Counter, _, texts: list[bytes | None]) -> None:
    for t in texts:
        if t:
            found.update(t.lower().split())


def _node_counts(rows: DataFrame, order: int, across: bool) -> DataFrame:
    """(node, n, learned): how often all texts and those to learn from hold each longest node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_blocks(batch, "text"):
                learns = np.array([x is True for x in part.column("train").to_pylist()], np.int64)
                for node, of in windows(texts, order, across):
                    both, n = np.unique(node << 1 | learns[of], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(both >> 1), pa.array(n), pa.array(n * (both & 1))], names=["node", "n", "learned"])

    found = rows.select("text", "train").mapInArrow(task(run), "node long, n long, learned long")
    return found.groupBy("node").agg(F.sum("n").alias("n"), F.sum("learned").alias("learned"))


def _size(node: Column) -> Column:
    """Bytes of a node or context."""
    return ((F.length(F.hex(node)) - 1) / 2).cast("int")


def _end(node: Column, size: Column | int) -> Column:
    """The last ``size`` bytes of a node or context."""
    mark = F.call_function("shiftleft", F.lit(1).cast("long"), 8 * size) if isinstance(size, Column) else F.lit(1 << 8 * size).cast("long")
    return node.bitwiseAND(mark - 1).bitwiseOR(mark)


def _bytes(node: int) -> bytes:
    return node.to_bytes((node.bit_length() + 7) // 8, "big")[1:]


def _coded(counts: DataFrame, order: int) -> DataFrame:
    """(node, n, code): log10 of the probability of each node's last byte."""
    learned = counts.where("learned > 0").select("node", "learned", F.explode(F.sequence(F.lit(1), _size(F.col("node")))).alias("__size"))
    nodes = learned.select(_end(F.col("node"), F.col("__size")).alias("node"), "learned").groupBy("node").agg(F.sum("learned").alias("learned"))
    symbol, context = F.col("node").bitwiseAND(F.lit(255).cast("long")), F.shiftright("node", 8)
    contexts = nodes.groupBy(context.alias("context")).agg(F.sum("learned").alias("total"), F.collect_list(F.col("learned") * 256 + symbol).alias("seen"))
    contexts = contexts.withColumn("size", _size(F.col("context")))
    # Contexts of a byte or none, at most 257, are sent to all tasks.
    unpacked = lambda seen: {x & 255: x >> 8 for x in seen}
    short = {r.context: (r.total, unpacked(r.seen)) for r in contexts.where("size < 2").collect()}
    asked = counts.groupBy(context.alias("context")).agg(F.collect_list(F.struct(symbol.alias("symbol"), "n")).alias("asked")).withColumn("size", _size(F.col("context")))
    for k in range(2, order + 1):
        level = contexts.where(F.col("size") == k).select(F.col("context").alias(f"c{k}"), F.struct("total", "seen").alias(f"s{k}"))
        asked = asked.withColumn(f"c{k}", F.when(F.col("size") >= k, _end(F.col("context"), k))).join(level, f"c{k}", "left").drop(f"c{k}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(f"s{k}") for k in range(order, 1, -1)]

            def levels(i: int, context: int) -> Iterator[tuple[int, dict[int, int]]]:
                for c in own:
                    if c[i].is_valid:
                        found = c[i].as_py()
                        yield found["total"], unpacked(found["seen"])
                for c in dict.fromkeys((256 | context & 255 if context > 1 else 1, 1)):
                    if c in short:
                        yield short[c]

            node, times, code = [], [], []
            for i, (context, asked) in enumerate(zip(batch.column("context").to_pylist(), batch.column("asked").to_pylist())):
                found = code_lengths(levels(i, context), impossible(_bytes(context)), [x["symbol"] for x in asked])
                for x in asked:
                    node.append(context << 8 | x["symbol"])
                    times.append(x["n"])
                    code.append(found[x["symbol"]])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(times, pa.int64()), pa.array(code, pa.float64())], names=["node", "n", "code"])

    return asked.select("context", "asked", *[f"s{k}" for k in range(2, order + 1)]).mapInArrow(task(run), "node long, n long, code double")


def score(docs: DataFrame, trains: Column, doc_id: str = "doc_id", text: str = "text", model: Model = Model()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document.

    The model learns from the rows where ``trains`` is true.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ppm")
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text"), trains.alias("train"))
    learned = rows.where("train")
    words = scratch.keep(_counted(learned.select("text"), "text", model.memo, _count_words))
    ends = learned.count()
    n_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    tokens, kinds = n_words + ends, distinct + (ends > 0)
    floor = math.log10(tokens + 0.5 * (kinds + 1))
    log_c = lambda c: math.log10(c + 0.5) - floor
    order, across = model.order, model.across_words
    counts = scratch.keep(_node_counts(rows, order, across))
    codes = scratch.keep(_coded(counts, order))
    # At most 2**cache_bits nodes, and as many words.
    held = codes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    cached = codes.where(F.col("n") >= held / (1 << model.cache_bits)).select("node", "code").toArrow().sort_by("node")
    common = {bytes(r.item): log_c(r.n) for r in words.where((F.col("n") >= max(1, tokens / (1 << model.cache_bits))) & (F.octet_length("item") <= model.cache_word)).toLocalIterator()}
    sent = spark.sparkContext.broadcast((cached["node"].to_numpy(), cached["code"].to_numpy(), common))
    end_base = log_c(ends)

    def work():
        nodes, code, common = sent.value

        def f(texts):
            cols = [[] for _ in range(5)]
            for t in texts:
                found = Counter(t.lower().split()) if t else {}
                base, known, rare, times = end_base, int(ends > 0), [], []
                for w, n in found.items():
                    b = common.get(w)
                    if b is None:
                        rare.append(w)
                        times.append(n)
                    else:
                        base += n * b
                        known += n
                for c, x in zip(cols, (sum(found.values()) + 1, known, base, rare, times)):
                    c.append(x)
            total, missed = np.zeros(len(texts)), [[] for _ in texts]
            for node, of in windows(texts, order, across):
                kinds, which = np.unique(node, return_inverse=True)
                place = np.searchsorted(nodes, kinds)
                place[place == len(nodes)] = 0
                hit = nodes[place] == kinds if len(nodes) else np.zeros(len(kinds), bool)
                value = np.where(hit, code[place], 0.0) if len(nodes) else np.zeros(len(kinds))
                total += np.bincount(of, value[which], len(texts))
                if not hit.all():
                    lost = ~hit[which]
                    for i, x in zip(of[lost].tolist(), node[lost].tolist()):
                        missed[i].append(x)
            return [*cols[:3], total.tolist(), *cols[3:], missed]

        return f

    fields = [("n_tokens", "long"), ("known", "long"), ("base", "double"), ("score", "double"), ("rare", "array<binary>"), ("times", "array<int>"), ("nodes", "array<long>")]
    done = scratch.keep(map_texts(rows, "text", ["id", "train"], fields, work).withColumn("row", F.monotonically_increasing_id()))
    rare = done.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("item"), F.col("r.times").alias("times"))
    found = rare.join(words, "item").groupBy("row").agg(F.sum("times").alias("more"), F.sum(F.col("times") * (F.log10(F.col("n") + 0.5) - F.lit(floor))).alias("more_base"))
    missed = done.select("row", F.explode("nodes").alias("node")).join(codes, "node").groupBy("row").agg(F.sum("code").alias("more_score"))
    whole = done.select("row", "id", "train", "n_tokens", "known", "base", "score", F.aggregate("times", F.lit(0).cast("long"), lambda a, x: a + x).alias("rare")).join(found, "row", "left").join(missed, "row", "left")
    more = F.coalesce(F.col("more"), F.lit(0))
    return whole.select(
        F.col("id").alias(doc_id),
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        (F.col("known") + more).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more_base"), F.lit(0.0)) + (F.col("rare") - more) * F.lit(log_c(0))).alias("base_score"),
        (F.col("score") + F.coalesce(F.col("more_score"), F.lit(0.0))).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 != 1
    return score(docs, trains, model=Model())

