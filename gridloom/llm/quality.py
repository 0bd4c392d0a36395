"""Host-level quality rules.

Rules are judged per document, failures are summed per host, each host's
failure rate is shrunk towards the corpus by an empirical beta prior (method of
moments over the hosts), and the host verdicts are joined back to documents.

Defined results: a null text counts as an empty one and fails; a null host has
no verdict of its own, so only the base rules judge its documents; repeated
rows are judged one by one and count one by one; an empty table gives an empty
result; an input column named as a result column gives way to it.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bytes_of, map_texts, row_key, small

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
_CONTINUATION = bytes(range(0x80, 0xC0))
STATS = [("n_words", "long"), ("word_chars", "long"), ("n_symbols", "long"), ("n_dup_lines", "long"), ("n_repeat_words", "long")]


@dataclass(frozen=True)
class Rules:
    """A document fails its base rules below ``min_words`` or above ``max_repeat_percent``.

    The other limits only count towards its host's failure rate.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10
    max_dup_lines_percent: int = 50
    min_mean_chars: int = 2
    max_mean_chars: int = 15
    #: A host whose shrunk failure rate is above this is rejected as a whole.
    max_host_rate: float = 0.6
    #: Bounds of the prior's weight in documents.
    prior_weight: tuple[float, float] = (2.0, 1000.0)
    #: Rejected hosts or documents up to this many are broadcast; more are joined by shuffle.
    broadcast_hosts: int = 100_000
    broadcast_documents: int = 500_000


def text_stats(text: bytes | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of one text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if len(words) > 3:
        second, third = words[1:], words[2:]
        found = Counter(zip(words, second, third))
        if len(found) < len(words) - 2:
            end = 0
            for i, window in enumerate(zip(words, second, third)):
                if found[window] > 1:
                    repeated += i + 3 - max(end, i)
                    end = i + 3
    return (
        len(words),
        len(text.translate(None, _CONTINUATION + WHITE)),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
    )


def _work():
    return lambda texts: [list(x) for x in zip(*map(text_stats, texts))]


def document_stats(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with the five counts of STATS."""
    return map_texts(docs, text, docs.columns if keep is None else keep, STATS, _work)


def base_failed(rules: Rules):
    return (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def any_failed(rules: Rules):
    words = F.col("n_words")
    return (
        base_failed(rules)
        | (100 * F.col("n_symbols") > rules.max_symbol_percent * words)
        | (100 * F.col("n_dup_lines") > rules.max_dup_lines_percent * words)
        | (F.col("word_chars") < rules.min_mean_chars * words)
        | (F.col("word_chars") > rules.max_mean_chars * words)
    )


def host_verdicts(stats: DataFrame, host: str, rules: Rules, scratch: Scratch) -> DataFrame:
    """One row for each host that isn't null: docs, failures, shrunk_rate and host_failed."""
    hosts = scratch.keep(
        stats.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("__host"))
        .agg(F.count(F.lit(1)).alias("docs"), F.sum(any_failed(rules).cast("long")).alias("failures"))
    )
    rate = F.col("failures") / F.col("docs")
    mean, var = hosts.agg(F.avg(rate), F.var_pop(rate)).first()
    low, high = rules.prior_weight
    mean, var = mean or 0.0, var or 0.0
    weight = min(high, max(low, mean * (1 - mean) / var - 1)) if var > 0 else high
    shrunk = (F.col("failures") + F.lit(mean * weight)) / (F.col("docs") + F.lit(weight))
    return hosts.withColumn("shrunk_rate", shrunk).withColumn("host_failed", F.col("shrunk_rate") > rules.max_host_rate)


def judge(docs: DataFrame, text: str = "text", host: str = "source", keep: list[str] | None = None, rules: Rules = Rules()) -> DataFrame:
    """``keep`` columns, the counts, base_failed, host_failed and kept of every document.

    Texts are read once: the counts are written beside the kept columns, so keep no texts if they are large.
    """
    keep = docs.columns if keep is None else keep
    scratch = Scratch(docs.sparkSession, "quality")
    with_host = docs.withColumn("__of_host", F.col(f"`{host}`"))
    kept = [c for c in keep if c.lower() not in {"base_failed", "host_failed", "kept"} | {n for n, _ in STATS}]
    stats = scratch.keep(document_stats(with_host, text, [*kept, "__of_host"]))
    hosts = host_verdicts(stats, "__of_host", rules, scratch)
    rejected = hosts.where("host_failed").select("__host", "host_failed")
    # Hosts are far fewer than documents, yet their number has no bound: only a counted few are broadcast.
    few = small(rejected, rules.broadcast_hosts, bytes_of("__host"))
    judged = stats.join(F.broadcast(rejected) if few else rejected, F.col("__of_host") == F.col("__host"), "left")
    return (
        judged.withColumn("base_failed", base_failed(rules))
        .withColumn("host_failed", F.coalesce(F.col("host_failed"), F.lit(False)))
        .withColumn("kept", ~(F.col("base_failed") | F.col("host_failed")))
        .select(*[F.col(f"`{c}`") for c in kept], *[n for n, _ in STATS], "base_failed", "host_failed", "kept")
    )


def drop_rejected(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", rules: Rules = Rules()) -> DataFrame:
    """The documents that neither their own rules nor their host's verdict reject, with all their columns.

    Only keys, texts and hosts are judged; the rows meet their verdicts in the JVM.
    """
    narrow = docs.select(row_key(doc_id, text).alias("__key"), F.col(f"`{text}`").alias("text"), F.col(f"`{host}`").alias("source"))
    bad = judge(narrow, keep=["__key", "source"], rules=rules).where("not kept").select("__key", F.col("source").alias("__source")).distinct()
    few = small(bad, rules.broadcast_documents, bytes_of("__key", "__source"))
    same = (row_key(doc_id, text) == F.col("__key")) & docs[f"`{host}`"].eqNullSafe(F.col("__source"))
    return docs.join(F.broadcast(bad) if few else bad, same, "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=["doc_id"])


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
g AS (
  SELECT *, [ws[i] || chr(10) || ws[i+1] || chr(10) || ws[i+2] FOR i IN range(1, len(ws) - 1)] AS tri,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM w),
r AS (SELECT *, list_histogram(tri) AS h FROM g),
s AS (
  SELECT doc_id, source, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         len([i FOR i IN range(1, len(ws) + 1) IF
              coalesce(h[tri[i]], 0) > 1
              OR (i > 1 AND coalesce(h[tri[i-1]], 0) > 1)
              OR (i > 2 AND coalesce(h[tri[i-2]], 0) > 1)])::BIGINT AS n_repeat_words
  FROM r),
b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
a AS (
  SELECT source, count(*) AS docs,
         sum(CASE WHEN base_failed OR 100 * n_symbols > 10 * n_words OR 100 * n_dup_lines > 50 * n_words
                  OR word_chars < 2 * n_words OR word_chars > 15 * n_words THEN 1 ELSE 0 END) AS failures
  FROM b WHERE source IS NOT NULL GROUP BY source),
p AS (
  SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v FROM a),
q AS (
  SELECT source, (failures + m * k) / (docs + k) > 0.6 AS host_failed
  FROM (SELECT a.*, m, CASE WHEN v > 0 THEN least(1000.0, greatest(2.0, m * (1 - m) / v - 1)) ELSE 1000.0 END AS k FROM a, p))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       coalesce(host_failed, false) AS host_failed,
       NOT (base_failed OR coalesce(host_failed, false)) AS kept
FROM b LEFT JOIN q USING (source)
"""
