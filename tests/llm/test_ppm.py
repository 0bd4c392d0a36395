import math
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.llm import ppm

from .conftest import documents


def naive(texts, trained, order, least):
    """Contexts counted straight from the words."""
    nodes = Counter()
    for t in trained:
        for w in (t or "").encode().lower().split():
            s = b"\n" + w + b" "
            for i in range(1, len(s)):
                for k in range(0, order + 1):
                    if i - k >= 0:
                        nodes[s[i - k : i], s[i]] += 1
    totals, seen = Counter(), {}
    for (c, x), n in nodes.items():
        totals[c] += n
        if n >= least:
            seen.setdefault(c, {})[x] = n
    if trained:
        for c in (b"\n", b""):
            totals[c] += len(trained)
            seen.setdefault(c, {})[10] = len(trained)
    contexts = {c: (totals[c], x) for c, x in seen.items()}
    trie = ppm.Trie(contexts, order, 1000)
    return trie, [sum(trie.word(w) for w in (t or "").encode().lower().split()) + trie.end() for t in texts]


def test_symbols_sum_to_one():
    trie, _ = naive([], ["the cat sat on the mat", "thé cats  satin", "a"], 3, 2)
    for c in (b"\n", b"\nt", b"the", b"at", b"zzz", b""):
        symbols = [s for s in range(256) if s not in b" \t\n\x0b\x0c\r"] + ([10] if c == b"\n" else [32])
        assert math.isclose(sum(10 ** trie.symbol(c + bytes([s])) for s in symbols), 1, rel_tol=1e-9)


@pytest.mark.parametrize("bits", [20, 6, 1])
def test_against_naive(spark, bits):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["The", "the", "né", "Éa", "cat", "x" * rng.randint(1, 9), "ing\n", "\x85"]) for _ in range(rng.randint(0, 25))), "s") for i in range(60)]
    rows += [(3, rows[3][1], "s"), (None, None, None), (70, "", "s"), (71, "word " * 4000 + "new", "s")]
    df = documents(spark, rows).selectExpr("*", "'x' as train", "1 as row", "2 as score")
    trains = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 != 1
    out = ppm.score(df, trains, model=ppm.Model(across_words=False, cache_bits=bits, cache_word=2 * bits)).collect()
    learns = lambda i: zlib.crc32(("null" if i is None else str(i)).encode()) % 5 != 1
    words = lambda t: (t or "").encode().lower().split()
    trained = [t for i, t, _ in rows if learns(i)]
    c = Counter(w for t in trained for w in words(t))
    _, scores = naive([t for _, t, _ in rows], trained, 4, 1)
    c[None] = len(trained)
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t, _), s in zip(rows, scores):
        tokens = [*words(t), None]
        want.append((i, not learns(i), len(tokens), sum(c[w] > 0 for w in tokens), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), 4), round(s, 4)))
    got = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in out]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_whole_trie_at_any_size(spark):
    """Nodes seen once in more than 2**18 symbols count, and nodes that aren't broadcast too."""
    rows = [(0, "common words " * 25000, "s"), (1, "zyx", "s"), (2, "zyx qqq", "s")]
    texts = [t for _, t, _ in rows]
    _, want = naive(texts, texts, 4, 1)
    _, cut = naive(texts, texts, 4, 3)
    assert abs(want[1] - cut[1]) > 1
    for model in (ppm.Model(across_words=False), ppm.Model(across_words=False, cache_bits=4)):
        out = {r.doc_id: r.score for r in ppm.score(documents(spark, rows), F.lit(True), model=model).collect()}
        assert all(math.isclose(out[i], s, rel_tol=1e-9) for i, s in enumerate(want))


@pytest.mark.parametrize("across", [False, True])
def test_windows_by_pieces(monkeypatch, across):
    texts = [b"ab c" * 9, None, b"", b"longword " * 20, b"x"]
    whole = [x.tolist() for x in next(ppm.windows(texts, 4, across))]
    for size in (1, 3, 50):
        monkeypatch.setattr(ppm, "PIECE", size)
        pieces = [(n.tolist(), of.tolist()) for n, of in ppm.windows(texts, 4, across)]
        assert [sum((p[i] for p in pieces), []) for i in (0, 1)] == whole


@pytest.mark.parametrize("bits", [20, 3])
def test_contexts_run_across_words(spark, bits):
    """Against contexts counted from each text's whole stream; the order of words counts."""
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(["The", "né", "cat", "x" * rng.randint(1, 9), "a", "\x00"]) for _ in range(rng.randint(0, 30))), "s") for i in range(40)]
    rows += [(50, "new york city", "s"), (51, "new york city", "s"), (52, "york new city", "s"), (53, None, "s"), (54, " ", "s")]
    streams = [b"\n" + b"".join(w + b" " for w in (t or "").encode().lower().split()) + b"\n" for _, t, _ in rows]
    learns = [i % 3 != 0 or i >= 50 and i != 52 for i, _, _ in rows]
    nodes = Counter(s[i - k : i + 1] for s, learn in zip(streams, learns) if learn for i in range(1, len(s)) for k in range(min(4, i) + 1))
    contexts = {}
    for x, n in nodes.items():
        total, seen = contexts.get(x[:-1], (0, {}))
        contexts[x[:-1]] = total + n, seen | {x[-1]: n}
    trie = ppm.Trie(contexts, 4, 1000)
    df = documents(spark, rows)
    trains = F.col("doc_id").isin([i for (i, _, _), learn in zip(rows, learns) if learn])
    out = {r.doc_id: r.score for r in ppm.score(df, trains, model=ppm.Model(across_words=True, cache_bits=bits)).collect()}
    for (i, _, _), s in zip(rows, streams):
        assert math.isclose(out[i], sum(trie.symbol(s[max(0, j - 4) : j + 1]) for j in range(1, len(s))), rel_tol=1e-9), i
    assert out[52] < out[51] - 0.1
    for c in (b"cat ", b"york", b"\n", b"e n", b""):
        symbols = [s for s in range(256) if s not in b" \t\n\x0b\x0c\r"] + ([10] if c[-1:] in (b"\n", b" ") else [32])
        assert c == b"" or math.isclose(sum(10 ** trie.symbol(c + bytes([s])) for s in symbols), 1, rel_tol=1e-9)


def test_query_scores_the_order_of_words(spark, tmp_path):
    rows = [(i, t, "s") for i in range(30) for t in ["new york city", "city of new jersey"]] + [(100, "york new city", "s"), (101, "new york city", "s")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.score for r in ppm.query(spark, str(tmp_path)).collect()}
    assert out[101] > out[100] + 0.1


def test_empty(spark):
    assert ppm.score(documents(spark, []), F.lit(True)).count() == 0
    out = ppm.score(documents(spark, [(1, "a b", "s")]), F.lit(False)).collect()
    assert out[0].train_tokens == 0 and out[0].held_out and math.isfinite(out[0].score)
