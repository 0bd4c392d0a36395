import hashlib
import random
import re

import pytest

from gridloom.llm import decontam

from .conftest import documents


def words(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute(rows, items):
    out = []
    for doc_id, text, _ in rows:
        w, hit, found = words(text), set(), set()
        for item_id, item in items:
            b = words(item)
            n = min(10, len(b))
            windows = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if windows and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    if item_id is not None:
                        found.add(str(item_id))
        out.append((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def case(short):
    rng = random.Random(9)
    word = lambda: rng.choice(["The", "of", "é", "É", "in", "a", "x1", "日本", "İz", "blue", "Ox", "k"])
    text = lambda n: rng.choice([" ", "-", ", "]).join(word() for _ in range(n))
    items = [(i, text(rng.choice([10, 11, 14, 25]))) for i in range(25)] + [(3, text(12)), (None, text(15)), (30, ""), (31, None), (32, "!!")]
    if short:
        items += [(40, "blue Ox"), (41, "É"), (42, text(5)), (43, text(7)), (44, text(9))]
    rows = []
    for i in range(80):
        body = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = re.split(r"[ ,-]+", rng.choice([t for _, t in items if t]))
            cut = rng.randint(0, 4)
            body += [" ".join(w[cut : cut + rng.randint(8, 14)]).upper() if rng.random() < 0.3 else " ".join(w[cut:]), text(rng.randint(0, 8))]
        rows.append((i, " / ".join(body), "s"))
    rows += [(5, rows[0][1], "s"), (0, rows[0][1], "s"), (None, rows[1][1], None), (90, None, "s"), (91, "", "s"), (92, "a " * 3000 + (items[0][1]), "s")]
    return rows, items


@pytest.mark.parametrize("short", [False, True])
@pytest.mark.parametrize("bound", [100_000, 0])
def test_against_brute_force(spark, tmp_path, short, bound):
    rows, items = case(short)
    docs = documents(spark, rows).selectExpr("*", "'x' as words", "1 as hash", "2 as item", "3 as id")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as need", "'y' as doc_id")
    p = decontam.Winnowing(broadcast_fingerprints=bound, broadcast_keys=bound)
    from pyspark.sql import functions as F

    out = decontam.contamination(docs, bench, params=p).withColumn("sha", F.sha2(F.array_join("items", ","), 256))
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.sha, r.contaminated) for r in out.collect()), key=str)
    assert got == brute(rows, items)
    left = decontam.remove_contaminated(docs, bench, params=p)
    assert left.columns == docs.columns and left.count() == sum(not r[-1] for r in got)


def test_empty_tables(spark):
    docs = documents(spark, [(1, "one two", "s")])
    bench = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    assert decontam.contamination(docs.limit(0), bench).count() == 0
    assert [r.contaminated for r in decontam.contamination(docs, bench.limit(0)).collect()] == [False]
    assert [r.n_hit for r in decontam.contamination(docs, bench).collect()] == [2]
