import random
import re

import pytest

from gridloom.llm import lines

from .conftest import documents


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(new[-1] + 1, row[j + 1] + 1, row[j] + (x != y)))
        row = new
    return row[-1]


def brute(rows, p):
    """The cleaned text of each row, by comparing all lines."""
    cut = lambda line: re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in line))
    seen = {}
    for i, t, _ in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        for no, line in enumerate((t or "").split("\n")):
            w = tuple(cut(line))
            if len(w) >= p.min_words:
                seen.setdefault(w, (i is not None, i or 0, no))
    out = []
    for i, t, _ in rows:
        if t is None:
            out.append((i, None, 0))
            continue
        stay = []
        for no, line in enumerate(t.split("\n")):
            w, at = tuple(cut(line)), (i is not None, i or 0, no)
            near = lambda x: len(w) >= p.fuzzy_words <= len(x) and abs(len(w) - len(x)) < 2 and distance(w, x) <= 1
            if len(w) < p.min_words or not (seen[w] < at or any(f < seen[w] and near(x) for x, f in seen.items())):
                stay.append(line)
        out.append((i, "\n".join(stay), len(t.split("\n")) - len(stay)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [300_000, 0])
def test_against_brute_force(spark, bound):
    rng = random.Random(8)
    word = lambda: rng.choice(["The", "the", "é", "of", "cat", "Ox", "x", "y9", "日本"])
    pool = [" ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 10, 11, 12, 20]))) for _ in range(25)]

    def line():
        w = rng.choice(pool).split()
        for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
            at = rng.randrange(len(w) + 1)
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + [word()] + w[at:], w[:at] + [word()] + w[at + 1 :]])
        return rng.choice([" ", "  ", "\t"]).join(w)

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 7))), "s") for i in rng.sample(range(1000), 50)]
    rows += [(rows[0][0], rows[0][1], "s"), (None, rows[1][1], None), (2000, None, "s"), (2001, "", "s"), (2002, "\n\n", "s"), (2003, "a b c d " * 5000, "s"), (2004, "a b c d " * 5000, "s")]
    p = lines.Lines(broadcast_documents=bound)
    df = documents(spark, rows).selectExpr("*", "'x' as n_lines", "1 as gone", "2 as id", "3 as k", "4 as row")
    out = lines.dedup_lines(df, p=p)
    assert [c for c in out.columns if c not in ("n_lines", "n_removed")] == [c for c in df.columns if c != "n_lines"]
    assert sorted(((r.doc_id, r.text, r.n_removed) for r in out.collect()), key=str) == brute(rows, p)
    assert lines.dedup_lines(df.limit(0), p=p).count() == 0


def test_halves_are_shared_by_neighbours():
    rng = random.Random(1)
    for _ in range(2000):
        a = [rng.choice([b"a", b"b"]) for _ in range(rng.randint(4, 9))]
        b = list(a)
        at = rng.randrange(len(a))
        b = rng.choice([b[:at] + b[at + 1 :], b[:at] + [b"c"] + b[at:], b[:at] + [b"c"] + b[at + 1 :]])
        assert set(lines.half_keys(a, 3)) & set(lines.half_keys(b, 3))
        assert lines.within_one(a, b) and distance(a, b) == 1
