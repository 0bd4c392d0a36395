import random

from gridloom.llm import quality

from .conftest import documents


def brute(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    tri = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {k for i, t in enumerate(tri) if tri.count(t) > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = sum(lines[i] in lines[:i] for i in range(len(lines)))
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(hit)


def test_stats_against_brute_force():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["a ", "b ", "é ", "#c\t", "a\n", "\n", " \n", "日 ", "d\x85e "]) for _ in range(rng.randint(0, 40)))
        assert quality.text_stats(t.encode()) == brute(t)
    assert quality.text_stats(None) == (0, 0, 0, 0, 0)


def test_hosts(spark):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good + f" {i}", "fine") for i in range(40)]
    rows += [(100 + i, "short", "bad") for i in range(60)] + [(200, good, "bad"), (200, good, "bad")]
    rows += [(300, good, None), (301, None, None), (None, good, "fine"), (302, "", "fine")]
    df = documents(spark, rows).selectExpr("*", "'x' as kept", "7 as n_words", "'h' as host_failed")
    out = quality.judge(df).collect()
    assert len(out) == len(rows)
    for r in out:
        failed = r.text is None or len(r.text.split()) < 50
        assert r.base_failed == failed
        assert r.host_failed == (r.source == "bad")
        assert r.kept == (not failed and r.source != "bad")
    assert quality.judge(df.limit(0)).count() == 0
    many = quality.judge(df, rules=quality.Rules(broadcast_hosts=0)).collect()
    assert sorted(map(str, many)) == sorted(map(str, out))


def test_very_long_texts(spark):
    long = " ".join(f"w{i % 70_000}" for i in range(140_000))
    out = {r.doc_id: r for r in quality.judge(documents(spark, [(1, long, "s"), (2, "x " * 200_000, "s"), (3, "#" * 500_000, "t")])).collect()}
    assert (out[1].n_words, out[1].n_repeat_words, out[1].base_failed) == (140_000, 140_000, True)
    assert (out[2].n_words, out[2].n_repeat_words) == (200_000, 200_000) and out[3].n_symbols == 500_000
