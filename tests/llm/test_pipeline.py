import random

import public_tokenizers
import pyarrow as pa
import sentencepiece

import corpus_pipeline
from gridloom.llm import common, lines

from . import test_decontam, test_lines, test_quality


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    clean = [(i, "\n".join(text(20) for _ in range(rng.randint(4, 8)))) for i in range(20)]
    item = text(14)
    rows = clean + [
        (100, clean[0][1]),  # copy: all of its lines go
        (101, " ".join(clean[1][1].split())),  # the same words on one line: a near-duplicate
        (102, text(40) + " " + item + " " + text(40)),  # holds a benchmark item
        (103, "too short"),
        (104, "spam spam spam " * 40),
        (105, None),
        (106, clean[2][1].split("\n")[0] + "\n" + text(70)),  # starts with another's line
    ]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item), (1, text(12))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == {i for i, _ in clean} | {106}
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = dict(rows) | {106: rows[-1][1].split("\n")[1]}
    for i, r in out.items():
        assert list(r.pieces) == model.encode(texts[i]) and r.n_pieces == len(r.pieces) and r.round_trip
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name


def test_stages_take_any_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, empty tables."""
    good = " ".join(f"w{i}" for i in range(70))
    rows = [(1, good, "en", "s", 5), (1, good, "en", "s", 5), (None, None, None, None, None), (2, "", None, "s", None), (None, good + " x", "en", None, 1), (3, good.upper() + " y" * 20000, None, None, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.selectExpr("*", "'a' as kept", "'b' as n_words", "'c' as row", "'d' as n_lines", "'e' as key", "'f' as id", "'g' as k", "'h' as words", "'i' as item", "'j' as digest", "'k' as pieces")
    spark.createDataFrame([(0, None), (None, good[-60:]), (1, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        if name != "sentencepiece":
            assert out.columns == docs.columns and all((r.kept, r.n_words, r.row, r.n_lines) == ("a", "b", "c", "d") for r in got), name
        assert len(got) == {"quality_rules": 3, "line_dedup": 4, "minhash_near_dedup": 3, "benchmark_decontamination": 2, "sentencepiece": 6}[name], name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_short_lines_are_deduplicated(spark, tmp_path):
    """Equal lines of one and two words go too; empty lines stay."""
    rows = [(1, "Menu\nread more\n\nfirst text here", "en", "s", 0), (2, "menu\n\nRead  more\nMenu now\nother", "en", "s", 0), (3, "menu", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).collect()}
    assert out == {1: rows[0][1], 2: "\nMenu now\nother"}


def brute_pipeline(rows, items):
    """The ids and texts that each stage keeps, by comparing everything with everything."""
    hosts = {}
    failed = {}
    for i, t, host in rows:
        n_words, chars, symbols, dups, repeated = test_quality.brute(t)
        base = n_words < 50 or 100 * repeated > 50 * n_words
        every = base or 100 * symbols > 10 * n_words or 100 * dups > 50 * n_words or not 2 * n_words <= chars <= 15 * n_words
        failed[i] = base
        if host is not None:
            hosts.setdefault(host, []).append(every)
    rates = {h: sum(x) / len(x) for h, x in hosts.items()}
    mean = sum(rates.values()) / len(rates)
    var = sum((r - mean) ** 2 for r in rates.values()) / len(rates)
    weight = min(1000.0, max(2.0, mean * (1 - mean) / var - 1)) if var else 1000.0
    bad = {h for h, x in hosts.items() if (sum(x) + mean * weight) / (len(x) + weight) > 0.6}
    stages = [sorted((i, t) for i, t, h in rows if not failed[i] and h not in bad)]
    cut = test_lines.brute([(i, t, None) for i, t in stages[-1]], lines.Lines())
    stages.append(sorted((i, t) for i, t, n in cut if not n or t.split()))
    sets = {}
    for i, t in stages[-1]:
        w = t.encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    group[a] = group[b] = min(group[a], group[b])
    stages.append([(i, t) for i, t in stages[-1] if group[i] == i])
    hit = {r[0] for r in test_decontam.brute([(i, t, None) for i, t in stages[-1]], items) if r[-1]}
    stages.append([(i, t) for i, t in stages[-1] if i not in hit])
    return stages


def test_pipeline_against_brute_force(spark, tmp_path):
    rng = random.Random(23)
    word = lambda: "".join(rng.choice("abcdefghijklmé") for _ in range(rng.randint(2, 7)))
    line = lambda n: [word() for _ in range(n)]
    shared = [line(rng.randint(1, 14)) for _ in range(12)]
    items = [(i, " ".join(line(rng.choice([4, 9, 12, 25])))) for i in range(6)]

    def edited(w):
        w = list(w)
        for _ in range(rng.choice([0, 0, 1, 2])):
            w[rng.randrange(len(w))] = word()
        return w

    rows = []
    for i in range(70):
        body = [edited(rng.choice(shared)) if rng.random() < 0.3 else line(rng.randint(3, 16)) for _ in range(rng.randint(3, 12))]
        if rng.random() < 0.2:
            body.insert(1, line(3) + [x.upper() if x.isascii() else x for x in items[rng.randrange(6)][1].split()] + line(2))
        if rng.random() < 0.15:
            body = [["spam", "spam", "###", "|"]] * 20
        rows.append((i, "\n".join(" ".join(x) for x in body), rng.choice(["a", "b", "c", None])))
    for i in range(70, 95):
        # The words of an earlier one on lines of other lengths, with a few changes: near-duplicates past the line stage.
        w = edited(edited(rng.choice(rows[:70])[1].split()))
        rows.append((i, "\n".join(" ".join(w[k : k + 23]) for k in range(0, len(w), 23)), "d"))
    rows += [(100 + i, "too short", "junk") for i in range(20)] + [(130, " ".join(line(70)), "junk"), (131, None, None), (132, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", h, len(t or "")) for i, t, h in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = brute_pipeline(rows, items)
    now = docs
    for (name, stage), kept in zip(corpus_pipeline.STAGES, want):
        now = stage(spark, now, str(tmp_path))
        assert sorted((r.doc_id, r.text) for r in now.collect()) == kept, name
    assert [len(rows), *map(len, want)] == sorted([len(rows), *map(len, want)], reverse=True) and len(set(map(len, want))) == 4
    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    out = sorted((r.doc_id, list(r.pieces)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert out == [(i, model.encode(t)) for i, t in want[-1]]


def test_batches_of_texts_are_bounded(spark):
    """10,000 rows of long texts are far more than a Python task and its JVM should hold at once."""
    rows = spark.range(0, 4000, 1, 1).selectExpr("id as doc_id", "repeat(cast(id as string), 2500) as text")
    encoded = common.map_texts(rows, "text", ["doc_id"], [("n", "long")], lambda: lambda texts: [[len(t) for t in texts]])

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"size": pa.array([b.nbytes], pa.int64())})

    assert encoded.selectExpr("sum(n)").first()[0] == sum(len(str(i)) * 2500 for i in range(4000))
    found = [r.size for r in rows.mapInArrow(sizes, "size long").collect()]
    assert sum(found) > 30 << 20 and max(found) < 16 << 20
