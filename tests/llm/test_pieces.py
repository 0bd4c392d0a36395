import random
import zlib

import public_tokenizers as P
import pytest
import sentencepiece

from gridloom.llm import pieces

from .conftest import documents

PATH = P.path("piece_bpe_32k.model")


def texts():
    rng = random.Random(2)
    pool = list("abcdeghi THE  \n\t'1234.,-é日ß🙂") + ["the ", " ing", "▁", "<s>", "</s>", "<0x41>", "   ", "\x00", "Ωμ", "́"]
    out = ["", " ", "  ", "a", " a ", "a  b", "\n", "Hello  world", "日本語テキスト", "▁▁x", "aaaaaaaaaaaaaa", "�", "x" * 70, "Straße öffnen"]
    return out + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 60))) for _ in range(600)]


def test_against_library():
    own, ref = pieces.Transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    for t in texts():
        ids = own.encode(t)
        assert ids == ref.encode(t), repr(t)
        assert own.decode(ids) == ref.decode(ids), repr(t)
        if "▁" not in t:
            assert own.decode(ids) == t


def test_few_arcs_are_weighed_and_parts_remembered_once():
    class Counting(dict):
        asked = 0

        def get(self, key):
            Counting.asked += 1
            return super().get(key)

    own, ref = pieces.Transducer(PATH), sentencepiece.SentencePieceProcessor(model_file=PATH)
    own.arcs.arcs = Counting()
    words = "understanding interpretations thoronsh rementeau thedwhnt einöenen ciónícique quelean".split()
    text = " ".join(words)
    assert own.encode(text) == ref.encode(text)
    assert Counting.asked <= len(text)
    # With other characters beside them, words are remembered by themselves.
    asked = Counting.asked
    for mark in ",.;:!?)1":
        text = "x " + mark.join(f" {w}" for w in words) + mark
        assert own.encode(text) == ref.encode(text)
    assert Counting.asked - asked < 100 and sum(map(len, own.memo)) < 50


def test_unigram_lattice(tmp_path):
    """A small unigram model, built here byte by byte, against all segmentations."""
    import itertools
    import math
    import struct

    def field(number, kind, body):
        return bytes([number << 3 | kind]) + (bytes([len(body)]) + body if kind == 2 else body)

    vocab = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.9, "ba": -4.1, "▁a": -2.2, "aba": -6.0, "▁ab": -5.5}
    data = b""
    for piece, score, kind in [("<unk>", 0.0, 2), *[(p, s, 1) for p, s in vocab.items()]]:
        raw = piece.encode()
        data += field(1, 2, field(1, 2, raw) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))
    data += field(2, 2, field(3, 0, b"\x01")) + field(3, 2, field(3, 0, b"\x01") + field(4, 0, b"\x01"))
    path = tmp_path / "m.model"
    path.write_bytes(data)
    own = pieces.Transducer(str(path))
    names = [p for p, _, _ in own.model.pieces]
    for n in range(1, 8):
        for t in map("".join, itertools.product("ab", repeat=n)):
            full = "▁" + t
            best = math.inf
            for cuts in itertools.product([0, 1], repeat=len(full) - 1):
                at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(full)]
                parts = [full[i:j] for i, j in zip(at, at[1:])]
                if all(p in vocab for p in parts):
                    best = min(best, -sum(vocab[p] for p in parts))
            ids = own.encode(t)
            assert "".join(names[i] for i in ids) == full
            assert math.isclose(-sum(vocab[names[i]] for i in ids), best, rel_tol=1e-6)
    assert own.decode(own.encode("  ab   a ")) == "ab a"
    assert [names[i] for i in own.encode("aZZb")] == ["▁a", "<unk>", "b"]


@pytest.mark.parametrize("empty", [False, True])
def test_frames(spark, empty):
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    rows = [(1, "Hello  world", "a"), (None, None, None), (2, "", "b"), (1, "Hello  world", "a"), (3, "word\n " * 20000, "c")]
    df = documents(spark, rows).selectExpr("*", "'x' as pieces", "1 as decoded")
    if empty:
        assert pieces.decode(pieces.encode(df.limit(0), PATH), PATH).count() == 0
        return
    out = pieces.decode(pieces.encode(df, PATH), PATH).collect()
    once = pieces.encode(df, PATH, decoded=True).collect()
    assert len(out) == 5 and sorted((r.pieces, r.decoded) for r in once) == sorted((r.pieces, r.decoded) for r in out)
    for r in out:
        assert list(r.pieces) == ref.encode(r.text or "") and r.decoded == (r.text or "")


def test_query(spark, tmp_path):
    documents(spark, [(i, t, "s") for i, t in enumerate(texts()[:60])]).write.parquet(f"{tmp_path}/documents.parquet")
    ref = sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in pieces.query(spark, str(tmp_path)).collect():
        ids = ref.encode(texts()[r.doc_id])
        assert r.n_pieces == len(ids) and r.pieces_crc32 == zlib.crc32(",".join(map(str, ids)).encode())
        assert r.round_trip or "▁" in texts()[r.doc_id]
