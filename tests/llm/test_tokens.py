import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from gridloom.llm import tokens

from .conftest import documents

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    "", " ", "  ", "a  b", "a \n\n b", "\n\nX", "I'll we've you're don't '' 'l 're", "<|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>x",
    "  lead", "trail  ", "\t\tx\t y", "aaaaaaaaaaaaaaa", "éÉ日本語 ½ ²", "🙂🙂 ok", "x  y", "a　b", "1234567 89", "----------", "          z", "\x1c\x1d \x85", "▁s \xa0\x1c", " \x1c", "\xa0 \x1f\x1f a", "  \x1e", "é",
]


@pytest.fixture(scope="module")
def both():
    return tokens.counter(PATH), Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(3)
    pool = list("abcdefghij THE ing tion  \n\t'slrev0123.,-é日🙂 <|>") + ["\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u2028", "\u200b", "\u3000", "\x0b"] + ["'ll", "'re", "<|endoftext|>", "  ", "er", " the"]
    return TEXTS + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 40))) for _ in range(1500)]


def test_whole_texts(both):
    own, ref = both
    for t in texts():
        assert own.table(t)[0] == len(ref.encode(t, add_special_tokens=False).ids), repr(t)


def test_every_prefix(both):
    own, ref = both
    for t in texts()[:400]:
        n, deltas = own.table(t)
        assert len(deltas) == len(t)
        assert list(tokens.prefix_counts(deltas)) == [len(ref.encode(t[: i + 1], add_special_tokens=False).ids) for i in range(len(t))], repr(t)


def test_budget(both):
    own, _ = both
    _, d = own.table("The quick brown fox jumps over the lazy dog")
    full = list(tokens.prefix_counts(d))
    for budget in range(0, 12):
        best = max([i + 1 for i, c in enumerate(full) if c <= budget], default=0)
        assert tokens.longest_prefix(d, budget) == best
    assert tokens.count_at(d, 9) == full[8] and tokens.count_at(d, 0) == 0


def test_frame(spark, both):
    _, ref = both
    rows = [(1, "Hello  world", "a"), (None, None, None), (2, "", "b"), (1, "Hello  world", "a"), (3, "word " * 30000, "c")]
    df = documents(spark, rows).selectExpr("*", "'x' as n_tokens", "1 as token_deltas")
    out = tokens.token_tables(df, PATH).collect()
    assert len(out) == 5
    for r in out:
        assert r.n_tokens == len(ref.encode(r.text or "", add_special_tokens=False).ids)
        assert r.n_bytes == len((r.text or "").encode())
    assert tokens.token_tables(df.limit(0), PATH).count() == 0
