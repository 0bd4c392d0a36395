"""Token counts at every prefix of a text, by dynamic programming over prefixes.

For every document a table of one signed byte per character is stored: how the
exact number of tokens changes when that character is added.  Its running sum
is the token count of every prefix, so truncation and budget questions need no
encoder: see :func:`prefix_counts`, :func:`longest_prefix` and :func:`count_at`.

The vocabulary is a byte-level pair encoding in the ``tokenizers`` format; its
path is a parameter.  Strings of its special tokens count as one token each.

Defined results: a null text is empty and has no tokens; invalid UTF-8 counts as
replacement characters; repeated rows are counted one by one; an empty table
gives an empty result; a kept column named as a result column gives way to it.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import MEMO, PairAutomaton
from .common import held, map_texts

#: Fixed value: how byte-level vocabularies split texts before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fixed value: what the pattern's \s takes (str.isspace also takes U+001C to U+001F).
_WHITE = frozenset("\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
#: Contractions whose shorter prefixes are split otherwise than themselves.
_LONG_CONTRACTIONS = frozenset({"'re", "'ve", "'ll"})


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(plain))
    return [out[b] for b in range(256)]


class PrefixCounter:
    def __init__(self, path: str):
        import regex

        spec = json.loads(open(path, encoding="utf-8").read())
        model, pre = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec["normalizer"]:
            raise ValueError("not a plain byte-level pair encoding")
        merges = {tuple(m.split(" ") if isinstance(m, str) else m): i for i, m in enumerate(model["merges"])}
        special = [t["content"] for t in spec["added_tokens"]]
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that take their surroundings aren't known")
        # Tokens as texts of one character for each byte.
        raw = str.maketrans({c: chr(b) for b, c in enumerate(byte_symbols())})
        merges = {(a.translate(raw), b.translate(raw)): i for (a, b), i in merges.items()}
        made = {a + b: (a, b) for a, b in merges}
        rank = merges.get
        vocab = {t.translate(raw): i for t, i in model["vocab"].items()}
        self.bpe = PairAutomaton({t: i for t, i in vocab.items() if t in made or len(t) == 1}, lambda a, b: rank((a, b)), made)
        self.split = regex.compile(PATTERN).findall
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.hints = special
        self.spaces = regex.compile(r"\s\s").search
        self.pieces: dict[str, tuple[int, bytes]] = {}
        self.words: dict[str, tuple[int, bytes]] = {}

    def piece(self, text: str) -> tuple[int, bytes]:
        """Tokens of a piece that is split no further, and the change at each of its characters."""
        found = self.pieces.get(text)
        if found is None:
            if len(self.pieces) >= MEMO:
                self.pieces.clear()
            found = self.pieces[text] = self.deltas(self.counts(text))
        return found

    def counts(self, text: str) -> list[int]:
        """Tokens of each prefix of a piece that is split no further."""
        raw = text.encode()
        at = self.bpe.prefixes(raw.decode("latin-1"))[0][1:]
        if len(raw) == len(text):
            out = at
        else:
            # Only prefixes that end with a character count.
            out = [c for c, b in zip(at, raw[1:] + b" ") if b & 0xC0 != 0x80]
        if text in _LONG_CONTRACTIONS:
            out[1] = self.counts(text[0])[0] + self.counts(text[1])[0]
        return out

    @staticmethod
    def deltas(counts: list[int]) -> tuple[int, bytes]:
        if not counts:
            return 0, b""
        return counts[-1], bytes([(b - a) & 255 for a, b in zip([0, *counts], counts)])

    def plain(self, text: str) -> list[int]:
        """Tokens of each prefix of any text without special tokens."""
        out: list[int] = []
        done = 0
        parts = self.split(text)
        i = 0
        while i < len(parts):
            # A run of white space is one piece while nothing follows it, and may be split when something does.
            j = i
            while j < len(parts) and parts[j][-1] in _WHITE:
                j += 1
            run = "".join(parts[i:j])
            follower = parts[j] if j < len(parts) else ""
            led = follower[:1] in _WHITE
            if j > i and (j - i > 1 or led):
                whole = run + (follower[0] if led else "")
                out += [done + c for c in self.counts(whole)]
                done += sum(self.piece(p)[0] for p in parts[i:j])
                if follower:
                    own = self.counts(follower)
                    out += [done + c for c in own[len(whole) - len(run) :]]
                    done += own[-1]
                i = j + 1
            else:
                out += [done + c for c in self.counts(parts[i])]
                done += self.piece(parts[i])[0]
                i += 1
        return out

    def word(self, text: str) -> tuple[int, bytes]:
        """As piece, for a text between spaces with the space before it."""
        found = self.words.get(text)
        if found is None:
            if len(self.words) >= MEMO:
                self.words.clear()
            n, parts = 0, []
            for p in self.split(text):
                c, d = self.piece(p)
                n += c
                parts.append(d)
            found = self.words[text] = self.pieces[text] if len(parts) == 1 and text in self.pieces else (n, b"".join(parts))
        return found

    def table(self, text: str) -> tuple[int, bytes]:
        """Tokens of the text, and the change of the count at each of its characters."""
        if not text:
            return 0, b""
        if self.special and any(s in text for s in self.hints) and (marks := list(self.special.finditer(text))):
            counts: list[int] = []
            done = start = 0
            for m in [*marks, None]:
                body = text[start : m.start()] if m else text[start:]
                own = self.plain(body)
                if m:
                    # Until its last character a special string is ordinary text.
                    shown = self.plain(text[start : m.end() - 1])
                    counts += [done + c for c in shown]
                    done += (own[-1] if own else 0) + 1
                    counts.append(done)
                    start = m.end()
                else:
                    counts += [done + c for c in own]
            return self.deltas(counts)
        if self.spaces(text):
            return self.deltas(self.plain(text))
        words = text.split(" ")
        known, new = self.words.get, self.word
        n, parts = new(words[0]) if words[0] else (0, b"")
        parts = [parts]
        for w in words[1:]:
            w = " " + w
            c, d = known(w) or new(w)
            n += c
            parts.append(d)
        return n, b"".join(parts)


@held
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def token_tables(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns with n_bytes, n_tokens and token_deltas (one signed byte per character)."""

    def work():
        table = counter(path).table

        def f(texts):
            found = [table(t.decode("utf-8", "replace")) if t else (0, b"") for t in texts]
            return [[len(t) if t else 0 for t in texts], [n for n, _ in found], [d for _, d in found]]

        return f

    return map_texts(docs, text, docs.columns if keep is None else keep, [("n_bytes", "long"), ("n_tokens", "long"), ("token_deltas", T.BinaryType())], work)


def prefix_counts(deltas: bytes) -> np.ndarray:
    """Tokens of the prefixes of 1, 2, ... characters."""
    return np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)


def count_at(deltas: bytes, chars: int) -> int:
    """Tokens of the first ``chars`` characters."""
    return int(np.frombuffer(deltas, np.int8, count=min(chars, len(deltas))).sum(dtype=np.int64))


def longest_prefix(deltas: bytes, budget: int) -> int:
    """Characters of the longest prefix with at most ``budget`` tokens."""
    fits = np.flatnonzero(prefix_counts(deltas) <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = token_tables(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.length("token_deltas").cast("long").alias("n_prefixes"))
