"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled to a cascade of transducers:

* the rewriter replaces the longest match of a rule (a double array of rules, if the
  model has one);
* the spacer, of three states, puts the space mark before the text and for spaces,
  and squeezes spaces if the model wants that;
* the piece transducer reads the spacer's characters and writes piece ids.  An arc
  weighs minus its piece's score.  For unigram models all pieces leave its one state;
  for pair-encoding models its states are the last piece written, and an arc is
  absent (infinitely heavy) where pair merging would not put its piece after that
  one.  Characters that no piece starts from have an arc of byte pieces (or of the
  unknown piece) into the starting state.

The cascade is composed with a text as far as it is read, and the encoding is the
shortest path in the tropical semiring, by one routine for both kinds of models.  Where
all characters are pieces of a pair-encoding model, one path only reaches each place: no
weights are summed then, and places are settled from the end on, as far as needed.  No
piece goes on past the space before a word (checked when compiling), so the composed
lattice falls apart before spaces, and a worker remembers the paths of parts.

Defined results: a null text is an empty one, without pieces; invalid UTF-8
becomes replacement characters; unknown ids decode to the model's unknown sign;
repeated rows are encoded one by one; an empty table gives an empty result; a
kept column named as a result column gives way to it.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import PairAutomaton
from .common import held, map_texts

#: Fixed values of the model format: the space mark, kinds of pieces and of models.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Parts of texts whose paths a worker remembers until the next so many (those with and without a space before them share what were two
#: memories), and characters of the longest one.
MEMO, MEMO_CHARS = 250_000, 32
#: Fixed value: what the unknown piece decodes to where a model names nothing else.
UNKNOWN_SIGN = " ⁇ "
#: Fixed value: how much less than the lowest score an unknown character counts in unigram models.
UNKNOWN_PENALTY = 10.0


def fields(data: bytes):
    """(number, value) of a protocol buffer message: integers, or bytes for the rest."""
    i = 0

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield key >> 3, data[i : i + size]
        i += size


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.unknown_sign, self.byte_fallback = UNIGRAM, UNKNOWN_SIGN, False
        self.dummy_prefix = self.trim = self.escape = True
        self.rules = b""
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
            elif number == 2:
                spec = dict(fields(value))
                self.kind = spec.get(3, UNIGRAM)
                self.byte_fallback = bool(spec.get(35, 0))
                self.unknown_sign = spec[44].decode() if 44 in spec else UNKNOWN_SIGN
            elif number == 3:
                spec = dict(fields(value))
                self.rules = spec.get(2, b"")
                self.dummy_prefix, self.trim, self.escape = (bool(spec.get(n, 1)) for n in (3, 4, 5))
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and pair-encoding models are known")


class Rules:
    """The normaliser's longest-match rules: a double array over bytes and the texts that its leaves stand for."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0]
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.texts = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Bytes read and text written by the longest rule at a place."""
        units, found = self.units, None
        node = 0
        step = lambda u: (u >> 10) << ((u & (1 << 9)) >> 6)
        node ^= step(units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(units) or (units[node] & ((1 << 31) | 0xFF)) != data[i]:
                break
            unit = units[node]
            node ^= step(unit)
            if (unit >> 8) & 1:
                start = units[node] & ((1 << 31) - 1)
                found = (i + 1 - at, self.texts[start : self.texts.index(b"\0", start)])
        return found

    def apply(self, text: str) -> str:
        data, out, i = text.encode(), [], 0
        while i < len(data):
            hit = self.longest(data, i)
            if hit:
                i += hit[0]
                out.append(hit[1])
            else:
                n = 1
                while i + n < len(data) and data[i + n] & 0xC0 == 0x80:
                    n += 1
                out.append(data[i : i + n])
                i += n
        return b"".join(out).decode("utf-8", "replace")


class Spacer:
    """States, and for each state and a space or another character: the next state, what is written before it, and what becomes of it (None: itself)."""

    EMPTY, TEXT, SPACES = range(3)

    def __init__(self, model: Model):
        self.runs = re.compile(" +|[^ ]+").findall
        mark = MARK if model.escape else " "
        lead = mark if model.dummy_prefix else ""
        self.arcs = {(self.EMPTY, False): (self.TEXT, lead, None), (self.TEXT, False): (self.TEXT, "", None)}
        if model.trim:
            self.arcs |= {(self.EMPTY, True): (self.EMPTY, "", ""), (self.SPACES, True): (self.SPACES, "", "")}
            self.arcs |= {(self.TEXT, True): (self.SPACES, "", ""), (self.SPACES, False): (self.TEXT, mark, None)}
        else:
            self.arcs |= {(self.EMPTY, True): (self.TEXT, lead, mark), (self.TEXT, True): (self.TEXT, "", mark)}

    def read(self, text: str, state: int) -> str:
        out = []
        for run in self.runs(text):
            for c in run if run[0] == " " else (run,):
                # The characters after the first of a word are copied in the text state.
                state, before, instead = self.arcs[state, c == " "]
                out += (before, c if instead is None else instead)
        return "".join(out)


#: States: no piece was written that matters; the unknown piece was the last.
START, UNKNOWN_LAST = -1, -2
#: Arcs of a pair-encoding model that a worker remembers.
ARCS = 200_000


class PieceArcs:
    """The piece transducer.  Its states are places in ``ids``, START or UNKNOWN_LAST."""

    def __init__(self, model: Model):
        usable = {p: i for i, (p, _, k) in enumerate(model.pieces) if k == NORMAL}
        score = {p: s for p, s, k in model.pieces if k == NORMAL}
        if any(k == USER for _, _, k in model.pieces):
            raise ValueError("user-defined pieces aren't known")
        self.bytes = {int(p[1:-1], 16): i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.unknown = next(i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN)
        self.fallback = model.byte_fallback
        #: The weight of an arc for a character that is no piece.
        self.strange = UNKNOWN_PENALTY - min(score.values(), default=0.0)
        self.chars = {p for p in usable if len(p) == 1}
        self.pairs = None
        if model.kind == BPE:
            # The higher the score of the merged piece, the earlier the merge.
            self.pairs = PairAutomaton(usable, lambda a, b: -score[a + b] if a + b in score else None)
            tokens, self.ends = self.pairs.tokens, self.pairs.ends
        else:
            import ahocorasick

            tokens, self.ends = list(usable), ahocorasick.Automaton(ahocorasick.STORE_ANY)
            for i, t in enumerate(tokens):
                self.ends.add_word(t, (i, len(t)))
            if tokens:
                self.ends.make_automaton()
        self.ids, self.weights = [usable[t] for t in tokens], [-score[t] for t in tokens]
        #: For each piece of a pair-encoding model its longest proper ending that is a piece: place and length.
        self.shorter: list[tuple[int, int] | None] = []
        if self.pairs:
            place = {t: (i, len(t)) for i, t in enumerate(tokens)}
            self.shorter = [next((place[t[i:]] for i in range(1, len(t)) if t[i:] in place), None) for t in tokens]

        #: All weights of a unigram model, those met so far of a pair-encoding one, by state and piece; unigram states fall together.
        self.arcs: dict[int, float] = {} if self.pairs else dict(enumerate(self.weights))
        self.mask = -1 if self.pairs else (1 << 20) - 1

    def weight(self, state: int, place: int) -> float:
        """The weight of the arc of a piece; infinity if there is none."""
        absent = self.pairs is not None and state >= 0 and not self.pairs.fits(self.pairs.tokens[state], self.pairs.tokens[place])
        if len(self.arcs) >= ARCS:
            self.arcs.clear()
        w = self.arcs[(state << 20 | place) & self.mask] = float("inf") if absent else self.weights[place]
        return w

    def strange_character(self, char: str, after_unknown: bool) -> list[int]:
        """The ids of the arc of a character that is no piece."""
        if self.fallback:
            return [self.bytes[b] for b in char.encode()]
        # Neighbouring unknown characters are one unknown piece.
        return [] if after_unknown else [self.unknown]


def shortest_path(arcs: PieceArcs, text: str) -> list[int]:
    """The ids along the path of least weight; of equal ones the one whose last piece starts first.

    Arcs into a place are taken in the order of places, so what leads to their start is settled.  Both kinds of models
    have one state at each place: unigram models have no other, and pair encodings have one last piece of each prefix.
    """
    if arcs.pairs is not None and arcs.chars.issuperset(text):
        return _only_path(arcs, text)
    n, inf = len(text), float("inf")
    cost, last, back = [0.0] + [inf] * n, [START] * (n + 1), [0] * (n + 1)
    known, weight, mask, one, ids = arcs.arcs.get, arcs.weight, arcs.mask, arcs.pairs is not None, arcs.ids
    strange = deque([n] if arcs.chars.issuperset(text) else [*(i for i, c in enumerate(text) if c not in arcs.chars), n])
    next_ = strange[0]
    for end, (t, size) in arcs.ends.iter(text) if ids else ():
        while next_ <= end:
            _step_over(arcs, strange.popleft(), cost, last, back)
            next_ = strange[0]
        j = end + 1
        if one and cost[j] < inf:
            continue
        i = j - size
        w = known((last[i] << 20 | t) & mask)
        total = cost[i] + (weight(last[i], t) if w is None else w)
        if total < cost[j]:
            cost[j], last[j], back[j] = total, t, i
    while len(strange) > 1:
        _step_over(arcs, strange.popleft(), cost, last, back)
    out, j = [], n
    while j:
        i, t = back[j], last[j]
        if t >= 0:
            out.append(ids[t])
        else:
            out += arcs.strange_character(text[i], last[i] == UNKNOWN_LAST)[::-1]
        j = i
    return out[::-1]


def _only_path(arcs: PieceArcs, text: str) -> list[int]:
    """``shortest_path`` where one path only reaches each place, so that nothing is summed.

    The arcs into a place are those of the longest piece that ends there and of its endings.  From the text's end on,
    places are settled only as arcs start from them: each by the first of its arcs that is not infinitely heavy.
    """
    inf, n = float("inf"), len(text)
    known, weight, ids, shorter = arcs.arcs.get, arcs.weight, arcs.ids, arcs.shorter
    # By a prefix's last character; of several pieces that end with it the longest comes first.
    tried = dict(reversed(list(arcs.ends.iter(text))))
    last = [None] * n + [START]
    stack = [n - 1] if n else []
    while stack:
        end = stack[-1]
        piece = tried[end]
        # Before the first character is index -1, the last of the list.
        while (before := last[end - piece[1]]) is not None:
            w = known(before << 20 | piece[0])
            if (weight(before, piece[0]) if w is None else w) < inf:
                last[end] = piece[0]
                stack.pop()
                break
            piece = shorter[piece[0]]
        else:
            stack.append(end - piece[1])
        tried[end] = piece
    out, j = [], n - 1
    while j >= 0:
        t, size = tried[j]
        out.append(ids[t])
        j -= size
    out.reverse()
    return out


def _step_over(arcs: PieceArcs, i: int, cost: list[float], last: list[int], back: list[int]) -> None:
    """The arc of the strange character at a place, into the starting state."""
    if cost[i] + arcs.strange < cost[i + 1]:
        cost[i + 1], last[i + 1], back[i + 1] = cost[i] + arcs.strange, START if arcs.fallback else UNKNOWN_LAST, i


class Transducer:
    def __init__(self, path: str, memo: int = MEMO):
        self.most = memo
        with open(path, "rb") as f:
            self.model = m = Model(f.read())
        self.rules = Rules(m.rules) if m.rules else None
        self.spacer, self.arcs = Spacer(m), PieceArcs(m)
        #: The lattice falls apart before each run of spaces, unless a piece goes on past one.
        mark = MARK if m.escape else " "
        self.apart = not any(mark in p.lstrip(mark) for p, _, k in m.pieces if k == NORMAL)
        #: It also falls apart around line feeds, if they are bytes of their own whatever is beside them.
        lines = m.byte_fallback and not m.trim and not any("\n" in p for p, _, k in m.pieces if k == NORMAL)
        feed, no_feed = (r"\n|", r"\n") if lines else ("", "")
        #: And between letters and other characters, if no piece has both.
        numbers = re.escape("".join(sorted({c for p, _, _ in m.pieces for c in p if c.isalnum() and not c.isalpha()})))
        falls = re.compile(rf"[^\W\d_{numbers}]+|[\W\d_{numbers}]+").findall
        mixed = not m.byte_fallback or any(len(falls(p.lstrip(mark))) > 1 for p, _, k in m.pieces if k == NORMAL)
        words = rf" *[^ {no_feed}]+" if mixed else rf" *[^\W\d_{numbers}]+| *(?:(?![ {no_feed}])[\W\d_{numbers}])+"
        self.parts = re.compile(rf"{feed}{words}| +").findall
        #: The paths of parts, as bytes of int32: of a text's start, and of the rest; then those not asked for since the last time.
        self.memo: list[dict[str, bytes]] = [{}, {}]
        self.older: list[dict[str, bytes]] = [{}, {}]
        self.space = self.spacer.read(" x", Spacer.TEXT)[:-1]
        table = [p.encode().replace(MARK.encode(), b" ") if m.escape else p.encode() for p, _, _ in m.pieces]
        for i, (p, _, k) in enumerate(m.pieces):
            table[i] = bytes([int(p[1:-1], 16)]) if k == BYTE else m.unknown_sign.encode() if k == UNKNOWN else b"" if k == CONTROL else table[i]
        self.written = table

    def part(self, text: str, kind: int) -> bytes:
        """The shortest path of the cascade composed with a part of a text; ``kind`` is its place in ``memo``."""
        memo = self.memo[kind]
        found = memo.get(text)
        if found is None:
            found = self.older[kind].get(text)
            if found is None:
                spaces = text.rfind(" ") if kind else 1
                if spaces > 0 or text == " ":
                    read = self.spacer.read(text, Spacer.TEXT if kind else Spacer.EMPTY)
                else:
                    # What the spacer writes for one space and a word is the same for all words.
                    read = text if spaces else self.space + text[1:]
                found = array("i", shortest_path(self.arcs, read)).tobytes()
            if len(text) <= MEMO_CHARS:
                if len(memo) >= self.most:
                    # The half that was not asked for since the last time goes.
                    self.older[kind], memo = memo, {}
                    self.memo[kind] = memo
                memo[text] = found
        return found

    def encoded(self, text: str) -> bytes:
        """``encode`` as bytes of int32."""
        if self.rules:
            text = self.rules.apply(text)
        if not text:
            return b""
        # A space mark in the text may share a piece with the space beside it.
        if not self.apart or MARK in text:
            return array("i", shortest_path(self.arcs, self.spacer.read(text, Spacer.EMPTY))).tobytes()
        parts = self.parts(text)
        out = list(map(self.memo[1].get, parts))
        out[0] = self.part(parts[0], 0)
        part = self.part
        for i, found in enumerate(out):
            if found is None:
                out[i] = part(parts[i], 1)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids: the inverse of the piece transducer, and the leading space taken away."""
        table = self.written
        data = b"".join([table[i] for i in ids])
        if self.model.dummy_prefix and data[:1] == b" ":
            data = data[1:]
        return data.decode("utf-8", "replace")


@held
def transducer(path: str, memo: int = MEMO) -> Transducer:
    return Transducer(path, memo)


def encode(docs: DataFrame, path: str, text: str = "text", keep: list[str] | None = None, decoded: bool = False, memo: int = MEMO) -> DataFrame:
    """``keep`` columns with ``pieces``, the ids of each text; with ``decoded``, also the text that these decode to.

    ``memo`` parts of texts are remembered by a worker, which only saves time.  One pass does both, so a core needs one Python worker with one table of words.
    """

    def work():
        both = transducer(path, memo)

        def run(texts):
            ids = [both.encoded(t.decode("utf-8", "replace")) if t else b"" for t in texts]
            offsets = np.zeros(len(ids) + 1, np.int32)
            np.cumsum([len(x) // 4 for x in ids], out=offsets[1:])
            out = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), np.int32)))]
            return [*out, [both.decode(np.frombuffer(x, np.int32).tolist()) for x in ids]] if decoded else out

        return run

    fields = [("pieces", "array<int>"), ("decoded", "string")][: 1 + decoded]
    return map_texts(docs, text, docs.columns if keep is None else keep, fields, work)


def decode(encoded: DataFrame, path: str, keep: list[str] | None = None, pieces: str = "pieces") -> DataFrame:
    """``keep`` columns with ``decoded``, the text of the ids (null for null)."""
    keep = [c for c in (encoded.columns if keep is None else keep) if c.lower() != "decoded"]
    source = encoded.select(*[encoded[f"`{c}`"] for c in keep], F.col(f"`{pieces}`").alias("__ids"))
    out = T.StructType([encoded.schema[c] for c in keep] + [T.StructField("decoded", T.StringType())])

    def run(batches):
        f = transducer(path).decode
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                ids = part.column("__ids")
                flat, ends = ids.flatten().to_numpy(zero_copy_only=False).tolist(), np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)).tolist()
                texts, at = [], 0
                for end, there in zip(ends, ids.is_valid().to_pylist()):
                    texts.append(f(flat[at:end]) if there else None)
                    at = end
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(texts, pa.string())], names=[*keep, "decoded"])

    return source.mapInArrow(run, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.select("doc_id", "text", F.md5(F.coalesce("text", F.lit(""))).alias("of_text"))
    back = encode(docs, path, keep=["doc_id", "of_text"], decoded=True)
    return back.select(
        "doc_id",
        F.size("pieces").cast("long").alias("n_pieces"),
        F.crc32(F.array_join("pieces", ",")).alias("pieces_crc32"),
        (F.md5("decoded") == F.col("of_text")).alias("round_trip"),
    )
