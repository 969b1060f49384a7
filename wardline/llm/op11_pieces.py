"""SentencePiece (byte-pair merges of characters) by a table of each prefix's last token.

Of the merges' result for a prefix of a text, the last token depends on the prefix alone. A token ends a prefix if it is matched there by the
automaton of all tokens, and if it may follow the last token of the prefix before it: the two, merged on their own, must
stay apart. Exactly one token does, so a table of last tokens is filled from left to right, and the ids are read off it backwards. That a pair
stays apart is decided by running the two tokens' own merges in the common order of scores and asking, before each, whether a merge across
the border would come first. Time is linear in a text's length, whatever it holds.
"""

from __future__ import annotations

import codecs
import re
import struct
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_LEAST = float("-inf")
#: Characters encoded at once; entries of a worker's table of units, and of its table of pairs; characters of a unit that is kept there.
_TEXT, _UNITS, _PAIRS, _SHORT = 1 << 21, 600_000, 1_000_000, 48


def _fields(data: bytes):
    """Number and value of each field of a protocol buffer's message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            value = varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


def read_model(data: bytes) -> list[tuple[str, float, int]]:
    """Piece, score and type of each id. A ValueError unless the model merges characters, falls back to bytes and leaves texts as they are but
    for spaces and a space put before them."""
    pieces, trainer, normalizer = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            piece = dict(_fields(value))
            pieces.append((piece.get(1, b"").decode("utf-8"), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, _NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) and not normalizer.get(4, 1) and normalizer.get(5, 1) and not trainer.get(24, 0)
    kinds = {kind for _, _, kind in pieces}
    if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or not plain or not kinds <= {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
        raise ValueError("the model must be BPE with byte fallback, no normalisation, a dummy prefix and no user-defined pieces")
    return pieces


def _each_byte(error: UnicodeError):
    return "�" * (error.end - error.start), error.end


codecs.register_error("wardline-each-byte", _each_byte)


class Pieces:
    """Encodes and decodes by a model's pieces and scores."""

    def __init__(self, data: bytes):
        pieces = read_model(data)
        self.score = {p: s for p, s, kind in pieces if kind == _NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        known = {c for p in self.score for c in p}
        # Characters that only occur within pieces are symbols too, with numbers beyond the ids.
        self.symbols = [p for p, _, _ in pieces] + sorted(known - self.score.keys())
        self.merges: list = [None] * len(self.symbols)
        self.automaton, self.codes = ahocorasick.Automaton(), [b""] * len(self.symbols)
        for i, symbol in enumerate(self.symbols):
            normal = i >= len(pieces) or pieces[i][2] == _NORMAL
            if normal and (merges := self._merges(symbol)) is not None:
                self.merges[i] = merges
                self.codes[i] = struct.pack("<i", i) if i < len(pieces) else self._bytes(symbol)
                self.automaton.add_word(symbol, (i, len(symbol)))
        self.automaton.make_automaton()
        self.sizes = [len(s) for s in self.symbols]
        # No piece has a space after another character, so texts fall apart there, and around characters that no piece has.
        plain = "".join(map(re.escape, sorted(known - {SPACE})))
        inner = any(SPACE in p.lstrip(SPACE) for p in self.score)
        self.unit = re.compile(f"(?s)[{plain}{SPACE}]+|." if inner else f"(?s){SPACE}*[{plain}]+|{SPACE}+|.")
        self.known, self.pairs, self.units = known, {}, {}
        kinds = [kind for _, _, kind in pieces]
        unknown = " ⁇ "
        # A byte is carried through the joined text as a lone surrogate, or as itself.
        surface = {_NORMAL: lambda p: p.replace(SPACE, " "), _UNKNOWN: lambda p: unknown, _CONTROL: lambda p: "", _BYTE: lambda p: bytes([int(p[3:5], 16)]).decode("ascii", "surrogateescape")}
        self.surface = [surface[kind](p) for p, _, kind in pieces]
        self.spaced = [kind == _NORMAL and p.startswith(SPACE) for p, _, kind in pieces]
        self.control = np.array([kind == _CONTROL for kind in kinds])
        self.has_bytes = np.array([kind == _BYTE and int(p[3:5], 16) > 127 for p, _, kind in pieces])

    def _bytes(self, text: str) -> bytes:
        return b"".join(struct.pack("<i", self.byte[b]) for b in text.encode("utf-8"))

    def _merges(self, symbol: str):
        """The merges that make ``symbol`` of its characters, in order: score, last symbol after it, first symbol after it. None if merging
        makes something else of them."""
        parts, out = list(symbol), []
        while len(parts) > 1:
            best = max(((self.score[x], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (x := a + b) in self.score), default=None)
            if best is None:
                return None
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            out.append((best[0], parts[-1], parts[0]))
        return out

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves tokens ``a`` and ``b`` side by side as they are. Of merges of equal score the leftmost comes first."""
        left, right, score = self.merges[a], self.merges[b], self.score
        last, first, i, j = self.symbols[a][-1], self.symbols[b][0], 0, 0
        while True:
            s = left[i][0] if i < len(left) else _LEAST
            t = right[j][0] if j < len(right) else _LEAST
            across = score.get(last + first)
            if across is not None and across > s and across >= t:
                return False
            if s >= t and i < len(left):
                last, i = left[i][1], i + 1
            elif j < len(right):
                first, j = right[j][2], j + 1
            else:
                return True

    def _encoded(self, unit: str) -> bytes:
        if unit[0] not in self.known:
            return self._bytes(unit)
        table, known, done = [-1] * len(unit), self.pairs.get, -1
        if len(self.pairs) > _PAIRS:
            self.pairs.clear()
        for end, (token, size) in self.automaton.iter(unit):
            if end == done:
                continue
            if size <= end:
                before = table[end - size]
                if before < 0:
                    continue
                pair = before << 32 | token
                apart = known(pair)
                if apart is None:
                    apart = self.pairs[pair] = self._apart(before, token)
                if not apart:
                    continue
            table[end], done = token, end
        codes, sizes, out, at = self.codes, self.sizes, [], len(unit) - 1
        while at >= 0:
            token = table[at]
            out.append(codes[token])
            at -= sizes[token]
        out.reverse()
        return b"".join(out)

    def _code(self, unit: str) -> bytes:
        code = self.units.get(unit)
        if code is None:
            code = self._encoded(unit)
            if len(unit) <= _SHORT:
                if len(self.units) >= _UNITS:
                    self.units.clear()
                self.units[unit] = code
        return code

    def encode(self, text: str) -> bytes:
        """Ids of a text as packed little-endian 32-bit integers."""
        if not text:
            return b""
        text = SPACE + text.replace(" ", SPACE)
        units = self.unit.findall(text) if len(text) <= _TEXT else (m[0] for m in self.unit.finditer(text))
        return b"".join(map(self._code, units))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: the space put before it is taken off again, and bytes that are no UTF-8 become U+FFFD, one for each."""
        control = self.control[ids]
        tokens = ids.tolist()
        # Bytes on either side of a control id are no common character.
        cuts = [0, *(np.flatnonzero(control) + 1).tolist(), len(tokens)] if control.any() else [0, len(tokens)]
        runs = ["".join(map(self.surface.__getitem__, tokens[a:b])) for a, b in zip(cuts, cuts[1:])]
        if self.has_bytes[ids].any():
            runs = [r.encode("utf-8", "surrogateescape").decode("utf-8", "wardline-each-byte") for r in runs]
        text, first = "".join(runs), np.flatnonzero(~control)[:1]
        return text[1:] if len(first) and self.spaced[tokens[int(first[0])]] else text


@lru_cache(maxsize=1)
def _pieces(path: str) -> Pieces:
    """One for each worker, kept between its tasks."""
    with open(path, "rb") as file:
        return Pieces(file.read())


def _coded(path: str, carry: list[str]):
    def code(batches):
        model = _pieces(path)
        for batch in batches:
            column, i = batch.column("text"), 0
            while i < batch.num_rows:
                codes, decoded, j, size, before = [], [], i, 0, None
                while j < batch.num_rows and size < _TEXT:
                    text = column[j].as_py() or ""
                    if text != before:  # Copies of a text often stand side by side.
                        ids = model.encode(text)
                        back, before = model.decode(np.frombuffer(ids, "<i4")), text
                    codes.append(ids)
                    decoded.append(back)
                    j, size = j + 1, size + len(text)
                ends = np.concatenate([[0], np.cumsum([len(c) // 4 for c in codes])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4")))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in carry), lists, pa.array(decoded, pa.string())], [*carry, "ids", "decoded"])
                i = j

    return code


def encode(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), path: str | None = None) -> DataFrame:
    """The columns of ``carry``, ids (an array) and decoded (their text), without begin or end ids.

    ``path`` is a model file that every worker can open. Null texts count as empty (no ids, an empty text); texts of any length are encoded whole.
    Every row is encoded for itself, whatever its id, which may be null or repeated; an empty table gives an empty result. Columns that aren't
    carried are ignored, whatever their names. A space decodes from the model's own space character too, as in the library.
    """
    docs = docs.select(*carry, "text")
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry) + ", ids array<int>, decoded string"
    return docs.mapInArrow(_coded(path or public_tokenizers.path(MODEL), list(carry)), schema)


def digest(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``carry``, n_tokens, ids_sha256 (of decimal ids joined by commas) and decoded_sha256; odd input as in ``encode``."""
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return encode(docs, carry).select(*carry, F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
