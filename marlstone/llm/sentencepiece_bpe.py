"""Exact encoding and decoding of merge-type SentencePiece models.

A sequence of pieces is what merging makes of a text if and only if each two neighbours are
compatible, that is, if merging their joined text gives back just those two. So a text can be
encoded from left to right: take the longest piece that an Aho-Corasick automaton finds here; if it
isn't compatible with the piece before it, try its longest shorter prefix, and if none is left, go
back over the last piece and remember in a bitfield that no encoding passes this position. Each
position fails at most once, so time is linear in the text.

Pieces never hold a space mark behind another character (checked when a model is loaded), so a text
falls apart before each run of marks that follows a character; those parts repeat, and are kept in a
bounded cache.

Null and empty texts have no ids; no ids decode to an empty text; null ids decode to null.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from marlstone.llm.common import add_columns, kept_in_worker

MARK = "▁"
CACHED_PARTS, CACHED_LENGTH, KNOWN_PAIRS = 500_000, 48, 400_000
NORMAL, CONTROL, USER_DEFINED, BYTE, UNUSED = 1, 3, 4, 6, 5


class PieceModel:
    """One model, from the bytes of its file."""

    def __init__(self, content: bytes):
        proto = model_pb2.ModelProto()
        proto.ParseFromString(content)
        rules = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix or not proto.trainer_spec.byte_fallback:
            raise ValueError("only merge-type models with byte fallback and without normalisation are supported")
        if any(p.type in (USER_DEFINED, UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = MARK if rules.add_dummy_prefix else ""
        self.text = [p.piece for p in proto.pieces]
        self.kind = [p.type for p in proto.pieces]
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.score = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[1:-1], 16): i for i, p in enumerate(proto.pieces) if p.type == BYTE}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        known = set("".join(self.ids))
        if any(MARK in p.lstrip(MARK) for p in self.ids) or any(c not in self.ids for c in known):
            raise ValueError("pieces must start with their space marks, and their characters be pieces")
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        #: The longest piece that is a shorter prefix of a piece, or -1.
        self.shorter = [next((self.ids[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.ids), -1) for t in self.text]
        self.fits: dict[int, bool] = {}
        self.size = len(self.text)
        self.width = [len(t) for t in self.text]
        self.characters = known
        self.parts = _Parts(self)
        self.decoded = [(" " * len(t) if not t.strip(MARK) else t.replace(MARK, " ")) if k == NORMAL else "" if k == CONTROL else " ⁇ " for t, k in zip(self.text, self.kind, strict=True)]

    def merged(self, text: str) -> list[int]:
        """What merging does with a short text: the best-scored pair first, the leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best = max(((self.score[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.ids[p] for p in parts]

    def compatible(self, left: int, right: int) -> bool:
        """left -1: whether right alone stands for its text."""
        key = (left + 1) * self.size + right
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) > KNOWN_PAIRS:
                self.fits.clear()
            joined = self.text[right] if left < 0 else self.text[left] + self.text[right]
            known = self.fits[key] = self.merged(joined) == ([right] if left < 0 else [left, right])
        return known

    def known_run(self, text: str) -> list[int]:
        """Encode a text all of whose characters are pieces.

        If the longest matches from left to right are compatible all along, they are the encoding.
        """
        out = [piece for _, piece in self.automaton.iter_long(text)]
        left, known, size = 0, self.fits.get, self.size
        for piece in out:
            if not known(left * size + piece) and not self.compatible(left - 1, piece):
                return self.backtracked(text, out)
            left = piece + 1
        return out

    def backtracked(self, text: str, greedy: list[int]) -> list[int]:
        """Go on where the longest matches stop being compatible."""
        n, size, width, shorter, known = len(text), self.size, self.width, self.shorter, self.fits.get
        longest = [-1] * (n + 1)
        for end, piece in self.automaton.iter(text):  # by ascending ends: what stays is the longest
            longest[end + 1 - width[piece]] = piece
        failed = 0  # a bit for each position
        out: list[int] = []
        at, left, piece = 0, 0, greedy[0]
        while at < n:
            end = at + width[piece]
            if not failed >> end & 1:
                fits = known(left * size + piece)
                if fits or fits is None and self.compatible(left - 1, piece):
                    out.append(piece)
                    at, left, piece = end, piece + 1, longest[end]
                    continue
            if (prefix := shorter[piece]) >= 0:
                piece = prefix
            else:
                failed |= 1 << at
                piece = out.pop()
                at -= width[piece]
                left = out[-1] + 1 if out else 0
        return out

    def part_ids(self, part: str) -> list[int]:
        """Encode a part; a character that no piece has becomes its bytes and separates what is around it."""
        if self.characters.issuperset(part):
            return self.known_run(part)
        out: list[int] = []
        run = 0
        for k, c in enumerate(part):
            if c not in self.ids:
                if run < k:
                    out += self.known_run(part[run:k])
                out += [self.byte_ids[b] for b in c.encode()]
                run = k + 1
        return out + self.known_run(part[run:]) if run < len(part) else out

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if len(self.parts) > CACHED_PARTS:
            self.parts.clear()
        return np.frombuffer(b"".join(map(self.parts.__getitem__, _PART.findall(self.prefix + text.replace(" ", MARK)))), np.int32)

    def decode(self, ids: list[int]) -> str:
        """Bytes in a row are read as UTF-8; each byte that isn't part of it gives a replacement character."""
        if not self.byte_of.keys().isdisjoint(ids):
            out: list[str] = []
            run = bytearray()
            for i in ids:
                if (b := self.byte_of.get(i)) is not None:
                    run.append(b)
                    continue
                if run:
                    out.append(_from_bytes(run))
                    run = bytearray()
                out.append(self.decoded[i])
            text = "".join([*out, _from_bytes(run)])
        else:
            text = "".join(map(self.decoded.__getitem__, ids))
        first = next((i for i in ids if self.kind[i] != CONTROL), None)
        return text[1:] if self.prefix and first is not None and self.kind[first] == NORMAL and text.startswith(" ") else text


class _Parts(dict):
    """Ids of parts as bytes; long parts aren't kept."""

    def __init__(self, model: PieceModel):
        self.model = model

    def __missing__(self, part: str) -> bytes:
        ids = np.array(self.model.part_ids(part), np.int32).tobytes()
        if len(part) <= CACHED_LENGTH:
            self[part] = ids
        return ids


_PART = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_models: dict[int, PieceModel] = {}
kept_in_worker(_models.clear)


def _from_bytes(run: bytearray) -> str:
    """Each byte outside valid UTF-8 becomes one replacement character."""
    out, at = [], 0
    while at < len(run):
        for n in (4, 3, 2, 1):
            try:
                out.append(bytes(run[at : at + n]).decode())
                at += n
                break
            except UnicodeDecodeError:
                if n == 1:
                    out.append("�")
                    at += 1
    return "".join(out)


def _loaded(content: bytes) -> PieceModel:
    key = hash(content)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(content)
    return _models[key]


def encode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """docs with the ids of every whole text as array<int>.

    model_file is read on the driver; its content (under a megabyte) goes along with the tasks.
    """
    with open(model_file, "rb") as f:
        content = f.read()

    def compute(batch: pa.RecordBatch) -> list:
        model = _loaded(content)
        found = [model.encode(t) for t in batch.column(text).to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32)))]

    return add_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType()))], compute)


def decode(docs: DataFrame, model_file: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the text that the ids stand for."""
    with open(model_file, "rb") as f:
        content = f.read()

    def compute(batch: pa.RecordBatch) -> list:
        model = _loaded(content)
        column = batch.column(ids)
        values, ends, nulls = column.values.to_numpy(zero_copy_only=False).tolist(), column.offsets.tolist(), column.is_null().to_pylist()
        return [pa.array([None if none else model.decode(values[a:b]) for a, b, none in zip(ends, ends[1:], nulls, strict=False)], pa.string())]

    return add_columns(docs, [T.StructField(decoded, T.StringType())], compute)


def encode_and_decode(docs: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the ids of every whole text and the text that these stand for, in one pass: half as many Python workers."""
    with open(model_file, "rb") as f:
        content = f.read()

    def compute(batch: pa.RecordBatch) -> list:
        model = _loaded(content)
        found = [model.encode(t) for t in batch.column(text).to_pylist()]
        offsets = np.zeros(len(found) + 1, np.int32)
        np.cumsum([len(x) for x in found], out=offsets[1:])
        back = pa.array([model.decode(x.tolist()) for x in found], pa.string())
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))), back]

    return add_columns(docs, [T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())], compute)
