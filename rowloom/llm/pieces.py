r"""SentencePiece encoding that keeps source offsets, and decoding.

Normalisation is done here, byte by byte through the model's compiled character map: the longest entry that is a
prefix of what is left gives the replacement, anything else stays, and every byte of the result records the source byte
that it came from. Blanks become the meta symbol, one is put in front where the model asks for it. The merge engine
then gets text that needs no normalising, and each of its pieces is projected through the record to a span of the
original UTF-8 bytes.

Defined results: null is encoded as the empty text (no pieces, decoded to the empty text); invalid bytes cannot occur
in a string column, a lone surrogate becomes a question mark; repeated rows are encoded each; an empty table gives no rows; the
piece before the text (dummy prefix) has an empty span. Texts are cut into batches by bytes, never cut themselves.
Only doc_id and text are read.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread, text_slices

META = "▁"
_META, _BAD = META.encode(), "�".encode()
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Appended to a model: its normaliser becomes the identity without dummy prefix, as later fields win.
_IDENTITY = bytes([0x1A, 0x08, 0x12, 0x00, 0x18, 0x00, 0x20, 0x00, 0x28, 0x00])


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a serialised message."""
    at = 0

    def varint() -> int:
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
        number, wire = divmod(varint(), 8)
        if wire == 0:
            yield number, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield number, data[at : at + size]
            at += size


@dataclass
class Normaliser:
    """The rules of a normaliser spec: character map, dummy prefix, extra blanks, escaping."""

    units: np.ndarray | None = None
    strings: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True
    verbatim: list[bytes] = field(default_factory=list)

    @classmethod
    def of_spec(cls, spec: bytes, verbatim: list[bytes] = ()) -> Normaliser:
        values = dict(_fields(spec))
        out = cls(dummy_prefix=bool(values.get(3, 1)), squeeze=bool(values.get(4, 1)), escape=bool(values.get(5, 1)), verbatim=sorted(verbatim, key=len, reverse=True))
        if blob := values.get(2, b""):
            size = struct.unpack_from("<I", blob)[0]
            out.units, out.strings = np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :]
        return out

    def _blanks_only(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """The whole text at once under rules that change blanks and nothing else."""
        space = _META if self.escape else b" "
        width = np.where(np.frombuffer(data, np.uint8) == 32, len(space), 1)
        source = np.repeat(np.arange(len(data)), width)
        if self.dummy_prefix:
            source = np.concatenate([np.zeros(len(space), np.int64), source])
        return (space if self.dummy_prefix else b"") + data.replace(b" ", space), np.append(source, len(data))

    def _mapped(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Longest entry of the character map at ``at``: a double-array trie walked byte by byte."""
        if self.units is None:
            return None
        units, best = self.units, None
        unit = int(units[0])
        node = (unit >> 10) << ((unit & 512) >> 6)
        for i in range(at, len(data)):
            node ^= data[i]
            unit = int(units[node])
            if unit & 0x800000FF != data[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                best = int(units[node]) & 0x7FFFFFFF, i + 1 - at
        if best is None:
            return None
        return self.strings[best[0] : self.strings.index(b"\0", best[0])], best[1]

    def _step(self, data: bytes, at: int) -> tuple[bytes, int]:
        """Replacement at ``at`` and the number of source bytes that it stands for."""
        for symbol in self.verbatim:
            if data.startswith(symbol, at):
                return symbol, len(symbol)
        if (found := self._mapped(data, at)) is not None:
            return found
        lead = data[at]
        size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        return data[at : at + size], size

    def __call__(self, data: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes, and for each of them and the end the source byte it comes from."""
        out, source, at = bytearray(), [], 0
        if not data:
            return b"", np.zeros(1, np.int64)
        if self.units is None and not self.squeeze and not self.verbatim:
            return self._blanks_only(data)
        space = _META if self.escape else b" "
        if self.squeeze:
            while at < len(data) and (step := self._step(data, at))[0] == b" ":
                at += step[1]
            if at == len(data):
                return b"", np.array([at])
        if self.dummy_prefix:
            out += space
            source += [at] * len(space)
        after_space = self.squeeze
        while at < len(data):
            new, size = self._step(data, at)
            if after_space:
                new = new.lstrip(b" ")
            if new:
                put = new.replace(b" ", space)
                out += put
                source += [at] * len(put)
                after_space = new.endswith(b" ")
            at += size
            if not self.squeeze:
                after_space = False
        end = at
        if self.squeeze:
            while out.endswith(space) and len(out) >= len(space):
                del out[-len(space) :]
                end = source[len(out)]
                del source[len(out) :]
        return bytes(out), np.array([*source, end], np.int64)


class PieceCodec:
    """Encoder and decoder of one model, with spans."""

    def __init__(self, model: bytes):
        import sentencepiece

        pieces, spec = [], b""
        for number, value in _fields(model):
            if number == 1:
                pieces.append(dict(_fields(value)))
            elif number == 3:
                spec += value  # repeated messages merge
        kinds = [p.get(3, NORMAL) for p in pieces]
        raw = [p.get(1, b"") for p in pieces]
        self.unknown = kinds.index(UNKNOWN)
        self.normalise = Normaliser.of_spec(spec, [r for r, k in zip(raw, kinds) if k == USER_DEFINED])
        #: Bytes of each piece in normalised text.
        self.width = np.array([1 if k == BYTE else len(r) for r, k in zip(raw, kinds)], np.int64)
        self.engine = sentencepiece.SentencePieceProcessor(model_proto=model + _IDENTITY)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)

    def _spans(self, ids: np.ndarray, norm: str, source: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source bytes of each piece: its bytes in the normalised text, looked up in the record."""
        if (ids == self.unknown).any():
            widths = np.array([len(p.surface.encode()) for p in self.engine.encode(norm, out_type="proto").pieces], np.int64)
        else:
            widths = self.width[ids]
        ends = np.cumsum(widths)
        return source[np.concatenate([[0], ends[:-1]])[: len(ids)]], source[ends]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first source byte, source byte after the last) for each text."""
        texts = [(t or "").encode("utf-8", "replace").decode() if t and not t.isascii() else t or "" for t in texts]
        ready = [(data.decode(), source) for data, source in map(self.normalise, map(str.encode, texts))]
        found = self.engine.encode([norm for norm, _ in ready], out_type="numpy", num_threads=1)
        out = []
        for ids, (norm, source) in zip(found, ready):
            ids = np.asarray(ids, np.int32)
            out.append((ids, *(self._spans(ids, norm, source) if len(ids) else (ids, ids))))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode(ids, num_threads=1) if ids else []


SCHEMA = "ids array<int>, starts array<int>, ends array<int>, decoded string"


def encode_documents(docs: DataFrame, model_path: str, carry: list[str] | None = None) -> DataFrame:
    """``carry`` (doc_id by default) plus ids, starts, ends (source bytes of each piece) and decoded.

    The model is read on the driver and broadcast: half a megabyte, whatever the input.
    """
    names = carry or ["doc_id"]
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = PieceCodec(model.value)
        for batch in text_slices(batches, 2 << 20):
            coded = codec.encode(batch.column("text").to_pylist())
            offsets = pa.array(np.cumsum([0, *(len(c[0]) for c in coded)]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([c[k] for c in coded]).astype(np.int32))) for k in range(3)]
            decoded = pa.array(codec.decode([c[0].tolist() for c in coded]), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("row"), *lists, decoded], ["row", "ids", "starts", "ends", "decoded"])

    rows = spread(docs.select(F.struct(*[docs[c] for c in names]).alias("row"), docs["text"].alias("text")))
    empty = rows.select("row", *[F.array().cast("array<int>").alias(c) for c in ("ids", "starts", "ends")], F.lit("").alias("decoded"))
    out = rows.mapInArrow(emit, empty.schema)
    return out.select(*[F.col("row")[c].alias(c) for c in names], "ids", "starts", "ends", "decoded")
