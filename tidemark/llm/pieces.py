"""SentencePiece encoding with offsets, and decoding.

The normaliser walks the model's compiled character map (a double array over UTF-8 with the replacements behind it) by
longest prefix and records for each byte of the normalised text the span of source bytes it comes from. The library is
given the model without its normaliser and merges pieces of exactly that normalised text; each piece covers as many bytes of the normalised text as its string, so a running sum of piece
lengths projects every piece to a span of bytes of the original text. A row whose pieces don't tile the normalised
text is an error, never a guess.

Null text counts as empty: begin and end id alone, spans (0, 0). A very long text is one row of work: a task holds one
chunk of a quarter of a megabyte, or one longer text. Repeated rows are encoded alike. An empty table gives an empty result. Other
columns are passed over.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import list_array, table, text_chunks

DEFAULT_MODEL = "piece_bpe_32k.model"
SPACE = "▁".encode()
#: Overrides a model's normalizer_spec: the name `identity`, no character map, and no change of spaces.
IDENTITY = b"\x0a\x08identity" + b"\x12\x00" + b"\x18\x00" + b"\x20\x00" + b"\x28\x00"


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = varint() if kind == 2 else 8 if kind == 1 else 4
            yield key >> 3, raw[at : at + n]
            at += n


class Normaliser:
    """What a model's normalizer_spec asks for, with the source span of every byte."""

    def __init__(self, model: bytes):
        spec = {k: v for number, part in _fields(model) if number == 3 for k, v in _fields(part)}  # later ones replace earlier ones
        self.dummy_prefix, self.squeeze, self.escape = bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))
        blob = spec.get(2, b"")
        self.units, self.replacements = None, b""
        if blob:
            (n,) = struct.unpack_from("<I", blob)
            self.units, self.replacements = np.frombuffer(blob, "<u4", n // 4, 4), blob[4 + n :]

    def _longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key of the map that text has at `at`, and its replacement."""
        units, node, best = self.units, 0, None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node ^= offset(int(units[0]))
        for k in range(at, len(text)):
            node ^= text[k]
            u = int(units[node]) if node < len(units) else 0
            if (u & 0x800000FF) != text[k]:
                break
            node ^= offset(u)
            if u >> 8 & 1:
                best = k + 1 - at, int(units[node]) & 0x7FFFFFFF
        return best and (best[0], self.replacements[best[1] : self.replacements.index(b"\0", best[1])])

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray, np.ndarray]:
        out, begin, end, at = bytearray(), [], [], 0
        while at < len(text):
            found = self._longest(text, at)
            if found is None:
                b = text[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                found = n, text[at : at + n]
            n, new = found
            out += new
            begin += [at] * len(new)
            end += [at + n] * len(new)
            at += n
        return bytes(out), np.array(begin, np.int64), np.array(end, np.int64)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the normalised text, and for each one the begin and end of its source bytes."""
        if self.units is None:
            a = np.frombuffer(text, np.uint8)
            lead = (a & 0xC0) != 0x80
            begin = np.flatnonzero(lead)
            size = np.diff(np.append(begin, a.size))
            begin, end = np.repeat(begin, size), np.repeat(begin + size, size)
        else:
            text, begin, end = self._mapped(text)
            a = np.frombuffer(text, np.uint8)
        if self.squeeze and a.size:
            gap = a == 32
            keep = ~(gap & np.append(True, gap[:-1]))
            if keep.any() and (last := np.flatnonzero(keep)[-1]) >= 0 and gap[last]:
                keep[last] = False
            a, begin, end = a[keep], begin[keep], end[keep]
        if not a.size:
            return a, begin, end
        if self.dummy_prefix:
            a, begin, end = np.append(np.uint8(32), a), np.append(begin[0], begin), np.append(begin[0], end)
        if self.escape:
            size = np.where(a == 32, len(SPACE), 1)
            at = np.cumsum(size) - size
            out = np.zeros(int(size.sum()), np.uint8)
            gap = at[a == 32]
            out[at] = a
            for i, b in enumerate(SPACE):
                out[gap + i] = b
            a, begin, end = out, np.repeat(begin, size), np.repeat(end, size)
        return a, begin, end


class Codec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            raw = f.read()
        self.normaliser = Normaliser(raw)
        # fields of a message that come again replace the earlier ones
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=raw + bytes([26, len(IDENTITY)]) + IDENTITY)
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=raw)
        sp, n = self.sp, self.sp.get_piece_size()
        self.control = np.array([sp.is_control(i) for i in range(n)])
        self.size = np.array([0 if sp.is_control(i) else 1 if sp.is_byte(i) else len(sp.id_to_piece(i).encode()) for i in range(n)])
        self.unknown = sp.unk_id()

    def encode(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, and begin and end, in bytes of text, of each piece."""
        normal, begin, end = self.normaliser(text)
        ids = np.array(self.sp.encode(normal.tobytes().decode(), add_bos=True, add_eos=True), np.int32)
        return ids, *self.spans(text, ids, begin, end)

    def spans(self, text: bytes, ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        stop = np.cumsum(self.size[ids])
        if (ids == self.unknown).any() or (int(stop[-1]) if len(stop) else 0) != len(begin):
            raise ValueError("the pieces don't tile the normalised text")
        start = stop - self.size[ids]
        covered = stop > start
        left = np.append(begin, len(text))[start]
        right = np.append(end, len(text))[np.maximum(stop - 1, 0)] if len(end) else np.zeros(len(ids), np.int64)
        return left, np.where(covered, right, left)


@cache
def codec(path: str) -> Codec:
    return Codec(path)


ARRAYS = "n_tokens long, ids array<int>, begins array<int>, ends array<int>, decoded string"
DIGESTS = "n_tokens long, ids_sha256 string, decoded_sha256 string, spans_crc32 long"


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """id_col and, of each text, ids with begin and end id, byte spans and the text decoded again; or digests of these.

    Spans are byte offsets into the UTF-8 of the original text; spans_crc32 is that of all begins, then all ends, as
    little-endian 32-bit integers."""

    def run(batches):
        c = codec(model)
        for batch in batches:
            column = batch.column(1)
            for lo, hi, data, offs in text_chunks(column):
                raw = data.tobytes()
                found = [c.encode(raw[offs[i] : offs[i + 1]]) for i in range(hi - lo)]
                ids, spans = [x[0] for x in found], [x[1:] for x in found]
                decoded = [c.decoder.decode(x.tolist()) for x in ids]
                n = np.array([len(x) for x in ids])
                if digests:
                    crc = [zlib.crc32(e.astype("<i4").tobytes(), zlib.crc32(b.astype("<i4").tobytes())) for b, e in spans]
                    cols = [pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded]), pa.array(crc, pa.int64())]
                    names = ["ids_sha256", "decoded_sha256", "spans_crc32"]
                else:
                    flat = [list_array(np.concatenate(x).astype(np.int32), n) for x in (ids, [s[0] for s in spans], [s[1] for s in spans])]
                    cols, names = [*flat, pa.array(decoded)], ["ids", "begins", "ends", "decoded"]
                yield pa.RecordBatch.from_arrays([batch.column(0)[lo:hi], pa.array(n, pa.int64()), *cols], names=[id_col, "n_tokens", *names])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, {DIGESTS if digests else ARRAYS}")


def op1_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model or public_tokenizers.path(DEFAULT_MODEL), digests=True)
