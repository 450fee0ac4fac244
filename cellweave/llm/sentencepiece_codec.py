"""SentencePiece encoding with the byte span of every piece, and decoding."""

from __future__ import annotations

import functools
import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁".encode()
#: Texts whose results are held at once before they go back to Spark.
OUT_ROWS = 200


class CharMap:
    """The model's compiled character map: a double-array trie of prefixes and their replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack("<I", blob[:4])[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.out = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest mapped prefix of ``text[at:]`` and what replaces it."""
        units, found = self.units, None
        if not units:
            return None
        unit = units[0]
        node = (unit >> 10) << ((unit & 512) >> 6)
        for k in range(at, len(text)):
            node ^= text[k]
            unit = units[node]
            if (unit & 0x800000FF) != text[k]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = k + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.out[found[1] : self.out.index(b"\0", found[1])]


class Normalizer:
    """Normalises as the model's specification says and records, for each normalised byte, where it came from."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and an array one longer: the source byte at which each of them, and the end, begins."""
        if not text:
            return b"", np.zeros(1, np.int64)
        if self.map.units or self.squeeze:
            raw, source = self._mapped(text)
            if not raw:
                return b"", np.zeros(1, np.int64)
        else:
            raw, source = text, np.arange(len(text) + 1)
        if self.dummy:
            raw, source = b" " + raw, np.concatenate([source[:1], source])
        if not self.escape:
            return raw, source
        width = np.where(np.frombuffer(raw, np.uint8) == 32, len(SPACE), 1)
        return raw.replace(b" ", SPACE), np.concatenate([np.repeat(source[:-1], width), source[-1:]])

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, source, at, blank = bytearray(), [], 0, self.squeeze
        while at < len(text):
            got = self.map.longest(text, at)
            if got is None:
                first = text[at]
                n = 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                got = n, text[at : at + n]
            n, new = got
            for b in new:
                if self.squeeze and b == 32 and blank:
                    continue
                blank = b == 32
                out.append(b)
                source.append(at)
            at += n
        end = len(text)
        while self.squeeze and out and out[-1] == 32:
            out.pop()
            end = source.pop()
        return bytes(out), np.array([*source, end], np.int64)


class Codec:
    """A model, its normaliser and the normalised length of every piece."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.lib = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normalize = Normalizer(proto.normalizer_spec)
        self.unknown = self.lib.unk_id()
        control = {3, 5}  # control and unused pieces stand for no text
        #: What each piece stands for in normalised bytes; byte pieces are named <0x00> to <0xFF>.
        self.stands = [b"" if p.type in control else bytes([int(p.piece[3:5], 16)]) if p.type == 6 else p.piece.encode() for p in proto.pieces]
        self.width = np.array([len(p) for p in self.stands], np.int64)

    def encode(self, text: str, bos: bool, eos: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and for each the ``[start, end)`` bytes of ``text`` that it stands for.

        The pieces, put together, must be the text as this class normalises it.
        """
        ids = np.array(self.lib.encode(text, add_bos=bos, add_eos=eos), np.int64)
        raw = text.encode()
        norm, source = self.normalize(raw)
        width, stands = self.width[ids] if len(ids) else ids, map(self.stands.__getitem__, ids.tolist())
        if (ids == self.unknown).any():  # what it stands for is told with the text only
            pieces = [p.piece.encode() if p.id == self.unknown else self.stands[p.id] for p in self.lib.encode(text, out_type="immutable_proto").pieces]
            stands = [b""] * bos + pieces + [b""] * eos
            width = np.array([len(p) for p in stands], np.int64)
        if b"".join(stands) != norm:
            raise ValueError("the pieces are not the normalised text")
        ends = np.cumsum(width)
        # A piece ends where the next normalised byte begins; bytes of one source character share it.
        return ids, np.stack([source[ends - width], source[ends]], axis=1) if len(ids) else np.zeros((0, 2), np.int64)

    def decode(self, ids: np.ndarray) -> str:
        return self.lib.decode(ids.tolist())


@functools.cache
def load_codec(path: str) -> Codec:
    """One codec for each Python worker; the model file is there on every executor, as libraries are."""
    with open(path, "rb") as f:
        return Codec(f.read())


def encode_documents(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text", bos: bool = True, eos: bool = True, spans: bool = True, digests: bool = False) -> DataFrame:
    """Encodes each text and decodes the ids again; no shuffle, one text at a time in memory.

    Texts are normalised by the longest prefix that the compiled character map knows, with the source position of each
    byte, and each piece of the encoding is projected onto the original bytes; a text whose pieces, put together, differ from its
    normalised form in any byte raises an error, so a wrong alignment can't pass unseen. Null texts count as empty, which
    give the begin and end ids only. Rows, repeats and ties included, stay as they are; null ids pass through.

    Returns ``doc_id, ids array<int>, starts array<int>, ends array<int>, decoded``, without starts and ends if ``spans``
    is false; with ``digests`` instead ``doc_id, n_tokens, ids_sha256, decoded_sha256, spans_sha256`` (of starts and ends in turn, as
    unsigned 32-bit integers), which keeps the output small.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    if digests:
        schema = f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string"
    else:
        schema = f"doc_id {id_type}, ids array<int>" + ", starts array<int>, ends array<int>" * spans + ", decoded string"

    def row(codec: Codec, text: str | None) -> tuple:
        ids, span = codec.encode(text or "", bos, eos)
        decoded = codec.decode(ids)
        if digests:
            return len(ids), *(hashlib.sha256(x).hexdigest() for x in (ids.astype("<u4").tobytes(), decoded.encode(), span.astype("<u4").tobytes()))
        return ids, *((span[:, 0], span[:, 1]) if spans else ()), decoded

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = load_codec(model)
        kinds = [pa.int64(), pa.string(), pa.string(), pa.string()] if digests else [pa.list_(pa.int32())] * (1 + 2 * spans) + [pa.string()]
        names = [x.split()[0] for x in schema.split(", ")]
        for whole in batches:
            for at in range(0, whole.num_rows, OUT_ROWS):
                batch = whole.slice(at, OUT_ROWS)
                columns = zip(*(row(codec, text.as_py()) for text in batch.column(1)), strict=True)
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True))], names)

    return docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{text_col}`"].alias("text")).mapInArrow(encode, schema)
