"""SentencePiece encoding and decoding with byte spans in the original text.

Normalisation is this module's own: at every place the longest key of the
model's compiled character map that matches is replaced by its value (a
character without a key stays as it is), white space is escaped and the dummy
prefix is set in front, and every normalised byte records the source offset it
came from. A model without a map, where normalised and source bytes correspond
one to one but for spaces, takes a vectorised way to the same alignment.
Merging is the library's. Every piece's place in the normalised text is then
projected through the alignment to a span of the original bytes.

Pieces never run over the start of a word (checked against the vocabulary), so
the words of an Arrow batch are encoded once each and the ids put together
again; texts with runs of spaces or a literal word mark are encoded whole.

The model's path is a parameter; executors open it where they run.

Edge cases: null text counts as empty (the end id only, decoded as the empty
string); repeated rows are encoded again; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2

from .common import byte_slices, byte_values, offsets

MARK = "▁"
REPLACEMENT = "�".encode()


class CharacterMap:
    """The compiled map: a double-array trie of keys and a pool of replacements, each ended by a zero byte."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, dtype="<u4", offset=4, count=size // 4).tolist()
        self.pool = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, int] | None:
        """Length of the longest key at ``at`` and the place of its value, if any."""
        units, found, node = self.units, None, 0
        node ^= self._offset(units[0])
        for length in range(1, len(text) - at + 1):
            label = text[at + length - 1]
            node ^= label
            if node >= len(units) or units[node] & 0x800000FF != label:
                break
            unit = units[node]
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (length, units[node] & 0x7FFFFFFF)
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def value(self, at: int) -> bytes:
        return self.pool[at : self.pool.index(b"\0", at)]


class Codec:
    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = model_pb2.ModelProto()
        spec.ParseFromString(self.library.serialized_model_proto())
        rules = spec.normalizer_spec
        self.map = CharacterMap(rules.precompiled_charsmap) if rules.precompiled_charsmap else None
        self.prefix, self.squeeze, self.escape = rules.add_dummy_prefix, rules.remove_extra_whitespaces, rules.escape_whitespaces
        self.space = MARK.encode() if self.escape else b" "
        pieces = [p.piece for p in spec.pieces]
        control, byte = model_pb2.ModelProto.SentencePiece.CONTROL, model_pb2.ModelProto.SentencePiece.BYTE
        self.lengths = np.array([0 if p.type == control else 1 if p.type == byte else len(p.piece.encode()) for p in spec.pieces], dtype=np.int64)
        self.end = self.library.eos_id()
        self.plain = self.map is None and not self.squeeze and self.prefix and self.escape
        self.by_word = self.plain and spec.trainer_spec.byte_fallback and not any(MARK in p.lstrip(MARK) for p in pieces if not p.startswith("<"))

    def align(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised text, and the source offset of each of its bytes, with the source's length at the end."""
        out, source, at = bytearray(), [], 0
        while at < len(text):
            hit = self.map.longest(text, at) if self.map else None
            if hit:
                length, piece = hit[0], self.map.value(hit[1])
            else:
                length = 1
                while at + length < len(text) and text[at + length] & 0xC0 == 0x80:
                    length += 1
                piece = text[at : at + length]
            for part, value in enumerate(piece):
                whole = not hit
                if value == 0x20:
                    if self.squeeze and (not out or out.endswith(self.space)):
                        continue
                    out += self.space
                    source += [at + part if whole else at] * len(self.space)
                else:
                    out.append(value)
                    source.append(at + part if whole else at)
            at += length
        if self.squeeze:
            while out.endswith(self.space):
                del out[-len(self.space) :], source[-len(self.space) :]
        if self.prefix and out:
            out[:0] = self.space
            source[:0] = [0] * len(self.space)
        return bytes(out), np.array([*source, len(text)], dtype=np.int64)

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = self.library.encode(texts, num_threads=1)
        return np.fromiter(chain.from_iterable(coded), np.int32), np.array([len(x) for x in coded], dtype=np.int64)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, each with the end id, and how many each has."""
        odd = np.ones(len(texts), dtype=bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, f"  |{MARK}|^ | $|\0").to_numpy(zero_copy_only=False)
        per_text = np.ones(len(texts), dtype=np.int64)
        parts = []
        for rows, by_word in ((np.flatnonzero(~odd), True), (np.flatnonzero(odd), False)):
            chosen = texts.take(pa.array(rows))
            if by_word:
                words = pc.split_pattern(chosen, " ")
                flat = words.flatten().dictionary_encode()
                codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                known, sizes = self._whole(flat.dictionary.to_pylist())
                first = np.cumsum(sizes) - sizes
                n = sizes[codes]
                got = known[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[codes], n)]
                edges = np.asarray(words.offsets, dtype=np.int64) - words.offsets[0].as_py()
                upto = np.concatenate(([0], np.cumsum(n)))
                count = upto[edges[1:]] - upto[edges[:-1]]
            else:
                got, count = self._whole(chosen.to_pylist())
            per_text[rows] += count
            parts.append((rows, got, count))
        ids = np.full(per_text.sum(), self.end, dtype=np.int32)
        begin = np.cumsum(per_text) - per_text
        for rows, got, count in parts:
            ids[np.repeat(begin[rows] - (np.cumsum(count) - count), count) + np.arange(len(got))] = got
        return ids, per_text

    def span_ends(self, texts: pa.Array, ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
        """Where each piece ends in its text, in original bytes; it starts where the one before ends."""
        upto = np.cumsum(self.lengths[ids])
        last = np.cumsum(per_text)
        base = np.concatenate(([0], upto[last[:-1] - 1])) if len(per_text) else upto
        ends = upto - np.repeat(base, per_text)
        if not self.plain:
            at = last - per_text
            return np.concatenate([self.align(t.as_py().encode())[1][ends[a:b]] for t, a, b in zip(texts, at, last, strict=True)]) if len(texts) else ends
        data, bounds = byte_values(texts), offsets(texts) - offsets(texts)[0]
        mark = len(self.space)
        width = np.where(data == 0x20, mark, 1)
        grown = np.concatenate(([0], np.cumsum(width)))
        sizes = grown[bounds[1:]] - grown[bounds[:-1]]
        source = np.repeat(np.arange(len(data), dtype=np.int64), width)  # source byte of each normalised byte
        start = np.cumsum(sizes) - sizes
        place = np.repeat(start, per_text) + ends - mark  # past the dummy prefix
        inside = ends - mark < np.repeat(sizes, per_text)
        low, high = np.repeat(bounds[:-1], per_text), np.repeat(bounds[1:], per_text)
        if not len(source):
            return np.zeros(len(ids), dtype=np.int64)
        found = np.where(inside, source[np.clip(place, 0, len(source) - 1)], high)
        return np.where(ends <= mark, low, found) - low

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[str]:
        flat, at = ids.tolist(), 0
        rows = []
        for n in per_text.tolist():
            rows.append(flat[at : at + n])
            at += n
        return self.library.decode(rows, num_threads=1) if rows else []


def encode(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text", spans: bool = True, decoded: bool = True) -> DataFrame:
    """Rows of (doc_id, ids, ends, decoded): piece ids with the end id, the end of each
    piece's span in bytes of the original text, and the text decoded from the ids."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + ", ends array<int>" * spans + ", decoded string" * decoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(model_path)
        for batch in batches:
            for start, stop in byte_slices(batch.column("text"), 2 << 20):
                part = batch.slice(start, stop - start)
                texts = part.column("text")
                ids, per_text = own.ids(texts)
                edges = pa.array(np.concatenate(([0], np.cumsum(per_text))).astype(np.int32))
                made = {"doc_id": part.column("doc_id"), "ids": pa.ListArray.from_arrays(edges, pa.array(ids))}
                if spans:
                    made["ends"] = pa.ListArray.from_arrays(edges, pa.array(own.span_ends(texts, ids, per_text).astype(np.int32)))
                if decoded:
                    made["decoded"] = pa.array(own.decode(ids, per_text), pa.string())
                yield pa.RecordBatch.from_pydict(made)

    return slim.mapInArrow(run, schema)
