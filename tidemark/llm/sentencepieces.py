"""SentencePiece ids of whole texts by a table of distinct chunks, and texts from ids.

The model's pieces cannot cross a whitespace marker, and a line break is in no piece, so a text's
ids are those of its chunks, one after the other: a chunk is a run of markers with the word behind
it, or a line break with the word behind it. Each task keeps a table chunk -> ids. The chunks of an
Arrow batch that the table lacks are gathered once, segmented in one call to the library, and every
document's ids are joined from the table by position. Nothing is shuffled or broadcast; the table
is bounded (``TABLE_ENTRIES``; longer chunks than ``LONGEST_KEPT`` leave it with their batch).

Whether the precondition holds is read off the model when it is loaded (``ChunkTable``): a model
with a piece across a marker, a line break in a piece, another normaliser or user-defined symbols
is refused.

Edge cases: null and empty texts have no ids; repeated rows are encoded alike, one row out for one
row in; an empty table gives an empty one; other columns than the id and the text are not read, so
none can clash. A null list of ids decodes to the empty text; an id the model lacks is an error.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tidemark.llm.common import text_rows
from tidemark.llm.tokens import public_tokenizer

MARKER = "▁"
TABLE_ENTRIES = 400_000
LONGEST_KEPT = 64
OUT_BYTES = 8 << 20

_CHUNK = re.compile(r"\n[^ \n]*| +[^ \n]*")


class ChunkTable:
    """Distinct chunks with their ids, for one model file.

    A chunk is named by its characters without its first marker; one that begins with a line break
    has no marker.
    """

    def __init__(self, path: str, entries: int = TABLE_ENTRIES):
        from sentencepiece import SentencePieceProcessor
        self.model = SentencePieceProcessor(model_file=path)
        self.entries = entries
        self.ids: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.segmented = 0
        self._check()

    def _check(self) -> None:
        m = self.model
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            if MARKER in piece.lstrip(MARKER) or "\n" in piece or " " in piece:
                raise ValueError(f"piece {i} crosses a whitespace marker or a line break")
        probe = "Å　 ﬁ  \t́x "  # any normaliser but the identity changes this text
        if m.decode(m.encode(probe)) != probe or m.encode("x") != [m.piece_to_id(MARKER + "x")] or m.encode("") != []:
            raise ValueError("the model changes white space or characters, or adds no leading marker")
        self.marker = m.encode("\n")[0]
        if m.id_to_piece(self.marker) != MARKER:
            raise ValueError("a line break does not stand alone")

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Names of a text's chunks in order (one marker stands before the first word)."""
        if not text:
            return []
        if MARKER in text:  # the library takes it for a space
            text = text.replace(MARKER, " ")
        if text[0] == " " or "  " in text:
            return [c if c[0] == "\n" else c[1:] for c in _CHUNK.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def _segment(self, new: list[str]) -> dict[str, bytes]:
        """ids of chunks, each segmented once."""
        self.segmented += len(new)
        found = {}
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1)):
            if chunk[:1] == "\n":
                ids = ids[1:]  # the marker the library puts before
            found[chunk] = array("I", ids or [self.marker]).tobytes()
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        if len(self.ids) > self.entries:  # what is used again outlives the older half
            self.old, self.ids = self.ids, {}
        ids, old = self.ids, self.old
        parts = [self.chunks(t) if t else [] for t in texts]
        joined = [list(map(ids.get, p)) for p in parts]
        holes = [i for i, ids_of in enumerate(joined) if None in ids_of]
        lacking = {c for i in holes for c, known in zip(parts[i], joined[i]) if known is None}
        found = {c: old[c] for c in lacking.intersection(old)}
        found |= self._segment([c for c in lacking if c not in found])
        for i in holes:
            joined[i] = [found[c] if known is None else known for c, known in zip(parts[i], joined[i])]
        ids.update((c, blob) for c, blob in found.items() if len(c) <= LONGEST_KEPT)
        return [b"".join(p) for p in joined]

    def rest(self) -> None:
        """Give back what a task leaves behind."""
        self.old = {}
        if len(self.ids) > self.entries // 4:
            self.ids = {}


class Surfaces:
    """Bytes that each id stands for."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor
        self.model = m = SentencePieceProcessor(model_file=path)
        self.bytes = []
        self.plain = []  # whether an id stands for the same bytes wherever it is
        for i in range(m.get_piece_size()):
            if m.is_byte(i):
                self.bytes.append(bytes([int(m.id_to_piece(i)[3:-1], 16)]))
            else:
                self.bytes.append(m.id_to_piece(i).replace(MARKER, " ").encode())
            self.plain.append(not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)))
        self.special = {i for i, plain in enumerate(self.plain) if not plain}

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids)``."""
        if ids and min(ids) >= 0 and self.special.isdisjoint(ids):
            data = b"".join(map(self.bytes.__getitem__, ids))
            try:
                text = data.decode()
            except UnicodeDecodeError:  # bytes that are no characters: the library says what they become
                return self.model.decode(ids)
            return text[1:] if text[:1] == " " and not self.model.is_byte(ids[0]) else text
        return self.model.decode(ids)


_TABLES: dict[str, ChunkTable] = {}
_SURFACES: dict[str, Surfaces] = {}


def _lists(blobs: list[bytes]) -> pa.ListArray:
    import numpy as np
    at = np.zeros(len(blobs) + 1, dtype=np.int32)
    np.cumsum([len(b) // 4 for b in blobs], out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(blobs), dtype="<i4")))


def encode(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``doc_id``, ``ids``): the ids of each row's whole text, without begin and end ids."""
    path = model or public_tokenizer("piece_bpe_32k.model")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _TABLES:
            _TABLES[path] = ChunkTable(path)
        table = _TABLES[path]
        for batch in batches:
            texts = batch.column("text").to_pylist()
            blobs, start, size = table.encode(texts), 0, 0
            for i, blob in enumerate(blobs):
                size += len(blob)
                if size > OUT_BYTES or i + 1 == len(blobs):
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, i + 1 - start),
                                                      _lists(blobs[start:i + 1])], names=["doc_id", "ids"])
                    start, size = i + 1, 0
        table.rest()

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` (doc_id, ids) with ``decoded``, the text that the ids stand for."""
    path = model or public_tokenizer("piece_bpe_32k.model")
    rows = encoded.select("doc_id", F.col(ids_col).cast("array<int>").alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _SURFACES:
            _SURFACES[path] = Surfaces(path)
        surfaces = _SURFACES[path]
        for batch in batches:
            texts = [surfaces.decode(ids) if ids else "" for (ids,) in text_rows(batch, "ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())],
                                             names=["doc_id", "ids", "decoded"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def pieces_digest(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (decimal, joined by commas) and of the decoded text."""
    return decode(encode(docs, model), model).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))
