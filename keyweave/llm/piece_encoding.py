"""SentencePiece encoding and decoding by a table of distinct chunks.

No piece of the model has a whitespace marker after another character. So no merge crosses from a word into the
marker of the next one, and a text is the chain of its chunks: a run of markers with the word that follows. Each
task keeps a table of the chunks it has met, segments a new one once, and joins the ids back by position.
Spark sends the texts to the tasks in Arrow batches of bounded size; nothing is shuffled.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import column

MARKER = "▁"
_CHUNK = re.compile(f"[ {MARKER}]+[^ {MARKER}]*")
#: Bounds of a task's table: chunks, and characters of a chunk that is kept. Others are segmented each time they occur.
TABLE_CHUNKS, KEPT_CHARS = 200_000, 40


class ChunkTable:
    """The ids of chunks by one model."""

    def __init__(self, model: str):
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=model)
        vocabulary = map(self.pieces.id_to_piece, range(self.pieces.vocab_size()))
        if any(MARKER in piece.lstrip(MARKER) for piece in vocabulary):
            raise ValueError("pieces of this model cross whitespace markers")
        if self.pieces.encode("  a") != self.pieces.encode(f"{MARKER} a") or self.pieces.encode("a  b") == self.pieces.encode("a b"):
            raise ValueError("this model changes white space")
        self.ids: dict[str, bytes] = {}  # packed: numbers of their own would take several times the space
        self.marker = [self.pieces.piece_to_id(MARKER)]

    def _segment(self, chunks: list[str]) -> list[bytes]:
        # The first marker of a chunk is what the library puts before any text.
        return [array("i", ids or self.marker).tobytes() for ids in self.pieces.encode([c[1:] for c in chunks], num_threads=1)]

    def encode(self, text: str) -> array:
        out = array("i")
        if not text:
            return out
        chunks = _CHUNK.findall(f" {text}")
        new = list({c for c in chunks if c not in self.ids})
        if len(self.ids) + len(new) > TABLE_CHUNKS:
            self.ids.clear()
            new = list(set(chunks))
        own = dict(zip(new, self._segment(new), strict=True))
        self.ids.update((c, ids) for c, ids in own.items() if len(c) <= KEPT_CHARS)
        known = self.ids
        out.frombytes(b"".join([own[c] if c in own else known[c] for c in chunks]))
        return out

    def decode(self, ids: array) -> str:
        return self.pieces.decode(ids.tolist()) if ids else ""


@lru_cache(maxsize=2)
def chunk_table(model: str) -> ChunkTable:
    """One table for each Python worker."""
    return ChunkTable(model)


def encode_and_decode(df: DataFrame, model: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the ids of each whole text and the text that the model makes of them again.

    The ids are those of the library, without begin and end. A null counts as an empty text, which has no ids and
    decodes to an empty text. Rows are kept as they are, repeated ones too; input columns named like the two outputs
    are replaced.
    """

    @F.arrow_udf(returnType="struct<ids: array<int>, decoded: string>")
    def pieces(texts: pa.Array) -> pa.Array:
        table = chunk_table(model)
        # A batch has thousands of texts, so what it becomes is held once, as Arrow's own buffers.
        values, lengths, back, ends = array("i"), [], bytearray(), [0]
        for value in texts:
            found = table.encode(value.as_py())
            values.extend(found)
            lengths.append(len(found))
            back += table.decode(found).encode()
            ends.append(len(back))
        offsets = pa.array(np.concatenate(([0], np.cumsum(lengths))), pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(values, np.int32) if values else [], pa.int32()))
        texts_again = pa.StringArray.from_buffers(len(texts), pa.py_buffer(np.array(ends, np.int32)), pa.py_buffer(back))
        return pa.StructArray.from_arrays([lists, texts_again], ["ids", "decoded"])

    found = pieces(column(text).cast("string"))
    return df.withColumns({ids: found["ids"], decoded: found["decoded"]})
