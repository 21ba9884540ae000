import random
import tracemalloc

import sentencepiece

from keyweave.llm import piece_encoding
from keyweave.llm.piece_encoding import ChunkTable, encode_and_decode
from keyweave.llm.queries import tokenizer_file

ODD = ["a", "b", " ", "  ", "▁", "\n", "\t", "é", "漢", "😀", "<s>", "</s>", "<unk>", "<0x0A>", "the ", "\x00", " ", "　", "1", "!"]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=tokenizer_file())


def test_chunks_give_the_ids_of_the_library():
    rng, pieces, table = random.Random(1), library(), ChunkTable(tokenizer_file())
    for _ in range(3000):
        text = "".join(rng.choice(ODD) for _ in range(rng.randint(0, 14)))
        ids = table.encode(text)
        assert ids.tolist() == pieces.encode(text)
        assert table.decode(ids) == pieces.decode(pieces.encode(text))


def test_table_stays_small(monkeypatch):
    monkeypatch.setattr(piece_encoding, "TABLE_CHUNKS", 5)
    table, pieces = ChunkTable(tokenizer_file()), library()
    for i in range(30):
        text = f"one two three {i} four five six"
        assert table.encode(text).tolist() == pieces.encode(text)
    assert len(table.ids) <= 7


def test_rows(texts):
    values = [None, "", "Some words here", "Some words here", "x" * 50_000, "  lead and trail  "]
    df = encode_and_decode(texts(values, extra=["ids", "_words"]), tokenizer_file())
    pieces = library()
    rows = {r.doc_id: r for r in df.collect()}
    assert len(rows) == len(values)
    for i, value in enumerate(values):
        ids = pieces.encode(value or "")
        assert (rows[i].ids, rows[i].decoded, rows[i]._words) == (ids, pieces.decode(ids) if ids else "", "own")


def test_empty_table(texts):
    assert encode_and_decode(texts([]), tokenizer_file()).collect() == []


def test_the_table_is_packed():
    table = ChunkTable(tokenizer_file())
    rng = random.Random(7)
    text = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=10)) for _ in range(20_000))
    tracemalloc.start()
    table.encode(text)
    held = tracemalloc.get_traced_memory()[0] / len(table.ids)
    tracemalloc.stop()
    assert len(table.ids) > 19_000 and held < 200, held
