"""The agenda encoder and the decoder against the sentencepiece library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from precis.llm.sentencepiece_bpe import BpeModel, decode_documents, encode_documents, read_model

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = [" ", "  ", "\n", "\t", "a", "b", "the", "é", "▁", "　", "😀", "\x00", "\r", "ing", "<s>", "<0x0A>", "ß",
         "中", "文", "!!", "  \n", " \n", "1", "23", "a" * 50]


@pytest.fixture(scope="module")
def both():
    return BpeModel(read_model(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def test_random_texts_and_ids(both):
    model, lib = both
    rnd = random.Random(7)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    offsets, ids = model.encode_batch(texts)
    decoded = model.decode_batch(offsets, ids)
    for k, text in enumerate(texts):
        want = lib.encode(text)
        assert ids[offsets[k]:offsets[k + 1]].tolist() == want, text
        assert decoded[k] == lib.decode(want), text
    lists = [[rnd.randrange(0, 32000 if rnd.random() < 0.5 else 259) for _ in range(rnd.randint(0, 9))] for _ in range(3000)]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
    flat = np.array([i for x in lists for i in x], dtype=np.int32)
    assert model.decode_batch(offsets, flat) == [lib.decode(x) for x in lists]


def test_long_chunk_without_spaces(both):
    model, lib = both
    text = "".join(random.Random(3).choice("abcdefgthe") for _ in range(20000))
    assert model.encode(text) == lib.encode(text)


def test_documents(spark, both):
    _, lib = both
    rows = [(1, "Hello  world\nagain", "x"), (2, None, "x"), (3, "", None), (None, "null id", "x"),
            (1, "Hello  world\nagain", "x"), (5, "a b " * 30000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode_documents(docs, PATH).collect()
    assert len(out) == len(rows)
    for row in out:
        assert row.n_tokens == len(row.ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, row.ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(lib.decode(list(row.ids)).encode()).hexdigest()
    want = sorted((d if d is not None else -1, lib.encode(t or "")) for d, t, _ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids)) for r in out) == want
    back = decode_documents(encode_documents(docs, PATH), PATH).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert encode_documents(docs, PATH).collect() == []
    assert encode_documents(docs, PATH, with_ids=False).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_a_run_of_unknown_characters_is_one_id():
    """A vocabulary without byte pieces, written out by hand (fields of the model format)."""
    import struct

    def field(number, wire, payload):
        size = bytes([len(payload)]) if wire == 2 else b""
        return bytes([number << 3 | wire]) + size + payload

    def piece(text, score, kind):
        return field(1, 2, field(1, 2, text.encode()) + field(2, 5, struct.pack("<f", score)) + field(3, 0, bytes([kind])))

    data = piece("<unk>", 0.0, 2) + piece("<s>", 0.0, 3) + piece("</s>", 0.0, 3)
    data += b"".join(piece(p, -float(i), 1) for i, p in enumerate(["ab", "\u2581", "a", "b"]))
    data += field(2, 2, field(3, 0, b"\x02"))
    data += field(3, 2, field(1, 2, b"identity") + field(4, 0, b"\x00"))
    lib = sentencepiece.SentencePieceProcessor(model_proto=data)
    model = BpeModel(data)
    rnd = random.Random(2)
    for text in ["\U0001F600\u00e9\U0001F600", "a\u00e9\u00e9b ab"] + [
            "".join(rnd.choice("ab \u00e9\U0001F600") for _ in range(rnd.randint(0, 12))) for _ in range(500)]:
        offsets, ids = model.encode_batch([text])
        assert ids.tolist() == lib.encode(text), text
