import os
import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from larch.llm import pieces


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.MODEL)


def texts():
    rng = random.Random(1)
    out = ["", None, " ", "  ", "a", "Hello  world \n x\tñ 漢字 \n\n  y", "   lead", "trail   ", "a" * 3000, "\n", "x\n\ny", " \n \n ", "<s> <0x0A>"]
    out += ["".join(rng.choice("abcdehint  \nñé漢🙂.,#<>s/") for _ in range(rng.randrange(1, 80))) for _ in range(400)]
    return out + ["".join(rng.choice("ehint rsao") for _ in range(rng.randrange(1, 80))) for _ in range(400)]


def encoded(model, have):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(have))), pa.array(have, pa.string())], names=["doc_id", "text"])
    return list(pieces._encode(model)([batch]))


def test_ids_are_the_library_s_and_decoding_restores_the_text(model):
    have = texts()
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    got = [r["ids"] for b in encoded(model, have) for r in b.to_pylist()]
    assert got == [library.encode(t or "") for t in have]
    back = [r["decoded"] for b in pieces._decode(model.text)(encoded(model, have)) for r in b.to_pylist()]
    assert back == [t or "" for t in have]


def test_unigram_scores_are_the_best():
    model = pieces.Model(pieces.MODEL)
    model.bpe = False
    words = sorted(["▁the", "▁theatre", "▁then", "▁tin", "▁xylem", "▁"])
    sizes, flat = pieces.Encoder(model).encode(words)
    name = {i: p for p, i in model.ids.items()}

    def best(word):
        return max([0.0] if not word else [model.score[word[:k]] + best(word[k:]) for k in range(1, len(word) + 1) if word[:k] in model.score])

    for w, ids in zip(words, np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
        assert "".join(name[i] for i in ids) == w
        assert sum(model.score[name[i]] for i in ids) == best(w)


def test_forward_scores_are_kept_by_node(model):
    """Each prefix is one node; its score and count are those of the library's pieces for it."""
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    words = sorted(["▁the", "▁theatre", "▁then", "▁tin", "▁xylem", "▁"])
    shared = pieces.shared_prefixes(words).tolist()
    assert shared == [0] + [len(os.path.commonprefix(x)) for x in zip(words[:-1], words[1:], strict=True)]
    last, _, _, count, total = pieces.Encoder(model).walk(words, shared)
    assert len(total) == 1 + len({w[:k] for w in words for k in range(1, len(w) + 1)})
    for w, node in zip(words, last.tolist(), strict=True):
        ids = library.encode(w[1:]) if len(w) > 1 else [model.ids[w]]
        assert count[node] == len(ids) and abs(total[node] - sum(library.get_score(i) for i in ids)) < 1e-6


def test_whole_and_long_texts(model):
    """Texts over a step's bytes, one word without spaces among them, and literal marks."""
    rng = random.Random(3)
    filler = "".join(rng.choice("ehint rsao\n") for _ in range(3_000_000))
    have = [filler, "ab▁▁c ▁d", "x" * 200_000, None, "short", filler[:1000] * 3, "▁", "漢字" * 50_000]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    out = encoded(model, have)
    got = [r["ids"] for b in out for r in b.to_pylist()]
    assert len(out) > 1 and got == [library.encode(t or "") for t in have]
    back = [r["decoded"] for b in pieces._decode(model.text)(out) for r in b.to_pylist()]
    assert back == [(t or "").replace("▁", " ") for t in have]


def test_decoding_by_bytes_of_any_ids(model, monkeypatch):
    """Slices by ids and not rows; null lists, null and unknown ids, and bytes that are no UTF-8."""
    monkeypatch.setattr(pieces, "IDS", 5)
    lists = [[1, 2], None, [], [model.bytes[0xC3]], [model.bytes[0xC3], model.bytes[0xA9]], [model.ids["▁the"]] * 12, [None, -1, 10**6], [model.ids["▁the"]]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(9), pa.int64()), pa.array([0] * 9), pa.array([[9]] + lists, pa.list_(pa.int32()))], names=["doc_id", "n_tokens", "ids"])
    out = [r["decoded"] for b in pieces._decode(model.text)([batch.slice(1)]) for r in b.to_pylist()]
    unknown = model.text[0].decode()
    assert out == ["", None, "", "�", "é", "the" + " the" * 11, (unknown * 3)[1:], "the"]


def test_task_memory_starts_anew(model, monkeypatch):
    monkeypatch.setattr(pieces, "WORDS", 10)
    monkeypatch.setattr(pieces, "PAIRS", 5)
    have = texts()[13:80]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    run = pieces._encode(model)
    batches = [pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t], pa.string())], names=["doc_id", "text"]) for i, t in enumerate(have)]
    assert [r["ids"] for b in run(batches) for r in b.to_pylist()] == [library.encode(t) for t in have]


def test_frames(spark, documents, nothing):
    out = pieces.decode(pieces.encode(documents)).collect()
    assert sorted((str(r["doc_id"]), r["decoded"]) for r in out) == sorted((str(r["doc_id"]), r["text"] or "") for r in documents.collect())
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)
    assert pieces.encode(nothing).count() == 0
    assert pieces.decode(spark.createDataFrame([(1, 0, None)], "doc_id long, n_tokens long, ids array<int>")).first()["decoded"] is None
