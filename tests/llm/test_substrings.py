import hashlib

import pytest

from larch.llm import substrings
from tests.llm.conftest import words


def brute(rows):
    first, split = {}, [(i, words(t)) for i, t in rows]
    order = lambda i: -(2**63) if i is None else i
    for i, w in split:
        for j in range(len(w) - 19):
            x = tuple(w[j : j + 20])
            first[x] = min(first.get(x, (2**70, 0)), (order(i), j))
    out = []
    for i, w in split:
        lost = set()
        for j in range(len(w) - 19):
            if first[tuple(w[j : j + 20])] < (order(i), j):
                lost |= set(range(j, j + 20))
        kept = " ".join(x for k, x in enumerate(w) if k not in lost)
        out.append((i, len(w), len(lost), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("hot", [False, True, None])
def test_against_brute_force(documents, monkeypatch, hot):
    if hot is None:  # buckets are reduced at every block, and every text is a step of its own
        monkeypatch.setattr(substrings, "HOLD", 1)
        monkeypatch.setattr(substrings, "PIECE", 1)
    if hot:  # every repeated minimiser is split up
        monkeypatch.setattr(substrings, "HOT_LEAST", 0)
        monkeypatch.setattr(substrings, "HOT_MOST", 10)
        monkeypatch.setattr(substrings, "BUCKET", 50)
    have = [(r["doc_id"], r["text"]) for r in documents.collect()]
    got = sorted((tuple(r) for r in substrings.dedup_substrings(documents).collect()), key=str)
    assert got == brute(have)
    assert sum(r[2] for r in got) > 0


def test_texts(documents, nothing):
    for r in substrings.dedup_substrings(documents, with_text=True).collect():
        assert hashlib.sha256(r["kept_text"].encode()).hexdigest() == r["kept_sha256"]
        assert len(words(r["kept_text"])) == r["n_words"] - r["n_removed"]
    assert substrings.dedup_substrings(nothing).count() == 0


def test_windows_hash_alike_wherever_they_stand():
    import numpy as np

    from larch.llm.words import windows

    h = np.random.default_rng(0).integers(0, 2**63, 50, dtype=np.uint64)
    for k in (1, 2, 5, 13, 20):
        assert [int(windows(h[i : i + k], k)[0]) for i in range(51 - k)] == windows(h, k).tolist()


def test_long_texts(spark):
    """A passage of a text of several MB, which also stands in short ones."""
    import random

    rng = random.Random(1)
    long_ = [f"w{rng.randrange(10**6)}" for _ in range(700_000)]
    rows = [(5, " ".join(long_)), (2, " ".join(long_[350_000:350_060])), (9, " ".join(["x"] + long_[:25]))]
    got = sorted((tuple(r) for r in substrings.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == brute(rows) and [r[2] for r in got] == [0, 60, 25]
