import random

import pyarrow as pa

from larch.llm import quality
from tests.llm.conftest import words


def brute(text):
    w = words(text)
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i : i + 5]), []).append(i)
    covered, longest = set(), 0
    for places in at.values():
        if len(places) > 1:
            for i in places:
                covered |= set(range(i, i + 5))
            for a in places:
                for b in places:
                    if a < b:
                        k = 5
                        while b + k < len(w) and w[a + k] == w[b + k]:
                            k += 1
                        longest = max(longest, k)
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), longest


def measures(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return [x for b in quality.judge(iter([batch])) for x in b.to_pylist()]


def test_measures_against_brute_force():
    rng = random.Random(1)
    texts = ["", None, "a", "a b c d e f g h i j k l", "a " * 40, "x\n\nx\n x\nx", "#*$%&|<> x"]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))) for _ in range(150)]
    texts += [rng.choice(" \n\t").join(rng.choice("ab") for _ in range(rng.randrange(0, 50))) for _ in range(150)]
    for text, got in zip(texts, measures(texts), strict=True):
        n, chars, symbols, lines, repeat, longest = brute(text)
        assert (got["n_words"], got["word_chars"], got["n_symbols"], got["n_dup_lines"], got["n_repeat_words"], got["longest_repeat"]) == (n, chars, symbols, lines, repeat, longest)
        assert got["base_failed"] == (n < 10 or 100 * repeat > 20 * n)
        assert got["n_maximal_repeats"] == len(quality.repeats(text or ""))


def test_maximal_repeats_can_not_be_extended():
    rng = random.Random(2)
    for _ in range(40):
        w = [rng.choice("ab") for _ in range(40)]
        for length, places in quality.repeats(" ".join(w)):
            assert len({tuple(w[i : i + length]) for i in places}) == 1 and len(places) > 1
            assert len({w[i - 1] if i else None for i in places}) > 1 or 0 in places
            assert len({w[i + length] if i + length < len(w) else None for i in places}) > 1


def test_long_repeat_is_rejected_and_clean_text_kept():
    rng = random.Random(3)
    clean = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    passage = " ".join(f"p{i}" for i in range(150))
    rest = " ".join(f"r{i}" for i in range(1600))
    kept = [x["kept"] for x in measures([clean, f"{passage} {rest} {passage}", clean + " " + clean])]
    assert kept == [True, False, False]


def test_frames(documents, nothing):
    assert quality.quality_rules(documents).count() == documents.count()
    assert quality.quality_rules(nothing).count() == 0
    kept = quality.keep(documents)
    assert kept.schema == documents.schema
    assert sorted(r["tie"] for r in kept.collect()) == sorted(r["tie"] for r in documents.collect() if measures([r["text"]])[0]["kept"])


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["ab", "cd", "e", "fgh"]) for _ in range(rng.randrange(0, 60))) for _ in range(100)]
    want = [{k: v for k, v in x.items() if k != "doc_id"} for t in texts for x in measures([t])]
    for poor in (lambda w: (w.end - w.start).astype("uint64"), lambda w: 0 * w.start.astype("uint64")):
        monkeypatch.setattr(quality.Words, "hashes", poor)
        assert [{k: v for k, v in x.items() if k != "doc_id"} for x in measures(texts)] == want


def test_long_texts():
    """Texts over a step's bytes: a passage far from its copy, one word over and over, and short ones beside them."""
    rng = random.Random(6)
    long_ = [f"w{rng.randrange(10**7)}" for _ in range(400_000)]
    passage = [f"p{i}" for i in range(200)]
    texts = ["a b c", " ".join(passage + long_ + passage), None, " ".join(["a"] * 600_000), "x " * 9]
    got = measures(texts)
    assert got[1]["n_words"] == 400_400 and got[1]["longest_repeat"] == 200 and got[1]["n_repeat_words"] == 400 and got[1]["kept"]
    assert got[3]["n_repeat_words"] == 600_000 and got[3]["longest_repeat"] == 599_999 and not got[3]["kept"]
    assert [x["n_words"] for x in got] == [3, 400_400, 0, 600_000, 9]
