"""Quality rules by suffix-array repetition.

For every whole text the words (see words.py) form a sequence.  A suffix array over the words,
built by prefix doubling on the suffixes that still tie, gives longest-common-prefix (LCP)
intervals.  An interval of LCP l >= `min_len` is a repeated substring of l words, maximal if its
occurrences don't all follow the same word; the union of the spans of all occurrences of the maximal
ones is the covered part of the text.  A text fails when the covered fraction or the longest
maximal repeat passes its limit.  Words are compared by hashes that their bytes have confirmed.

Defined cases: a null or empty text has no words, fails the word-count rule and is rejected; a
null doc_id is carried through; repeated rows are judged each on its own; very long texts are
handled whole (n log n in their words); other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from larch.llm.words import Words, buffers, mix, pieces, windows

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A repeat may take up at most so many words, or this share of the text if that is more.
LONGEST_WORDS, LONGEST_SHARE = 100, 0.05

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "longest_repeat long, n_maximal_repeats long, base_failed boolean, kept boolean"
)
_SYMBOLS = np.zeros(256, dtype=np.int64)
_SYMBOLS[list(b"#*$%&|<>")] = 1
_GAPS = b" \t\n\r\x0b\x0c"


def suffix_ranks(h: np.ndarray, text: np.ndarray, n: int, k: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP over the positions whose k-word window occurs twice or more in the same text.

    h: word hashes; text: number of the text of each word; n: first position of the next text for each word.
    Returns (sa, lcp): positions text by text in lexicographic order of their suffixes (words compare by hash, see Words.exact),
    and the LCP in words of sa[i] with sa[i - 1] (0 at a text's first).  Positions left out share no k words
    with any other of their text, so they take part in no repeat of k words.
    """
    w = windows(h, k)
    at = np.flatnonzero(np.arange(len(w)) + k <= n[: len(w)])
    key = mix(w[at] ^ mix(text[at].astype(np.uint64), 3), 1)
    order = np.argsort(key)
    key, at = key[order], at[order]
    same = np.zeros(len(at) + 1, dtype=bool)
    same[1:-1] = key[1:] == key[:-1]
    tied = np.zeros(len(h), dtype=bool)
    tied[at[same[1:] | same[:-1]]] = True
    at = np.flatnonzero(tied)
    if not len(at):
        return at, np.zeros(0, dtype=np.int64)
    # Ranked: the tied positions and what follows them k words later; others never decide an order.
    ranked = tied.copy()
    beyond = at + k
    ranked[beyond[beyond < n[at]]] = True
    q = np.flatnonzero(ranked)
    keys = [np.where(q + i < n[q], h[np.minimum(q + i, len(h) - 1)], np.uint64(0)) for i in range(k)]
    order = np.lexsort([*reversed(keys), text[q]])
    new = np.ones(len(q), dtype=bool)
    new[1:] = text[q][order][1:] != text[q][order][:-1]
    for x in keys:
        new[1:] |= x[order][1:] != x[order][:-1]
    q = q[order]
    # rank[p]: slot of the first position of p's group; slots never leave their group.  Unranked ones are alone.
    rank = -np.arange(1, len(h) + 1, dtype=np.int64)
    rank[q] = np.flatnonzero(new)[np.cumsum(new) - 1]
    size, levels = k, []
    slots = q.copy()
    while True:
        levels.append((size, rank))
        group = rank[slots]
        alone = np.bincount(group, minlength=len(slots))[group] == 1
        if alone.all():
            break
        open_at = slots[~alone]
        beyond = open_at + size
        follow = np.where(beyond < n[open_at], rank[np.minimum(beyond, len(h) - 1)], -len(h) - 1)
        order = np.lexsort((follow, rank[open_at]))
        open_at, follow = open_at[order], follow[order]
        old = rank[open_at]
        new = np.ones(len(open_at), dtype=bool)
        new[1:] = (old[1:] != old[:-1]) | (follow[1:] != follow[:-1])
        place = np.flatnonzero(~alone)
        slots[place] = open_at
        rank = rank.copy()
        rank[open_at] = place[np.flatnonzero(new)[np.cumsum(new) - 1]]
        size *= 2
    at = slots[tied[slots]]
    a, b = at[:-1], at[1:]
    lcp = np.zeros(len(at), dtype=np.int64)
    live = text[a] == text[b]
    total = np.zeros(len(a), dtype=np.int64)
    for size, rank in reversed(levels):
        i, j = a + total, b + total
        room = live & (i + size <= n[a]) & (j + size <= n[b])
        total += np.where(room & (rank[np.minimum(i, len(h) - 1)] == rank[np.minimum(j, len(h) - 1)]), size, 0)
    for _ in range(k - 1):  # what is left is shorter than the first level
        i, j = a + total, b + total
        hit = live & (i < n[a]) & (j < n[b]) & (h[np.minimum(i, len(h) - 1)] == h[np.minimum(j, len(h) - 1)])
        if not hit.any():
            break
        total += hit
    lcp[1:] = total
    return at, lcp


def intervals(sa: np.ndarray, lcp: np.ndarray, h: np.ndarray, first: np.ndarray, min_len: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The LCP intervals of min_len words or more that are maximal repeats: not all their occurrences follow the same word.

    Returns (length, low, high, reach): the intervals as slots sa[low] to sa[high], and for each slot the length of the
    innermost of them that holds it (0: none).  first: first position of the text of each word.  One sweep with the
    usual stack; inner intervals close first, so each slot is written once, however deep they are nested.
    """
    out, reach, bare = [], [0] * len(sa), []
    if len(sa):
        before = np.where(sa == first[sa], np.uint64(0), mix(h[np.maximum(sa - 1, 0)], 5) | np.uint64(1)).tolist()
        values = lcp.tolist() + [0]
        stack: list[list] = []  # [lcp, word before all occurrences or None if they differ, low]
        for i in range(1, len(values)):
            value, left, low = values[i], before[i - 1] or None, i - 1
            bare.append(i - 1)
            while stack and stack[-1][0] > value:
                top, own, low = stack.pop()
                left = left if left == own else None
                if top >= min_len and left is None:
                    out.append((top, low, i - 1))
                    while bare and bare[-1] >= low:
                        reach[bare.pop()] = top
            if value > 0:
                if stack and stack[-1][0] == value:
                    stack[-1][1] = left if left == stack[-1][1] else None
                else:
                    stack.append([value, left, low])
            else:
                bare.clear()
    length, low, high = np.array(out, dtype=np.int64).reshape(-1, 3).T
    return length, low, high, np.array(reach, dtype=np.int64)


def covered(sa: np.ndarray, reach: np.ndarray, n: int) -> np.ndarray:
    """Boolean per word: in the union of the spans of all occurrences of the intervals."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, sa, reach > 0)
    np.add.at(edge, sa + reach, -(reach > 0).astype(np.int64))
    return np.cumsum(edge[:-1]) > 0


def _judge(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts = batch.column(1)
    data, offsets = buffers(texts)
    words = Words(data, offsets)
    h, first, counts = words.exact(), words.first, words.counts
    n_texts = len(counts)
    text = np.repeat(np.arange(n_texts), counts)
    sa, lcp = suffix_ranks(h, text, first[1:][text])
    length, low, _, reach = intervals(sa, lcp, h, first[:-1][text], WINDOW)
    inside = covered(sa, reach, len(h))
    total = lambda x: np.concatenate(([0], np.cumsum(x, dtype=np.int64)))
    per = lambda x, at: np.diff(total(x)[at])
    repeat = per(inside, first)
    longest = np.zeros(n_texts, dtype=np.int64)
    np.maximum.at(longest, text[sa[low]], length)
    maximal = np.bincount(text[sa[low]], minlength=n_texts)
    chars = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    held = np.concatenate(([0], np.cumsum(chars[words.end] - chars[words.start])))
    symbols = per(_SYMBOLS[data], offsets)
    lines = np.zeros(n_texts, dtype=np.int64)
    raw = data.tobytes()
    for i, (lo, hi) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        parts = raw[lo:hi].split(b"\n")
        if len(parts) > 1 and len(set(parts)) < len(parts):
            solid = [x for x in parts if x.strip(_GAPS)]
            lines[i] = len(solid) - len(set(solid))
    failed = (counts < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * counts)
    kept = ~failed & (longest <= np.maximum(LONGEST_WORDS, LONGEST_SHARE * counts))
    out = [counts, np.diff(held[first]), symbols, lines, repeat, longest, maximal]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(x.astype(np.int64)) for x in out), pa.array(failed), pa.array(kept)], names=names)


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            yield _judge(piece)


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): the measures, base_failed and the verdict kept."""
    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that pass; the others go."""
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                at = [columns.index("doc_id"), columns.index("text")]
                yield piece.filter(_judge(piece.select(at)).column("kept"))

    return docs.mapInArrow(run, docs.schema)


def repeats(text: str, min_len: int = WINDOW) -> list[tuple[int, list[int]]]:
    """The maximal repeated substrings of one text: (length in words, first words of the occurrences)."""
    words = Words(*buffers(pa.array([text])))
    h = words.exact()
    zero = np.zeros(len(h), dtype=np.int64)
    sa, lcp = suffix_ranks(h, zero, np.full(len(h), len(h)), min(min_len, WINDOW))
    length, low, high, _ = intervals(sa, lcp, h, zero, min_len)
    return sorted((n, sorted(sa[lo : hi + 1].tolist())) for n, lo, hi in zip(length.tolist(), low.tolist(), high.tolist(), strict=True))
