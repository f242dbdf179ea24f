"""Substring dedup by super-k-mers.

A window is 20 consecutive words of one document.  Its minimiser is the smallest hash among its
3-word runs; consecutive windows with one minimiser form a super-k-mer, which travels as one packed
string of words to the bucket of the minimiser.  So all windows with the same words meet in one
bucket, while words are sent about 3 times and not 20.  In a bucket windows are sorted by hash;
equal hashes are confirmed byte by byte, and all but the earliest (doc_id, then start) are repeats.

Skew: within a step of PIECE bytes, equal super-k-mers travel once - a later one repeats an earlier one,
whatever the bucket says - and a bucket that passes HOLD bytes is reduced in the same way as it is read, so a
passage of all documents is held once.  Minimisers that are frequent all the same (counted in a first pass over all
documents) don't share a bucket: their windows travel one by one, each to the bucket of its whole
hash.  The list of those is bounded (HOT_MOST entries), as each holds a share of all super-k-mers.

Strings are packed by bucket and compressed before the shuffle, so a row is a block.

Defined cases: a null text has no words; texts under 20 words are kept whole; a null doc_id counts
as smaller than all others; rows that repeat a doc_id are judged each on its own, and of two windows
with the same doc_id and start neither is earlier; empty tables give no rows; very long texts are
handled whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larch.llm.common import cut, drop
from larch.llm.words import Words, buffers, mix, pieces, sliding_min, windows

WINDOW = 20
MINIMISER = 3
#: Text that one step holds, and a bucket before equal strings are reduced; level of compression; super-k-mers that one bucket is to hold; a minimiser with more than
#: HOT_LEAST and a share of 1 / HOT_MOST of them is split up.
PIECE = 4 << 20
HOLD = 32 << 20
LEVEL = 6
BUCKET = 60_000
HOT_LEAST, HOT_MOST = 4_096, 1 << 20
_NO_ID = -(2**63)

_BLOCK = "bucket int, texts binary, size long, docs binary, keys binary, starts binary, known binary"
_SPANS = "doc_id long, key int, start int, n int"
_SPAN = np.dtype([("doc", "<i8"), ("key", "<i4"), ("start", "<i4"), ("n", "<i4")])


def joined(words: Words, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, heads): the words, or those kept, each with a space after it; heads[i] is where word i begins (would)."""
    length = words.end - words.start
    own = length + 1 if keep is None else (length + 1) * keep
    heads = np.concatenate(([0], np.cumsum(own)))
    out = np.full(int(heads[-1]), 32, dtype=np.uint8)
    word = np.repeat(np.arange(len(length)), length)
    raw = words.data[words._solid]
    place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], np.cumsum(length)[:-1])) if len(length) else length, length) + heads[word]
    if keep is not None:
        solid = keep[word]
        raw, place = raw[solid], place[solid]
    out[place] = raw
    return out, heads


class _Runs:
    """Super-k-mers of one piece, in the order of doc_id and start."""

    def __init__(self, batch: pa.RecordBatch, hot: np.ndarray):
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        order = np.argsort(ids, kind="stable")
        batch = batch.take(pa.array(order))
        self.ids, self.keys = ids[order], batch.column(1).to_numpy(zero_copy_only=False)
        self.words = words = Words(*buffers(batch.column(2)))
        h, first = words.hashes(), words.first
        self.text = np.repeat(np.arange(len(self.ids)), words.counts)
        whole = windows(h, WINDOW)
        at = np.flatnonzero(np.arange(len(whole)) + WINDOW <= first[1:][self.text[: len(whole)]])
        least = sliding_min(windows(h, MINIMISER), WINDOW - MINIMISER + 1)[at] if len(at) else np.zeros(0, np.uint64)
        new = np.ones(len(at), dtype=bool)
        single = np.isin(least, hot) if len(hot) else np.zeros(len(at), dtype=bool)
        new[1:] = (least[1:] != least[:-1]) | (at[1:] != at[:-1] + 1) | (self.text[at[1:]] != self.text[at[:-1]]) | single[1:]
        head = np.flatnonzero(new)
        self.start = at[head]
        self.n = np.diff(np.append(head, len(at)))
        self.least = least[head]
        self.route = np.where(single[head], mix(whole[self.start], 11), mix(self.least, 12))
        self.sign = mix(whole[self.start] ^ mix(whole[self.start + self.n - 1] + self.n.astype(np.uint64), 13), 14)
        self.inner = self.start - first[self.text[self.start]] if len(head) else self.start


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(minimiser, distinct super-k-mers) where a piece holds two or more, and (null, all) once a piece."""
    for batch in batches:
        for piece in pieces(batch, limit=PIECE):
            runs = _Runs(piece, np.zeros(0, np.uint64))
            _, head = np.unique(runs.sign, return_index=True)
            least, n = np.unique(runs.least[head], return_counts=True)
            many = n >= 2
            yield pa.RecordBatch.from_arrays(
                [pa.array([*least[many].view(np.int64).tolist(), None], pa.int64()), pa.array([*n[many].tolist(), len(head)], pa.int64())], names=["least", "n"]
            )


def _pack(hot: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                yield from block(piece)

    def block(piece: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs = _Runs(piece, hot)
        if not len(runs.start):
            return
        text, heads = joined(runs.words)
        raw = text.tobytes()
        lo, hi = heads[runs.start], heads[runs.start + runs.n + WINDOW - 1] - 1
        where = runs.text[runs.start]
        docs, keys, inner = runs.ids[where], runs.keys[where], runs.inner
        # Equal strings travel once: the first in (doc_id, start) order, and any at the very same place.
        seen: dict[bytes, int] = {}
        strings, goes, known = [], [], []
        d, s = docs.tolist(), inner.tolist()
        for i, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True)):
            x = raw[a:b]
            j = seen.setdefault(x, i)
            if j == i or (d[j] == d[i] and s[j] == s[i]):
                goes.append(i)
                strings.append(x)
            else:
                known.append(i)
        goes = np.array(goes, dtype=np.int64)
        bucket = (runs.route[goes] % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        spans = np.zeros(len(known), dtype=_SPAN)
        spans["doc"], spans["key"], spans["start"], spans["n"] = docs[known], keys[known], inner[known], runs.n[known]
        rows: list[list] = [[] for _ in range(7)]
        size = 0
        for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            own = order[a:b]
            which = goes[own]
            packed = b"\n".join([strings[i] for i in own.tolist()])
            at = (spans[k :: len(cuts) - 1]).tobytes()
            parts = [int(bucket[own[0]]), _zip(packed), len(packed), *(_zip(x.tobytes()) for x in (docs[which], keys[which].astype("<i4"), inner[which].astype("<i4"))), at]
            for row, x in zip(rows, parts, strict=True):
                row.append(x)
            size += len(parts[1])
            if size > PIECE:
                yield _block(rows)
                rows, size = [[] for _ in range(7)], 0
        if rows[0]:
            yield _block(rows)

    return run


def _zip(x: bytes) -> bytes:
    return len(x).to_bytes(8, "little") + pa.Codec("zstd", compression_level=LEVEL).compress(x, asbytes=True)


def _unzip(x: bytes) -> bytes:
    return pa.decompress(x[8:], decompressed_size=int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True)


def _block(rows: list[list]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.binary(), pa.int64(), *[pa.binary()] * 4)
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])


def repeats(text: bytes, docs: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Spans (doc, key, start, n) of the windows of one bucket that begin earlier elsewhere.

    text: super-k-mers, one by line; docs, keys, starts: where each begins.
    """
    data = np.frombuffer(text, dtype=np.uint8)
    edges = np.concatenate(([0], np.flatnonzero(data == 10) + 1, [len(data) + 1]))
    offsets = np.minimum(edges, len(data))
    words = Words(data, offsets)
    whole = windows(words.hashes(), WINDOW)
    n = words.counts - WINDOW + 1
    by = np.lexsort((starts, docs))
    n_by = n[by]
    run = np.repeat(by, n_by)
    step = np.arange(len(run)) - np.repeat(np.cumsum(n_by) - n_by, n_by)
    at = words.first[run] + step
    h = whole[at]
    order = np.argsort(h)
    sorted_h = h[order]
    same = np.zeros(len(h) + 1, dtype=bool)
    same[1:-1] = sorted_h[1:] == sorted_h[:-1]
    tied = same[1:] | same[:-1]
    left = order[tied]
    group = np.cumsum(~same[:-1][tied])
    inner = np.lexsort((left, group))  # within a group by (doc, start)
    left, group = left[inner], group[inner]
    head = left[np.searchsorted(group, group)]
    lo, hi = words.start[at], words.end[at + WINDOW - 1]
    later = (docs[run[left]] != docs[run[head]]) | (starts[run[left]] + step[left] != starts[run[head]] + step[head])
    left, head = left[later], head[later]
    a, b, c, d = (x.tolist() for x in (lo[left], hi[left], lo[head], hi[head]))
    equal = [text[i:j] == text[k:m] for i, j, k, m in zip(a, b, c, d, strict=True)]
    found = left
    if not all(equal):  # unequal windows share a 64-bit hash: settle their groups by their words
        keep = np.array(equal)
        firsts: dict[bytes, tuple] = {}
        odd = np.isin(head, head[~keep])
        members = np.unique(np.concatenate((left[odd], head[odd])))
        extra = []
        for i in members.tolist():
            place = (docs[run[i]], starts[run[i]] + step[i])
            if firsts.setdefault(text[lo[i] : hi[i]], place) != place:
                extra.append(i)
        found = np.concatenate((left[~odd], np.array(extra, dtype=np.int64)))
    found = np.sort(found)
    fresh = np.ones(len(found), dtype=bool)
    fresh[1:] = (found[1:] != found[:-1] + 1) | (run[found[1:]] != run[found[:-1]])
    first = np.flatnonzero(fresh)
    out = np.zeros(len(first), dtype=_SPAN)
    which = run[found[first]]
    out["doc"], out["key"], out["start"] = docs[which], keys[which], starts[which] + step[found[first]]
    out["n"] = np.diff(np.append(first, len(found)))
    return out


class _Bucket:
    """Super-k-mers of one bucket; equal strings are reduced to the earliest whenever HOLD more bytes have come."""

    def __init__(self) -> None:
        self.texts: list[bytes] = []
        self.places: list[np.ndarray] = []
        self.spans: list[np.ndarray] = []
        self.size = self.floor = 0

    def add(self, text: bytes, docs: bytes, keys: bytes, starts: bytes, known: bytes) -> None:
        text = _unzip(text)
        place = np.zeros(text.count(b"\n") + 1, dtype=_SPAN)
        place["doc"], place["key"], place["start"] = (np.frombuffer(_unzip(x), t) for x, t in ((docs, "<i8"), (keys, "<i4"), (starts, "<i4")))
        self.texts.append(text)
        self.places.append(place)
        if known:
            self.spans.append(np.frombuffer(known, _SPAN))
        self.size += len(text)
        if self.size > self.floor + HOLD:
            self.reduce()

    def reduce(self) -> None:
        """Of equal strings the earliest stays, with any at its very place; the others are repeats from end to end."""
        strings = b"\n".join(self.texts).split(b"\n")
        places = np.concatenate(self.places)
        order = np.lexsort((places["start"], places["doc"])).tolist()
        first: dict[bytes, int] = {}
        stays, goes = [], []
        for i in order:
            j = first.setdefault(strings[i], i)
            at, own = places[j], places[i]
            (stays if at["doc"] == own["doc"] and at["start"] == own["start"] else goes).append(i)
        late = places[goes]
        late["n"] = [strings[i].count(b" ") + 2 - WINDOW for i in goes]
        self.spans.append(late)
        self.texts, self.places = [b"\n".join([strings[i] for i in stays])], [places[stays]]
        self.size = self.floor = len(self.texts[0])

    def close(self) -> pa.RecordBatch:
        places = np.concatenate(self.places)
        found = repeats(b"\n".join(self.texts), places["doc"], places["key"], places["start"].astype(np.int64))
        return _spans(np.concatenate([found, *self.spans]))


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bucket, held = None, None
    for batch in batches:
        columns = [batch.column(i) for i in range(batch.num_columns)]
        for i, own in enumerate(columns[0].to_pylist()):
            if own != bucket:
                if held:
                    yield held.close()
                bucket, held = own, _Bucket()
            held.add(*(columns[k][i].as_py() for k in (1, 3, 4, 5, 6)))
    if held:
        yield held.close()


def _spans(x: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x[k])) for k in ("doc", "key", "start", "n")], names=["doc_id", "key", "start", "n"])


def _apply(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                yield one(piece)

    def one(piece: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(*buffers(piece.column(1)))
        spans = piece.column(2)
        text = np.repeat(np.arange(len(spans)), np.diff(spans.offsets.to_numpy()))
        flat = spans.flatten()
        start, n = flat.field("start").to_numpy(), flat.field("n").to_numpy()
        edge = np.zeros(len(words) + 1, dtype=np.int64)
        np.add.at(edge, words.first[text] + start, 1)
        np.add.at(edge, words.first[text] + start + n + WINDOW - 1, -1)
        keep = np.cumsum(edge[:-1]) == 0
        raw, heads = joined(words, keep)
        raw, at = raw.tobytes(), heads[words.first].tolist()
        kept = [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
        lost = np.concatenate(([0], np.cumsum(~keep)))[words.first]
        out = [piece.column(0).cast(pa.int64()), pa.array(words.counts.astype(np.int64)), pa.array(np.diff(lost).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept])]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if with_text:
            out, names = [*out, pa.array([x.decode() for x in kept])], [*names, "kept_text"]
        return pa.RecordBatch.from_arrays(out, names=names)

    return run


def _key() -> Column:
    """Tells rows that repeat a doc_id apart by their text; equal rows fare alike."""
    return (F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)) - 2**31).cast("int")


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (crc32 of the text), start, n: runs of windows whose words also start earlier in docs."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _key().alias("key"), "text").filter("text is not null")
    counts = {r["least"]: r["n"] for r in _heavy(rows.mapInArrow(_count, "least long, n long"))}
    total = counts.pop(None, 0)
    hot = np.sort(np.array(list(counts), dtype=np.int64).view(np.uint64)) if counts else np.zeros(0, np.uint64)
    buckets = max(16, -(-total // BUCKET))
    blocks = rows.mapInArrow(_pack(hot, buckets), _BLOCK)
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_judge, _SPANS)


def _heavy(counted: DataFrame) -> list:
    """The total (least is null), and the minimisers with more than their share: HOT_MOST rows at most."""
    sums = cut(counted.groupBy("least").agg(F.sum("n").alias("n")))
    total = sums.filter("least is null").agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    found = sums.filter(F.col("least").isNull() | (F.col("n") > max(HOT_LEAST, total // HOT_MOST))).collect()
    drop(sums)
    return found


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) by row of docs (doc_id, text)."""
    spans = repeated_spans(docs)
    spans = spans.groupBy("doc_id", "key", "start").agg(F.max("n").alias("n"))
    spans = spans.groupBy(F.col("doc_id").alias("_doc"), F.col("key").alias("_key")).agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_crc", _key())
    rows = rows.join(spans, (F.coalesce("doc_id", F.lit(_NO_ID)) == F.col("_doc")) & (F.col("_crc") == F.col("_key")), "left")
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return rows.select("doc_id", "text", "spans").mapInArrow(_apply(with_text), schema)
