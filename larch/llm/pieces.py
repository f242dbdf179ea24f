"""SentencePiece encoding and decoding by a shared-prefix Viterbi.

Texts are cut into marked words: a run of spaces (the mark) with what follows it.  No piece of the
vocabulary crosses such a cut (checked when the model is read), so each distinct word is encoded
once per task (while the task remembers it: WORDS).  Distinct words are sorted, which lays them out as a
trie in depth-first order.  A node of the trie is a prefix; its forward score, its best last piece and the
node before that piece are computed once and read by all words below it.  Ids live in flat arrays by the
words' 64-bit hashes, so Python runs for words only that the task has not met.

Forward scores.  For a unigram model the score of a prefix is the largest sum of piece scores, as
usual.  A BPE model has ranks for scores, and the path with the best sum of ranks has other ids than
the model's.  There the step to a piece is allowed only if merging by rank would keep the two pieces
apart: by the theorem that a sequence is the merge result if and only if every adjacent pair is the
merge result of its own text, exactly one path is allowed, its sum is the score, and its ids are those
of the model.  Words with several spaces in front are merged by rank directly, as pieces of spaces
share one score, for which the theorem doesn't hold.

Characters without a piece become their UTF-8 bytes (byte fallback), so decoding restores the text.

Defined cases: null and empty texts have no ids; a null doc_id is carried through; texts of any
length, with or without spaces, are encoded whole; decoding null gives null, and drops the dummy
prefix; a literal mark U+2581 in a text is the same as a space, as in the library; null and unknown ids
decode to the unknown mark; repeated rows are encoded each on its own; other columns are not read by
encode(), and kept by neither; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame

from larch.llm.words import _BASE, _BYTE, buffers, mix, pieces

MARK = "▁"
#: The model's path where neither an argument nor the session's SETTING gives one.
MODEL, SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.larch.sentencepiece.model"
_MARK = MARK.encode()
#: Distinct words that a task remembers (some 40 bytes each), and pairs of pieces.
WORDS, PAIRS = 1 << 20, 200_000
#: Score of a character without a piece: below every piece's.
UNKNOWN = -1e6
#: Ids decoded at once (or those of one longer text).
IDS = 1 << 20
ENCODED = "doc_id long, n_tokens long, ids array<int>"


class Model:
    """Pieces, scores and kinds of a SentencePiece model file; small enough to travel with the tasks."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bpe = sp.encode("a b", out_type=int) is not None and self._kind(path) == 2
        self.text: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.bytes = [0] * 256
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.text.append(b"" if sp.is_control(i) else " ⁇ ".encode())
            else:
                self.ids[piece], self.score[piece] = i, sp.get_score(i)
                self.text.append(piece.replace(MARK, " ").encode())
        if any(x > 0 and p[x - 1] != MARK for p in self.ids for x, c in enumerate(p) if c == MARK):
            raise ValueError("a piece has a space after another character; words can't be encoded apart")
        # Line ends are cut off as well if no piece holds one next to another character.
        self.lines = not any("\n" in p and len(p) > 1 for p in self.ids)

    @staticmethod
    def _kind(path: str) -> int:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        n = model.normalizer_spec
        if n.precompiled_charsmap or n.remove_extra_whitespaces or not n.add_dummy_prefix or not model.trainer_spec.byte_fallback:
            raise ValueError("only models without normalisation, with a dummy prefix and byte fallback, restore texts")
        return model.trainer_spec.model_type


def merge(word: str, score: dict[str, float]) -> list[str]:
    """The word's characters merged by rank: best score first, leftmost of equal ones."""
    parts = list(word)
    while len(parts) > 1:
        best, at = None, -1
        for i in range(len(parts) - 1):
            s = score.get(parts[i] + parts[i + 1])
            if s is not None and (best is None or s > best):
                best, at = s, i
        if at < 0:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Encoder:
    """Encodes sorted distinct words over their trie, depth first; a node's forward score is computed once.

    A node is a prefix of a word: its score, its last piece and the node before that piece.  Sorted words visit the
    trie in depth-first order, and the nodes up to the prefix shared with the word before are reused.  The pieces that
    end at a node come from an automaton whose state is the longest suffix that some piece begins with; states are
    made as they are met.
    """

    def __init__(self, model: Model):
        self.model = model
        self.prefixes = {p[:k] for p in model.ids for k in range(1, len(p) + 1)}
        self.score, self.name = [0.0] * len(model.text), dict(zip(model.ids.values(), model.ids, strict=True))
        for p, i in model.ids.items():
            self.score[i] = model.score[p]
        self.states, self.number, self.go, self.ends = [""], {"": 0}, [{}], [()]
        self.unknown: dict[str, int] = {}
        self.pairs: dict[int, bool] = {}

    def _id(self, piece: str) -> int:
        """The piece's id; characters without one get numbers beyond the model's."""
        own = self.model.ids.get(piece)
        if own is None:
            own = self.unknown.get(piece)
            if own is None:
                own = self.unknown[piece] = len(self.score)
                self.name[own] = piece
                self.score.append(UNKNOWN)
        return own

    def _follow(self, state: int, c: str) -> int:
        s = self.states[state] + c
        while len(s) > 1 and s not in self.prefixes:
            s = s[1:]
        to = self.number.get(s)
        if to is None:
            to = self.number[s] = len(self.states)
            self.states.append(s)
            self.go.append({})
            tails = (s[k:] for k in range(len(s)))
            self.ends.append(tuple((self._id(x), len(x)) for x in tails if len(x) == 1 or x in self.model.ids))
        self.go[state][c] = to
        return to

    def _apart(self, before: int, piece: int, key: int) -> bool:
        """Whether merging leaves the two pieces as they are (the piece alone at a word's begin)."""
        if len(self.pairs) > 2 * PAIRS:
            self.pairs.clear()
        both = [self.name[i] for i in (before, piece) if i >= 0]
        out = self.pairs[key] = merge("".join(both), self.model.score) == both
        return out

    def walk(self, words: list[str], shared: list[int]) -> tuple[np.ndarray, ...]:
        """(last node of each word, and by node: piece, node before it, number of pieces, score) for sorted words.

        shared: how many characters each word has in common with the one before.
        """
        go, ends, score, pairs, bpe = self.go, self.ends, self.score, self.pairs, self.model.bpe
        piece, back, count, total = [-1], [0], [0], [0.0]
        path, states, last = [0], [0], []
        for word, keep in zip(words, shared, strict=True):
            del path[keep + 1 :], states[keep + 1 :]
            state = states[keep]
            for end, c in enumerate(word[keep:], keep + 1):
                to = go[state].get(c)
                state = self._follow(state, c) if to is None else to
                if bpe:
                    for own, n in ends[state]:
                        at = path[end - n]
                        key = piece[at] << 32 | own
                        ok = pairs.get(key)
                        if self._apart(piece[at], own, key) if ok is None else ok:
                            break
                    else:
                        raise AssertionError("no path")
                    best = total[at] + score[own]
                else:
                    best = None
                    for i, n in ends[state]:
                        s = total[path[end - n]] + score[i]
                        if best is None or s > best:
                            best, own, at = s, i, path[end - n]
                path.append(len(piece))
                states.append(state)
                piece.append(own)
                back.append(at)
                count.append(count[at] + 1)
                total.append(best)
            last.append(path[-1])
        return tuple(np.array(x, dtype=t) for x, t in ((last, np.int64), (piece, np.int32), (back, np.int64), (count, np.int64), (total, float)))

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, all ids one after another); words must be distinct and sorted."""
        spaced = [self.model.bpe and w.startswith(MARK * 2) for w in words]
        plain = [w for w, x in zip(words, spaced, strict=True) if not x]
        last, piece, back, count, _ = self.walk(plain, shared_prefixes(plain).tolist())
        sizes = np.zeros(len(words), dtype=np.int64)
        spaced = np.array(spaced, dtype=bool)
        sizes[~spaced] = count[last]
        other = [[self._id(x) for x in merge_long(words[i], self.model.score)] for i in np.flatnonzero(spaced).tolist()]
        sizes[spaced] = [len(x) for x in other]
        ends = np.cumsum(sizes)
        flat = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for ids, end in zip(other, ends[spaced].tolist(), strict=True):
            flat[end - len(ids) : end] = ids
        # All words go back along their best paths at once, a piece a step.
        at, node = ends[~spaced], last
        while len(node):
            at = at - 1
            flat[at] = piece[node]
            node = back[node]
            at, node = at[node > 0], node[node > 0]
        return self._bytes(sizes, flat)

    def _bytes(self, sizes: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with the ids of their UTF-8 bytes in place of characters without a piece."""
        known = len(self.model.text)
        if not (flat >= known).any():
            return sizes, flat
        lists = [[i] for i in range(known)] + [[self.model.bytes[x] for x in c.encode()] for c in self.unknown]
        length = np.array([len(x) for x in lists])
        out = _ragged(np.array([i for x in lists for i in x], dtype=np.int32), np.cumsum(length) - length, length, flat)
        return np.diff(np.concatenate(([0], np.cumsum(length[flat])))[np.concatenate(([0], np.cumsum(sizes)))]), out


def shared_prefixes(words: list[str]) -> np.ndarray:
    """How many characters each word has in common with the one before it."""
    n = np.array([len(w) for w in words], dtype=np.int64)
    out = np.zeros(len(words), dtype=np.int64)
    chars = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
    head = np.cumsum(n) - n
    live = np.arange(1, len(words))
    k = 0
    while len(live):
        live = live[(n[live] > k) & (n[live - 1] > k)]
        live = live[chars[head[live] + k] == chars[head[live - 1] + k]]
        out[live] += 1
        k += 1
    return out


def merge_long(word: str, score: dict[str, float]) -> list[str]:
    """merge() by a heap, for words of any length."""
    import heapq

    part, after, before = list(word), list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(part):
            s = score.get(part[i] + part[j])
            if s is not None:
                heapq.heappush(heap, (-s, i, part[i], part[j]))

    for i in range(len(part)):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        if part[i] != a or after[i] >= len(part) or part[after[i]] != b:
            continue
        j = after[i]
        part[i], part[j], after[i] = a + b, "", after[j]
        if after[j] < len(part):
            before[after[j]] = i
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [x for x in part if x]


def _marked(piece: pa.RecordBatch, lines: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with a space before each text, starts of the marked words, first word of each text and the total)."""
    data, offsets = buffers(piece.column(1))
    raw, o = data.tobytes(), offsets.tolist()
    texts = [b" " + raw[a:b] if b > a else b"" for a, b in zip(o[:-1], o[1:], strict=True)]
    if _MARK in raw:  # a literal mark is a space
        texts = [x.replace(_MARK, b" ") for x in texts]
    offsets = np.cumsum([0, *map(len, texts)])
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    begin = np.zeros(len(data) + 1, dtype=bool)
    space = data == 32
    if len(data):
        begin[0] = True
        begin[1:-1] = space[1:] & ~space[:-1]
        if lines:
            end = data == 10
            begin[1:-1] |= end[1:] != end[:-1]
        begin[offsets] = True
    starts = np.flatnonzero(begin[:-1])
    return data, starts, np.searchsorted(starts, offsets)


def _segment_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    length = np.diff(np.append(starts, len(data)))
    place = np.arange(len(data)) - np.repeat(starts, length)
    power = np.ones(int(length.max()), dtype=np.uint64)
    with np.errstate(over="ignore"):
        power[1:] = _BASE
        power = np.cumprod(power, dtype=np.uint64)
        return mix(np.add.reduceat(_BYTE[data] * power[place], starts) + length.astype(np.uint64))


def _ragged(values: np.ndarray, heads: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values of the segments `which`, one after another."""
    n = sizes[which]
    ends = np.cumsum(n)
    return values[np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - n, n) + np.repeat(heads[which], n)]


class _Known:
    """Ids of the distinct words that a task has met, in flat arrays by the words' sorted 64-bit hashes."""

    def __init__(self) -> None:
        self.hash, self.head, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def missing(self, h: np.ndarray) -> np.ndarray:
        """Which of the sorted distinct hashes are not known."""
        if not len(self.hash):
            return np.ones(len(h), dtype=bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)] != h

    def add(self, h: np.ndarray, sizes: np.ndarray, flat: np.ndarray) -> None:
        order = np.argsort(h)
        heads = len(self.flat) + np.cumsum(sizes) - sizes
        at = np.searchsorted(self.hash, h[order])
        self.hash, self.head, self.size = (np.insert(x, at, y[order]) for x, y in ((self.hash, h), (self.head, heads), (self.size, sizes)))
        self.flat = np.concatenate((self.flat, flat))


def _encode(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, known = Encoder(model), _Known()
        for batch in batches:
            for piece in pieces(batch):
                if len(known.hash) > WORDS:
                    known = _Known()
                yield one(piece, encoder, known)

    def one(piece: pa.RecordBatch, encoder: Encoder, known: _Known) -> pa.RecordBatch:
        data, starts, first = _marked(piece, model.lines)
        sizes_of = np.zeros(len(first) - 1, dtype=np.int64)
        flat = np.zeros(0, dtype=np.int32)
        if len(starts):
            h, index, which = np.unique(_segment_hashes(data, starts), return_index=True, return_inverse=True)
            fresh = np.flatnonzero(known.missing(h))
            if len(fresh):
                raw, begin, stop = data.tobytes(), starts[index[fresh]], np.append(starts[1:], len(data))[index[fresh]]
                words = [raw[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
                # Bytes of UTF-8 sort as the characters do, and the mark stands first in all words or in none of a kind.
                order = sorted(range(len(words)), key=words.__getitem__)
                known.add(h[fresh[order]], *encoder.encode([words[i].decode().replace(" ", MARK) for i in order]))
            at = np.searchsorted(known.hash, h)[which]
            sizes = known.size[at]
            flat = _ragged(known.flat, known.head, known.size, at)
            sizes_of = np.diff(np.concatenate(([0], np.cumsum(sizes)))[first])
        offsets = np.concatenate(([0], np.cumsum(sizes_of))).astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [piece.column(0).cast(pa.int64()), pa.array(sizes_of), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["doc_id", "n_tokens", "ids"]
        )

    return run


def _decode(texts: list[bytes]):
    size = np.array([len(x) for x in texts])
    values, heads = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum(size) - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            ends = np.cumsum(batch.column(at).value_lengths().fill_null(0).to_numpy())
            lo = 0
            while lo < batch.num_rows:  # rows of IDS ids together, or one longer row
                hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + IDS, side="right"))
                part = batch.slice(lo, max(hi, lo + 1) - lo)
                lo += part.num_rows
                yield pa.RecordBatch.from_arrays([*part.columns, text_of(part.column(at))], names=[*part.schema.names, "decoded"])

    def text_of(lists: pa.Array) -> pa.Array:
        ids = lists.flatten().fill_null(0).to_numpy()
        ids = np.where((ids < 0) | (ids >= len(texts)), 0, ids)
        rows = np.concatenate(([0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy())))
        raw = _ragged(values, heads, size, ids)
        ends = np.concatenate(([0], np.cumsum(size[ids])))[rows]
        # The dummy prefix of each text goes.
        full = np.flatnonzero(ends[1:] > ends[:-1])
        drop = ends[full][raw[ends[full]] == 32]
        keep = np.ones(len(raw), dtype=bool)
        keep[drop] = False
        ends = ends - np.searchsorted(drop, ends)
        raw = raw[keep]
        begins = ends[:-1][ends[1:] > ends[:-1]]
        try:
            raw.tobytes().decode()
            whole = not ((raw[begins] & 0xC0) == 0x80).any()
        except UnicodeDecodeError:
            whole = False
        if whole:
            mask = pa.array(~lists.is_valid().to_numpy(zero_copy_only=False))
            out = pa.StringArray.from_buffers(len(lists), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(raw))
            return pa.compute.if_else(mask, pa.scalar(None, pa.string()), out)
        bounds = zip(lists.is_valid().to_pylist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True)
        return pa.array([raw[a:b].tobytes().decode(errors="replace") if valid else None for valid, a, b in bounds], pa.string())

    return run


def _model(df: DataFrame, path: str | None) -> Model:
    return Model(path or df.sparkSession.conf.get(SETTING, MODEL))


def encode(docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens and ids of each row of docs (doc_id, text); model: the path of a model file."""
    return docs.select("doc_id", "text").mapInArrow(_encode(_model(docs, model)), ENCODED)


def decode(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """encoded (doc_id, n_tokens, ids) with the text `decoded`."""
    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(_decode(_model(encoded, model).text), ENCODED + ", decoded string")
