"""Secret scans with a random forest for false-positive removal.

A candidate is a run of 16 or more token characters with letters and digits mixed, or a digit run of
16 and more; and, whatever its characters, the whole quoted or assigned value of SHORTEST or more
after a secret's name.  Most candidates are no secrets: hashes of commits, paths, names of classes, numbers,
placeholders.  A forest of decision trees in numpy, trained on labelled findings, removes these.

Features: length; character transitions, shares and entropy; dictionary coverage, the share of the candidate in
words (split at case changes) that are among the DICTIONARY most frequent ones of the corpus, counted over all
documents, or among COMMON; path, that is the depth of the document's own path, the log-odds of secrets among the
labelled findings of its directory, and the separators in the candidate; and neighbouring words, of which the
largest and the smallest log-odds count, taken from the labelled findings.  A candidate is reported if the forest's mean vote reaches THRESHOLD.

Labelled findings come from three places: those that the caller has (text before, value, after, path, label); built-in
ones, in which secrets and false positives of the same shape stand in varied places, some false ones
after a secret's name; and candidates of the corpus that rules label by a key's format or a sure sign (an address,
a date, a plain number).  These last ones are a bounded sample: the TRAIN_ROWS smallest hashes by label, equal
candidates once.  Every row of the table is scanned for candidates and scored.

Defined cases: a null or empty text has no findings; a null doc_id is carried through; a null part of a path is _;
repeated rows are scanned each on its own; very long texts are scanned whole; a table without labelled findings
leaves the built-in ones; an empty table gives no rows; other columns are kept by redact() and not read by scan().
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larch.llm.common import cut, drop
from larch.llm.words import NOT_LETTERS, Words, buffers, pieces

CANDIDATE = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: Names of secrets, by which a quoted value right after one is labelled a finding.
NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "auth", "credential", "private_key")
#: Key formats that are labelled findings wherever they stand.
FORMATS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}$|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}$|eyJ[A-Za-z0-9_-]{10,}")
ASSIGNED = re.compile(r"(?i)(?:" + "|".join(NAMES) + r")[\"']?\s*[:=]\s*[\"']?$")
SHORTEST = 6
#: A value after a secret's name: quoted up to its quote, or up to white space or a closing sign.
VALUE = re.compile(r"(?i)(?:" + "|".join(NAMES) + r")[\"']?\s*[:=]\s*(?:\"([^\"\n]{%d,})\"|'([^'\n]{%d,})'|([^\s\"']{%d,}))" % (SHORTEST, SHORTEST, SHORTEST))
#: Most labelled candidates of one label that the forest is trained on.
TRAIN_ROWS = 4_000
TREES, DEPTH, LEAST = 25, 8, 5
THRESHOLD = 0.5
AROUND = 40
FINDINGS = "doc_id long, start long, length long, digest string, score double, label int"
#: Most frequent words of the corpus that make the dictionary (8 bytes each), the fewest letters of one, and neighbouring words looked at.
DICTIONARY, WORD_LETTERS, NEAR = 1 << 16, 4, 4
LOW_32 = 2**32
#: Words of names in programs, which are in every dictionary.
COMMON = (
    "access account action address admin align annotation apache application array auth base bean binary block boolean bootstrap bottom branch browser buffer build builder button byte cache call "
    "camel case center channel character check checksum child class client close code collection color column command commit common commons component config connection container content context "
    "controller cookie count create currency custom data database date debug default delete depends digest directory display document domain double element email empty enable encode endpoint entity "
    "entry error event example exception export factory false feature field file filter float folder font format foreground frame framework function generator getter github global graph group handle handler "
    "hash header height helper here hidden home host html http https icon image implementation import index information init input insert instance integer interface internal international item java javascript "
    "json keyboard label language layout length library license limit link list listener load local locale location lock logger login long machine main manager mapper master maven member memory menu message "
    "method mime mode model module mouse name native network node null number object office open operation option order organization output package padding page parameter parent parser password path pattern "
    "payload permission person place player plugin point policy port position post prefix preference primary print private process processor product profile program project property protocol provider proxy public "
    "query queue random range reader record reference region registry release remote render replace report repository request required resolver resource response rest result return right root route runtime "
    "sample scale schedule schema screen script search section secret security select sequence serial server service session setting setup shared signature simple size socket solid sort source spring "
    "stack standard start state static status storage store stream string strict style submit success suffix support switch symbol sync system table target task template test text theme thread time title token "
    "tools transaction transform tree true type unicode unit update upload user util utils valid validation value variable vendor version video view visible warning website widget width window word worker write your"
).split()


def _drawn(rng: random.Random, alphabet: str, low: int, high: int) -> str:
    return "".join(rng.choice(alphabet) for _ in range(rng.randrange(low, high)))


def built_in(n: int = 2_000, seed: int = 7) -> list[tuple[str, str, str, str, int]]:
    """Labelled findings (path, before, value, after, label): n of either kind by a fixed seed."""
    rng = random.Random(seed)
    hexa, digits, lower, mixed = "0123456789abcdef", "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    word = lambda: rng.choice(COMMON)
    camel = lambda k: "".join(word().title() + rng.choice(("", "", "2", "4", "8")) for _ in range(k))
    prose = lambda: " ".join(word() for _ in range(rng.randrange(2, 6))) + " "
    names = [x for name in NAMES for x in (name, name.upper(), f"{word()}_{name}", f"{word()}{name.title()}")]
    paths = ("src/{}.py", "config/{}.yml", "{}/main.java", "docs/{}.md", "{}", "web/en/{}", "tests/{}.js")
    path = lambda: rng.choice(paths).format(word())
    key = lambda: rng.choice((lambda: _drawn(rng, hexa, 32, 65), lambda: _drawn(rng, hexa, 40, 41), lambda: _drawn(rng, mixed, 16, 48), lambda: _drawn(rng, mixed + "+/", 24, 60) + "=", lambda: "sk_live_" + _drawn(rng, mixed, 20, 30), lambda: "ghp_" + _drawn(rng, mixed, 36, 37)))()
    short = lambda: rng.choice((lambda: _drawn(rng, mixed + "!&$@.%", 8, 16), lambda: word()[:6] + _drawn(rng, digits, 1, 4) + _drawn(rng, lower + digits + "!&", 2, 6), lambda: _drawn(rng, mixed + "!&$@.%:", 16, 30)))()
    digest = lambda: _drawn(rng, hexa, *rng.choice(((32, 33), (40, 41), (64, 65))))

    def secret() -> tuple[str, str, str]:
        name, quote = rng.choice(names), rng.choice("\"'")
        kind = rng.randrange(7)
        if kind < 3:
            return f"{prose()}{name}{rng.choice((' = ', '=', ': '))}{quote}", rng.choice((key, short))(), quote + rng.choice(("", " and", "\n", ";"))
        if kind == 3:
            return f'{{"{name}": "', rng.choice((key, short))(), '", "' + word()
        if kind == 4:
            return f"{prose()}\nexport {name.upper()}=", key(), "\n" + word()
        if kind == 5:
            return f"https://{word()}.example.com/{word()}?{name}=", key(), rng.choice(("&", " ", "\n"))
        return f"{rng.choice(('Authorization: Bearer ', 'X-Api-Key: ', prose() + name + ' is '))}", key(), rng.choice(("\n", " ", "."))

    def other() -> tuple[str, str, str]:
        name, quote = rng.choice(names), rng.choice("\"'")
        kind = rng.randrange(12)
        if kind == 0:
            return f"{prose()}{rng.choice(('commit ', 'commit: ', 'merge ', 'revision ', 'index ', 'tree ', 'parent ', 'since '))}", digest(), rng.choice(("\n", " ", ".."))
        if kind == 1:
            return f"{rng.choice(('sha256:', 'sha1 = ' + quote, 'md5: ', 'checksum ', 'digest: ' + quote, 'etag: ' + quote, 'integrity=' + quote))}", digest(), rng.choice((quote, " ", "\n"))
        if kind == 2:
            return f"{rng.choice(('import ', 'see ', 'open ', 'path = ' + quote, 'file: ', 'in '))}", "/".join(["src", *(word() for _ in range(rng.randrange(2, 5))), camel(rng.randrange(1, 4))]), rng.choice((quote, " ", ".java"))
        if kind == 3:
            return f"{rng.choice(('class ', 'new ', 'import ', 'name = ' + quote, 'type: '))}", camel(rng.randrange(3, 6)), rng.choice(("(", " ", quote, ";"))
        if kind == 4:
            return f"{prose()}{rng.choice(('call ', 'number ', 'id ', 'card ', 'order '))}", _drawn(rng, digits, 16, 22), rng.choice((" ", ".", ","))
        if kind == 5:
            return prose(), (word() * 4)[: rng.randrange(16, 28)], " " + word()
        if kind == 6:
            return f"{prose()}{rng.choice(('', 'const ', 'def ', name + ' = '))}", "_".join(word() for _ in range(rng.randrange(3, 6))), rng.choice(("(", " ", " = ", "()"))
        if kind == 7:
            return f"{name}{rng.choice((' = ', ': ', '='))}{quote}", rng.choice((f"your_{name}_here", "change-me-please", "placeholder", "xxxx-yyyy-xxxx", "${" + word().upper() + "}", f"<{name}>", "example", word() + "-" + word())), quote
        if kind == 8:
            return f"{prose()}{name}: ", rng.choice((word() + word(), word() + "ation", word()[:5] + "ings")), rng.choice((" " + word(), ".", " as they"))
        if kind == 9:
            return f"{name} = ", f"{word()}.{word()}_{name}({word()})", "\n"
        if kind == 10:
            return rng.choice(("id: ", "uuid = " + quote, "urn:uuid:", "guid ")), "-".join(_drawn(rng, hexa, n, n + 1) for n in (8, 4, 4, 4, 12)), rng.choice((quote, " ", "\n"))
        return f"{prose()}{rng.choice(('mail ', 'to ', 'from ', 'https://'))}", f"{word()}{word()}{_drawn(rng, digits, 2, 9)}-{word()}", rng.choice(("@example.com", ".example.org/", ".com"))

    return [(path(), *made(), y) for y, made in ((1, secret), (0, other)) for _ in range(n)]


FEATURES = (
    "length", "digits", "upper", "symbols", "transitions", "transition_rate", "entropy", "distinct", "hex", "coverage", "longest_word", "separators", "quoted", "path_depth", "path_odds", "near_most", "near_least",
)
_PARTS = re.compile(r"[A-Z]?[a-z\u0080-\U0010ffff]+|[A-Z]+(?![a-z])")
_NEAR = re.compile(r"[^\W\d_]+|[=:@?]")


def kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.islower() else 2 if c.isupper() else 3


def candidates(text: str) -> Iterator[tuple[int, str]]:
    """(start, value): long runs of token characters that are more than one word or a ruled line, and values of secrets' names; they may overlap."""
    found = {}
    for m in CANDIDATE.finditer(text):
        value = m.group().strip("=-_/+")
        if len(value) >= 16 and any(c.isalnum() for c in value) and len(set(value)) > 3:
            found[m.start() + m.group().index(value), value] = None
    for m in VALUE.finditer(text):
        value = m.group(m.lastindex)
        if m.lastindex == 3:
            value = value.rstrip(".,;:)]}>")
        if len(value) >= SHORTEST and len(set(value)) > 3:
            found[m.start(m.lastindex), value] = None
    yield from sorted(found)


def _quoted(before: str, after: str) -> bool:
    return before[-1:] in ("'", '"') and before[-1:] == after[:1]


def label(before: str, value: str, after: str) -> int:
    """1: a finding, 0: none, -1: the rules can't tell."""
    digits = sum(c.isdigit() for c in value)
    if FORMATS.match(value):
        return 1
    if digits >= 4 and digits < len(value) and ASSIGNED.search(before) and len(set(value)) >= 8:
        return 1
    if ASSIGNED.search(before) and _quoted(before, after):
        return 1 if 0 < digits < len(value) and len(set(value)) >= 5 else -1
    if digits == 0 and (value.islower() or value[1:].islower()):
        return 0
    if digits == len(value) or after.startswith(("@", ".com", ".org", ".net")) or before.endswith("@") or "://" in before.split(" ")[-1]:
        return 0
    return -1


def shape(before: str, value: str, after: str) -> list[float]:
    """The features that need the candidate alone: all of FEATURES up to hex, and separators and quoted."""
    n = len(value)
    kinds = [kind(c) for c in value]
    moves = sum(a != b for a, b in zip(kinds[:-1], kinds[1:], strict=True))
    counts = [x / n for x in Counter(value).values()]
    return [
        n, kinds.count(0) / n, kinds.count(2) / n, kinds.count(3) / n, moves, moves / n, -sum(p * math.log2(p) for p in counts), len(counts) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in value)), float(sum(value.count(c) for c in "/_-.")), float(_quoted(before, after)),
    ]


def near_words(before: str, after: str) -> list[str]:
    """Words (and signs of assignment) next to a candidate, with the side they are on."""
    camel = lambda x: re.sub(r"([a-z])([A-Z])", r"\1 \2", x)
    left, right = (_NEAR.findall(camel(x).lower()) for x in (before, after))
    return sorted({"<" + w for w in left[-NEAR:]} | {">" + w for w in right[: NEAR // 2]})


class Dictionary:
    """Frequent words by the hashes of their lower-case letters."""

    def __init__(self, hashes: np.ndarray):
        own = Words(*buffers(pa.array([" ".join(w for w in COMMON if len(w) >= WORD_LETTERS)]))).hashes()
        self.hashes = np.unique(np.concatenate((hashes, own)))

    def cover(self, values: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(share of each value that is in words of the dictionary, share of the longest such word)."""
        runs = [[m for m in _PARTS.findall(v) if len(m) >= WORD_LETTERS] for v in values]
        n = np.array([len(x) for x in runs], dtype=np.int64)
        size = np.array([max(1, len(v)) for v in values], dtype=float)
        flat = [m for x in runs for m in x]
        if not flat:
            return np.zeros(len(values)), np.zeros(len(values))
        h = Words(*buffers(pa.array([" ".join(flat)])), lower=True).hashes()
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        known = (self.hashes[at] == h) * np.array([len(m) for m in flat])
        of = np.repeat(np.arange(len(values)), n)
        most = np.zeros(len(values))
        np.maximum.at(most, of, known)
        return np.bincount(of, weights=known, minlength=len(values)) / size, most / size


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words = Words(*buffers(piece.column(0)), lower=True, between=NOT_LETTERS)
            h, n = np.unique(words.hashes()[words.end - words.start >= WORD_LETTERS], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])


def dictionary(docs: DataFrame, most: int = DICTIONARY) -> Dictionary:
    """The `most` most frequent words of all texts, of those that occur more than once."""
    counts = cut(docs.select("text").mapInArrow(_counted, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1"))
    # How many words there are by power of two of their count bounds what has to be sorted.
    level, seen = 0, 0
    for r in sorted(counts.groupBy(F.length(F.bin("n")).alias("level")).count().collect(), key=lambda r: -r["level"]):
        level, seen = r["level"], seen + r["count"]
        if seen >= most:
            break
    top = counts.filter(F.length(F.bin("n")) >= level).orderBy(F.desc("n"), "h").limit(most).toArrow()
    drop(counts)
    return Dictionary(top.column("h").to_numpy().view(np.uint64))


def directory(path: str) -> str:
    return path.rsplit("/", 1)[0] if "/" in path else ""


class Judge:
    """The forest with what its features need: the dictionary, and log-odds of neighbouring words and directories.

    found: labelled findings (path, before, value, after, label); made: built-in ones, whose paths say nothing.  All
    tables are bounded by the number of findings.
    """

    def __init__(self, found: list[tuple[str, str, str, str, int]], words: Dictionary, made: list[tuple[str, str, str, str, int]] = ()):
        self.words = words
        self.near, self.places = Counter(), Counter()
        for f in found:
            self.places[directory(f[0]), f[4]] += 1
            self.places[None, f[4]] += 1
        both = [*found, *made]
        for f in both:
            self.near.update((w, f[4]) for w in near_words(f[1], f[3]))
            self.near[None, f[4]] += 1
        y = np.array([f[4] for f in both], dtype=float)
        self.forest = Forest().fit(self._features([f[:4] for f in both], [*(f[4] for f in found), *(-1 for _ in made)], y.tolist()), y)

    @staticmethod
    def _odds(counts: Counter, key: str, own: float | None) -> float:
        """Log-odds of secrets where `key` is; 0 where it is rare.  A finding's own label says nothing about itself."""
        n, total = [counts[key, 0], counts[key, 1]], [counts[None, 0], counts[None, 1]]
        if own is not None and own >= 0:
            n[int(own)] -= 1
            total[int(own)] -= 1
        if n[0] + n[1] < LEAST:
            return 0.0
        return math.log((n[1] + 1) / (total[1] + 2)) - math.log((n[0] + 1) / (total[0] + 2))

    def _features(self, found: list[tuple[str, str, str, str]], placed: list[int] | None = None, labels: list[float] | None = None) -> np.ndarray:
        """placed and labels, for findings that were counted: their labels, placed -1 where the path was not."""
        if not found:
            return np.zeros((0, len(FEATURES)))
        none = [None] * len(found)
        base = np.array([shape(*f[1:]) for f in found], dtype=float)
        cover, longest = self.words.cover([f[2] for f in found])
        rest = []
        for f, at, own in zip(found, placed or none, labels or none, strict=True):
            odds = [self._odds(self.near, w, own) for w in near_words(f[1], f[3])]
            rest.append([f[0].count("/"), self._odds(self.places, directory(f[0]), at), max(odds, default=0.0), min(odds, default=0.0)])
        return np.column_stack([base[:, :9], cover, longest, base[:, 9:], np.array(rest)])

    def vote(self, found: list[tuple[str, str, str, str]]) -> np.ndarray:
        return self.forest.vote(self._features(found))


class Forest:
    """Decision trees on balanced bootstrap rows and random features, split by Gini impurity; plain numpy."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, least: int = LEAST, seed: int = 0):
        self.n, self.depth, self.least, self.rng = trees, depth, least, np.random.default_rng(seed)
        self.trees: list[tuple[np.ndarray, ...]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        kinds = [x for x in (np.flatnonzero(y > 0), np.flatnonzero(y <= 0)) if len(x)]
        for _ in range(self.n):  # as many rows of either label
            rows = np.concatenate([self.rng.choice(k, len(y) // len(kinds)) for k in kinds])
            nodes: list[list] = []
            self._grow(x[rows], y[rows], self.depth, nodes)
            self.trees.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, nodes: list[list]) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, float(y.mean())])  # feature, bound, left, right, vote
        if depth and len(y) >= 2 * self.least and 0 < y.sum() < len(y):
            best = None
            for f in self.rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])))]:
                order = np.argsort(x[:, f], kind="stable")
                v, ones = x[order, f], np.cumsum(y[order])
                n = np.arange(1, len(y))
                left, right = ones[:-1], ones[-1] - ones[:-1]
                gini = left * (n - left) / n + right * (len(y) - n - right) / (len(y) - n)
                ok = (v[1:] > v[:-1]) & (n >= self.least) & (len(y) - n >= self.least)
                if ok.any():
                    i = int(np.argmin(np.where(ok, gini, np.inf)))
                    if best is None or gini[i] < best[0]:
                        best = (gini[i], int(f), (v[i] + v[i + 1]) / 2)
            if best:
                go = x[:, best[1]] <= best[2]
                left = self._grow(x[go], y[go], depth - 1, nodes)
                right = self._grow(x[~go], y[~go], depth - 1, nodes)
                nodes[me][:4] = [best[1], best[2], left, right]
        return me

    def vote(self, x: np.ndarray) -> np.ndarray:
        """Mean share of findings in the leaves that each row reaches."""
        total = np.zeros(len(x))
        for feature, bound, left, right, vote in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.depth):
                f = feature[at]
                go = x[np.arange(len(x)), np.maximum(f, 0)] <= bound[at]
                at = np.where(f < 0, at, np.where(go, left[at], right[at]))
            total += vote[at]
        return total / max(1, len(self.trees))


def _found(text: str) -> list[tuple[int, str, str, str]]:
    return [(s, text[max(0, s - AROUND) : s], v, text[s + len(v) : s + len(v) + AROUND]) for s, v in candidates(text)]


_LABELLED = "y int, h long, path string, before string, value string, after string"


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from zlib import crc32

    for batch in batches:
        for piece in pieces(batch, column="text"):
            rows = set()
            for path, text in zip(*(piece.column(i).to_pylist() for i in (0, 1)), strict=True):
                for _, before, value, after in _found(text or ""):
                    y = label(before, value, after)
                    if y >= 0:
                        rows.add((y, crc32(f"{before}\0{value}\0{after}".encode()), path, before, value, after))
            # A piece's smallest hashes hold all of the table's smallest ones that are in it.
            few = list(chain(*(sorted(r for r in rows if r[0] == y)[:TRAIN_ROWS] for y in (0, 1))))
            kinds = (pa.int32(), pa.int64(), *[pa.string()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in few], t) for i, t in enumerate(kinds)], names=[x.split()[0] for x in _LABELLED.split(", ")])


def corpus_findings(docs: DataFrame, rows: int = TRAIN_ROWS) -> list[tuple[str, str, str, str, int]]:
    """At most `rows` labelled candidates of each label in docs, equal ones once: those with the smallest hashes."""
    found = cut(_texts(docs).select("path", "text").mapInArrow(_labelled, _LABELLED).groupBy("y", "h", "before", "value", "after").agg(F.min("path").alias("path")))
    # Hashes spread evenly over 32 bits, so a bound on them leaves few rows to sort, from however many tasks.
    counts = {r["y"]: r["count"] for r in found.groupBy("y").count().collect()}
    out = []
    for y in (1, 0):
        bound = LOW_32 * min(1.0, 2 * rows / max(1, counts.get(y, 0)))
        got = found.filter((F.col("y") == y) & (F.col("h") < bound)).orderBy("h", "before", "value", "after").limit(rows).collect()
        out += [(r["path"], r["before"], r["value"], r["after"], y) for r in got]
    drop(found)
    return out


def train(docs: DataFrame, rows: int = TRAIN_ROWS, labelled: list[tuple[str, str, str, str, int]] | None = None) -> Judge:
    """A judge from the built-in findings, the corpus' own labelled ones and the caller's (path, before, value, after, label)."""
    return Judge([*corpus_findings(docs, rows), *(labelled or [])], dictionary(docs), built_in())


def _texts(docs: DataFrame) -> DataFrame:
    """doc_id, path and text; the path is the column of that name, or else source/lang/doc_id as far as they are there."""
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("_"))
    have = ["path"] if "path" in docs.columns else [c for c in ("source", "lang", "doc_id") if c in docs.columns]
    doc_id = F.col("doc_id").cast("long") if "doc_id" in docs.columns else F.lit(None).cast("long")
    return docs.select(doc_id.alias("doc_id"), F.concat_ws("/", *[part(c) for c in have]).alias("path"), F.col("text").cast("string").alias("text"))


def judged(paths: list[str], texts: list[str], judge: Judge) -> list[list[tuple[int, str, float, int]]]:
    """(start, value, score, label) of the candidates of each text."""
    found = [_found(t) for t in texts]
    votes = iter(judge.vote([(p, *f[1:]) for p, fs in zip(paths, found, strict=True) for f in fs]).tolist())
    return [[(f[0], f[2], next(votes), label(*f[1:])) for f in fs] for fs in found]


def scan(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """doc_id, start, length, digest (sha256 of the value), score, label of every candidate in docs (doc_id, text; path, or source and lang).

    start and length count characters; label is what the rules say (-1: nothing); values themselves are not given out.
    """
    judge = judge or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                found = judged(piece.column(1).to_pylist(), [x or "" for x in piece.column(2).to_pylist()], judge)
                rows = [(i, s, len(v), hashlib.sha256(v.encode()).hexdigest(), p, y) for i, fs in zip(piece.column(0).to_pylist(), found, strict=True) for s, v, p, y in fs]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int32())
                names = [x.split()[0] for x in FINDINGS.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return _texts(docs).mapInArrow(run, FINDINGS)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans with overlapping ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in spans:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def redact(docs: DataFrame, judge: Judge | None = None, mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """docs with every reported secret in `text` replaced by `mask`, and n_chars (if there) counted anew; other rows as they are."""
    judge = judge or train(docs)
    counted = "n_chars" in docs.columns
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            for piece in pieces(batch):
                paths, piece = piece.column(n).to_pylist(), piece.select(list(range(n)))
                texts = piece.column(at).to_pylist()
                out, sizes = list(texts), piece.column(batch.schema.get_field_index("n_chars")).to_pylist() if counted else []
                for i, found in enumerate(judged(paths, [x or "" for x in texts], judge)):
                    for start, end in reversed(_merged([(f[0], f[0] + len(f[1])) for f in found if f[2] >= threshold])):
                        out[i] = out[i][:start] + mask + out[i][end:]
                    if counted and out[i] != texts[i]:
                        sizes[i] = len(out[i])
                piece = piece.set_column(at, piece.schema.field(at), pa.array(out, piece.schema.field(at).type))
                if counted:
                    k = piece.schema.get_field_index("n_chars")
                    piece = piece.set_column(k, piece.schema.field(k), pa.array(sizes, piece.schema.field(k).type))
                yield piece

    # The path travels behind the row's own columns, under a name that none of them has.
    own, name = docs.columns, "_path"
    while name in own:
        name += "_"
    path = [F.coalesce(F.col(c).cast("string"), F.lit("_")) for c in (["path"] if "path" in own else [c for c in ("source", "lang", "doc_id") if c in own])]
    return docs.withColumn(name, F.concat_ws("/", *path)).mapInArrow(run, docs.schema)
