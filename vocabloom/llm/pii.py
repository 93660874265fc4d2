"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds what they miss."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import slices, with_columns

KINDS = ("email", "ip", "card", "phone")
SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            last = found.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _DOTTED.finditer(text):
        parts, start = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield start, end
            start = end + 1


def _luhn(digits: str) -> bool:
    doubled = (int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits)))
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and _luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield m.span()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns in code points, by kind and then start."""
    finders = zip(KINDS, (_emails, _ips, _cards, _phones), strict=True)
    return [(kind, *span) for kind, find in finders for span in find(text)]


#: The labelled table: sentences in which [kind words] marks personal data that the patterns don't find, and none in others.
LABELLED = """
call me on [phone (212) 555-0182] after noon
call [phone (415) 555-0119] or write
our number is [phone (303) 555-0147] in town
the office ( [phone 646-555-0101] ) is open
phone [phone 718-555-0163] today
fax [phone 202-555-0172] and ask
dial [phone 312.555.0190] for help
reach him at [phone 503.555.0126] at night
tel [phone (617) 555-0155] or [phone 617-555-0156]
text [phone 808-555-0134] please
write to [email anna.bell [at] mail [dot] example] now
write to [email joe [at] example [dot] com] please
contact [email info (at) example (dot) org] for it
mail [email sales (at) shop (dot) example] and wait
or [email m.weber [at] post [dot] example] instead
the host [ip 2001:db8::1] is down
from [ip fe80::1ff:fe23:4567:890a] to us
ping [ip 2001:db8:85a3::8a2e:370:7334] again
server [ip 2001:db8:0:1::5] answered
route via [ip fe80::2] only
in 2019 we had 14 of 20
chapter 12 and 13.5 of 2.0
version 2.0 of 1999-12-31
on 12/05/2020 at 10:30 they met
at 10:45:30 it was 98.6 of 100
it costs 1,250.00 or 15 euros
room 101 and line 4 of page 77
token = 839756d1d951091d9155cd2a457ceedd23acaf1e was set
password=b7db7aa4a5fcc78305 was old
key AKIAM2HKU6VBLCCCCE4 was new
the number 40418949746 and 4753376719988204 are long
order 123-45-678901 came in 3 parts
isbn 978-3-16-148410-0 is a book
items 1 2 3 4 5 6 7 8 of 10
about 555 or 212 of 0182
from 10.5.2020 to 11.5.2020
see [1] and (2) and [3]
the years 1990-2000 and 2001-2005
between 100-200-300 parts
ratio 3:2 and 16:9 of 4:3
at a1b2c3d4 and 0xdeadbeef there
a [at] sign and a (dot) there
""".strip().splitlines()

_EDGE = "\"'<>,;!?*#$%&|{}="
_WORD = re.compile(r"\S+")
#: No datum of the labelled table's kinds has a longer word; longer ones are split at all that can't be in one.
_LONG = 64
_LONGER = re.compile(r"\S{65,}")
_OTHER = re.compile(r"[^\w\s.:+()\[\]-]|_")
_BLANKED = str.maketrans(dict.fromkeys(_EDGE, " "))
_PIECE = 1 << 20
_MARK = re.compile(r"[\[(](?:at|dot)[\])]", re.IGNORECASE)
_PIECES = re.compile(r"\[(email|ip|card|phone) ((?:[^][]|\[[a-z]+\])*)\]|(\S+)")


def shape(word: str) -> str:
    """A word's shape: digits d, letters x (hexadecimal ones h next to a colon), others themselves; runs of over four letters or digits are cut to five."""
    if _MARK.fullmatch(word):
        return word.lower().translate({91: 40, 93: 41})
    word = word.strip(_EDGE).rstrip(".,;:")
    if word.isalpha():
        return "x"
    colon = word.count(":") > 1
    out: list[str] = []
    for c in word:
        s = "d" if c.isdecimal() else "h" if colon and c in "abcdefABCDEF" else "x" if c.isalpha() else c
        if colon and s in "dh":
            s = "h"
            if out[-1:] == ["h"]:
                continue
        elif out[-5:] == [s] * 5 or (s == "x" and out[-1:] == ["x"]):
            continue
        out.append(s)
    return "".join(out) if not colon else re.sub("(:h)+", ":h", "".join(out))


class Crf:
    """A linear-chain conditional random field; the features of a word are the shapes of it and of its neighbours."""

    def __init__(self) -> None:
        self.labels = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
        self.features: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.labels)))
        self.move = np.zeros((len(self.labels), len(self.labels)))
        self.start = np.zeros(len(self.labels))
        for i, label in enumerate(self.labels):
            if label[0] == "I":
                self.start[i] = -1e4
                self.move[[j for j, o in enumerate(self.labels) if o == "O" or o[1:] != label[1:]], i] = -1e4
        self.shapes: dict[str, int] = {}
        self.index: dict[int, int] = {}
        self.scored, self.margin, self.pulls = np.zeros((0, len(self.labels))), np.zeros((0, len(KINDS) + 1)), np.zeros((0, len(KINDS)))

    @staticmethod
    def names(before: str, own: str, after: str) -> tuple[str, ...]:
        return "bias", f"0{own}", f"-{before}|{own}", f"+{own}|{after}"

    def rows(self, shapes: list[str], before: str = "", after: str = "") -> list[list[int]]:
        around = [before, *shapes, after]
        return [[self.features[n] for n in self.names(*around[i : i + 3]) if n in self.features] for i in range(len(shapes))]

    def fit(self, sentences: list[tuple[list[str], list[str]]], epochs: int = 60, rate: float = 0.3, l2: float = 1e-3) -> Crf:
        for shapes, _ in sentences:
            around = ["", *shapes, ""]
            for i in range(len(shapes)):
                for n in self.names(*around[i : i + 3]):
                    self.features.setdefault(n, len(self.features))
        k = len(self.labels)
        self.emit = np.zeros((len(self.features), k))
        squares = [np.full_like(x, 1e-8) for x in (self.emit, self.move, self.start)]
        data = [(self.rows(s), [self.labels.index(t) for t in tags]) for s, tags in sentences]
        for _ in range(epochs):
            for rows, tags in data:
                scores = np.array([self.emit[r].sum(axis=0) for r in rows])
                n = len(rows)
                ahead, back = np.zeros((n, k)), np.zeros((n, k))
                ahead[0] = self.start + scores[0]
                for i in range(1, n):
                    ahead[i] = _logsum(ahead[i - 1][:, None] + self.move, 0) + scores[i]
                for i in range(n - 2, -1, -1):
                    back[i] = _logsum(self.move + (scores[i + 1] + back[i + 1])[None, :], 1)
                total = _logsum(ahead[-1], 0)
                grads = [l2 * self.emit, np.zeros_like(self.move), np.zeros_like(self.start)]
                grads[1] += l2 * np.where(self.move > -100, self.move, 0)
                for i, row in enumerate(rows):
                    p = np.exp(ahead[i] + back[i] - total)
                    p[tags[i]] -= 1
                    grads[0][row] += p
                    if i == 0:
                        grads[2] += p
                    else:
                        q = np.exp(ahead[i - 1][:, None] + self.move + (scores[i] + back[i])[None, :] - total)
                        q[tags[i - 1], tags[i]] -= 1
                        grads[1] += q
                for x, g, s in zip((self.emit, self.move, self.start), grads, squares, strict=True):
                    s += g * g
                    x -= rate * g / np.sqrt(s)
        return self

    def ready(self) -> Crf:
        """Number the shapes that occur in features: 0 is any other shape, 1 the edge of a text and the empty shape."""
        self.shapes = {"": 1}
        for name in self.features:
            for x in name[1:].split("|") if name != "bias" else ():
                self.shapes.setdefault(x, len(self.shapes) + 1)
        self.names_of = {i: x for x, i in self.shapes.items()} | {0: "\0"}
        self.base = len(self.shapes) + 1
        x = self.shapes.get("x", 0)
        self.plain = (x * self.base + x) * self.base + x
        self.row(self.plain)
        self.reach = self._reach()
        return self

    def _reach(self) -> float:
        """Of a row of plain words (letters among letters), all but so many before its end are O on a best path; infinite if that can't be said.

        A datum that lies in the row or ends there loses nothing if its words of the row turn O. One that goes on after the
        row loses at most a fixed sum, as its next word turns B, but gains something for each word that turns O.
        """
        s, move = self.scored[0], self.move
        outside = [i for i in range(len(self.labels)) if i == 0 or i % 2]
        sides = defaultdict(lambda: np.zeros(len(self.labels)))
        for name, i in self.features.items():
            sides[name[0] if name != "bias" else "b"] = np.maximum(sides[name[0] if name != "bias" else "b"], np.append(0, self.emit[i][1:] - self.emit[i][:-1]))
        reach = 0.0
        for first in range(1, len(self.labels), 2):
            inner = first + 1
            each = s[0] - s[inner] + move[0, 0] - move[inner, inner]
            begun = s[0] - s[first] + min(self.start[0] - self.start[first], *(move[p, 0] - move[p, first] for p in range(len(self.labels))))
            tail = min(move[p, 0] - move[p, inner] for p in (first, inner)) + s[0] - s[inner]
            ended = min(0.0, *(move[0, q] - move[inner, q] for q in outside))
            alone = begun + min(0.0, *(move[0, q] - move[first, q] for q in outside))
            pair = begun + move[0, 0] - move[first, inner] + s[0] - s[inner] + ended
            if each <= 0 or min(alone, pair, tail + ended) < 0:
                return np.inf
            pull = sum(side[inner] for side in sides.values())
            after = min(0.0, *(move[first, r] - move[inner, r] for r in [*outside, inner])) + move[0, first] - pull
            one = min(begun - move[first, inner], tail - move[inner, inner])
            reach = max(reach, np.ceil(-(one + after) / each) + 1)
        return reach

    def row(self, key: int) -> int:
        """The row of a triple of shape numbers in the tables of scores, margins and pulls.

        margin: by how much O at this word beats any other label at least, whatever the neighbours' labels (last column),
        and by how much for each kind if the next word has to turn from I to B for that. pulls: by how much the next
        word prefers I to B.
        """
        if key not in self.index:
            own = [self.names_of[k] for k in (key // self.base**2, key // self.base % self.base, key % self.base)]
            s = self.emit[[self.features[n] for n in self.names(*own) if n in self.features]].sum(axis=0)
            inside = [i for i, name in enumerate(self.labels) if name[0] == "I"]
            outside = [i for i in range(len(self.labels)) if i not in inside]
            end = np.inf
            turned = np.full(len(KINDS), np.inf)
            for own in range(1, len(self.labels)):
                first = own - (own in inside)
                before = [first, own] if own in inside else range(len(self.labels))
                gain = min(self.move[p, 0] - self.move[p, own] for p in before)
                if own not in inside:
                    gain = min(gain, self.start[0] - self.start[own])
                gain += s[0] - s[own]
                end = min(end, gain + min(0.0, *(self.move[0, q] - self.move[own, q] for q in outside)))
                after = min(0.0, *(self.move[first, r] - self.move[first + 1, r] for r in [*outside, first + 1]))
                k = (first - 1) // 2
                turned[k] = min(turned[k], gain + self.move[0, first] - self.move[own, first + 1] + after)
            self.index[key] = len(self.index)
            self.scored = np.vstack([self.scored, s])
            self.margin = np.vstack([self.margin, [*turned, end]])
            self.pulls = np.vstack([self.pulls, [s[i] - s[i - 1] for i in inside]])
        return self.index[key]

    def open_runs(self, ids: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Rows of the words of a text, and the runs of words that have to be decoded; on a best path, all others are O."""
        around = np.concatenate([[1], ids, [1]])
        keys = (around[:-2] * self.base + around[1:-1]) * self.base + around[2:]
        rows = np.zeros(len(ids), np.int64)
        odd = np.flatnonzero(keys != self.plain)
        if len(odd):
            unique, at = np.unique(keys[odd], return_inverse=True)
            rows[odd] = np.array([self.row(int(k)) for k in unique])[at]
        if len(odd) == 0 and self.reach < np.inf:
            return rows, []
        loose = np.full(len(ids), self.reach == np.inf)
        look = np.unique(np.concatenate([odd, *(odd - i for i in range(1, int(min(self.reach, len(ids))) + 1))])) if self.reach < np.inf else np.arange(len(ids))
        look = look[look >= 0]
        loose[look] = self.margin[rows[look], -1] < 0
        look = look[look < len(ids) - 1]
        loose[look] |= (self.margin[rows[look], :-1] < self.pulls[rows[look + 1]]).any(axis=1)
        at = np.flatnonzero(loose)
        cuts = np.flatnonzero(np.diff(at) > 1)
        return rows, list(zip(at[[0, *(cuts + 1)]].tolist(), (at[[*cuts, -1]] + 1).tolist(), strict=True)) if len(at) else []

    def scores(self, rows: np.ndarray, start: int, end: int) -> np.ndarray:
        """Scores of a run, with the moves from and to the O words around it."""
        out = self.scored[rows[start:end]]
        out[0] += self.move[0] if start else self.start
        if end < len(rows):
            out[-1] += self.move[:, 0]
        return out

    def decode(self, runs: list[np.ndarray]) -> list[np.ndarray]:
        """Viterbi paths of many runs of scores; runs of one length are decoded together."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(runs)
        by_size = defaultdict(list)
        for i, run in enumerate(runs):
            by_size[len(run)].append(i)
        for size, own in by_size.items():
            for part in (own[i : i + 4096] for i in range(0, len(own), 4096)):
                scores = np.stack([runs[i] for i in part])
                best, back = scores[:, 0], []
                for t in range(1, size):
                    ways = best[:, :, None] + self.move
                    back.append(ways.argmax(axis=1).astype(np.int8))
                    best = ways.max(axis=1) + scores[:, t]
                path = [best.argmax(axis=1)]
                for b in reversed(back):
                    path.append(b[np.arange(len(part)), path[-1]])
                for i, p in zip(part, np.stack(path[::-1], axis=1), strict=True):
                    out[i] = p
        return out


class Numbers(dict):
    """Shape numbers of words; keeps those of at most 200,000 words."""

    def __init__(self, crf: Crf) -> None:
        self.shapes = crf.shapes

    def __missing__(self, word: str) -> int:
        number = self.shapes.get(shape(word), 0)
        if len(word) <= _LONG:
            if len(self) >= 200_000:
                self.clear()
            self[word] = number
        return number


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def labelled_sentences(table: list[str]) -> list[tuple[list[str], list[str]]]:
    """Shapes and labels of the sentences of a labelled table."""
    out = []
    for line in table:
        shapes, tags = [], []
        for m in _PIECES.finditer(line):
            words = blanked(m[2] or m[3]).split()
            shapes += map(shape, words)
            tags += ["O"] * len(words) if m[3] else [f"{'I' if i else 'B'}-{m[1]}" for i in range(len(words))]
        out.append((shapes, tags))
    return out


def train(table: list[str] = LABELLED) -> Crf:
    return Crf().fit(labelled_sentences(table)).ready()


def blanked(text: str) -> str:
    """A text with blanks for what separates words: marks of _EDGE, colons that stand alone, and in longer words all that can't be in a datum."""
    text = text.translate(_BLANKED).replace(" : ", "   ")
    if max(map(len, text.split()), default=0) > _LONG:
        text = _LONGER.sub(lambda m: _OTHER.sub(" ", m.group()), text)
    return text


def pieces(text: str) -> Iterator[str]:
    """Consecutive parts of a text, cut at blanks."""
    start = 0
    while start <= len(text):
        end = text.find(" ", start + _PIECE)
        end = len(text) if end < 0 else end
        yield text[start:end]
        start = end + 1


def added_spans(texts: list[str], crf: Crf, base: list[list[tuple[str, int, int]]], numbers: Numbers) -> list[list[tuple[str, int, int]]]:
    """What the field finds in whole texts beside the base spans; a span that overlaps a base span is left out."""
    numbers = Numbers(crf) if numbers is None else numbers
    runs, where = [], []
    for n, text in enumerate(texts):
        ids = np.concatenate([np.fromiter(map(numbers.__getitem__, part.split()), np.int64) for part in pieces(blanked(text))])
        rows, own = crf.open_runs(ids)
        runs += [crf.scores(rows, a, b) for a, b in own]
        where += [(n, a) for a, _ in own]
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    of, places = -1, []
    for (n, a), path in zip(where, crf.decode(runs), strict=True):
        names = [crf.labels[i] for i in path]
        for i, name in enumerate(names):
            if name[0] == "B":
                if of != n:
                    of, places = n, [m.span() for m in _WORD.finditer(blanked(texts[n]))]
                j = i + 1
                while j < len(names) and names[j] == "I" + name[1:]:
                    j += 1
                start, end = places[a + i][0], places[a + j - 1][1]
                while start < end and not (texts[n][start].isalnum() or texts[n][start] in "(:"):
                    start += 1
                while end > start and not (texts[n][end - 1].isalnum() or texts[n][end - 1] in ")]"):
                    end -= 1
                if end > start and not any(x < end and start < y for _, x, y in base[n]):
                    out[n].append((name[2:], start, end))
    return out


def find_pii(docs: DataFrame, text_col: str = "text", table: list[str] = LABELLED) -> DataFrame:
    """`docs` with base_spans and spans: arrays of kind, start and end (code points, end exclusive), by kind and start.

    base_spans are those of the fixed patterns; spans has them and what a conditional random field adds, which is trained
    on `table`. All words of a text are decoded, from their whole shapes. Marks of _EDGE and lone colons separate words like white space, and
    words of over 64 characters, none of which the table has in personal data, are split at all marks but .:+-()[] too.
    Words that are O on a best path whatever their neighbours' labels are found first, so a text falls into runs of the
    other words; they are decoded by Viterbi, many at a time. Null texts count as empty; repeated rows and null ids
    pass through; columns of `docs` named as a result column are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(table))

    def make():
        crf = shared.value
        numbers = Numbers(crf)

        def work(batch):
            base_out, all_out = [], []
            for _, part in slices(batch.column(text_col), 2 << 20):
                texts = [(t or b"").decode() for t in part]
                base = [base_spans(t) for t in texts]
                for own, more in zip(base, added_spans(texts, crf, base, numbers), strict=True):
                    base_out.append(_structs(own))
                    all_out.append(_structs(sorted(own + more, key=lambda s: (KINDS.index(s[0]), *s[1:]))))
            return [base_out, all_out]

        return work

    spans = T.ArrayType(SPAN)
    return with_columns(docs, [T.StructField("base_spans", spans), T.StructField("spans", spans)], make)


def _structs(spans: list[tuple[str, int, int]]) -> list[dict]:
    return [{"kind": k, "start": a, "end": b} for k, a, b in spans]
