"""Secrets in text: fixed patterns, and a linear-chain conditional random field for what they miss.

The field tags the tokens of a line as begin, inside or outside of a secret. Its features are the token's shape (kinds of
characters, length, changes between letters and digits), its neighbours (a keyword, a separator or a quote before it, what
follows, whether it is glued to the token before) and the file (whether it looks like code, whether the line assigns).
Weights are fitted by gradient steps on the likelihood of lines that the fixed patterns have tagged; the sample is bounded by
`SAMPLE_DOCS` documents and `SAMPLE_LINES` lines, chosen by hash. Tags are those of Viterbi, for every line. A bound on what any secret in a
line can gain over no secret, taken from the same scores, comes first: where it is below zero the best path is all outside and needs no decoding.

One pass over the texts without a shuffle; memory is that of one text, or of several short ones.

Defined cases: a null text is empty and has no spans; repeated rows are scanned one by one; other columns of the input
stay, one named `spans` is overwritten; with no line to learn from only the fixed patterns find secrets.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCS = 20000
SAMPLE_LINES = 2000
SEQUENCE = 80  # tokens of a training line
STEPS = 60
LEAST = 6  # characters of a secret
TOGETHER = 1 << 17  # characters of the texts whose lines are looked at together

# The patterns every scan reports, and the words that announce a secret.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "pwd", "passphrase", "credential", "auth", "bearer", "private", "key")
KINDS = ("assign", "access", "hex", "crf")

_TOKEN = re.compile(r"[A-Za-z0-9]+|[^\W\d_A-Za-z]+|\S")
_DIGIT = re.compile(r"[0-9]")
_KEYWORDS = frozenset(KEYWORDS)
_LOUD = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CODE = re.compile(r"[{};]\s*$|^\s*(?:def|class|import|const|let|var|export)\s", re.M)


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, by start and kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _LOUD):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _values(text: str) -> list[tuple[int, int]]:
    """The secrets themselves inside the fixed spans: what the field learns to tag."""
    out = [m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST]
    out += [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return out + [m.span() for m in HEX.finditer(text)]


# --- features ---------------------------------------------------------------------------

_TYPES = ("none", "keyword", "separator", "quote", "digits", "mixed", "word", "mark")
_SIZES = {"shape": 8 * 6, "changes": 8, "type": 8, "before": 8, "before2": 8, "after": 8, "near": 2, "glued": 2 * 8, "file": 4}
_OFFSETS = dict(zip(_SIZES, np.cumsum([0, *_SIZES.values()]).tolist(), strict=False))
N_FEATURES = sum(_SIZES.values())


def _type(token: str) -> int:
    if token[0] in ":=":
        return 2
    if token[0] in "\"'":
        return 3
    if not token.isalnum():
        return 7
    if token.lower() in _KEYWORDS:
        return 1
    if token.isdigit():
        return 4
    return 6 if token.isalpha() else 5


def _shape(t: str) -> tuple[int, int]:
    """Numbers of a token's shape and of its changes."""
    size = len(t)
    length = 0 if size < 4 else 1 if size < 8 else 2 if size < 16 else 3 if size < 24 else 4 if size < 40 else 5
    if t.isalpha():
        if not t.isascii():  # such a token has no other letters
            return length, 0
        kinds = 1 if t.islower() else 2 if t.isupper() else 3
        return kinds * 6 + length, int(kinds == 1 and not t.strip("abcdef"))
    kinds = (any("a" <= c <= "z" for c in t)) + 2 * (any("A" <= c <= "Z" for c in t)) + 4 * (any("0" <= c <= "9" for c in t))
    flips = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:], strict=False))
    hexed = t.isascii() and all(c in "0123456789abcdef" for c in t)
    return kinds * 6 + length, (0 if not flips else 1 if flips < 3 else 2 if flips < 8 else 3) * 2 + hexed


def _open(t: str) -> bool:
    return t.isascii() and (t.isalnum() or t in "+/_.=-")


def features(line: str, code: bool) -> tuple[list[tuple[int, int]], np.ndarray, np.ndarray]:
    """Spans of the tokens of a line, a row of feature numbers for each, and which may begin or continue a secret."""
    spans = [m.span() for m in _TOKEN.finditer(line)]
    tokens = [line[a:b] for a, b in spans]
    types = [_type(t) for t in tokens]
    n = len(tokens)
    rows = np.empty((n, len(_SIZES)), np.int32)
    at = list(_OFFSETS.values())
    file = 2 * code + ("=" in line)
    last_keyword = -99
    for i, t in enumerate(tokens):
        shape, changes = _shape(t)
        before = types[i - 1] if i else 0
        glued = i > 0 and spans[i - 1][1] == spans[i][0]
        rows[i] = (
            at[0] + shape, at[1] + changes, at[2] + types[i], at[3] + before, at[4] + (types[i - 2] if i > 1 else 0),
            at[5] + (types[i + 1] if i + 1 < n else 0), at[6] + (i - last_keyword <= 5), at[7] + glued * 8 + before, at[8] + file,
        )
        if types[i] == 1:
            last_keyword = i
    open_ = np.array([_open(t) for t in tokens], bool)
    return spans, rows, open_


class Words(dict):
    """Word -> the classes of its tokens as 16-bit numbers; a class has shape, changes, type, whether open, whether glued to the token before.

    White space alone parts tokens that are not glued, so a word's tokens do not depend on where it stands.
    """

    MOST = 1 << 17
    LONGEST = 64

    def __init__(self):
        super().__init__()
        self.numbers: dict[tuple, int] = {}
        self.table = np.zeros((5, 0), np.int64)

    def classes(self) -> np.ndarray:
        """A row each for the shape, changes, type, openness and glue of all classes."""
        if self.table.shape[1] < len(self.numbers):
            self.table = np.array(list(self.numbers), np.int64).T
        return self.table

    def __missing__(self, word: str) -> bytes:
        out = []
        for k, t in enumerate(_TOKEN.findall(word)):
            out.append(self.numbers.setdefault((*_shape(t), _type(t), _open(t), k > 0), len(self.numbers)))
        own = array("H", out).tobytes()
        if len(word) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[word] = own
        return own


# --- the field --------------------------------------------------------------------------

NEVER = -1e9
# What a token that can be in no secret loses in the bound.
FAR = 1e3
OUTSIDE, BEGIN, INSIDE = 0, 1, 2


class Field:
    """Weights of features by state, and of steps from state to state."""

    def __init__(self):
        self.weights = np.zeros((N_FEATURES, 3))
        self.steps = np.zeros((3, 3))
        self.trained = False

    def emissions(self, rows: np.ndarray, open_: np.ndarray) -> np.ndarray:
        out = self.weights[rows].sum(-2)
        out[..., 1:][~open_] = NEVER
        return out

    def decode(self, rows: np.ndarray, open_: np.ndarray) -> list[int]:
        """The likeliest states, by Viterbi; inside follows begin or inside only."""
        scores = self.emissions(rows, open_).tolist()
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.steps.tolist()
        o, b, i = scores[0][0], scores[0][1], NEVER
        back = []
        for so, sb, si in scores[1:]:
            fo = max((o + oo, 0), (b + bo, 1), (i + io, 2))
            fb = max((o + ob, 0), (b + bb, 1), (i + ib, 2))
            fi = max((b + bi, 1), (i + ii, 2))
            back.append((fo[1], fb[1], fi[1]))
            o, b, i = fo[0] + so, fb[0] + sb, fi[0] + si
        state = max((o, 0), (b, 1), (i, 2))[1]
        out = [state]
        for step in reversed(back):
            state = step[state]
            out.append(state)
        return out[::-1]

    def train(self, lines: list[tuple[np.ndarray, np.ndarray, np.ndarray]], steps: int = STEPS, rate: float = 0.3, pull: float = 1e-3) -> None:
        """Gradient steps, scaled by their history, on the log-likelihood of (rows, open, states) lines."""
        if not lines:
            return
        n, most = len(lines), max(len(r) for r, _, _ in lines)
        rows = np.zeros((n, most, len(_SIZES)), np.int32)
        open_, mask, gold = np.zeros((n, most), bool), np.zeros((n, most), bool), np.zeros((n, most), np.int64)
        for k, (r, o, g) in enumerate(lines):
            rows[k, : len(r)], open_[k, : len(r)], gold[k, : len(r)], mask[k, : len(r)] = r, o, g, True
        one = np.eye(3)[gold] * mask[..., None]
        pairs_gold = np.einsum("nta,ntb->ab", one[:, :-1], one[:, 1:])
        seen_w, seen_s = np.full_like(self.weights, 1e-8), np.full_like(self.steps, 1e-8)
        barred = np.zeros((3, 3))
        barred[OUTSIDE, INSIDE] = NEVER
        for _ in range(steps):
            score = np.where(mask[..., None], self.emissions(rows, open_), 0.0)
            score[:, 0, INSIDE] = NEVER
            step = self.steps + barred
            ahead = np.zeros((n, most, 3))
            ahead[:, 0] = score[:, 0]
            for t in range(1, most):
                new = np.logaddexp.reduce(ahead[:, t - 1, :, None] + step, axis=1) + score[:, t]
                ahead[:, t] = np.where(mask[:, t, None], new, ahead[:, t - 1])
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            behind = np.zeros((n, most, 3))
            pairs = np.zeros((3, 3))
            for t in range(most - 2, -1, -1):
                reach = step + (score[:, t + 1] + behind[:, t + 1])[:, None, :]
                live = mask[:, t + 1]
                behind[:, t] = np.where(live[:, None], np.logaddexp.reduce(reach, axis=2), 0.0)
                pairs += np.exp(np.minimum(0, ahead[:, t, :, None] + reach - total[:, None, None]))[live].sum(0)
            share = np.exp(np.minimum(0, ahead + behind - total[:, None, None])) * mask[..., None]
            gap = (one - share)[mask]
            slope = np.stack([np.bincount(rows[mask].ravel(), np.repeat(gap[:, s], len(_SIZES)), N_FEATURES) for s in range(3)], 1) / n
            slope -= pull * self.weights
            slope_s = (pairs_gold - pairs) / n - pull * self.steps
            seen_w += slope**2
            seen_s += slope_s**2
            self.weights += rate * slope / np.sqrt(seen_w)
            self.steps += rate * slope_s / np.sqrt(seen_s)
        self.steps[OUTSIDE, INSIDE] = NEVER
        self.trained = True

    def may_hold(self, lines: list[str], code: np.ndarray, words: Words) -> np.ndarray:
        """Per line, with the code marks of their files, whether a path with a secret can be as good as the one that is all outside.

        A run of begin and inside tokens gains its first token's start, the best step into each further one, and its end. The runs
        of a path add up, so where the best run of a line loses, every path with runs does.
        """
        out = np.zeros(len(lines), bool)
        known = words.__getitem__
        packed = [b"".join(map(known, line.split())) for line in lines]
        sizes = np.fromiter(map(len, packed), np.int64, len(lines)) // 2
        some = np.flatnonzero(sizes)
        if not len(some):
            return out
        token = np.frombuffer(b"".join(packed), np.uint16)
        shape, changes, kind, open_, glued = words.classes()
        gain = self.weights[:, 1:] - self.weights[:, :1]
        at = _OFFSETS
        own = gain[at["shape"] + shape] + gain[at["changes"] + changes] + gain[at["type"] + kind]
        own[open_ == 0] = -FAR
        n = len(token)
        ends = np.cumsum(sizes[some])
        starts = ends - sizes[some]
        place, line = np.arange(n), np.repeat(np.arange(len(some)), sizes[some])
        first = starts[line]
        types = kind[token]
        before, before2, after = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        before[1:], before2[2:], after[:-1] = types[:-1], types[:-2], types[1:]
        before[starts], after[ends - 1] = 0, 0
        before2[place - first < 2] = 0
        keyword = np.full(n + 1, -99)
        keyword[1:] = np.maximum.accumulate(np.where(types == 1, place, -99))
        near = (place - keyword[:-1] <= 5) & (keyword[:-1] >= first)
        file = 2 * code[some] + np.fromiter(("=" in lines[k] for k in some.tolist()), np.int64, len(some))
        score = own[token] + gain[at["before"] + before] + gain[at["before2"] + before2] + gain[at["after"] + after]
        score += gain[at["near"] + near] + gain[at["glued"] + glued[token] * 8 + before] + gain[at["file"] + file][line]
        (oo, ob, _), (bo, bb, bi), (io, ib, ii) = self.steps.tolist()
        start, end = score[:, 0] + (ob - oo), np.full(n, max(bo, io) - oo)
        start[starts] -= ob - oo
        end[ends - 1] = 0.0
        further = np.maximum(np.maximum(score[:, 0] + max(bb, ib) - oo, score[:, 1] + max(bi, ii) - oo), -FAR)
        total = np.cumsum(further)
        total -= (total[starts] - further[starts])[line]
        # The best start so far in the same line: later lines stand higher than all of an earlier one.
        lead = start - total
        lift = (lead.max() - lead.min() + 1.0) * line
        run = np.maximum.accumulate(lead + lift) - lift + total + end
        out[some] = np.maximum.reduceat(run, starts) > -1e-3
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Secrets of a text as the field sees them."""
        return self.spans_of([text], Words())[0]

    def spans_of(self, texts: list[str], words: Words) -> list[list[tuple[int, int]]]:
        """Secrets of every text."""
        found: list[list[tuple[int, int]]] = [[] for _ in texts]
        if not self.trained:
            return found
        split = [t.split("\n") for t in texts]
        code = np.array([bool(_CODE.search(t)) for t in texts], np.int64)
        counts = np.array([len(x) for x in split])
        lines = [line for x in split for line in x]
        marked = np.flatnonzero(self.may_hold(lines, np.repeat(code, counts), words))
        owners = np.repeat(np.arange(len(texts)), counts)[marked]
        firsts = np.cumsum(counts) - counts
        for at, t in zip(marked.tolist(), owners.tolist(), strict=True):
            start = sum(len(x) + 1 for x in lines[firsts[t] : at])
            found[t] += self._spans_of_line(lines[at], start, bool(code[t]))
        return found

    def _spans_of_line(self, line: str, start: int, code: bool) -> list[tuple[int, int]]:
        out = []
        spans, rows, open_ = features(line, code)
        if not open_.any():
            return out
        states = self.decode(rows, open_)
        i = 0
        while i < len(states):
            if states[i] == BEGIN:
                j = i + 1
                while j < len(states) and states[j] == INSIDE:
                    j += 1
                if spans[j - 1][1] - spans[i][0] >= LEAST:
                    out.append((start + spans[i][0], start + spans[j - 1][1]))
                i = j
            else:
                i += 1
        return out


def _lines(text: str) -> Iterator[tuple[str, bool, list[tuple[int, int]]]]:
    """Training lines of a text: a stretch of at most SEQUENCE tokens, the code mark, and the secrets in it."""
    code, secrets = bool(_CODE.search(text)), _values(text)
    start = 0
    for line in text.split("\n"):
        tokens = [m.span() for m in _TOKEN.finditer(line)]
        own = [(a - start, b - start) for a, b in secrets if start <= a and b <= start + len(line)]
        wanted = own[0][0] if own else next((m.start() for m in _DIGIT.finditer(line)), 0)
        middle = sum(b <= wanted for _, b in tokens)
        part = tokens[max(0, middle - SEQUENCE // 2) : middle + SEQUENCE // 2]
        if part:
            first, last = part[0][0], part[-1][1]
            yield line[first:last], code, [(a - first, b - first) for a, b in own if first <= a and b <= last]
        start += len(line) + 1


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    n = docs.count()
    bound = int(min(1.0, sample_docs / max(1, n)) * (1 << 30))
    turn = F.xxhash64(F.lit(13), "doc_id")
    chosen = docs.select("doc_id", "text").filter((F.pmod(turn, F.lit(1 << 30)) <= bound) & F.col("text").isNotNull()).select("text")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column("text"):
                got = list(_lines(text.as_py()))
                turns = [xxhash.xxh64_intdigest(x[0].encode(), 13) >> 1 for x in got]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(turns, pa.int64()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.bool_()),
                     pa.array([[v for s in x[2] for v in s] for x in got], pa.list_(pa.int32()))],
                    ["turn", "line", "code", "secrets"],
                )

    found = chosen.mapInArrow(lines, "turn bigint, line string, code boolean, secrets array<int>").distinct()
    # Half the lines with secrets, half without, so that either is seen often.
    tagged = F.size("secrets") > 0
    rows = [r for side in (tagged, ~tagged) for r in found.filter(side).orderBy("turn", "line").limit(sample_lines // 2).collect()]
    data = []
    for r in rows:
        spans, feats, open_ = features(r["line"], r["code"])
        states, edges = np.zeros(len(spans), np.int64), list(zip(r["secrets"][::2], r["secrets"][1::2], strict=True))
        for k, (a, b) in enumerate(spans):
            for x, y in edges:
                if x <= a and b <= y and open_[k]:
                    states[k] = INSIDE if k and states[k - 1] and spans[k - 1][0] >= x else BEGIN
        data.append((feats, open_, states))
    field = Field()
    field.train(data)
    return field


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """`docs` with `spans`: array of (kind, start, end) in code points, the field's only where no fixed one stands."""
    field = field or fit(docs)
    kept = docs.drop("spans")
    shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(field))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, words = cloudpickle.loads(shared.value), Words()
        for batch in batches:
            out = []
            for texts in _together(batch.column("text")):
                for text, seen in zip(texts, own.spans_of(texts, words), strict=True):
                    fixed = fixed_spans(text)
                    more = [(a, b, "crf") for a, b in seen if not any(x < b and a < y for x, y, _ in _near(fixed, a, b))]
                    spans = sorted(fixed + more, key=lambda s: (s[0], KINDS.index(s[2])))
                    out.append([{"kind": k, "start": a, "end": b} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind)], [*batch.schema.names, "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, spans array<struct<kind:string,start:int,end:int>>")


def _together(column: pa.Array) -> Iterator[list[str]]:
    """The texts in order, so many at once that they have about `TOGETHER` characters."""
    held, size = [], 0
    for value in column:
        held.append(value.as_py() or "")
        size += len(held[-1])
        if size >= TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def _near(fixed: list[tuple[int, int, str]], start: int, end: int) -> list[tuple[int, int, str]]:
    """The fixed spans among which an overlap can be: those of each kind around the place."""
    return fixed if len(fixed) < 16 else [s for s in fixed if s[0] < end and s[1] > start]
