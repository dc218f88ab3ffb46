"""Secret scans: base patterns, and a character convolutional network over every other candidate in its context.

Base patterns (assign, access, hex) are found on every whole text. Candidates are runs of 12 or more token
characters with a letter and a digit, longer ones of letters whose case changes often, values of 6 or more characters of any
kind but short plain words after a credential word, and passwords in URLs. The network sees the candidate's characters and those around it; it is
trained on labelled findings: all different ones among the corpus's candidates that base patterns find, and as many made ones to each
PART of them, secrets and not, so that it is defined on an empty corpus too. Each part is trained on in a task of its own, and after each
round over the findings the parts' weights are averaged. Candidates that no base pattern
finds are what the network is asked about; they may be secrets and train nothing. Logits are calibrated by Platt scaling
on held-back findings, counted by their logits, and each kind of candidate gets the highest threshold that keeps the wanted recall
there. A candidate at or above it that no base span overlaps is added as kind `net`; base spans always stay.

Spans are in code points, end exclusive. Defined results: a null text is empty and has no span; repeated rows
are scanned each time; very long texts are scanned whole, and so are candidates longer than the network's window, in several
windows of which the most suspect counts; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import map_text
from weftline.llm.encode import text_blocks, text_slices
from weftline.session import materialize

#: The base patterns, on UTF-8 bytes, and their least lengths.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
MARK = "[secret]"
KINDS = ("assign", "access", "hex", "net")
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=~-]{12,}")
DIGIT, LETTER = re.compile(rb"[0-9]").search, re.compile(rb"[A-Za-z]").search
#: Runs of letters only: the least length and number of different characters, and of changes of case where no credential word stands before.
LETTERS, CHANGES = (16, 9), 4
CHANGE = re.compile(rb"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])").findall
#: On lower-case bytes: a credential word before a value, which follows a sign, or the word and a space.
NAMED = re.compile(rb"""(?:pass|pwd|\bpw|secret|token|key|auth|bearer|basic|credential|login)[a-z_-]{0,16}["']?(?:\x20*(?:[:=]|=>|\x20is\x20)\x20*(?:bearer\x20+|basic\x20+)?|\x20+)["'`]?""")
NO_VALUE, QUOTE = re.compile(rb"[^!-~]"), re.compile(rb"[\"'`]")
URL = re.compile(rb"://[^\s/:@]*:([^\s/@]{6,})@")
#: Signs that end a value and are not taken as its part.
CLOSING = b"\"'`,;.)]}>"
HAS_DIGIT, HAS_UPPER, HAS_LOWER, HAS_SIGN = re.compile(rb"[0-9]"), re.compile(rb"[A-Z]"), re.compile(rb"[a-z]"), re.compile(rb"[!@#$%^&*+?~]")

LEFT, BODY, RIGHT = 24, 48, 16
WIDTH = LEFT + BODY + RIGHT
#: Character classes: padding, each printable ASCII character, line feed, all else.
CLASSES = 98
EMBED, FILTERS, SPAN = 8, 24, 5


def base_spans(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret value) in bytes, sorted by start, then kind."""
    found = []
    low = data.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in data:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(data)]
    return sorted(found)


def _run(token: bytes) -> bool:
    """Whether a run of token characters is a candidate wherever it stands."""
    return bool(LETTER(token) and (DIGIT(token) or (_varied(token) and len(CHANGE(token)) >= CHANGES)))


def _varied(token: bytes) -> bool:
    return len(token) >= LETTERS[0] and len(set(token)) >= LETTERS[1]


class _Next:
    """Where a pattern is next found, for starts that never fall: nothing is looked at twice."""

    def __init__(self, pattern: re.Pattern, data: bytes):
        self.search, self.data, self.at = pattern.search, data, -1

    def __call__(self, start: int) -> int:
        if self.at < start:
            found = self.search(self.data, start)
            self.at = found.start() if found else len(self.data)
        return self.at


class _Kinds:
    """Where the bytes from a start, which never falls, have had so many different values."""

    def __init__(self, data: bytes, wanted: int):
        self.data, self.wanted, self.counts, self.kinds, self.low, self.high = data, wanted, [0] * 256, 0, 0, 0

    def __call__(self, start: int, end: int) -> bool:
        """Whether they have before end."""
        data, counts = self.data, self.counts
        if start >= self.high:
            self.counts, counts = [0] * 256, self.counts
            counts = self.counts
            self.kinds, self.low, self.high = 0, start, start
        while self.low < start:
            b = data[self.low]
            counts[b] -= 1
            self.kinds -= not counts[b]
            self.low += 1
        while self.kinds < self.wanted and self.high < end:
            b = data[self.high]
            self.kinds += not counts[b]
            counts[b] += 1
            self.high += 1
        return self.kinds >= self.wanted and self.high <= end


def _named(data: bytes) -> list[tuple[int, int]]:
    """Values after a credential word, short ones of more than lower-case letters, and passwords in URLs. Linear in the text: a value that
    reaches far is not looked through again for each credential word in it."""
    found = [m.span(1) for m in URL.finditer(data)] if b"://" in data else []
    ends, quote, digit, sign, upper, lower, kinds, stop, last = None, None, None, None, None, None, None, -1, -1
    for m in NAMED.finditer(data.lower()):
        if ends is None:
            ends, quote, digit, sign, upper, lower = (_Next(p, data) for p in (NO_VALUE, QUOTE, HAS_DIGIT, HAS_SIGN, HAS_UPPER, HAS_LOWER))
            kinds = _Kinds(data, LETTERS[1])
        a = m.end()
        if a != (run := ends(a)) and run != stop:
            stop = last = run
            while last > a and data[last - 1] in CLOSING:
                last -= 1
        if run - a < 6:
            continue
        end = max(a, min(last, quote(a)))
        if end - a >= 6 and (digit(a) < end or sign(a) < end - 1 or (upper(a + 1) < end and lower(a) < end) or (end - a >= LETTERS[0] and kinds(a, end))):
            found.append((a, end))
    return found


def candidates(data: bytes) -> list[tuple[int, int]]:
    """Spans in order, none overlapping; of those that would, the earliest and then longest."""
    runs = [m.span() for m in CANDIDATE.finditer(data) if _run(m[0])]
    if not (named := _named(data)):
        return runs
    out, last = [], 0
    for a, e in sorted({*runs, *named}, key=lambda x: (x[0], -x[1])):
        if a >= last:
            out.append((a, e))
            last = e
    return out


def merged(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of what the spans cover, in order and apart."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(cover: tuple[list[int], list[int]], start: int, end: int) -> bool:
    starts, ends = cover
    i = bisect_right(ends, start)
    return i < len(ends) and starts[i] < end


_CLASS = np.full(256, CLASSES - 1, np.uint8)
_CLASS[32:127] = np.arange(1, 96)
_CLASS[10] = 96


def window(data: bytes, start: int, end: int) -> np.ndarray:
    """Classes of the characters before, in and after a candidate; of a long one, its first and last."""
    out = np.zeros(WIDTH, np.uint8)
    left = data[max(0, start - LEFT) : start]
    body = data[start:end] if end - start <= BODY else data[start : start + BODY // 2] + data[end - BODY // 2 : end]
    right = data[end : end + RIGHT]
    for at, part in ((LEFT - len(left), left), (LEFT, body), (LEFT + BODY, right)):
        out[at : at + len(part)] = _CLASS[np.frombuffer(part, np.uint8)]
    return out


def windows_of(data: bytes, start: int, end: int) -> list[np.ndarray]:
    """The candidate's window and, for one longer than that shows, windows on its middle."""
    inner = range(start + BODY // 2, end - BODY // 2, BODY) if end - start > BODY else ()
    return [window(data, start, end), *(window(data, a, min(a + BODY, end)) for a in inner)]


def candidate_kind(token: bytes) -> int:
    """0: hexadecimal digits, 1: letters and digits, 2: with other signs."""
    return 0 if re.fullmatch(rb"[0-9a-fA-F]+", token) else 1 if token.isalnum() else 2


@dataclass
class Net:
    embed: np.ndarray  # CLASSES x EMBED
    conv: np.ndarray  # SPAN * (EMBED + 1) x FILTERS
    conv_bias: np.ndarray
    out: np.ndarray  # 2 * FILTERS
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: tuple[float, float, float] = (0.5, 0.5, 0.5)

    @staticmethod
    def new(rng: np.random.Generator) -> Net:
        f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        return Net(f(CLASSES, EMBED) * 3, f(SPAN * (EMBED + 1), FILTERS), np.zeros(FILTERS, np.float32), f(2 * FILTERS), 0.0)

    def forward(self, x: np.ndarray):
        inside = np.zeros((len(x), WIDTH, 1), np.float32)
        inside[:, LEFT : LEFT + BODY] = (x[:, LEFT : LEFT + BODY] > 0)[..., None]
        e = np.concatenate([self.embed[x], inside], 2)
        cols = np.concatenate([e[:, k : WIDTH - SPAN + 1 + k] for k in range(SPAN)], 2)
        h = np.maximum(cols @ self.conv + self.conv_bias, 0)
        top = h.argmax(1)
        pooled = np.concatenate([np.take_along_axis(h, top[:, None], 1)[:, 0], h.mean(1)], 1)
        return pooled @ self.out + self.bias, (cols, h, top, pooled)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x[i : i + 256])[0] for i in range(0, len(x), 256)]) if len(x) else np.zeros(0, np.float32)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(x).astype(float) + b, -50, 50)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        z, (cols, h, top, pooled) = self.forward(x)
        n, steps = len(x), h.shape[1]
        dz = ((1 / (1 + np.exp(-z)) - y) / n).astype(np.float32)
        dp = dz[:, None] * self.out
        dh = np.repeat(dp[:, None, FILTERS:] / steps, steps, 1)
        np.put_along_axis(dh, top[:, None], np.take_along_axis(dh, top[:, None], 1) + dp[:, None, :FILTERS], 1)
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        dcols = dh @ self.conv.T
        de = np.zeros((n, WIDTH, EMBED), np.float32)
        for k in range(SPAN):
            de[:, k : WIDTH - SPAN + 1 + k] += dcols[..., k * (EMBED + 1) : k * (EMBED + 1) + EMBED]
        dembed = np.zeros_like(self.embed)
        np.add.at(dembed, x, de)
        return [dembed, cols.reshape(-1, cols.shape[2]).T @ flat, flat.sum(0), pooled.T @ dz, dz.sum(keepdims=True)]


def _made(rng: np.random.Generator, n: int) -> list[tuple[bytes, int, int, int]]:
    """Made findings: (text, start, end, label), half of them secrets."""
    hexa, mixed = b"0123456789abcdef", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda letters, k: bytes(rng.choice(np.frombuffer(letters, np.uint8), k))
    word = lambda: pick(b"etaoinshrdlu", int(rng.integers(2, 9)))
    prose = lambda: b" ".join(word() for _ in range(8))
    names = [b"key", b"secret", b"token", b"auth", b"pwd", b"password", b"api_key", b"access", b"credential", b"bearer"]
    letters, signs = mixed[:52], mixed + b"!@#$%^&*+?~"
    digits = lambda k: pick(b"0123456789", k)
    out = []
    for i in range(n):
        after = b" "
        if i % 2 and rng.random() < 0.6:
            kind, quote = rng.choice([0, 1, 2, 2, 2, 3, 4, 5, 6]), [b"", b'"', b"'"][rng.integers(3)]
            name = names[rng.integers(len(names))] + [b": ", b"=", b" = ", b":", b" is "][rng.integers(5)] + quote
            body = (
                pick(letters, int(rng.integers(16, 40))) if kind == 0 else digits(int(rng.integers(8, 24))) if kind == 1 else word() + digits(int(rng.integers(2, 5))) if kind == 2
                else pick(mixed, int(rng.integers(6, 12))) if kind == 3 else pick(mixed[26:52], int(rng.integers(16, 40))) if kind == 4
                else word().capitalize() + pick(b"!@#$%^&*", 1) + word() + pick(signs, 2) + digits(2) if kind == 5 else pick(signs, int(rng.integers(6, 20)))
            )
            body += digits(3) * (len(body) < 6)
            how = rng.integers(4)
            if how == 0 and kind != 2:
                name, quote = [b"Authorization: Bearer ", b"Authorization: Basic ", b"auth bearer "][rng.integers(3)], b""
            elif how == 1 and kind > 2:
                name, quote, after = [b"https", b"postgres", b"ftp"][rng.integers(3)] + b"://" + word() + b":", b"", b"@" + word() + b".com "
            before, after = prose() + b" " + name, quote + after
        elif i % 2:
            kind = rng.integers(4)
            body = pick(hexa, int(rng.choice([32, 40, 64]))) if kind == 0 else pick(mixed, int(rng.integers(20, 44))) if kind == 1 else b"AKIA" + pick(mixed[:26] + mixed[52:], 16) if kind == 2 else pick(mixed + b"+/", int(rng.integers(24, 60))) + b"=="
            join = [b" = \"", b": '", b"=", b": ", b" "][rng.integers(5)]
            before = prose() + b" " + (names[rng.integers(len(names))] + join if rng.random() < 0.85 else b"")
        else:
            kind = rng.integers(10)
            body = (
                word() + word() + digits(2) + word() if kind == 0 else digits(4) + b"-" + digits(2) + b"-" + digits(2) + b"T" + digits(2) if kind == 1
                else b"/" + word() + b"/" + word() + digits(3) + b"/" + word() if kind == 2 else word() + b"-" + word() + b"-" + digits(4) if kind == 3
                else word() + b"_" + word() + digits(1) + b"_" + word() if kind == 4 else digits(4) + b"-" + word() + word() + word() if kind == 5
                else word() + word() + word() + word() if kind == 6 else b"".join(word().capitalize() for _ in range(4)) if kind == 7
                else [digits(4) + b"-" + digits(2) + b"-" + digits(2), word().capitalize() + word().capitalize(), word() + b"?" + word()][rng.integers(3)] if kind == 8 else word().capitalize() + digits(6) + word()
            )
            body += b"x1y2" * int(len(body) < 12 and kind != 8) + b"end0" * (len(body) < 8)
            before = prose() + b" " + (names[rng.integers(len(names))] + [b" ", b": "][rng.integers(2)] if kind == 8 else b"")
        out.append((before + body + after + prose(), len(before), len(before) + len(body), i % 2))
    return out


def train(found: list[tuple[bytes, int, int, int]], *, made: int = 3000, recall: float = 0.98, epochs: int = 6, seed: int = 7) -> Net:
    """found: labelled findings (text around, start, end, label). A fifth is held back for calibration and thresholds."""
    rng = np.random.default_rng(seed)
    rows = [*found, *_made(rng, made)]
    x = np.stack([window(t, a, b) for t, a, b, _ in rows])
    y = np.array([r[3] for r in rows], np.float32)
    kinds = np.array([candidate_kind(t[a:b]) for t, a, b, _ in rows])
    turn = rng.permutation(len(rows))
    held, kept = turn[: len(turn) // 5], turn[len(turn) // 5 :]
    net = Net.new(rng)
    state, step = None, 0
    for _ in range(epochs):
        state, step = _round(net, state, step, x, y, rng.permutation(kept))
    _calibrate(net, net.logits(x[held]).astype(float), y[held].astype(float), kinds[held], np.ones(len(held)), recall)
    return net


def _round(net: Net, state: list | None, step: int, x: np.ndarray, y: np.ndarray, order: np.ndarray) -> tuple[list, int]:
    """Adam steps over the rows in an order, 64 at a time; the net changes in place. state and step: as returned by the round before."""
    state = state or [(np.zeros_like(p), np.zeros_like(p)) for p in (net.embed, net.conv, net.conv_bias, net.out, np.zeros(1, np.float32))]
    for at in range(0, len(order), 64):
        i = order[at : at + 64]
        step += 1
        moves = []
        for k, g in enumerate(net.gradients(x[i], y[i])):
            m, v = state[k]
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            state[k] = (m, v)
            moves.append(0.004 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8))
        net.embed, net.conv, net.conv_bias, net.out = (p - d.astype(np.float32) for p, d in zip((net.embed, net.conv, net.conv_bias, net.out), moves[:4], strict=True))
        net.bias -= float(moves[4][0])
    return state, step


def _calibrate(net: Net, z: np.ndarray, t: np.ndarray, kinds: np.ndarray, n: np.ndarray, recall: float) -> None:
    """Sets scale and thresholds by held-back logits z, with labels, kinds and how many findings each stands for."""
    net.scale = _platt(z, t, n=n)
    p = 1 / (1 + np.exp(-np.clip(net.scale[0] * z + net.scale[1], -50, 50)))
    whole = _threshold(p[t == 1], recall, n[t == 1])
    of = [(t == 1) & (kinds == k) for k in range(3)]
    net.thresholds = tuple(_threshold(p[own], recall, n[own]) if n[own].sum() >= 20 else whole for own in of)


def _platt(z: np.ndarray, t: np.ndarray, rounds: int = 50, n: np.ndarray | None = None) -> tuple[float, float]:
    """Newton steps for p = sigmoid(a z + b) with smoothed targets and a small ridge. n: how many each stands for."""
    n = np.ones(len(t)) if n is None else n
    up, down = (n * t).sum(), (n * (1 - t)).sum()
    target = np.where(t == 1, (up + 1) / (up + 2), 1 / (down + 2))
    w, x = np.array([1.0, 0.0]), np.column_stack([z, np.ones_like(z)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (n * (p - target)) + 1e-3 * w
        h = (x * (n * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        move = np.linalg.solve(h, g)
        w = w - move / max(1.0, np.abs(move).max())
    return float(w[0]), float(w[1])


def _threshold(p: np.ndarray, recall: float, n: np.ndarray | None = None) -> float:
    """The highest threshold that at least `recall` of the probabilities p of true secrets reach; 0.5 if there are none. n: how many each
    stands for."""
    if not len(p):
        return 0.5
    order = np.argsort(p, kind="stable")
    upto = np.cumsum((np.ones(len(p)) if n is None else n)[order])
    return float(p[order][np.searchsorted(upto, np.floor((1 - recall) * upto[-1]), "right")])


def findings(docs: DataFrame, text: str) -> DataFrame:
    """data, a, b, turn: every different candidate that base patterns find, with what stands around it, and a hash of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in text_slices(batches):
            rows = []
            for t in b.column(0).to_pylist():
                data = (t or "").encode("utf-8", "surrogatepass")
                base = merged([(s, e) for s, _, e, _ in base_spans(data)])
                for a, e in candidates(data) if base[0] else ():
                    if overlaps(base, a, e):
                        lo, hi = max(0, a - LEFT), min(e + RIGHT, a + 4096)
                        rows.append((data[lo:hi], a - lo, min(e, hi) - lo))
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int32()), strict=True)], names=["data", "a", "b"])

    return docs.select(text).mapInArrow(run, "data binary, a int, b int").withColumn("turn", F.xxhash64("data", "a")).dropDuplicates(["turn"])


def labelled_findings(docs: DataFrame, text: str, max_each: int = 2000) -> list[tuple[bytes, int, int, int]]:
    """At most max_each findings, those with the smallest hash, labelled 1: a look at them. Nothing is fitted on these alone."""
    return [(bytes(r["data"]), r["a"], r["b"], 1) for r in findings(docs, text).orderBy("turn").limit(max_each).collect()]


#: Findings that a task trains on, made ones beside them, and parts whose weights are averaged at once.
PART, MADE, FAN = 2000, 3000, 32
#: Held-back logits are counted by steps of this part of one.
STEPS = 1024


def training_rows(docs: DataFrame, text: str = "text", seed: int = 7) -> tuple[DataFrame, int]:
    """part, x (a window), label, kind, turn, held, of all findings and of MADE made ones to each part; and the number of parts, which
    follows the findings. A fifth is held back."""
    schema = "part long, x binary, label int, kind int, turn long"

    def rows(part: list[int], found: list[tuple[bytes, int, int, int]], turn: list[int]) -> pa.RecordBatch:
        x = [window(t, a, b).tobytes() for t, a, b, _ in found]
        columns = ((part, pa.int64()), (x, pa.binary()), ([f[3] for f in found], pa.int32()), ([candidate_kind(t[a:b]) for t, a, b, _ in found], pa.int32()), (turn, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], names=["part", "x", "label", "kind", "turn"])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, start, end, turn = (c.to_pylist() for c in b.columns)
            yield rows([0] * len(data), [(t, i, j, 1) for t, i, j in zip(data, start, end, strict=True)], turn)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in b.column(0).to_pylist():
                yield rows([part] * MADE, _made(np.random.default_rng([seed, part]), MADE), list(range(MADE)))

    known = materialize(findings(docs, text).mapInArrow(own, schema), "secret-findings")
    parts = max(1, -(-known.count() // PART))
    known = known.withColumn("part", F.pmod("turn", F.lit(parts)))
    both = known.unionByName(docs.sparkSession.range(parts).mapInArrow(made, schema))
    return materialize(both.withColumn("held", F.pmod(F.xxhash64("turn"), F.lit(5)) == 0), "secret-training"), parts


def _packed(net: Net, state: list) -> np.ndarray:
    """Weights and Adam's means in one row of numbers."""
    own = [net.embed, net.conv, net.conv_bias, net.out, np.array([net.bias])]
    return np.concatenate([a.ravel() for a in [*own, *(m for pair in state for m in pair)]]).astype(np.float32)


def _unpacked(numbers: np.ndarray) -> tuple[Net, list]:
    shapes = [(CLASSES, EMBED), (SPAN * (EMBED + 1), FILTERS), (FILTERS,), (2 * FILTERS,), (1,)]
    shapes += [s for s in shapes for _ in range(2)]
    ends = np.cumsum([int(np.prod(s)) for s in shapes])
    a = [part.reshape(s).copy() for part, s in zip(np.split(numbers, ends[:-1]), shapes, strict=True)]
    return Net(*a[:4], float(a[4][0])), [(a[i], a[i + 1]) for i in range(5, 15, 2)]


def _averaged(rows: list[tuple[int, int, bytes]]) -> np.ndarray:
    """The mean of packed weights, by the rows each was trained on. rows: (part, n, weights), added up in the parts' order."""
    rows = sorted(rows)
    return (sum(n * np.frombuffer(w, np.float32).astype(float) for _, n, w in rows) / max(1, sum(n for _, n, _ in rows))).astype(np.float32)


def _told(part: int, n: int, weights: np.ndarray) -> pa.Table:
    return pa.table({"part": pa.array([part], pa.int64()), "n": pa.array([n], pa.int64()), "weights": pa.array([weights.tobytes()], pa.binary())})


def _part_round(now: np.ndarray, step: int, seed: list[int]) -> Callable[[pa.Table], pa.Table]:
    """Trains on a part's rows from the packed weights on."""

    def run(group: pa.Table) -> pa.Table:
        group, part = group.sort_by([("label", "ascending"), ("turn", "ascending")]), group["part"][0].as_py()
        net, state = _unpacked(now)
        x = np.frombuffer(b"".join(group["x"].to_pylist()), np.uint8).reshape(-1, WIDTH)
        order = np.random.default_rng([*seed, part]).permutation(len(x))
        state, _ = _round(net, state, step, x, group["label"].to_numpy().astype(np.float32), order)
        return _told(part, len(x), _packed(net, state))

    return run


def _mean(group: pa.Table) -> pa.Table:
    part, n, weights = (group[c].to_pylist() for c in ("part", "n", "weights"))
    return _told(part[0] // FAN, sum(n), _averaged(list(zip(part, n, weights, strict=True))))


def train_parts(rows: DataFrame, parts: int, *, recall: float = 0.98, epochs: int = 6, seed: int = 7) -> Net:
    """A net trained on training_rows: in a round each part goes on from the same weights in its own task, then they are averaged, FAN parts at
    a time. Sums are taken in the parts' order, so that reruns agree."""
    schema = "part long, n long, weights binary"
    kept, held = rows.filter("not held").drop("held"), rows.filter("held").select("x", "label", "kind")
    net, step = Net.new(np.random.default_rng(seed)), 0
    zeros = [(np.zeros_like(p), np.zeros_like(p)) for p in (net.embed, net.conv, net.conv_bias, net.out, np.zeros(1, np.float32))]
    now = _packed(net, zeros)
    for epoch in range(epochs):
        made = kept.groupBy("part").applyInArrow(_part_round(now, step, [seed, epoch]), schema)
        left = parts
        while left > FAN:
            made, left = made.groupBy(F.call_function("div", F.col("part"), F.lit(FAN))).applyInArrow(_mean, schema), -(-left // FAN)
        met = [(r["part"], r["n"], bytes(r["weights"])) for r in made.collect()]  # FAN rows at most
        now, step = _averaged(met), step + -(-sum(n for _, n, _ in met) // (64 * parts))
    net, _ = _unpacked(now)

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = net.logits(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(-1, WIDTH))
            yield pa.RecordBatch.from_arrays([pa.array(np.floor(z.astype(float) * STEPS).astype(np.int64)), *b.columns[1:]], names=["z", "label", "kind"])

    counted = held.mapInArrow(logits, "z long, label int, kind int").groupBy("z", "label", "kind").agg(F.count("*").alias("n"))
    z, label, kind, n = (np.array(c) for c in zip(*sorted(map(tuple, counted.collect())), strict=True))  # bounded by the logits' range
    _calibrate(net, z / STEPS, label.astype(float), kind, n.astype(float), recall)
    return net


def without_secrets(text: str, spans: list[dict], mark: str = MARK) -> str:
    """The text with the secret values of its spans replaced; values that overlap are replaced once."""
    out, at = [], 0
    for x in sorted(spans, key=lambda x: (x["value_start"], x["end"])):
        if x["value_start"] >= at:
            out += [text[at : x["value_start"]], mark]
        at = max(at, x["end"])
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, net: Net, keep: list[Column | str], text: str) -> DataFrame:
    """The kept columns; secret_spans, an array of (kind, start, end, value_start) in code points, by start, then kind; and
    clean_text, the text without the secrets (null for a null text)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value_start", pa.int64())]))

    def compute(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, last in text_blocks(texts := texts.to_pylist()):
            found = found_in(texts[first:last])
            clean = [without_secrets(t, x) if x else t for t, x in zip(texts[first:last], found, strict=True)]
            yield first, last, [pa.array(found, kind), pa.array(clean, pa.string())]

    def found_in(texts: list[str | None]) -> list[list[dict]]:
        model, spans, asked, first, windows, kinds = shared.value, [], [], [], [], []
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "surrogatepass")
            base = base_spans(data)
            taken = merged([(s, e) for s, _, e, _ in base])
            spans.append((data, base))
            for a, e in candidates(data):
                if not overlaps(taken, a, e):
                    asked.append((i, a, e))
                    first.append(len(windows))
                    windows += windows_of(data, a, e)
                    kinds.append(candidate_kind(data[a:e]))
        if asked:
            p = np.maximum.reduceat(model.probabilities(np.stack(windows)), first)
            for (i, a, e), ok in zip(asked, p >= np.array(model.thresholds)[kinds], strict=True):
                if ok:
                    spans[i][1].append((a, 3, e, a))
        return [_in_code_points(data, sorted(found)) for data, found in spans]

    return map_text(docs, keep, text, "secret_spans array<struct<kind: string, start: bigint, end: bigint, value_start: bigint>>, clean_text string", compute)


def _in_code_points(data: bytes, spans: list[tuple[int, int, int, int]]) -> list[dict]:
    if not spans:
        return []
    if data.isascii():
        place = lambda x: x
    else:
        count = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
        place = lambda x: int(count[x])
    return [{"kind": KINDS[k], "start": place(s), "end": place(e), "value_start": place(v)} for s, k, e, v in spans]


def fitted(docs: DataFrame, text: str = "text") -> Net:
    """A net trained on all findings of docs."""
    return train_parts(*training_rows(docs, text))
