"""Quality rules as weak supervision.

Each rule looks at a text's statistics and votes good (2), bad (1) or abstains (0), in a grey zone or where the text is
too short for it. A text's votes make a pattern; texts are counted by pattern, of which there are at most 3 ** len(RULES), so that
expectation-maximisation over all texts runs on a table of bounded size. It estimates how often each rule votes each
way on good texts and on texts that are bad in each of a few ways (WAYS), and the share of each kind; no estimate is bounded. Two or
more rules see each way of being bad, so that a rule's errors show in the votes of its fellows: a single bad vote that no other rule
bears out is a misfire, and abstentions that go together speak against a text like bad votes do. Each pattern gets its posterior
probability of being good. That posterior, not a demand that every rule pass, decides which texts are kept.

Defined results: a null or empty text has no words, so the base rules fail and it is not kept; rules abstain on
texts too short for them; repeated rows count each time; with an empty table the estimates stay at their start;
very long texts are read whole; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.columns import map_text
from weftline.llm.words import U, Words, blocks, chained, mix64
from weftline.session import materialize

WINDOW = 8
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
_WHITE = " \t\n\x0b\x0c\r"
STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_letters", "n_marks", "n_distinct", "n_signs", "n_bytes", "n_bare", "n_capital", "n_again"]


def _per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offs])


def block_statistics(raw: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """The statistics of every text of a block."""
    w = Words(raw, offs)
    n, texts = np.diff(w.first), np.arange(len(offs) - 1)
    owner = np.repeat(texts, n)
    hashes = w.hashes()
    out = {"n_words": n, "word_chars": _per_text(w.inside & ((raw & 0xC0) != 0x80), offs), "n_symbols": _per_text(SYMBOLS[raw], offs)}

    dup, lines_n = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    data = raw.tobytes()
    for i in texts:
        lines = [x for x in data[offs[i] : offs[i + 1]].split(b"\n") if x.strip()]
        lines_n[i], dup[i] = len(lines), len(lines) - len(set(lines))
    out |= {"n_dup_lines": dup, "n_lines": lines_n}

    windows = chained(hashes, WINDOW)
    inside = owner[: windows.size] == owner[WINDOW - 1 :] if windows.size else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    keys = mix64(windows[at] + owner[at].astype(np.uint64) * U(0x9E3779B97F4A7C15))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(at.size, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(hashes.size + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    out["n_repeat_words"] = _per_text(np.cumsum(step[:-1]) > 0, w.first)

    upper, lower = (raw >= 65) & (raw <= 90), (raw >= 97) & (raw <= 122)
    out |= {"n_upper": _per_text(upper, offs), "n_letters": _per_text(upper | lower, offs), "n_marks": _per_text((raw == 33) | (raw == 63), offs)}
    letter = upper | lower | (raw >= 128)  # bytes beyond ASCII count as letters
    out |= {"n_signs": _per_text(w.inside & ~letter, offs), "n_bytes": _per_text(w.inside, offs)}
    letters, low = (np.concatenate([[0], np.cumsum(x)]) for x in (letter, lower))
    held = letters[w.end] - letters[w.start]
    out |= {"n_bare": _per_text(held == 0, w.first), "n_capital": _per_text((held >= 3) & (low[w.end] == low[w.start]), w.first)}
    again = np.zeros(hashes.size, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["n_again"] = _per_text(again, w.first)
    keys = mix64(hashes + owner.astype(np.uint64) * U(0x9E3779B97F4A7C15))
    _, first = np.unique(keys, return_index=True)
    out["n_distinct"] = np.bincount(owner[first], minlength=len(n))
    return out


def _vote(x: np.ndarray, able: np.ndarray, bad: np.ndarray, good: np.ndarray) -> np.ndarray:
    return np.where(able & bad, 1, np.where(able & good, 2, 0))


def _rule(of: str, over: str, bad, good, able: str = "n_words", least: int = 10):
    """Votes by the ratio of two statistics: bad and good are conditions on it, between which the rule abstains."""

    def vote(s: dict[str, np.ndarray]) -> np.ndarray:
        ratio = s[of] / np.maximum(s[over], 1)
        return _vote(ratio, s[able] >= least, bad(ratio), good(ratio))

    return vote


def _above(bad: float, good: float):
    return lambda x: x > bad, lambda x: x < good


#: Votes from statistics s; each rule abstains in the grey zone between its bounds.
RULES = {
    "length": lambda s: _vote(s["n_words"], s["n_words"] > 0, s["n_words"] < 20, s["n_words"] >= 60),
    "word_length": _rule("word_chars", "n_words", lambda m: (m < 2.5) | (m > 9), lambda m: (m > 3.5) & (m < 7)),
    "symbols": _rule("n_symbols", "n_words", *_above(0.1, 0.03)),
    "signs": _rule("n_signs", "n_bytes", *_above(0.15, 0.08)),
    "bare_words": _rule("n_bare", "n_words", *_above(0.1, 0.03)),
    "marks": _rule("n_marks", "n_words", *_above(0.3, 0.1)),
    "upper_case": _rule("n_upper", "n_letters", *_above(0.4, 0.15), "n_letters", 40),
    "capital_words": _rule("n_capital", "n_words", *_above(0.3, 0.1)),
    "repeated_lines": _rule("n_dup_lines", "n_lines", *_above(0.3, 0.05), "n_lines", 3),
    "repeated_words": _rule("n_repeat_words", "n_words", *_above(0.3, 0.05), "n_words", 20),
    "variety": lambda s: (lambda m: _vote(m, s["n_words"] >= 20, m < 1.5, m > 4))(s["n_distinct"] / np.sqrt(np.maximum(s["n_words"], 1))),
    "stutter": _rule("n_again", "n_words", *_above(0.2, 0.06)),
}
#: The rules that see each way of being bad.
WAYS = {
    "signs": ("symbols", "signs", "bare_words"),
    "shouting": ("marks", "upper_case", "capital_words"),
    "repetition": ("repeated_lines", "repeated_words", "variety", "stutter"),
    "shape": ("length", "word_length"),
}


def statistics_of(docs: DataFrame, keep: list[Column | str], text: str) -> DataFrame:
    """The kept columns, all statistics and `votes`, the pattern of votes as a number in base 3."""
    names = [*STATISTICS, *MORE, "votes"]

    def compute(texts: pa.Array) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for first, last, raw, offs in blocks(texts):
            s = block_statistics(raw, offs)
            s["votes"] = np.zeros(last - first, np.int64)
            for k, rule in enumerate(RULES.values()):
                s["votes"] += rule(s) * 3**k
            yield first, last, [pa.array(s[x].astype(np.int64)) for x in names]

    return map_text(docs, keep, text, ", ".join(f"{x} long" for x in names), compute, ("quality", "base_failed", "kept"))


def _start() -> np.ndarray:
    """Kinds x rules x (abstains, bad, good) before any text is seen."""
    names = list(RULES)
    out = np.tile([0.08, 0.02, 0.9], (1 + len(WAYS), len(names), 1))
    for kind, seen_by in enumerate(WAYS.values(), 1):
        out[kind] = [0.2, 0.1, 0.7]
        out[kind, [names.index(x) for x in seen_by]] = [0.15, 0.7, 0.15]
    return out


@dataclass
class Estimates:
    """A text is good (kind 0) or bad in one of WAYS."""

    shares: np.ndarray = field(default_factory=lambda: np.array([0.8, *[0.2 / len(WAYS)] * len(WAYS)]))
    votes: np.ndarray = field(default_factory=_start)  # kinds x rules x (abstains, bad, good): how often a rule votes so on texts of the kind

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """votes: patterns x rules of 0, 1, 2. Probabilities: patterns x kinds."""
        logs = np.log(self.votes)[:, np.arange(votes.shape[1]), votes].sum(2).T + np.log(self.shares)
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        return self.kinds(votes)[:, 0]


def unpack(patterns: np.ndarray) -> np.ndarray:
    return np.stack([patterns // 3**k % 3 for k in range(len(RULES))], 1)


#: The start counts as this many texts of each kind.
PRIOR = 5.0


def fit(patterns: np.ndarray, counts: np.ndarray, rounds: int = 500, start: Estimates | None = None) -> Estimates:
    """Expectation-maximisation over counted patterns. The start says which votes mean what; the counts outweigh it."""
    first = e = start or Estimates()
    if not counts.sum():
        return e
    votes, n = unpack(patterns), counts.astype(float)[:, None]
    cast = [(votes == v).astype(float) for v in range(3)]
    for _ in range(rounds):
        w = e.kinds(votes) * n
        seen = np.stack([w.T @ c for c in cast], 2) + PRIOR * first.votes
        before, e = e, Estimates((w.sum(0) + first.shares) / (w.sum() + 1), seen / seen.sum(2, keepdims=True))
        if max(np.abs(e.shares - before.shares).max(), np.abs(e.votes - before.votes).max()) < 1e-9:
            break
    return e


def judged(docs: DataFrame, keep: list[Column | str], text: str, threshold: float = 0.5) -> DataFrame:
    """The kept columns, statistics, base_failed, quality (posterior) and kept."""
    spark = docs.sparkSession
    stats = materialize(statistics_of(docs, keep, text), "rule-statistics")
    table = stats.groupBy("votes").agg(F.count("*").alias("n")).toPandas().sort_values("votes")  # 3 ** len(RULES) rows at most, 531,441
    patterns = table["votes"].to_numpy(np.int64)
    posterior = fit(patterns, table["n"].to_numpy(np.int64)).posterior(unpack(patterns))
    known = spark.createDataFrame(list(zip(patterns.tolist(), posterior.tolist(), strict=True)), "votes long, quality double")
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = stats.join(F.broadcast(known), "votes", "left").withColumn("base_failed", base)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))
