"""Weak supervision: rules vote or abstain, expectation-maximisation weighs them, and the posterior decides.

Votes are computed beside the text in one narrow pass; only the counts of distinct vote patterns, at most 4 ** rules of them
whatever the input, are gathered to fit the model. The model is then a small table of numbers in an expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import WORD_PATTERN, split_batches, with_fields, written

WORDS = re.compile(WORD_PATTERN)
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: Each rule: up to which value of its statistic it votes good, and from which it votes weakly and strongly bad; between them it
#: abstains. None: it never votes so. Rules in LOW_RULES are on how small a value is, so their bounds fall.
RULES = {
    "symbols": (0.01, 0.10, 0.30),
    "symbol_chars": (0.002, 0.02, 0.06),
    "word_length": (6.0, 7.0, 9.0),
    "repeat_words": (0.02, 0.12, 0.30),
    "dup_lines": (0.0, 0.15, 0.30),
    "one_word": (0.09, 0.18, 0.30),
    "bars": (None, 0.05, 0.20),
    "upper": (0.08, 0.25, 0.60),
    "exclaims": (None, 0.10, 0.30),
}
LOW_RULES = {"n_words": (80.0, 49.0, 20.0), "distinct": (0.65, 0.45, 0.25), "stops": (0.03, 0.005, None)}
RULE_NAMES = [*RULES, *LOW_RULES]
#: Votes: strongly bad, weakly bad, abstain, good.
GRADES = "=-0+"
#: Dirichlet priors of a rule's rates of these votes, in pseudo-documents, for good and for bad texts; the same for all rules, and no rate has a bound.
PRIOR_IF_GOOD, PRIOR_IF_BAD = (0.5, 1.5, 4.0, 14.0), (4.0, 4.0, 8.0, 4.0)
#: Beta prior of the share of good texts, in pseudo-documents.
PRIOR_SHARE = (8.0, 2.0)
BASE = ["word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[str], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words found twice or more, first finds included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    base = len(ids)
    key = code[:n].copy()
    for k in range(1, width):
        if base ** (k + 1) >= 1 << 62:  # keep keys exact: renumber what has been joined so far
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + code[k : k + n]
    _, where, times = np.unique(key, return_inverse=True, return_counts=True)
    again = times[where] > 1
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(again)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + width, -1)
    return int(np.count_nonzero(np.cumsum(edge)[:-1]))


def statistics(text: str | None) -> tuple:
    """n_words, the four base counts, and the rules' statistics in the order of RULE_NAMES."""
    text = text or ""
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return (0, 0, len(SYMBOLS.findall(text)), 0, 0, *([0.0] * len(RULE_NAMES)))
    joined = "".join(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    symbols, again = len(SYMBOLS.findall(text)), repeated_words(words)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    upper = sum(map(str.isupper, joined)) / len(joined) if not joined.islower() else 0.0
    tail = "".join([w[-1] for w in words])
    return (
        n, len(joined), symbols, dup, again,
        symbols / n, symbols / len(joined), len(joined) / n, again / n, dup / lines, max(counts.values()) / n if n >= 20 else 0.0, counts.get("|", 0) / n, upper,
        tail.count("!") / n, float(n), min(1.0, len(counts) / min(n, 400)), sum(map(tail.count, ".,;:?!")) / n,
    )


def vote(name: str, value: float) -> str:
    """The rule's vote, one of GRADES."""
    if name in LOW_RULES:
        good, weak, strong = (None if x is None else -x for x in LOW_RULES[name])
        value = -value
    else:
        good, weak, strong = RULES[name]
    if strong is not None and value >= strong:
        return "="
    return "-" if value >= weak else "+" if good is not None and value <= good else "0"


def with_votes(df: DataFrame, key: str = "doc_id", text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, votes), and the columns to ``carry``.

    ``votes`` has one character for each rule: + good, 0 abstain, - weakly bad, = strongly bad. A text without words (null, empty, blank) has abstentions only. Keys may be
    null or repeat; equal texts have equal votes; texts are read whole.
    """
    carry = carry or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in batches for s in split_batches([b], text)):
            rows = [statistics(x) for x in batch.column(text).to_pylist()]
            votes = ["".join(map(vote, RULE_NAMES, row[5:])) if row[0] else "0" * len(RULE_NAMES) for row in rows]
            numbers = [pa.array([row[k] for row in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(key), *numbers, pa.array(votes, pa.string()), *(batch.column(c) for c in carry)], names=[key, "n_words", *BASE, "votes", *carry])

    schema = with_fields([df.schema[key], *StructType.fromDDL(f"n_words long, {', '.join(f'{c} long' for c in BASE)}, votes string"), *(df.schema[c] for c in carry)])
    return df.select(*dict.fromkeys([key, text, *carry])).mapInArrow(run, schema)


@dataclass
class Model:
    """Share of good texts, and the rates of each rule's four votes among good and among bad texts (rules x votes)."""

    share: float
    good: np.ndarray
    bad: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good quality of rows of votes (numbers of GRADES), given which rules are independent."""
        gap = np.log(self.good) - np.log(self.bad)
        odds = gap[np.arange(votes.shape[1]), votes].sum(1) + np.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))

    def accuracy(self) -> dict[str, float]:
        """Of each rule: how often it is right when it does not abstain."""
        right = self.share * self.good[:, 3] + (1 - self.share) * self.bad[:, :2].sum(1)
        wrong = self.share * self.good[:, :2].sum(1) + (1 - self.share) * self.bad[:, 3]
        return dict(zip(RULE_NAMES, (right / (right + wrong)).tolist()))


def grades(patterns: list[str]) -> np.ndarray:
    return np.array([[GRADES.index(c) for c in p] for p in patterns], dtype=np.int64)


def fit(patterns: list[tuple[str, int]], steps: int = 100) -> Model:
    """Rates of votes by expectation-maximisation over the counts of vote patterns, from the priors above.

    No patterns: the priors' model. Same patterns and counts, same result, in any order.
    """
    patterns = sorted(patterns)
    width = len(patterns[0][0]) if patterns else len(RULE_NAMES)
    votes, count = grades([p for p, _ in patterns]).reshape(-1, width), np.array([c for _, c in patterns], dtype=float)
    pick = np.stack([(votes == v) for v in range(len(GRADES))], axis=2).astype(float)  # patterns x rules x votes

    def rates(weight: np.ndarray, prior: tuple[float, ...]) -> np.ndarray:
        return (np.tensordot(weight, pick, 1) + prior) / (weight.sum() + sum(prior))

    none = np.zeros(len(patterns))
    model = Model(PRIOR_SHARE[0] / sum(PRIOR_SHARE), rates(none, PRIOR_IF_GOOD), rates(none, PRIOR_IF_BAD))
    for _ in range(steps if patterns else 0):
        p = model.posterior(votes)
        model = Model((count @ p + PRIOR_SHARE[0]) / (count.sum() + sum(PRIOR_SHARE)), rates(count * p, PRIOR_IF_GOOD), rates(count * (1 - p), PRIOR_IF_BAD))
    return model


def fitted(voted: DataFrame) -> Model:
    """The model of all rows' votes. Only the counts of vote patterns that occur come to the driver: at most 4 ** rules, whatever the input."""
    return fit([(r[0], r[1]) for r in voted.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()])


def quality(voted: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """``voted`` with quality_probability, base_failed and kept, by an expression of the model's numbers."""
    gap = np.log(model.good) - np.log(model.bad)
    odds = F.lit(float(np.log(model.share / (1 - model.share))))
    for k, row in enumerate(gap.tolist()):
        letter = F.substring("votes", k + 1, 1)
        odds = odds + F.when(letter == "=", row[0]).when(letter == "-", row[1]).when(letter == "+", row[3]).otherwise(row[2])
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = voted.withColumn("quality_probability", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality_probability") >= threshold))


def judge(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, the base counts, votes, quality_probability, base_failed, kept) of every row; the statistics are written once, so texts are read once.

    A row whose base counts fail is not kept; of the others the posterior decides, so a weak bad vote may be outweighed, and abstentions
    alone may not be enough. A null or empty text has no words and fails. Repeated rows each count; an empty table gives an empty one; other columns
    are dropped.
    """
    voted = written(df.sparkSession, with_votes(df, key, text), "votes")
    return quality(voted, fitted(voted))


def kept_rows(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns. Votes are computed twice, to fit and to decide, so that no row is stored between."""
    rows = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row"))
    model = fitted(with_votes(rows, "_key", "_text"))
    return quality(with_votes(rows, "_key", "_text", carry=["_row"]), model).filter("kept").select("_row.*")
