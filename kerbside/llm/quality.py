"""Quality rules, line first.

Each line is judged by itself: by its punctuation (too many symbols or exclamations), as
navigation (items between separators) and as boilerplate (stock phrases). Failing lines are
removed. A document is rejected if that takes more than half of its text, or if it fails one
of the base rules on the whole text: fewer than 20 words, or more than 30 % of its words in
windows of eight that occur twice or more.

Words are runs of anything but the six ASCII white-space characters.

Cases: a null text has no words and is rejected; so is an empty one. Repeated rows are judged
each for itself. Other columns are ignored. Texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbside.llm.common import WordHashes, sequence_hashes, slices

SYMBOLS = "#*$%&|<>"

#: Words that separate the items of a menu.
SEPARATORS = ("|", "»", "›", "•", "·", ">", "/")

#: Stock phrases of boilerplate, in any case.
BOILERPLATE = (
    r"all rights reserved", r"\b(licensed|released) under\b", r"\bcopyright (\(c\)|©|[0-9]{4})", r"\bprivacy policy\b",
    r"\bterms of (use|service)\b", r"\b(use|accept|uses) cookies\b", r"\benable javascript\b", r"\bclick here\b",
    r"\bsubscribe to our\b", r"\bshare (this|on) (page|facebook|twitter)\b", r"lorem ipsum",
)

#: Base rules and the share of text that may go.
LEAST_WORDS, REPEAT_PERCENT, WINDOW, LOST_PERCENT = 20, 30, 8, 50

_STOCK = re.compile("|".join(BOILERPLATE), re.IGNORECASE | re.ASCII)
_SPACE = " \t\n\r\v\f"


@dataclass(frozen=True)
class Line:
    """Counts of one line with words."""

    text: str
    words: int
    chars: int

    def failure(self) -> str | None:
        """The rule that the line fails, if any."""
        symbols = sum(map(self.text.count, SYMBOLS))
        if 10 * symbols > self.chars and symbols >= 3 and not self._menu():
            return "punctuation"
        shouts = self.text.count("!") + self.text.count("?")
        if shouts >= 4 and 2 * shouts > self.words:
            return "punctuation"
        if self._menu():
            return "navigation"
        if _STOCK.search(self.text):
            return "boilerplate"
        return None

    def _menu(self) -> bool:
        items = sum(self.text.count(s) for s in SEPARATORS if s in self.text)
        if items < 3:
            return False
        items = sum(w in SEPARATORS for w in words_of(self.text))
        return items >= 3 and 5 * items >= self.words


def words_of(text: str) -> list[str]:
    return [w.decode() for w in text.encode().split()]


def _chars(text: str) -> int:
    return len(text) - sum(map(text.count, _SPACE))


def repeated_words(words: list[bytes], hashes: WordHashes) -> int:
    """Words that lie in a window of ``WINDOW`` words found twice or more."""
    if len(words) <= WINDOW:
        return 0
    windows = sequence_hashes(hashes.of(words), tuple(range(WINDOW)))
    if len(np.unique(windows)) == len(windows):
        return 0
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[inverse] > 1)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + WINDOW, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


@dataclass(frozen=True)
class Verdict:
    """What the rules found in one text, and the text without failing lines."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    n_failed_lines: int
    lost_chars: int
    base_failed: bool
    kept: bool
    cleaned: str


def judge(text: str | None, hashes: WordHashes) -> Verdict:
    text = text or ""
    raw = text.encode()
    words = raw.split()
    total = _chars(text)
    repeats = repeated_words(words, hashes)
    seen, n_lines, failed, lost, kept_lines = set(), 0, 0, 0, []
    for line in text.split("\n"):
        chars = _chars(line)
        if not chars:
            kept_lines.append(line)
            continue
        n_lines += 1
        seen.add(line)
        if Line(line, len(line.encode().split()), chars).failure():
            failed, lost = failed + 1, lost + chars
        else:
            kept_lines.append(line)
    base_failed = len(words) < LEAST_WORDS or 100 * repeats > REPEAT_PERCENT * len(words)
    return Verdict(
        len(words), total, sum(map(text.count, SYMBOLS)), n_lines - len(seen), repeats, failed, lost,
        base_failed, not base_failed and 100 * lost <= LOST_PERCENT * total, "\n".join(kept_lines))


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_SCHEMA = (
    "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS)
    + ", base_failed boolean, kept boolean, n_failed_lines bigint, lost_chars bigint")


def evaluate(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """One verdict per document; ``with_text`` adds ``cleaned``, the text of the lines left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in slices(batches):
            found = [judge(t, hashes) for t in b.column("text").to_pylist()]
            names = [*COUNTS, "base_failed", "kept", "n_failed_lines", "lost_chars"] + ["cleaned"] * with_text
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *[pa.array([getattr(v, n) for v in found], k) for n, k in zip(names, kinds, strict=True)]],
                ["doc_id", *names])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, _SCHEMA + (", cleaned string" if with_text else ""))
