"""Secrets in texts: fixed patterns, and strings of high entropy in a sliding window.

A candidate is a run of characters that keys are made of. For each character class, a window slides over the maximal
runs of that class within it; the counts of its characters, and with them its entropy, change by one character in and
one out. The highest window decides. Allow-listed shapes (paths, identifiers in words, checksums by name, ...) are let go.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import column

# The base kinds, in the order that spans of one start are listed, with their patterns.
KINDS = ["assign", "access", "hex", "entropy"]
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the maximal runs of 24 characters and more
LEAST = 20  # characters of a candidate, and of a run of one class in it
#: With its padding; a run right before `=` and a value is the value's name.
_CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+(?:={1,2}(?![A-Za-z0-9+/_=-])|(?!=[A-Za-z0-9+/_-]))")

_URL = re.compile(r"""[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+""")

SPAN = "struct<kind: string, start: int, end: int>"


@dataclass(frozen=True)
class CharacterClass:
    """A run of these characters counts as secret if a window of it has at least so many bits a character."""

    name: str
    characters: str
    bits: float


@dataclass(frozen=True)
class EntropyRule:
    window: int = 20
    classes: tuple[CharacterClass, ...] = (
        CharacterClass("hex", "0123456789abcdefABCDEF", 3.0),
        CharacterClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=", 3.8),
        CharacterClass("url64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_=", 3.8),
    )
    #: Whole candidates that are no secrets: without a digit or without letters (words and plain numbers), repeated
    #: identifiers (UUIDs), words joined by separators, and capitalised words and years run together.
    allowed: tuple[str, ...] = (
        r"[^0-9]*",
        r"[^A-Za-z]*",
        r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}",
        r"[A-Za-z]*([/_+-]+([A-Za-z]+|[0-9]+))*[/_+-]*",
        r"[A-Za-z]+[0-9]{1,4}=*",
        r"[a-z]*([A-Z][a-z]{2,}|[0-9]{1,4})+",
    )


def highest_entropy(run: str, window: int) -> float:
    """The most bits a character in any window; a shorter run is one window.

    With n characters, bits = log2(n) - sum(c * log2(c)) / n over the counts c, so a step changes two terms.
    """
    terms = [0.0, *(c * log2(c) for c in range(1, window + 1))]
    counts: dict[str, int] = {}
    total, least = 0.0, float("inf")
    for i, ch in enumerate(run):
        if i >= window:
            old = run[i - window]
            counts[old] -= 1
            total += terms[counts[old]] - terms[counts[old] + 1]
        counts[ch] = counts.get(ch, 0) + 1
        total += terms[counts[ch]] - terms[counts[ch] - 1]
        if i >= window - 1:
            least = min(least, total)
    n = min(len(run), window)
    return log2(n) - (total if len(run) < window else least) / n if n else 0.0


class SecretFinder:
    def __init__(self, rule: EntropyRule):
        self.window = rule.window
        self.classes = [(frozenset(c.characters), c.bits) for c in rule.classes]
        self.runs = [re.compile(f"[{re.escape(c.characters)}]{{{LEAST},}}") for c in rule.classes]
        self.allowed = re.compile("|".join(f"(?:{a})" for a in rule.allowed))

    def base(self, text: str) -> list[tuple[int, int, str]]:
        spans = []
        low = text.lower()
        if any(w in low for w in _ASSIGN_WORDS):
            spans += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            spans += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
        return spans + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]

    def is_secret(self, run: str) -> bool:
        if self.allowed.fullmatch(run):
            return False
        own = set(run)
        return any(own <= characters and highest_entropy(run, self.window) >= bits for characters, bits in self.classes)

    def secrets(self, candidate: str) -> list[tuple[int, int]]:
        """The candidate if it is of one class, otherwise its runs of a class that are secret; overlapping ones are one."""
        if self.is_secret(candidate):
            return [(0, len(candidate))]
        if self.allowed.fullmatch(candidate):
            return []
        found: list[tuple[int, int]] = []
        for start, end in sorted({m.span() for run in self.runs for m in run.finditer(candidate) if self.is_secret(m[0])}):
            if found and start < found[-1][1]:
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
        return found

    def candidates(self, text: str) -> Iterator[tuple[int, str]]:
        """Candidates with their places; those in a URL are cut at `/`, for the parts of a path are no one string."""
        urls = [m.span() for m in _URL.finditer(text)] if "://" in text else []
        k = 0
        for m in _CANDIDATE.finditer(text):
            while k < len(urls) and urls[k][1] <= m.start():
                k += 1
            if k == len(urls) or m.start() < urls[k][0]:
                yield m.start(), m[0]
                continue
            for part in re.finditer(rf"[^/]{{{LEAST},}}", m[0]):
                yield m.start() + part.start(), part[0]

    def spans(self, text: str | None) -> list[dict]:
        """All spans by start and kind; a string of high entropy counts where no base span touches it."""
        if not text:
            return []
        found = self.base(text)
        for at, candidate in self.candidates(text):
            for start, end in self.secrets(candidate):
                start, end = at + start, at + end
                if not any(s < end and start < e for s, e, _ in found):
                    found.append((start, end, "entropy"))
        found.sort(key=lambda x: (x[0], KINDS.index(x[2])))
        return [{"kind": kind, "start": start, "end": end} for start, end, kind in found]


def find_secrets(df: DataFrame, text: str = "text", spans: str = "secret_spans", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Add the spans (kind, start, end in code points, end exclusive) of all secrets in each whole text.

    A null counts as an empty text and has no spans. Rows stay as they are, repeated ones too; an input column named
    like the output is replaced.
    """

    @F.arrow_udf(returnType=f"array<{SPAN}>")
    def found(texts: pa.Array) -> pa.Array:
        finder = SecretFinder(rule)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.array([finder.spans(value.as_py()) for value in texts], kind)

    return df.withColumn(spans, found(column(text).cast("string")))


def mask_secrets(df: DataFrame, text: str = "text", mask: str = "[SECRET]", rule: EntropyRule = EntropyRule()) -> DataFrame:
    """Put the mask in the place of each secret; overlapping spans are masked as one. A null stays null."""

    @F.arrow_udf(returnType="string")
    def masked(texts: pa.Array) -> pa.Array:
        finder, out = SecretFinder(rule), []
        for value in texts:
            whole = value.as_py()
            pieces, at = [], 0
            for span in finder.spans(whole):
                if span["start"] >= at:
                    pieces += [whole[at : span["start"]], mask]
                at = max(at, span["end"])
            out.append(whole if whole is None else "".join(pieces) + whole[at:])
        return pa.array(out, pa.string())

    return df.withColumn(text, masked(column(text)))
