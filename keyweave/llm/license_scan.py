"""License notices by templates with optional and replaceable regions.

A template is wording with markup: `[[ ... ]]` may be left out, `{{m,n}}` stands for m to n words of any kind, all other
words are mandatory. It is compiled once into a token automaton whose states are the places between words. A text
is accepted where a run of its words leads from the first state to the last, so all mandatory wording is there,
in order and unchanged. Automata share an index of their first words and one of their guards, a mandatory word of
each: a text without a guard costs one intersection of sets, another one a look-up for each word, however many templates
there are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.columns import alnum_words, column
from keyweave.llm.license_templates import TEMPLATES

# The base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

_MARKUP = re.compile(r"(\[\[|\]\])|\{\{(\d+),(\d+)\}\}|([^\[\]{}\s]+)")
SPAN = "struct<template: string, first: int, words: int>"


class TokenAutomaton:
    """States are numbered places; a step takes one word. Free steps over optional regions are resolved at compile time."""

    def __init__(self, template: str):
        self.words: list[dict[bytes, int]] = [{}]  # by state: the next state for a word
        self.any: list[int | None] = [None]  # by state: the next state for whatever word
        self.free: list[set[int]] = [set()]  # by state: states reached without a word
        opened: list[int] = []
        here, mandatory = 0, []
        for bracket, least, most, word in _MARKUP.findall(template):
            if bracket == "[[":
                opened.append(here)
                here = self._state(free_from=here)
            elif bracket == "]]":
                start = opened.pop()
                here = self._state(free_from=here)
                self.free[start].add(here)
            elif word:
                after = self._state()
                self.words[here][word.encode()] = after
                here = after
                if not opened:
                    mandatory.append(word.encode())
            else:
                skippable = []
                for i in range(int(most)):
                    if i >= int(least):
                        skippable.append(here)
                    after = self._state()
                    self.any[here] = after
                    here = after
                for state in skippable:
                    self.free[state].add(here)
        self.last = here
        self.guard = max(mandatory, key=len)
        self.closed = [self._closure(s) for s in range(len(self.free))]
        self.first_words = {w for s in self.closed[0] for w in self.words[s]}

    def _state(self, free_from: int | None = None) -> int:
        self.words.append({})
        self.any.append(None)
        self.free.append(set())
        if free_from is not None:
            self.free[free_from].add(len(self.free) - 1)
        return len(self.free) - 1

    def _closure(self, state: int) -> frozenset[int]:
        seen, todo = {state}, [state]
        while todo:
            for s in self.free[todo.pop()] - seen:
                seen.add(s)
                todo.append(s)
        return frozenset(seen)

    def longest(self, words: list[bytes], start: int) -> int:
        """Words taken by the longest accepted run that begins at `start`; 0 for none."""
        states, taken, at = self.closed[0], 0, start
        while states and at < len(words):
            word, after = words[at], set()
            for s in states:
                for t in (self.words[s].get(word), self.any[s]):
                    if t is not None:
                        after |= self.closed[t]
            states, at = after, at + 1
            if self.last in states:
                taken = at - start
        return taken


@dataclass(frozen=True)
class Scan:
    n_words: int
    phrases: list[dict]
    notices: list[dict]
    covered: int


def covered_words(spans: list[dict]) -> int:
    """Words that are in one span or more."""
    n = end = 0
    for first, last in sorted((s["first"], s["first"] + s["words"]) for s in spans):
        n += max(0, last - max(first, end))
        end = max(end, last)
    return n


class LicenseScanner:
    def __init__(self, phrases: dict[str, str], templates: dict[str, str]):
        self.phrases = {tuple(p.encode().split()): label for p, label in phrases.items()}
        self.automata = {name: TokenAutomaton(t) for name, t in templates.items()}
        self.guarded: dict[bytes, list[str]] = {}
        for name, automaton in self.automata.items():
            self.guarded.setdefault(automaton.guard, []).append(name)

    def _starts(self, held: set[bytes]) -> dict[bytes, list[str]]:
        """The templates that may begin with a word, of those whose guard is held."""
        starts: dict[bytes, list[str]] = {}
        for guard in self.guarded.keys() & held:
            for name in self.guarded[guard]:
                for word in self.automata[name].first_words & held:
                    starts.setdefault(word, []).append(name)
        return starts

    def scan(self, text: str | None) -> Scan:
        words = alnum_words(text)
        held = set(words)
        phrases = [
            {"template": label, "first": i, "words": len(phrase)}
            for phrase, label in self.phrases.items()
            if held.issuperset(phrase)
            for i in range(len(words) - len(phrase) + 1)
            if words[i] == phrase[0] and tuple(words[i : i + len(phrase)]) == phrase
        ]
        starts = self._starts(held)
        notices = []
        ends: dict[str, int] = {}  # leftmost runs of a template that don't overlap
        for i, word in enumerate(words if starts else ()):
            for name in starts.get(word, ()):
                if i >= ends.get(name, 0) and (taken := self.automata[name].longest(words, i)):
                    notices.append({"template": name, "first": i, "words": taken})
                    ends[name] = i + taken
        notices.sort(key=lambda n: (n["first"], n["template"]))
        return Scan(len(words), phrases, notices, covered_words(notices))


def scan_licenses(
    df: DataFrame,
    text: str = "text",
    out: str = "license",
    phrases: dict[str, str] = PHRASES,
    templates: dict[str, str] = TEMPLATES,
) -> DataFrame:
    """Add a struct: the number of words, the places of base phrases, and the notices that a template accepts.

    Both are arrays of (template or label, first word from 0, number of words); places of a phrase are all counted,
    accepted runs of one template don't overlap, those of different ones may, and `covered` counts the words that are in
    any. A null counts as an empty text. Rows stay as they are, repeated
    ones too; an input column named like the output is replaced.
    """

    @F.arrow_udf(returnType=f"struct<n_words: bigint, phrases: array<{SPAN}>, notices: array<{SPAN}>, covered: bigint>")
    def scanned(texts: pa.Array) -> pa.Array:
        scanner = LicenseScanner(phrases, templates)
        found = [scanner.scan(value.as_py()) for value in texts]
        spans = pa.list_(pa.struct([("template", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
        return pa.StructArray.from_arrays(
            [
                pa.array([x.n_words for x in found], pa.int64()),
                pa.array([x.phrases for x in found], spans),
                pa.array([x.notices for x in found], spans),
                pa.array([x.covered for x in found], pa.int64()),
            ],
            ["n_words", "phrases", "notices", "covered"],
        )

    return df.withColumn(out, scanned(column(text).cast("string")))
