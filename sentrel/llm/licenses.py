"""Licence texts found by templates with optional and replaceable regions.

A template is licence wording with markup: ``<<beginOptional>> ... <<endOptional>>`` may be left out
(and nested), ``<<var;words=0-12>>`` stands for so many words of any kind, with ``match="..."`` for
words that match a regular expression. All templates are compiled into one token automaton. A text
is accepted where the mandatory wording stands word for word, with anything that the markup allows
in between; case, punctuation and line breaks play no part. The automaton is made deterministic as
texts need it, so a text is read once from each word that a template may begin with.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentrel.llm.common import slices, whole

#: Bytes of text handled together; remembered states of the automaton, and words' symbols.
SLICE, STATES, SYMBOLS = 4 << 20, 20_000, 200_000

#: Phrases whose places are counted, and the licence that each names.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]

#: Licence wording with markup.
TEMPLATES = [
    *PHRASES,
    ("mit", "licensed under the terms of the <<beginOptional>>expat or the<<endOptional>> mit license"),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;words=1-4>>"
        " and associated documentation files <<beginOptional>>(the <<var;words=1-3>>)<<endOptional>>, to deal in the"
        " <<var;words=1-3>> without restriction, including without limitation the rights to use, copy, modify,"
        " merge, publish, distribute, sublicense, and/or sell copies of the <<var;words=1-3>>, and to permit persons"
        " to whom the <<var;words=1-3>> is furnished to do so, subject to the following conditions: The above"
        " copyright notice and this permission notice <<beginOptional>>(including the next paragraph)"
        "<<endOptional>> shall be included in all copies or substantial portions of the <<var;words=1-3>>",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any"
        " purpose with or without fee is hereby granted, provided that the above copyright notice and this"
        " permission notice appear in all copies",
    ),
    (
        "bsd-2-clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code"
        " must retain the above copyright notice, this list of conditions and the following disclaimer"
        " <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice,"
        " this list of conditions and the following disclaimer in the documentation and/or other materials provided"
        " with the distribution",
    ),
    (
        "bsd-3-clause",
        "with the distribution <<beginOptional>>3<<endOptional>> Neither the name of <<var;words=1-12>> nor the names"
        " of <<beginOptional>>its<<endOptional>> <<beginOptional>>the<<endOptional>> contributors may be used to"
        " endorse or promote products derived from this software without specific prior written permission",
    ),
    (
        "apache-2",
        "Licensed under the Apache License, <<beginOptional>>Version 2.0<<endOptional>> <<beginOptional>>(the"
        " <<var;words=1-2>>)<<endOptional>>; you may not use this <<var;words=1-3>> except in compliance with the"
        " License",
    ),
    (
        "gpl-2",
        "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"
        " <<beginOptional>>either<<endOptional>> version 2",
    ),
    (
        "gpl-3",
        "GNU General Public License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>"
        " <<beginOptional>>either<<endOptional>> version 3",
    ),
    (
        "lgpl",
        "GNU <<beginOptional>>Library<<endOptional>> Lesser General Public License <<beginOptional>>as published by"
        " the Free Software Foundation<<endOptional>> <<beginOptional>>either<<endOptional>> version"
        ' <<var;words=1-2;match="[0-9]+">>',
    ),
    (
        "mpl-2",
        "subject to the terms of the Mozilla Public License, <<beginOptional>>v<<endOptional>>"
        " <<beginOptional>>version<<endOptional>> 2.0",
    ),
    ("cc-by", 'CC BY <<var;words=1-2;match="[0-9]+">>'),
    ("cc-by-sa", "CC BY SA"),
    ("cc-by-nc", "Creative Commons Attribution <<beginOptional>>-<<endOptional>> NonCommercial"),
    ("cc0", "CC0 1.0 <<beginOptional>>Universal<<endOptional>>"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]

#: Bytes that divide words become spaces, capital letters small ones.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
#: The same words as a regular expression on a text with small letters.
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_MARK = re.compile(r'<<(?:(beginOptional)|(endOptional)|var;words=(\d+)-(\d+)(?:;match="([^"]*)")?)>>')

SCHEMA = (
    "doc_id bigint, n_words bigint,"
    " places array<struct<template:int,label:string,first_word:bigint,n_words:bigint,mandatory:int>>"
)


def words_of(text: bytes) -> list[bytes]:
    """Words of a UTF-8 text: letters A to Z made small, ASCII other than letters and digits divides."""
    return text.translate(_FOLD).split()


@dataclass(frozen=True)
class Word:
    text: bytes


@dataclass(frozen=True)
class Gap:
    least: int
    most: int
    match: str | None


@dataclass(frozen=True)
class Optional:
    parts: tuple


def parse(markup: str) -> tuple:
    """Words, gaps and optional parts of a template."""
    levels: list[list] = [[]]
    at = 0
    for mark in [*_MARK.finditer(markup), None]:
        plain = markup[at : mark.start() if mark else len(markup)]
        levels[-1] += [Word(w) for w in words_of(plain.encode())]
        if mark is None:
            break
        at = mark.end()
        if mark[1]:
            levels.append([])
        elif mark[2]:
            if len(levels) == 1:
                raise ValueError("an optional region ends that has not begun")
            inner = tuple(levels.pop())
            if inner:
                levels[-1].append(Optional(inner))
        else:
            least, most = int(mark[3]), int(mark[4])
            if most < max(least, 1):
                raise ValueError("a replaceable region ends before it begins")
            levels[-1].append(Gap(least, most, mark[5]))
    if len(levels) > 1:
        raise ValueError("an optional region does not end")
    if not levels[0] or not isinstance(levels[0][0], Word):
        raise ValueError("a template begins with a mandatory word")
    return tuple(levels[0])


def mandatory(parts: tuple) -> int:
    """Number of words that may not be left out or replaced."""
    return sum(isinstance(p, Word) for p in parts)


class Automaton:
    """All templates as one automaton over words, made deterministic state by state.

    A symbol is a word of the templates, or any other word by the expressions that it matches.
    """

    def __init__(self, markups: Sequence[str]):
        self.templates = [parse(m) for m in markups]
        #: Of each place in a template: next places by word, next places by expression, free moves.
        self.by_word: list[dict[bytes, list[int]]] = []
        self.by_match: list[list[tuple[int, int]]] = []
        self.free: list[list[int]] = []
        self.ends: dict[int, int] = {}
        self.matches: list[re.Pattern[bytes]] = []
        self._numbers: dict[str | None, int] = {}
        starts = []
        for t, parts in enumerate(self.templates):
            start = self._place()
            starts.append(start)
            self.ends[self._chain(parts, start)] = t
        self.vocabulary = {w for moves in self.by_word for w in moves}
        self.starts = frozenset(w for s in starts for w in self.by_word[s])
        self._root = self._closure(starts)
        self.clear()

    def _place(self) -> int:
        self.by_word.append({})
        self.by_match.append([])
        self.free.append([])
        return len(self.free) - 1

    def _chain(self, parts: tuple, at: int) -> int:
        for part in parts:
            if isinstance(part, Word):
                to = self._place()
                self.by_word[at].setdefault(part.text, []).append(to)
            elif isinstance(part, Gap):
                if part.match not in self._numbers:
                    self._numbers[part.match] = len(self.matches)
                    self.matches.append(re.compile((part.match if part.match is not None else r"(?s:.*)").encode()))
                to = self._place()
                for i in range(part.most):
                    if i >= part.least:
                        self.free[at].append(to)
                    after = self._place()
                    self.by_match[at].append((self._numbers[part.match], after))
                    at = after
                self.free[at].append(to)
            else:
                to = self._place()
                self.free[at].append(to)
                self.free[self._chain(part.parts, at)].append(to)
            at = to
        return at

    def _closure(self, places: list[int]) -> frozenset[int]:
        seen, waiting = set(places), list(places)
        while waiting:
            for to in self.free[waiting.pop()]:
                if to not in seen:
                    seen.add(to)
                    waiting.append(to)
        return frozenset(seen)

    def clear(self) -> None:
        """Forget all states but the first."""
        self.states: list[frozenset[int]] = [frozenset(), self._root]
        self.number = {s: i for i, s in enumerate(self.states)}
        self.moves: list[dict] = [{}, {}]
        self.accepts: list[tuple[int, ...]] = [(), ()]
        self.symbols: dict[bytes, tuple] = {}

    def symbol(self, word: bytes) -> tuple:
        """What the automaton sees of a word; remembered."""
        found = self.symbols.get(word)
        if found is None:
            if len(self.symbols) >= SYMBOLS:
                self.symbols.clear()
            fits = tuple(bool(m.fullmatch(word)) for m in self.matches)
            found = self.symbols[word] = (word if word in self.vocabulary else None, fits)
        return found

    def step(self, state: int, symbol: tuple) -> int:
        """Next state; 0 is the state that nothing leaves."""
        word, fits = symbol
        to = []
        for place in self.states[state]:
            to += self.by_word[place].get(word, [])
            to += [p for number, p in self.by_match[place] if fits[number]]
        places = self._closure(to)
        found = self.number.get(places)
        if found is None:
            found = self.number[places] = len(self.states)
            self.states.append(places)
            self.moves.append({})
            self.accepts.append(tuple(sorted({self.ends[p] for p in places if p in self.ends})))
        self.moves[state][symbol] = found
        return found

    def find(self, words: list[bytes]) -> list[tuple[int, int, int]]:
        """``(start, end, template)`` of all places, each template's longest from a start."""
        starts = self.starts
        out = []
        for start in [i for i, w in enumerate(words) if w in starts]:
            if len(self.states) > STATES:
                self.clear()
            state, longest = 1, {}
            for at in range(start, len(words)):
                symbol = self.symbol(words[at])
                known = self.moves[state].get(symbol)
                state = self.step(state, symbol) if known is None else known
                if not state:
                    break
                for template in self.accepts[state]:
                    longest[template] = at + 1
            out += [(start, end, template) for template, end in sorted(longest.items())]
        return out


@cache
def automaton(markups: tuple[str, ...]) -> Automaton:
    return Automaton(markups)


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES)) -> DataFrame:
    """``doc_id, n_words`` and all ``places`` where a template's wording stands in the whole text.

    A place has the number and label of its template, its first word, how many words it takes, and
    how many of them are mandatory. Of places of one template from one word the longest counts; places
    may overlap. A null text counts as empty: no words, no places. Every row gives one row, also
    repeated rows and those with a null id; other columns, whatever their names, play no part.
    """
    labels = [label for label, _ in templates]
    markups = tuple(markup for _, markup in templates)
    wording = [mandatory(parse(m)) for m in markups]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(markups)
        for batch in slices(batches, "text", SLICE):
            counts, places = [], []
            for text in batch.column("text").cast(pa.binary()):
                words = words_of(text.as_py())
                counts.append(len(words))
                places.append(
                    [
                        {"template": t, "label": labels[t], "first_word": a, "n_words": b - a, "mandatory": wording[t]}
                        for a, b, t in machine.find(words)
                    ]
                )
            kind = pa.list_(
                pa.struct(
                    [
                        ("template", pa.int32()),
                        ("label", pa.string()),
                        ("first_word", pa.int64()),
                        ("n_words", pa.int64()),
                        ("mandatory", pa.int32()),
                    ]
                )
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(places, kind)],
                ["doc_id", "n_words", "places"],
            )

    return docs.select("doc_id", whole().alias("text")).mapInArrow(work, SCHEMA)


#: Words of mandatory wording that make a finding half certain.
HALF = 4


def report(docs: DataFrame) -> DataFrame:
    """Places of the phrases, labels with and without the templates', and a score, per document.

    ``score`` is m / (m + 4) with m the mandatory words of the longest wording that was found, 0
    without any.
    """
    base = F.filter("places", lambda p: p["template"] < len(PHRASES))
    found = scan(docs).withColumn("base", base)
    most = F.coalesce(F.array_max(F.col("places.mandatory")), F.lit(0))
    names = lambda places: F.array_join(F.array_sort(F.array_distinct(F.col(f"{places}.label"))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.first_word")).alias("first_word"),
        F.array_max(F.col("base.first_word")).alias("last_word"),
        names("base").alias("base_labels"),
        names("places").alias("labels"),
        (most / (most + HALF)).alias("score"),
    )


def _expression(parts: tuple) -> str:
    """A template as a regular expression on words that each follow a space."""
    out = ""
    for part in parts:
        if isinstance(part, Word):
            out += " " + part.text.decode()
        elif isinstance(part, Gap):
            out += f"(?: {part.match if part.match is not None else '[^ ]+'}){{{part.least},{part.most}}}"
        else:
            out += f"(?:{_expression(part.parts)})?"
    return out


def sql() -> str:
    """The same with one regular expression for each template over the joined words."""
    capitals = "".join(map(chr, range(65, 91)))

    def starts(phrase: str) -> str:
        same = " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split()))
        return f"list_filter(range(1, len(ws) + 1), lambda i: {same})"

    every = ", ".join(starts(p) for _, p in PHRASES)
    fits = [f"regexp_matches(t, '{_expression(parse(m))} ')" for _, m in TEMPLATES]
    labels = ", ".join(f"CASE WHEN {f} THEN '{label}' END" for (label, _), f in zip(TEMPLATES, fits))
    size = ", ".join(f"CASE WHEN {f} THEN {mandatory(parse(m))} ELSE 0 END" for (_, m), f in zip(TEMPLATES, fits))
    base = ", ".join(f"CASE WHEN {f} THEN '{label}' END" for (label, _), f in zip(PHRASES, fits))
    names = "array_to_string(list_sort(list_distinct([{}])), ',')"
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(
      translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '{_WORD}') AS ws FROM documents),
  p AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS t, flatten([{every}]) AS b FROM d),
  m AS (SELECT *, greatest({size}) AS m FROM p)
  SELECT doc_id, len(ws)::BIGINT AS n_words, len(b)::BIGINT AS n_base,
    list_min(b)::BIGINT - 1 AS first_word, list_max(b)::BIGINT - 1 AS last_word,
    {names.format(base)} AS base_labels, {names.format(labels)} AS labels,
    m / (m + {HALF})::DOUBLE AS score FROM m"""
