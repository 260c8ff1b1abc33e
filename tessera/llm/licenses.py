"""License scans: one Aho-Corasick pass for notice phrases, one for identifier tags, and a shunting-yard parser of license expressions.

A text's words (lower-cased, letters and digits) stand between single spaces, so that the automaton of all phrases reports every place
where a phrase's words follow each other, overlaps included.  Identifier tags are looked for in the text itself; what follows one on
its line is read as an expression of identifiers, parentheses, ``with``, ``and`` and ``or``
(binding in this order).  It is evaluated while it is parsed: how far it restricts use is the lesser side's for ``or``, the greater side's for
``and``, and half the licence's for ``with`` an exception.  A document's score is its most restrictive finding, 0 without any.

Each row is judged by itself within its task, so nothing is shuffled, and a text is held in memory with its words and no more.

Defined cases: a null or empty text has no words, no places, no labels and score 0; an expression ends at the first token that can't go on
with it, a dangling operator is dropped, an open parenthesis is closed at the end, a second tag on a line begins an expression of its own; an identifier of no known
family has no label and restricts as UNKNOWN; repeated rows give repeated results; a null doc_id is kept; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.frames import table
from tessera.llm.words import LETTERS, chunks

#: Phrases of the base and their labels: fixed values.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Further notice phrases and their labels.
NOTICES = {
    "affero general public license": "agpl", "apache license": "apache", "artistic license": "artistic", "boost software license": "bsl", "bsd license": "bsd",
    "cc by nc": "cc-by-nc", "cc by nd": "cc-by-nd", "cc by sa": "cc-by-sa", "cc0": "cc0", "creative commons attribution": "cc-by", "creative commons zero": "cc0",
    "eclipse public license": "epl", "european union public licence": "eupl", "isc license": "isc", "lesser general public license": "lgpl",
    "mit license": "mit", "mozilla public license": "mpl", "released into the public domain": "public-domain", "this is free and unencumbered software": "unlicense",
    "without permission of the copyright holder": "reserved",
}
#: Tags that an expression follows.
TAGS = ("spdx-license-identifier:", "license-expression:", "package-license-declared:", "package-license-concluded:")
#: How far a label restricts use, from 0 (not at all) to 1 (no use).
RESTRICTS = {
    "cc0": 0.0, "public-domain": 0.0, "unlicense": 0.0, "bsl": 0.1, "isc": 0.1, "mit": 0.1, "bsd": 0.1, "apache": 0.15, "artistic": 0.2, "cc-by": 0.2,
    "epl": 0.4, "mpl": 0.4, "lgpl": 0.5, "eupl": 0.5, "cc-by-sa": 0.6, "gpl": 0.7, "agpl": 0.8, "cc-by-nd": 0.85, "cc-by-nc": 0.9, "reserved": 1.0,
}
#: That of an identifier of no known family.
UNKNOWN = 0.75
#: Identifiers that don't begin with the label of their family.
OTHER_NAMES = {"cc-pdm": "public-domain", "0bsd": "bsd"}

_BINDS = {"or": 1, "and": 2, "with": 3}
_TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9.+:_-]+)")
_INSIDE = bytes(b if inside else 0x20 for b, inside in enumerate(LETTERS.tolist()))
_WORD = bytes(_INSIDE[b + 32 if 0x41 <= b <= 0x5A else b] for b in range(256))
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


class Meaning(NamedTuple):
    """What an expression names, and how far it restricts use."""

    labels: frozenset[str]
    restricts: float


@dataclass
class Place:
    label: str
    start: int
    words: int
    base: bool


@dataclass
class Expression:
    text: str
    labels: list[str]
    restricts: float


def family(identifier: str) -> Meaning:
    """The longest label that an identifier begins with (``gpl-2.0-or-later``: gpl)."""
    known = [(name, label) for name, label in (*OTHER_NAMES.items(), *((x, x) for x in RESTRICTS)) if identifier == name or identifier.startswith((f"{name}-", f"{name}+"))]
    label = max(known, key=lambda x: len(x[0]), default=("", None))[1]
    return Meaning(frozenset(), UNKNOWN) if label is None else Meaning(frozenset([label]), RESTRICTS[label])


def joined(operator: str, left: Meaning, right: Meaning) -> Meaning:
    if operator == "with":
        return Meaning(left.labels, left.restricts / 2)
    both = left.labels | right.labels
    return Meaning(both, min(left.restricts, right.restricts) if operator == "or" else max(left.restricts, right.restricts))


def tokens(text: str, start: int = 0) -> tuple[list[str], int]:
    """The tokens of the license expression at start of a lower-cased text, whole and with all parentheses closed, and its end."""
    found: list[tuple[str, int]] = []
    depth, operand, at = 0, True, start
    while m := _TOKEN.match(text, at):
        token, at = m.group(1), m.end()
        if token in TAGS or (token == "(" or token not in (")", *_BINDS)) != operand or (token == ")" and not depth):
            break
        depth += (token == "(") - (token == ")")
        operand = token == "(" or token in _BINDS
        found.append((token, at))
    while found and (found[-1][0] == "(" or found[-1][0] in _BINDS):
        depth -= found.pop()[0] == "("
    return [t for t, _ in found] + [")"] * depth, found[-1][1] if found else start


def evaluated(expression: list[str]) -> Meaning:
    """The meaning of a whole expression's tokens, by a shunting yard that joins values as soon as an operator is settled."""
    values: list[Meaning] = []
    waiting: list[str] = []

    def settle(least: int) -> None:
        while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= least:
            right, left = values.pop(), values.pop()
            values.append(joined(waiting.pop(), left, right))

    for token in expression:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            settle(0)
            waiting.pop()
        elif token in _BINDS:
            settle(_BINDS[token])
            waiting.append(token)
        else:
            values.append(family(token.rstrip(".:")))
    settle(0)
    return values[0]


@cache
def automata() -> tuple:
    """Automata of all phrases (each between spaces) and of all tags, once for each worker."""
    import ahocorasick

    phrases, tags = ahocorasick.Automaton(), ahocorasick.Automaton()
    for phrase, label in (*NOTICES.items(), *BASE.items()):
        phrases.add_word(f" {phrase} ", (label, phrase.count(" ") + 1, phrase in BASE))
    for tag in TAGS:
        tags.add_word(tag, tag)
    phrases.make_automaton()
    tags.make_automaton()
    return phrases, tags


def places(words: list[bytes]) -> Iterator[Place]:
    """Every place where a phrase's words stand one after another, by where they end."""
    said = f" {b' '.join(words).decode()} "
    seen = before = 0
    for end, (label, n, base) in automata()[0].iter(said):
        before += said.count(" ", seen, end)  # spaces before the phrase's last one: words up to its end
        seen = end
        yield Place(label, before - n, n, base)


def expressions(text: str) -> Iterator[Expression]:
    """The license expressions that follow identifier tags."""
    low = text.translate(_LOWER)
    for end, _ in automata()[1].iter(low):
        found, to = tokens(low, end + 1)
        if found:
            meaning = evaluated(found)
            yield Expression(text[end + 1 : to].strip(), sorted(meaning.labels), meaning.restricts)


PLACES = "array<struct<label:string,start:long,words:int,base:boolean>>"
FOUND = "array<struct<text:string,labels:array<string>,restricts:double>>"
_PLACES = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("words", pa.int32()), ("base", pa.bool_())]))
_FOUND = pa.list_(pa.struct([("text", pa.string()), ("labels", pa.list_(pa.string())), ("restricts", pa.float64())]))


def scan(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, n_words, places, expressions, labels (distinct, sorted), score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            counts, spots, read, labels, scores = [], [], [], [], []
            for raw in texts:
                words = raw.translate(_WORD).split()
                here, said = list(places(words)), list(expressions(raw.decode()))
                counts.append(len(words))
                spots.append([vars(p) for p in here])
                read.append([vars(e) for e in said])
                labels.append(sorted({p.label for p in here}.union(*(e.labels for e in said))))
                scores.append(max([0.0, *(RESTRICTS[p.label] for p in here), *(e.restricts for e in said)]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(spots, _PLACES), pa.array(read, _FOUND), pa.array(labels, pa.list_(pa.string())), pa.array(scores, pa.float64())],
                ["doc_id", "n_words", "places", "expressions", "labels", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id long, n_words long, places {PLACES}, expressions {FOUND}, labels array<string>, score double")


def digests(docs: DataFrame) -> DataFrame:
    """Per row of docs: doc_id, n_words; the number, first and last start and labels of the base's places; labels (joined by commas); score."""
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["start"])
    return scan(docs).select(
        "doc_id", "n_words", F.size(starts).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda p: p["label"]))), ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def op12_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
