"""License scans: Aho-Corasick over word streams, and licence expressions by a shunting-yard parser.

A text is reduced to its words (ASCII letters in lower case, digits, all non-ASCII
characters; everything else separates).  One Aho-Corasick automaton over the word
stream finds all notice phrases and the places of identifier tags.  The expression after
a tag is read from the original text, parsed by the shunting-yard method with the
precedence WITH, AND, OR, and evaluated to nested terms of alternatives and requirements,
without expansion and with absorption; ``expressions`` holds them as text and
``required_labels`` the labels that hold whichever alternative is taken, so AND and OR
differ.  Labels are those of the base phrases, of further notice phrases and of all
identifiers in valid expressions.

Score: 1 for a valid expression, 0.9 for a full notice phrase, 0.6 for a bare licence
name, 0 for no evidence; the best evidence counts.

Scale: one Arrow pass without shuffle over whole texts in slices of bounded bytes; time
is linear in the text.

Edge cases: null text is empty (no words, no labels, score 0, null places); malformed
expressions give no label, but an operator that ends a line is passed over; repeated rows
are scanned once each; result columns win over carried columns of the same name; an empty
table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ids_field, others, quoted, slices, utf8

RESULT = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "required_labels")

# Phrases of the scan contract.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases: label, and how much they prove.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "released under the mit license": ("mit", 0.9),
    "licensed under the apache license version 2 0": ("apache", 0.9),
    "licensed under the apache license": ("apache", 0.9),
    "licensed under the gnu general public license": ("gpl", 0.9),
    "under the terms of the gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "redistribution and use in source and binary forms with or without modification": ("bsd", 0.9),
    "bsd license": ("bsd", 0.6),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "creative commons attribution": ("cc-by", 0.6),
    "licensed under cc by": ("cc-by", 0.9),
    "licensed under cc by sa": ("cc-by-sa", 0.9),
    "licensed under cc by nc": ("cc-by-nc", 0.9),
    "licensed under cc by nd": ("cc-by-nd", 0.9),
    "creative commons zero": ("cc0", 0.6),
    "cc0 1 0": ("cc0", 0.9),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("all-rights-reserved", 0.9),
}
TAG = "spdx license identifier"
#: First parts of licence identifiers and their labels; the longest that fits counts.
FAMILIES = {
    "mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "bsl": "bsl", "isc": "isc", "zlib": "zlib", "unlicense": "public-domain",
    "cc0": "cc0", "cc-by": "cc-by", "cc-by-sa": "cc-by-sa", "cc-by-nc": "cc-by-nc", "cc-by-nd": "cc-by-nd", "python": "python", "postgresql": "postgresql", "artistic": "artistic", "eupl": "eupl", "wtfpl": "wtfpl",
}

_OTHER = bytes(b for b in range(128) if not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122))
_FOLD = bytes.maketrans(_OTHER + bytes(range(65, 91)), b" " * len(_OTHER) + bytes(range(97, 123)))
_TOKEN = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.:+-]*)")
_TAG_AT = re.compile(r"spdx[^0-9a-z]+license[^0-9a-z]+identifier[ \t]*:[ \t]*([^\r\n]*)", re.I)
_DANGLING = re.compile(r"(?:\s+(?:and|or|with)\b)+\W*$", re.I)
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


class ExpressionError(ValueError):
    """Not a licence expression."""


def to_postfix(text: str) -> list[str]:
    """Shunting-yard: the expression at the start of ``text`` in postfix order; what follows it is ignored."""
    output: list[str] = []
    stack: list[str] = []
    operand, at, depth = True, 0, 0
    while m := _TOKEN.match(text, at):
        token = m[1]
        word = token.upper()
        if operand:
            if token == "(":
                stack.append(token)
                depth += 1
            elif token == ")" or word in PRECEDENCE:
                raise ExpressionError(text)
            else:
                output.append(token)
                operand = False
        elif token == ")":
            if not depth:
                break
            while stack[-1] != "(":
                output.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in PRECEDENCE:
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[word]:
                output.append(stack.pop())
            stack.append(word)
            operand = True
        else:
            break
        at = m.end()
    if operand or depth:
        raise ExpressionError(text)
    return output + stack[::-1]


@dataclass
class Terms:
    """Licences (``leaves``) and nested terms joined by one operator; a single licence has no operator."""

    op: str | None
    leaves: set[str] = field(default_factory=set)
    nested: list[Terms] = field(default_factory=list)

    def settled(self) -> Terms:
        """Without what a licence beside it absorbs: A OR (A AND B) is A, A AND (A OR B) is A."""
        self.nested = [t for t in self.nested if t.leaves.isdisjoint(self.leaves)]
        if not self.nested and len(self.leaves) == 1:
            self.op = None
        return self

    def joined(self, op: str, other: Terms) -> Terms:
        """Both terms under ``op``; the larger one takes the smaller one in, so chains of any length stay linear."""
        ends = sorted((t if t.op == op else Terms(op, *_parts(t.settled())) for t in (self, other)), key=lambda t: len(t.leaves) + len(t.nested))
        ends[1].leaves |= ends[0].leaves
        ends[1].nested += ends[0].nested
        return ends[1]

    def text(self) -> str:
        """Licences in order, then nested terms in brackets."""
        out: list[str] = []
        todo: list[Terms | str] = [self]
        while todo:
            t = todo.pop()
            if isinstance(t, str):
                out.append(t)
                continue
            out.append(f" {t.op} ".join(sorted(t.leaves)))
            for k, sub in reversed(list(enumerate(sorted(t.nested, key=lambda n: sorted(n.leaves))))):
                todo += [")", sub, f" {t.op} (" if k or t.leaves else "("]
        return "".join(out)

    def required(self) -> set[str]:
        """Licences of the outer two levels that hold whichever choice is taken."""
        if self.op != "OR":
            return set(self.leaves)
        return set() if self.leaves else set.intersection(*[t.leaves for t in self.nested])


def _parts(t: Terms) -> tuple[set[str], list[Terms]]:
    return (t.leaves, []) if t.op is None else (set(), [t])


def evaluate(postfix: list[str]) -> tuple[Terms, list[str]]:
    """What an expression asks for, and all licences that it names."""
    stack: list[Terms] = []
    names: Counter[str] = Counter()
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append(Terms(None, {token}))
            names[token] += 1
            continue
        right, left = stack.pop(), stack.pop()
        if token != "WITH":
            stack.append(left.joined(token, right))
            continue
        if left.settled().op or right.settled().op:  # WITH binds one licence to one exception
            raise ExpressionError("WITH")
        pair = [*left.leaves, *right.leaves]
        names.subtract(pair)
        both = " WITH ".join(pair)
        names[both] += 1
        stack.append(Terms(None, {both}))
    return stack[0].settled(), sorted(n for n, times in names.items() if times > 0)


def label_of(identifier: str) -> str | None:
    name = identifier.split(" WITH ")[0].lower()
    parts = name.split("-")
    for k in range(len(parts), 0, -1):
        if (family := "-".join(parts[:k]).rstrip("+")) in FAMILIES:
            return FAMILIES[family]
    return None


def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase in [*BASE_PHRASES, *NOTICES, TAG]:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan(body: bytes, phrases: ahocorasick.Automaton) -> tuple[int, list[int], set[str], set[str], float, list[str], set[str]]:
    """Number of words, starts of base phrases, base labels, all labels, score, valid expressions, labels that these require."""
    words = body.translate(_FOLD).split(b" ")
    words = list(filter(None, words))
    stream = f" {b' '.join(words).decode('utf-8', 'replace')} "
    starts: list[int] = []
    base: set[str] = set()
    labels: set[str] = set()
    score, tagged = 0.0, False
    at, counted = 0, 0
    for end, phrase in phrases.iter(stream):
        if phrase == TAG:
            tagged = True
        elif phrase in BASE_PHRASES:
            begin = end - len(phrase) - 1
            # words before the phrase, counted onwards from the last one
            if begin >= at:
                counted += stream.count(" ", at, begin + 1)
                at = begin + 1
                starts.append(counted - 1)
            else:
                starts.append(stream.count(" ", 0, begin + 1) - 1)
            base.add(BASE_PHRASES[phrase])
            score = max(score, 0.6)
        if phrase in NOTICES:
            label, proof = NOTICES[phrase]
            labels.add(label)
            score = max(score, proof)
    found: list[str] = []
    required: set[str] = set()
    if tagged:
        for m in _TAG_AT.finditer(body.decode("utf-8", "replace")):
            try:
                terms, names = evaluate(to_postfix(_DANGLING.sub("", m[1])))  # what an operator at the line's end joined is not there
            except ExpressionError:
                continue
            own = {label for n in names if (label := label_of(n))}
            if own:
                labels |= own
                score = 1.0
                found.append(terms.text())
                required |= {label for n in terms.required() if (label := label_of(n))}
    return len(words), starts, base, labels | base, score, found, required


def scan_licenses(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", carry: list[str] | None = None) -> DataFrame:
    """``doc_id`` and ``carry`` of all rows with the counts, labels, score and valid ``expressions`` found."""
    kept = [doc_id, *[c for c in (carry or []) if c in others(docs, (*RESULT, doc_id))]]
    rows = docs.select(*[quoted(c).alias(f"__c{k}") for k, c in enumerate(kept)], utf8(quoted(text)).alias("__body"))
    types = [ids_field(rows, f"__c{k}") for k in range(len(kept))]
    longs, strings = ("n_words", "n_base", "first_word", "last_word"), ("base_labels", "labels")
    schema = T.StructType(
        [T.StructField(c, docs.schema[c].dataType) for c in kept] + [T.StructField(c, T.LongType()) for c in longs] + [T.StructField(c, T.StringType()) for c in strings] + [T.StructField("score", T.DoubleType()), T.StructField("expressions", T.ArrayType(T.StringType())), T.StructField("required_labels", T.StringType())]
    )

    def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = automaton()
        for batch in slices(batches, "__body", 2000, 8 << 20):
            found = [scan(b, phrases) for b in batch.column("__body").to_pylist()]
            data = [
                pa.array([f[0] for f in found], pa.int64()), pa.array([len(f[1]) for f in found], pa.int64()), pa.array([min(f[1], default=None) for f in found], pa.int64()), pa.array([max(f[1], default=None) for f in found], pa.int64()),
                pa.array([",".join(sorted(f[2])) for f in found], pa.string()), pa.array([",".join(sorted(f[3])) for f in found], pa.string()), pa.array([f[4] for f in found], pa.float64()), pa.array([f[5] for f in found], pa.list_(pa.string())),
                pa.array([",".join(sorted(f[6])) for f in found], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*[batch.column(k).cast(t) for k, t in enumerate(types)], *data], names=schema.names)

    return rows.mapInArrow(scan_rows, schema)
