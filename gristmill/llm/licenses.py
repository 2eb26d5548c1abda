"""Licence scans: an Aho-Corasick pass over a text's words finds notice phrases, another over its characters finds identifier tags; a shunting-yard
parser evaluates the and/or/with expression after each tag.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z. Base phrases are counted at every place where their
words stand consecutively. An expression is the longest well-formed one that begins after the tag and stays in its line; it ends at the first character
or word that can be no part of one, so identifiers are those of the table IDENTIFIERS. An expression of n terms takes time in proportion to n.
Nulls: a null text is empty and gives no words, no labels and score 0; a null doc_id stays null.
Repeated rows each give their row. Texts are scanned whole, whatever their length; only doc_id and text are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
from pyspark.sql import DataFrame

from .common import once, row_map

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Further notice phrases, as words.
NOTICES = {
    "lesser general public license": "lgpl", "affero general public license": "agpl", "gnu gpl": "gpl", "mozilla public license": "mpl", "bsd license": "bsd",
    "2 clause bsd": "bsd", "3 clause bsd": "bsd", "redistribution and use in source and binary forms": "bsd", "isc license": "isc", "eclipse public license": "epl",
    "boost software license": "bsl", "the unlicense": "unlicense", "creative commons": "cc", "cc by": "cc", "cc by sa": "cc", "cc by nc": "cc", "cc by nd": "cc", "cc0": "cc0",
    "public domain": "public-domain", "all rights reserved": "proprietary", "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache": "apache", "released under the mit": "mit",
}
#: Tags after which an expression may stand, lower-cased, up to the sign before it.
TAGS = ("spdx-license-identifier:", "license:", "licence:", 'license":', 'licence":', "license =", "licence =", "license=", "licence=", "license-expression:", "license :: osi approved ::")
#: Identifiers by label, as patterns of whole identifiers.
IDENTIFIERS = {
    "mit": r"mit(?:-0|-cmu|-feh|-advertising|-modern-variant)?", "apache": r"apache(?:-[0-9.]+)?", "gpl": r"gpl(?:-?v?[0-9.]+)?(?:\+|-only|-or-later)?", "lgpl": r"lgpl(?:-?v?[0-9.]+)?(?:\+|-only|-or-later)?",
    "agpl": r"agpl(?:-?v?[0-9.]+)?(?:\+|-only|-or-later)?", "mpl": r"mpl(?:-[0-9.]+)?(?:-no-copyleft-exception)?", "bsd": r"0bsd|bsd(?:-[0-9]-clause(?:-[a-z-]+)?)?", "isc": r"isc", "epl": r"epl-[0-9.]+", "bsl": r"bsl-1\.0",
    "unlicense": r"unlicense", "cc0": r"cc0(?:-1\.0)?", "cc": r"cc-by(?:-nc|-nd|-sa)*(?:-[0-9.]+)?", "zlib": r"zlib", "wtfpl": r"wtfpl", "artistic": r"artistic-[0-9.]+", "cddl": r"cddl-[0-9.]+", "eupl": r"eupl-[0-9.]+",
    "psf": r"psf-[0-9.]+|python-[0-9.]+", "ofl": r"ofl-[0-9.]+",
}
EXCEPTION = re.compile(r"[a-z0-9.+-]*exception(?:-[0-9.]+)?|linux-syscall-note", re.A)
#: Labels whose terms ask for little more than a notice; an expression is open if they suffice for it.
OPEN = frozenset("mit apache bsd isc bsl unlicense cc0 zlib wtfpl psf".split())
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
TOKEN = re.compile(r"[ \t]*(\(|\)|[a-z0-9][a-z0-9.+-]*)", re.A)
FILLER = re.compile(r"[ \t\"']*", re.A)
SEPARATORS = bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
SPACED = bytes.maketrans(SEPARATORS, b" " * len(SEPARATORS))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, open boolean"


def label_of(identifier: str) -> str | None:
    """The label of an identifier, None if the table does not hold it."""
    table = once("license-identifiers", lambda: [(label, re.compile(pattern, re.A)) for label, pattern in IDENTIFIERS.items()])
    return next((label for label, pattern in table if pattern.fullmatch(identifier)), None)


def to_postfix(text: str, at: int = 0) -> list[str]:
    """The longest well-formed expression that begins at this place, in postfix order; empty if none.

    An operand or a closing bracket leaves a well-formed whole if no bracket is open: then what is out and, in reverse, what waits as operators
    is that whole. Only its extent is noted, and the operators at that time, of which there are three at most, as each outranks the one before."""
    out: list[str] = []
    ops: list[str] = []
    best: tuple[int, list[str]] = (0, [])
    operand, open_brackets = False, 0  # whether an operand has just ended
    while m := TOKEN.match(text, at):
        token = m[1]
        bare = token.rstrip(".-")
        if token in PRECEDENCE:
            if not operand:
                break
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[token]:
                out.append(ops.pop())
            ops.append(token)
            operand = False
        elif token == "(":
            if operand or ops and ops[-1] == "with":
                break
            ops.append(token)
            open_brackets += 1
        elif token == ")":
            if not operand or not open_brackets:
                break
            while ops[-1] != "(":
                out.append(ops.pop())
            ops.pop()
            open_brackets -= 1
        else:
            exception = bool(ops) and ops[-1] == "with"
            if operand or not (EXCEPTION.fullmatch(bare) if exception else label_of(bare)):
                break
            out.append(bare)
            operand = True
        at = m.end()
        if operand and not open_brackets:
            best = len(out), ops[::-1]
        if bare != token:  # a full stop or dash ends it
            break
    return out[: best[0]] + best[1]


def evaluate(postfix: list[str]) -> tuple[set[str], bool, str]:
    """(labels that it names, whether OPEN labels suffice for it, its text in full brackets). with binds an exception to its licence.

    Texts are chains of cells (first, last), which two operands join in constant time."""
    labels: set[str] = set()
    stack: list[tuple[str, bool, list, list]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            cell = [token, None]
            stack.append((token, label_of(token) in OPEN, cell, cell))
            continue
        (right, q, b, b_end), (left, p, a, a_end) = stack.pop(), stack.pop()
        if token != "with" and right:
            labels.add(label_of(right))
        if left:
            labels.add(label_of(left))
        middle, end = [f" {token} ", b], [")", None]
        a_end[1], b_end[1] = middle, end
        stack.append(("", p if token == "with" else p and q if token == "and" else p or q, ["(", a], end))
    if not stack:
        return set(), False, ""
    name, good, cell, _ = stack[0]
    if name:
        labels.add(label_of(name))
    pieces = []
    while cell:
        pieces.append(cell[0])
        cell = cell[1]
    return labels, good, "".join(pieces)


def phrases() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase, label in {**NOTICES, **BASE}.items():
        found.add_word(f" {phrase} ", (phrase, label))
    found.make_automaton()
    return found


def tags() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for tag in TAGS:
        found.add_word(tag, True)
    found.make_automaton()
    return found


def scan(text: str | None) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, open of one text. open: whether OPEN labels suffice for all expressions; null without any."""
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    words = data.translate(SPACED).split()
    line = f" {b' '.join(words).decode('utf-8', 'surrogatepass')} "
    starts, base, labels = [], set(), set()
    at, seen = 0, 0
    for end, (phrase, label) in once("license-phrases", phrases).iter(line):
        labels.add(label)
        if phrase in BASE:
            start = end - len(phrase) - 1  # of the blank before it; ends ascend, but starts need not
            if start >= at:
                seen, at = seen + line.count(" ", at, start), start
                starts.append(seen)
            else:
                starts.append(line.count(" ", 0, start))
            base.add(label)
    expressions, good = [], True
    if b"licen" in data:
        lowered = data.decode("utf-8", "surrogatepass")
        for end, _ in once("license-tags", tags).iter(lowered):
            if names_all := to_postfix(lowered, FILLER.match(lowered, end + 1).end()):
                names, satisfied, shown = evaluate(names_all)
                labels |= names
                good &= satisfied
                expressions.append(shown)
    evidence = len(starts) + 2 * len(expressions) + len(labels)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), evidence / (evidence + 1.0), expressions, good if expressions else None


def scan_licenses(docs: DataFrame) -> DataFrame:
    """A row for each row of docs (doc_id, text), in one narrow pass. score grows from 0 with the places and tags found, below 1."""

    def rows(given: Iterator[tuple]) -> Iterable[tuple]:
        for doc_id, text in given:
            yield doc_id, *scan(text)

    return row_map(docs.select("doc_id", "text"), rows, SCHEMA)


#: DuckDB SQL for the base columns of scan_licenses(), for a table documents.
SQL = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), placed AS (
  SELECT doc_id, w, list_filter(range(0, len(w)), lambda k: w[k + 1] = 'mit' AND w[k + 2] = 'license') AS mit, list_filter(range(0, len(w)), lambda k: w[k + 1] = 'apache' AND w[k + 2] = 'license') AS apache,
    list_filter(range(0, len(w)), lambda k: w[k + 1] = 'general' AND w[k + 2] = 'public' AND w[k + 3] = 'license') AS gpl FROM worded
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(mit) + len(apache) + len(gpl) AS BIGINT) AS n_base, list_min(mit || apache || gpl) AS first_word, list_max(mit || apache || gpl) AS last_word,
  concat_ws(',', CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END) AS base_labels FROM placed
"""
