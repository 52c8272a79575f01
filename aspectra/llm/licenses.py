"""Licence scans: Aho-Corasick for notices and identifier tags, shunting-yard for expressions.

A text is read as words of ASCII letters (lower-cased) and digits and of
characters beyond ASCII; anything else parts words. One automaton finds notice
phrases in the words, a second finds identifier tags in the raw text; what
follows one on its line is parsed as an expression of and, or, with and
brackets, of identifiers that are known and exceptions. Reading stops where the
expression does, so that a line of many tags is read once.

Cases: a null text is empty: no words, no labels, score 0; repeated rows are
scanned each; an empty table gives no rows; an expression that does not parse,
or names something that is no licence, gives no label and counts in bad_tags;
phrases that start at one place count by the longest; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aspectra.llm.common import kind_of
from aspectra.llm.tokenizing import few_rows
from aspectra.session import ship_code

BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
NOTICES = {
    "lesser general public license": "lgpl",
    "affero general public license": "agpl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "boost software license": "bsl",
    "isc license": "isc",
    "this is free and unencumbered software": "unlicense",
    "creative commons attribution": "cc-by",
    "creative commons zero": "cc0",
    "cc by": "cc-by",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by nc sa": "cc-by-nc-sa",
    "cc by nc nd": "cc-by-nc-nd",
    "cc0": "cc0",
    "all rights reserved": "proprietary",
}
TAGS = ("spdx-license-identifier:", "license-identifier:", "license-expression:")
FAMILIES = {"mit": "mit", "apache": "apache", "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "cc0": "cc0", "unlicense": "unlicense", "bsl": "bsl"}
#: Families whose identifiers go on with numbers, clauses and or-later marks, and single identifiers.
_OF_FAMILY = re.compile(r"(" + "|".join(sorted(FAMILIES, key=len, reverse=True)) + r")(?:-?v?[0-9]+(?:\.[0-9]+)*)?(?:-clause)?(?:-(?:only|or-later|patent|clear|attribution|0|variant))*\+?")
_CREATIVE = re.compile(r"(cc-by(?:-nc)?(?:-nd|-sa)?|cc0)(?:-[0-9]+(?:\.[0-9]+)*)?(?:-[a-z]{2,3})?")
OTHERS = frozenset(
    "0bsd afl-3.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 busl-1.1 cddl-1.0 cddl-1.1 cecill-2.1 cpl-1.0 curl ecl-2.0 eupl-1.1 eupl-1.2 "
    "gfdl-1.2 gfdl-1.3 hpnd icu ijg intel libpng lppl-1.3c ms-pl ms-rl ncsa odbl-1.0 ofl-1.1 openssl osl-3.0 php-3.0 php-3.01 postgresql psf-2.0 python-2.0 "
    "qpl-1.0 ruby sleepycat sspl-1.0 tcl upl-1.0 vim w3c wtfpl x11 zlib zpl-2.1".split()
)
_EXCEPTION = re.compile(r"[a-z0-9.+-]*exception[a-z0-9.+-]*|linux-syscall-note")
PERMISSIVE = frozenset({"mit", "apache", "bsd", "isc", "cc0", "unlicense", "bsl", "cc-by", "0bsd", "zlib", "x11", "ncsa", "postgresql", "libpng", "wtfpl", "curl", "icu"})
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
_RANK = {"or": 1, "and": 2, "with": 3}
SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_tags long, bad_tags long, permissive boolean"


def label_of(identifier: str) -> str:
    """The label of a known licence identifier; ValueError for any other word."""
    name = identifier.lower()
    if found := _CREATIVE.fullmatch(name):
        return found[1]
    if name in OTHERS:
        return name
    if found := _OF_FAMILY.fullmatch(name):
        return FAMILIES[found[1]]
    if re.fullmatch("licenseref-[a-z0-9.-]+", name):
        return "other"
    raise ValueError(f"no licence: {identifier}")


def to_postfix(expression: str, at: int = 0) -> list[str]:
    """Shunting-yard from a place on: `with` binds closest, then `and`, then `or`; all associate to the left.

    Reading stops at the first character that no expression on one line has. Raises ValueError if malformed.
    """
    out: list[str] = []
    waiting: list[str] = []
    operand_next = True
    while found := _TOKEN.match(expression, at):
        at = found.end()
        bracket, word = found.groups()
        rank = _RANK.get((word or "").lower())
        if bracket == "(":
            if not operand_next:
                raise ValueError("bracket after an operand")
            waiting.append("(")
        elif bracket == ")":
            if operand_next:
                raise ValueError("nothing before a closing bracket")
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting:
                raise ValueError("closing bracket without its opening one")
            waiting.pop()
        elif rank:
            if operand_next:
                raise ValueError("operator without a left operand")
            while waiting and waiting[-1] != "(" and _RANK[waiting[-1]] >= rank:
                out.append(waiting.pop())
            waiting.append(word.lower())
            operand_next = True
        elif operand_next:
            out.append("id:" + word)
            operand_next = False
        else:
            break  # prose after the expression
    if operand_next or "(" in waiting:
        raise ValueError("incomplete expression")
    return out + waiting[::-1]


def evaluate(expression: str, at: int = 0) -> tuple[frozenset[str], bool]:
    """Labels named, and whether some choice leaves only permissive licences; ValueError for what is no expression of licences."""
    stack: list[str | tuple[frozenset[str], bool]] = []

    def licence() -> tuple[frozenset[str], bool]:
        top = stack.pop()
        if isinstance(top, str):
            label = label_of(top)
            return frozenset({label}), label in PERMISSIVE
        return top

    for item in to_postfix(expression, at):
        if item.startswith("id:"):
            stack.append(item[3:].rstrip("."))
        elif item == "with":
            exception = stack.pop()
            if not isinstance(exception, str) or not _EXCEPTION.fullmatch(exception.lower()):
                raise ValueError("no exception after with")
            stack.append(licence())
        else:
            (right, free_right), (left, free_left) = licence(), licence()
            stack.append((left | right, free_left and free_right if item == "and" else free_left or free_right))
    return licence()


class Scanner:
    def __init__(self):
        import ahocorasick

        self.notices, self.tags = ahocorasick.Automaton(), ahocorasick.Automaton()
        for phrase, label in (NOTICES | BASE).items():
            self.notices.add_word(f" {phrase} ", (len(phrase) + 2, label, phrase in BASE))
        for tag in TAGS:
            self.tags.add_word(tag, len(tag))
        self.notices.make_automaton()
        self.tags.make_automaton()

    def scan(self, text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.translate(_WORDS).split()
        line = f" {b' '.join(words).decode()} "
        base, own = [], []
        for end, (length, label, is_base) in self.notices.iter(line):
            start = end + 1 - length
            (base if is_base else own).append((start, end, label))
        # of phrases within one another only the longest counts
        own.sort(key=lambda x: (x[0], -x[1]))
        kept, reach = [], -1
        for start, end, label in own:
            if end > reach:
                kept.append(label)
                reach = end
        labels, free, bad, tags, seen = set(kept), [], 0, 0, -1
        lower = raw.translate(_LOWER).decode()
        for end, _ in self.tags.iter(lower):
            if end == seen:
                continue
            seen = end
            tags += 1
            try:
                found, permissive = evaluate(lower, end + 1)
                labels |= found
                free.append(permissive)
            except ValueError:
                bad += 1
        base_labels = {label for _, _, label in base}
        labels |= base_labels
        starts = [line.count(" ", 0, start) for start in (min(base)[0], max(base)[0])] if base else [None, None]
        doubt = 0.4 ** len(base) * 0.5 ** len(kept) * 0.05 ** len(free)
        permissive = all(free) if free else (labels <= PERMISSIVE if labels else None)
        return len(words), len(base), *starts, ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1.0 - doubt, tags, bad, permissive


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: words, places and labels of licences, see SCHEMA."""
    ship_code(docs.sparkSession)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        kinds = {"string": pa.string(), "double": pa.float64(), "boolean": pa.bool_(), "long": pa.int64()}
        types = [kinds[f.split()[1]] for f in SCHEMA.split(", ")]
        for batch in few_rows(batches):
            rows = list(zip(*[scanner.scan(t) for t in batch["text"].to_pylist()], strict=True)) or [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *[pa.array(r, t) for r, t in zip(rows, types[1:], strict=True)]], names=names)

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(scan, SCHEMA.replace("doc_id long", f"doc_id {kind_of(docs, id_col)}", 1))
