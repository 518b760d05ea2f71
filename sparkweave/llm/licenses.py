"""License scans by template-markup matching.

A template is mandatory wording with two kinds of markup: ``<<opt>> ... <<end>>``
may be absent, and ``<<any 1 4>>`` stands for that many words of whatever kind.
``<<one of a b c>>`` is one of these words. Templates are compiled to automata
over words; a text is accepted at a place if its words there spell the mandatory
wording exactly.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Phrases that always count, each with its label.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: (label, template): notices as the licenses' own texts recommend them.
TEMPLATES = [
    ("mit", "<<one of licensed released distributed available>> under <<opt>> the terms of <<end>> the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation"
        " files <<opt>> the software <<end>> to deal in the software without restriction",
    ),
    ("apache-2", "<<one of licensed released distributed>> under the <<opt>> terms of the <<end>> apache license version 2 <<opt>> 0 <<end>>"),
    (
        "gpl-3",
        "<<one of licensed released distributed redistribute>> <<opt>> it and or modify it <<end>> under the <<opt>> terms of the <<end>>"
        " gnu general public license <<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> version 3"
        " <<opt>> of the license <<end>> <<opt>> or at your option any later version <<end>>",
    ),
    (
        "gpl-2",
        "<<one of licensed released distributed redistribute>> <<opt>> it and or modify it <<end>> under the <<opt>> terms of the <<end>>"
        " gnu general public license <<opt>> as published by the free software foundation <<end>> <<opt>> either <<end>> version 2"
        " <<opt>> of the license <<end>> <<opt>> or at your option any later version <<end>>",
    ),
    ("lgpl", "under the <<opt>> terms of the <<end>> gnu <<one of lesser library>> general public license"),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following"
        " conditions are met",
    ),
    ("bsd", "<<one of licensed released distributed>> under <<opt>> the terms of <<end>> the <<any 0 2>> bsd license"),
    ("mpl-2", "subject to the terms of the mozilla public license v <<opt>> ersion <<end>> 2 <<opt>> 0 <<end>>"),
    ("isc", "permission to use copy modify and <<opt>> or <<end>> distribute this software for any purpose with or without fee is hereby granted"),
    (
        "cc-by-nc",
        "<<one of licensed released distributed available>> under <<opt>> <<one of a the>> <<end>> <<opt>> creative commons <<end>>"
        " <<opt>> cc <<end>> <<opt>> attribution <<end>> by nc <<opt>> <<one of sa nd>> <<end>> <<one of 1 2 3 4>> <<opt>> 0 <<end>>",
    ),
    (
        "cc-by-nc",
        "<<one of licensed released distributed available>> under <<opt>> <<one of a the>> <<end>> creative commons attribution"
        " <<one of noncommercial non>> <<opt>> commercial <<end>> <<any 0 2>> <<one of 1 2 3 4>>",
    ),
    (
        "cc-by-sa",
        "<<one of licensed released distributed available>> under <<opt>> <<one of a the>> <<end>> <<opt>> creative commons <<end>>"
        " <<opt>> cc <<end>> by sa <<opt>> <<one of 1 2 3 4>> 0 <<end>>",
    ),
    (
        "cc-by",
        "<<one of licensed released distributed available>> under <<opt>> <<one of a the>> <<end>> <<opt>> creative commons <<end>>"
        " cc by <<one of 1 2 3 4>> <<opt>> 0 <<end>>",
    ),
    ("cc0", "<<opt>> creative commons <<end>> cc0 1 0 <<opt>> universal <<end>> <<opt>> public domain dedication <<end>>"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

_MARKUP = re.compile(r"<<([^>]*)>>|([^\s<]+)")
_WORDS = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


@dataclass
class Automaton:
    """States are numbers; ``on`` are moves on a word, ``any`` moves on whatever word, ``free`` moves without one."""

    label: str
    base: bool = False
    on: list[dict[bytes, list[int]]] = field(default_factory=list)
    any: list[list[int]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)
    mandatory: int = 0
    #: One of the words that every accepted text has.
    needs: frozenset[bytes] = frozenset()
    first: frozenset[bytes] = frozenset()
    final: int = 0

    def state(self) -> int:
        for part in (self.on, self.any, self.free):
            part.append({} if part is self.on else [])
        return len(self.on) - 1

    def closed(self, states: set[int]) -> set[int]:
        todo = list(states)
        while todo:
            for s in self.free[todo.pop()]:
                if s not in states:
                    states.add(s)
                    todo.append(s)
        return states

    def match(self, words: list[bytes], at: int) -> int:
        """The end of the longest accepted run of words from ``at``, or -1."""
        now, found = self.closed({0}), -1
        for i in range(at, len(words)):
            step: set[int] = set()
            for s in now:
                step.update(self.on[s].get(words[i], ()))
                step.update(self.any[s])
            if not step:
                break
            now = self.closed(step)
            if self.final in now:
                found = i + 1
        return found


def compile_template(label: str, template: str, base: bool = False) -> Automaton:
    a = Automaton(label, base)
    at = a.state()
    opened: list[int] = []
    needs: list[frozenset[bytes]] = []
    for mark, word in _MARKUP.findall(template):
        kind = mark.split()
        if mark and kind[0] == "opt":
            opened.append(at)
        elif mark and kind[0] == "end":
            after = a.state()
            a.free[at].append(after)
            a.free[opened.pop()].append(after)
            at = after
        elif mark and kind[0] == "any":
            low, high = int(kind[1]), int(kind[2])
            skips = []
            for i in range(high):
                if i >= low:
                    skips.append(at)
                after = a.state()
                a.any[at].append(after)
                at = after
            for s in skips:
                a.free[s].append(at)
        else:
            options = kind[2:] if mark else [word]
            after = a.state()
            for w in options:
                a.on[at].setdefault(w.encode(), []).append(after)
            if not opened:
                a.mandatory += 1
                needs.append(frozenset(w.encode() for w in options))
            at = after
    if opened or not needs:
        raise ValueError(f"{label}: an open optional region, or no mandatory word")
    a.final = at
    starts = a.closed({0})
    if any(a.any[s] for s in starts):
        raise ValueError(f"{label}: a template can't begin with a replaceable region")
    a.first = frozenset(w for s in starts for w in a.on[s])
    a.needs = max(needs, key=lambda options: min(map(len, options)))
    return a


def compile_all(base: dict[str, str], templates: list[tuple[str, str]]) -> list[Automaton]:
    return [compile_template(label, phrase, base=True) for phrase, label in base.items()] + [
        compile_template(label, t) for label, t in templates
    ]


def scan_text(text: bytes | None, automata: list[Automaton]) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of a text."""
    flat = (text or b"").translate(_WORDS)
    words = flat.split()
    live = [a for a in automata if any(w in flat for w in a.needs)]
    spans: list[dict] = []
    base_at: list[int] = []
    base_labels, labels, score = set(), set(), 0.0
    if live:
        by_first: dict[bytes, list[Automaton]] = {}
        for a in live:
            for w in a.first:
                by_first.setdefault(w, []).append(a)
        for i, word in enumerate(words):
            for a in by_first.get(word, ()):
                end = a.match(words, i)
                if end < 0:
                    continue
                labels.add(a.label)
                if a.base:
                    base_at.append(i)
                    base_labels.add(a.label)
                score = max(score, (1 - 0.5**a.mandatory) * a.mandatory / (end - i) if end - i > a.mandatory else 1 - 0.5**a.mandatory)
                spans.append({"label": a.label, "start": i, "end": end, "base": a.base})
    return (
        len(words),
        len(base_at),
        min(base_at, default=None),
        max(base_at, default=None),
        ",".join(sorted(base_labels)),
        ",".join(sorted(labels)),
        score,
        spans,
    )


_FIELDS = [
    ("n_words", T.LongType(), pa.int64()),
    ("n_base", T.LongType(), pa.int64()),
    ("first_word", T.LongType(), pa.int64()),
    ("last_word", T.LongType(), pa.int64()),
    ("base_labels", T.StringType(), pa.string()),
    ("labels", T.StringType(), pa.string()),
    ("score", T.DoubleType(), pa.float64()),
    (
        "spans",
        T.ArrayType(
            T.StructType(
                [
                    T.StructField("label", T.StringType()),
                    T.StructField("start", T.LongType()),
                    T.StructField("end", T.LongType()),
                    T.StructField("base", T.BooleanType()),
                ]
            )
        ),
        pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])),
    ),
]


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: list[tuple[str, str]] = TEMPLATES,
    base: dict[str, str] = BASE,
) -> DataFrame:
    """A row for each row of ``docs``: doc_id, counts, labels, score and all accepted ``spans`` of words.

    Base phrases are automata without markup; all places where one stands are
    counted. ``score`` grows with the mandatory words of the best accepted
    template and falls with the words that optional and replaceable regions took:
    (1 - 1/2**m) * m / words of the span. Null and empty texts have no words,
    no labels and score 0; ids are passed on, null or repeated. No shuffle.
    """
    automata = compile_all(base, templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan_text(t.as_py(), automata) for t in batch.column(1).cast(pa.binary())]
            columns = list(zip(*rows, strict=True)) or [()] * len(_FIELDS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, kind) for c, (_, _, kind) in zip(columns, _FIELDS, strict=True))],
                names=["doc_id", *(name for name, _, _ in _FIELDS)],
            )

    kind = docs.select(id_col).schema[0].dataType
    schema = T.StructType([T.StructField("doc_id", kind), *(T.StructField(name, t) for name, t, _ in _FIELDS)])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
