"""License texts found by templates with optional and replaceable regions.

A template is its wording with two kinds of markup: `[words]` may be missing,
`{n}` stands for up to n words of any kind. Everything else is mandatory and
must match word by word. Each template is compiled once into an automaton over
words; a text is read word by word, case and punctuation do not count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Phrases whose places are counted, and their labels.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

_AS_IS = "[as is] [“as is”]"
_GNU = "[as published by the free software foundation] [either] version"
_MIT_GRANT = (
    "permission is hereby granted free of charge to any person obtaining a copy of this {6} and associated "
    "documentation files [the software] [the “software”] to deal in the software without restriction including without "
    "limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
    "and to permit persons to whom the software is furnished to do so"
)
_MIT_NOTICE = (
    "subject to the following conditions the above copyright notice and this permission notice [including the next "
    "paragraph] shall be included in all copies or substantial portions of the software"
)
_MIT_DISCLAIMER = (
    f"the software is provided {_AS_IS} without warranty of any kind express or implied including but not limited to the "
    "warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {6} be liable "
    "for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or "
    "in connection with the software or the use or other dealings in the software"
)
_ISC_GRANT = (
    "permission to use copy modify and or distribute this {4} for any purpose with or without fee is hereby granted"
)
_ISC_NOTICE = "provided that the above copyright notice and this permission notice appear in all copies"
_ISC_DISCLAIMER = (
    f"the {{4}} is provided {_AS_IS} and {{6}} [disclaims] [disclaim] all warranties with regard to this {{4}} including "
    "all implied warranties of merchantability and fitness in no event shall {6} be liable for any special direct "
    "indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in "
    "an action of contract negligence or other tortious action arising out of or in connection with the use or "
    "performance of this {4}"
)
_BSD_TWO = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the "
    "following conditions are met {1} redistributions of source code must retain the above copyright notice this list of "
    "conditions and the following disclaimer {1} redistributions in binary form must reproduce the above copyright "
    "notice this list of conditions and the following disclaimer in the documentation and or other materials provided "
    "with the distribution"
)
_BSD_ADVERTISING = (
    "{1} all advertising materials mentioning features or use of this software must display the following "
    "acknowledgement this product includes software developed by {16}"
)
_ENDORSE = "used to endorse or promote products derived from this software without specific prior written permission"
_BSD_NEITHER = f"{{1}} neither the name of {{12}} nor the names of {{4}} contributors may be {_ENDORSE}"
_BSD_AUTHOR = f"{{1}} the name of {{12}} may not be {_ENDORSE}"
_BSD_DISCLAIMER = (
    f"this software is provided by {{10}} {_AS_IS} and any express or implied warranties including but not limited to "
    "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall "
    "{10} be liable for any direct indirect incidental special exemplary or consequential damages including but not "
    "limited to procurement of substitute goods or services loss of use data or profits or business interruption "
    "however caused and on any theory of liability whether in contract strict liability or tort including negligence or "
    "otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)

#: (label, wording). Notices name a license; the others are a license's whole text without title and copyright lines.
TEMPLATES = [
    ("mit-notice", "[this {4} is] [released] [licensed] under the mit license"),
    ("mit-text", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_DISCLAIMER}"),
    ("mit-0", f"{_MIT_GRANT} {_MIT_DISCLAIMER}"),
    ("json", f"{_MIT_GRANT} {_MIT_NOTICE} the software shall be used for good not evil {_MIT_DISCLAIMER}"),
    ("apache-2.0", "[this {4} is] licensed under the apache license [version] 2 0"),
    ("gpl-2.0", f"[this {{4}} is] [licensed under the] gnu general public license {_GNU} 2"),
    ("gpl-3.0", f"[this {{4}} is] [licensed under the] gnu general public license {_GNU} 3"),
    ("lgpl-2.0", f"[this {{4}} is] [licensed under the] gnu library general public license {_GNU} 2"),
    ("lgpl-2.1", f"[this {{4}} is] [licensed under the] gnu lesser general public license {_GNU} 2 1"),
    ("lgpl-3.0", f"[this {{4}} is] [licensed under the] gnu lesser general public license {_GNU} 3"),
    ("agpl-3.0", f"[this {{4}} is] [licensed under the] gnu affero general public license {_GNU} 3"),
    ("cc-by-nc-4.0", "[this {4} is] licensed under [a] [creative commons] [cc] [attribution noncommercial] by nc 4 0"),
    ("cc-by-4.0", "[this {4} is] licensed under [a] [creative commons] [cc] [attribution] by 4 0"),
    ("bsd-2-clause", f"{_BSD_TWO} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_TWO} {_BSD_NEITHER} {_BSD_DISCLAIMER}"),
    ("bsd-3-clause", f"{_BSD_TWO} {_BSD_AUTHOR} {_BSD_DISCLAIMER}"),
    ("bsd-4-clause", f"{_BSD_TWO} {_BSD_ADVERTISING} {_BSD_NEITHER} {_BSD_DISCLAIMER}"),
    ("isc", f"{_ISC_GRANT} {_ISC_NOTICE} {_ISC_DISCLAIMER}"),
    ("0bsd", f"{_ISC_GRANT} {_ISC_DISCLAIMER}"),
]

ANY = None
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_MARKUP = re.compile(r"\[|\]|\{\d+\}|[^\s\[\]{}]+")


def parse(template: str) -> list:
    """Nested parts: a word, an int (that many replaceable words), or a list (an optional region)."""
    stack: list[list] = [[]]
    for token in _MARKUP.findall(template):
        if token == "[":
            stack.append([])
        elif token == "]":
            region = stack.pop()
            stack[-1].append(region)
        elif token[0] == "{":
            stack[-1].append(int(token[1:-1]))
        else:
            stack[-1].append(token.encode())
    if len(stack) != 1:
        raise ValueError(f"unbalanced markup: {template}")
    return stack[0]


class Automaton:
    """Word automaton of one template; states are numbered, the last one accepts."""

    def __init__(self, template: str):
        parts = parse(template)
        steps: list[dict] = [{}]  # state -> word -> next states
        skips: list[list[int]] = [[]]

        def new() -> int:
            steps.append({})
            skips.append([])
            return len(steps) - 1

        def add(parts: list, state: int) -> int:
            for part in parts:
                if isinstance(part, bytes):
                    after = new()
                    steps[state].setdefault(part, []).append(after)
                elif isinstance(part, int):
                    after, at = new(), state
                    skips[at].append(after)
                    for _ in range(part):
                        following = new()
                        steps[at].setdefault(ANY, []).append(following)
                        skips[following].append(after)
                        at = following
                else:
                    after = add(part, state)
                    skips[state].append(after)
                state = after
            return state

        self.accepting = add(parts, 0)
        self.steps = steps
        self.closure = []
        for s in range(len(steps)):
            seen, todo = {s}, [s]
            while todo:
                for t in skips[todo.pop()]:
                    if t not in seen:
                        seen.add(t)
                        todo.append(t)
            self.closure.append(frozenset(seen))
        #: A text without this mandatory word cannot match.
        self.needed = max((p for p in parts if isinstance(p, bytes)), key=len)
        self.starts = {w for s in self.closure[0] for w in steps[s]}

    def longest(self, words: list[bytes], start: int) -> int | None:
        """End of the longest accepted run of words from `start`."""
        states, end = self.closure[0], None
        for i in range(start, len(words)):
            reached: set[int] = set()
            for s in states:
                for key in (words[i], ANY):
                    for t in self.steps[s].get(key, ()):
                        reached |= self.closure[t]
            if not reached:
                break
            states = reached
            if self.accepting in states:
                end = i + 1
        return end

    def spans(self, words: list[bytes]) -> list[tuple[int, int]]:
        """Accepted runs from left to right, longest first, without overlaps."""
        out, i, any_start = [], 0, ANY in self.starts
        while i < len(words):
            if any_start or words[i] in self.starts:
                end = self.longest(words, i)
                if end is not None:
                    out.append((i, end))
                    i = end
                    continue
            i += 1
        return out


class Scanner:
    """Base phrases and template matches of one text."""

    def __init__(self, templates=TEMPLATES, base=BASE_PHRASES):
        self.automata = [(label, Automaton(t)) for label, t in templates]
        self.base = [(phrase.encode().split(), label) for phrase, label in base.items()]
        self.needed = {a.needed for _, a in self.automata} | {max(p, key=len) for p, _ in self.base}

    def __call__(self, text: str | None) -> dict:
        raw = (text or "").encode().translate(_LOWER)
        inside = _IN_WORD[np.frombuffer(raw, np.uint8)]
        n_words = int(np.count_nonzero(inside[1:] & ~inside[:-1])) + int(len(inside) > 0 and bool(inside[0]))
        places: list[int] = []
        base_labels, labels, spans = set(), set(), []
        if any(w in raw for w in self.needed):
            words = _WORD.findall(raw)
            for phrase, label in self.base:
                if phrase[0] in raw:
                    n = len(phrase)
                    here = [i for i, w in enumerate(words) if w == phrase[0] and words[i : i + n] == phrase]
                    if here:
                        places += here
                        base_labels.add(label)
            for label, automaton in self.automata:
                if automaton.needed in raw:
                    found = automaton.spans(words)
                    if found:
                        labels.add(label)
                        spans += [(label, a, b) for a, b in found]
        return {
            "n_words": n_words,
            "n_base": len(places),
            "first_word": min(places, default=None),
            "last_word": max(places, default=None),
            "base_labels": ",".join(sorted(base_labels)),
            "labels": ",".join(sorted(base_labels | labels)),
            "score": 1.0 if labels else 0.5 if base_labels else 0.0,
            "spans": [{"label": label, "start": a, "end": b} for label, a, b in sorted(spans)],
        }


RESULT = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label: string, start: long, end: long>>"
)


def find_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES) -> DataFrame:
    """One row per document: its id and RESULT.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. score: 1 if a template accepts part of the text, 0.5 if only a
    base phrase stands in it, else 0. spans: words [start, end) that a template
    accepts. Null and empty texts have no words, no labels and score 0; null and
    repeated ids are passed on. One pass, no shuffle; a text is the largest
    thing in memory.
    """

    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scanner = Scanner(templates)
        for texts in batches:
            out = pd.DataFrame([scanner(t) for t in texts])
            for c in ("first_word", "last_word"):
                out[c] = out[c].astype("Int64")
            yield out

    found = F.pandas_udf(scan, RESULT)(F.col(text_col))
    return docs.select(F.col(id_col), found.alias("_found")).select(id_col, "_found.*")


def as_pattern(template: str) -> str:
    """The template as a regular expression over words that are each followed by a space (for checking SQL)."""

    def write(parts: list) -> str:
        return "".join(
            f"{p.decode()} " if isinstance(p, bytes) else f"(?:[^ ]+ ){{0,{p}}}" if isinstance(p, int) else f"(?:{write(p)})?"
            for p in parts
        )

    return write(parse(template))
