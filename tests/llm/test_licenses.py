import itertools
import random
import re

import pytest

from tillsight.llm import licenses


def variants(parts):
    """All word patterns of a parsed template; None is any word."""
    options = []
    for p in parts:
        if isinstance(p, bytes):
            options.append([[p]])
        elif isinstance(p, int):
            options.append([[None] * n for n in range(p + 1)])
        else:
            options.append([[], *variants(p)])
    return [list(itertools.chain(*choice)) for choice in itertools.product(*options)]


def plain_spans(template, words):
    patterns, out, i = variants(licenses.parse(template)), [], 0
    while i < len(words):
        fits = [
            len(p)
            for p in patterns
            if len(p) <= len(words) - i and all(a is None or a == b for a, b in zip(p, words[i : i + len(p)]))
        ]
        if fits and max(fits):
            out.append((i, i + max(fits)))
            i += max(fits)
        else:
            i += 1
    return out


@pytest.mark.parametrize("template", ["a [b {2} c] d", "[x] a {1} b [c [d] a]", "a b {0} [a]", "[{2} b] a"])
def test_automaton_equals_all_variants(template):
    rng = random.Random(template)
    automaton = licenses.Automaton(template)
    for _ in range(400):
        words = [rng.choice([b"a", b"b", b"c", b"d", b"x"]) for _ in range(rng.randint(0, 14))]
        assert automaton.spans(words) == plain_spans(template, words)


def test_markup_must_balance():
    with pytest.raises(ValueError):
        licenses.parse("a [b")


TEXTS = {
    0: "Released under the MIT License.",
    1: "This work is licensed under the GNU General Public License, version 3.",
    2: "x MIT, license y Apache\nLicense: general PUBLIC licenses mit license",
    3: "Licensed under the Apache License, Version 2.0. " * 3,
    4: "Licensed under the Apache License, Version 3.0",
    5: None,
    6: "",
    7: "submit license mitlicense emit élicense ÉMIT license",
    8: "Licensed under CC BY-NC 4.0.",
    9: "a\x00b\x7fc é1é --- " * 4000 + "mit license",
}
WANT = {
    0: (5, 1, 3, 3, "mit", "mit,mit-notice", 1.0),
    1: (12, 1, 7, 7, "gpl", "gpl,gpl-3.0", 1.0),
    2: (11, 3, 1, 9, "apache,mit", "apache,mit", 0.5),
    3: (24, 3, 3, 19, "apache", "apache,apache-2.0", 1.0),
    4: (8, 1, 3, 3, "apache", "apache", 0.5),
    5: (0, 0, None, None, "", "", 0.0),
    6: (0, 0, None, None, "", "", 0.0),
    7: (7, 0, None, None, "", "", 0.0),
    8: (7, 0, None, None, "", "cc-by-nc-4.0", 1.0),
    9: (16002, 1, 16000, 16000, "mit", "mit", 0.5),
}


def test_find_licenses(spark):
    docs = spark.createDataFrame(
        [(i, t, "spans") for i, t in TEXTS.items()] + [(None, TEXTS[0], None)], "doc_id long, text string, labels string"
    )
    got = licenses.find_licenses(docs).collect()
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    by_id = {r.doc_id: tuple(r[c] for c in names) for r in got}
    for i, want in WANT.items():
        assert by_id[i] == want, i
    assert by_id[None] == WANT[0]
    assert [(s.label, s.start, s.end) for s in next(r for r in got if r.doc_id == 1).spans] == [("gpl-3.0", 0, 12)]
    assert licenses.find_licenses(docs.limit(0)).collect() == []
    for i, t in TEXTS.items():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        assert by_id[i][0] == len(words)


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so"""
MIT_NOTICE = """, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software."""
MIT_END = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_GRANT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted"""
ISC_NOTICE = ", provided that the above copyright notice and this permission notice appear in all copies"
ISC_END = """.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""
BSD_TWO = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
"""
BSD_ADVERTISING = """3. All advertising materials mentioning features or use of this software must display the following
acknowledgement: This product includes software developed by the organization.
"""
BSD_NEITHER = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or
promote products derived from this software without specific prior written permission.
"""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED
WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE
ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
EVIL = "\nThe Software shall be used for Good, not Evil."
WHOLE = [
    (MIT_GRANT + MIT_NOTICE + MIT_END, "mit-text"),
    (MIT_GRANT + MIT_NOTICE + MIT_END.replace('"AS IS"', "“AS IS”"), "mit-text"),
    (MIT_GRANT + "." + MIT_END, "mit-0"),
    (MIT_GRANT + MIT_NOTICE + EVIL + MIT_END, "json"),
    (MIT_GRANT + MIT_NOTICE, ""),
    (MIT_GRANT + MIT_NOTICE.replace("shall be included", "may be left out") + MIT_END, ""),
    (ISC_GRANT + ISC_NOTICE + ISC_END, "isc"),
    (ISC_GRANT + ISC_END, "0bsd"),
    (ISC_GRANT, ""),
    (BSD_TWO + BSD_END, "bsd-2-clause"),
    (BSD_TWO + BSD_NEITHER + BSD_END, "bsd-3-clause"),
    (BSD_TWO + BSD_ADVERTISING + BSD_NEITHER.replace("3", "4") + BSD_END, "bsd-4-clause"),
    (BSD_TWO + "3. No commercial use.\n" + BSD_END, ""),
    ("the GNU General Public License as published by the Free Software Foundation, either version 2", "gpl,gpl-2.0"),
    ("under the GNU Lesser General Public License, version 3", "gpl,lgpl-3.0"),
    ("under the GNU Lesser General Public License, version 2.1", "gpl,lgpl-2.1"),
    ("under the GNU Affero General Public License, version 3", "agpl-3.0,gpl"),
    ("a general public license version 3", "gpl"),
]


def test_whole_wording_is_mandatory():
    scanner = licenses.Scanner()
    for text, want in WHOLE:
        found = scanner("Copyright someone. " + text + " And more.")
        assert found["labels"] == want, (want, text)
        line = " ".join(w.decode() for w in licenses._WORD.findall(text.encode().translate(licenses._LOWER))) + " "
        by_pattern = {label for label, t in licenses.TEMPLATES if re.search(f"(?:^| ){licenses.as_pattern(t)}", line)}
        assert by_pattern == {s["label"] for s in found["spans"]}
