"""Licence scan against a plain scorer, on very long texts, denials and choices of licences."""

import math
import re
import time
from collections import Counter

from lensfold.llm import licence_notices, licenses
from tests.llm.frames import prose, simple

WORD = re.compile(r"[^\W_]")


def plain_windows(text):
    """The windows of a text: neighbouring lines, neighbouring sentences, blocks between blank lines."""
    low = text.lower()
    lines = [x for x in re.split(r"\r\n|[\n\r]", low) if WORD.search(x)]
    flat = re.sub(r"(?:\r\n|[\n\r])(?:[\W_](?<!\n))*", " ", low)
    sentences = [x for x in re.split(licenses.SENTENCE_ENDS, flat) if WORD.search(x)]
    out = set(re.split(r"(?:\r\n|[\n\r])(?:[\W_](?<!\n))*(?:\r\n|[\n\r])", low))
    for parts, longest in ((lines, licenses.LINES), (sentences, licenses.sentences_of_headers())):
        out |= {" ".join(parts[i : i + n]) for i in range(len(parts)) for n in range(1, longest + 1)}
    return {w for w in out if re.search(licenses.NAMING, w) and not re.search(licenses.DENIED, w)}


def plain_score(text, templates):
    """{licence: best cosine} by the formula, without anchors."""
    counts = Counter(w for w in licenses.words_of(licenses.normal_text(text)) if w not in licenses.STOP)
    known = {w: (1 + math.log(n)) * templates.idf[w] for w, n in counts.items() if w in templates.idf}
    norm = math.sqrt(sum(x * x for x in known.values()) + sum(w not in templates.idf for w in counts) * templates.unseen**2)
    dots = Counter()
    for i, licence, w, weight in templates.vectors:
        if w in known:
            dots[i, licence] += known[w] * weight
    return {licence: round(x / norm, 6) for (_, licence), x in sorted(dots.items(), key=lambda d: d[1])}


def plain_notice(text):
    """The licence of a text without one-line templates."""
    whole = {n: s for n, s in plain_score(text, licenses.whole_texts()).items() if s >= licenses.THRESHOLD} if re.search(licenses.NAMING, text.lower()) else {}
    best = Counter()
    for w in plain_windows(text):
        for licence, s in plain_score(w, licenses.headers()).items():
            if s >= licenses.THRESHOLD:
                best[licence] = max(best[licence], s)
    found = whole or best
    return min(((-s, n) for n, s in found.items()), default=None)


def scanned(spark, texts, templates=None):
    return {r["doc_id"]: r["licence"] for r in licenses.notices(simple(spark, texts), "doc_id", "text", templates or licenses.Templates()).collect()}


def test_windows_and_texts_against_a_plain_scorer(spark):
    headers = [t for _, t in licence_notices.HEADERS[::3]]
    texts = [f"{prose(i, 12)}\n{t}\n{prose(i + 900, 7)}" for i, t in enumerate(headers)]
    texts += [f"{prose(i, 9)}. {t} {prose(i + 900, 5)}." for i, t in enumerate(headers[::4])]
    texts += [t.replace(" ", "\n# ", 4) for t in headers[::5]] + [t for _, t in licence_notices.texts()][:4] + [prose(4, 60), "", "license license"]
    never = licenses.Templates([("None", "zzzzzz")])
    got = {r["doc_id"]: (-r["score"], r["licence"]) for r in licenses.notices(simple(spark, texts), "doc_id", "text", never).collect()}
    want = {i: n for i, t in enumerate(texts) if (n := plain_notice(t))}
    assert got.keys() == want.keys()
    assert [(i, n, round(s, 4)) for i, (s, n) in sorted(got.items())] == [(i, n, round(s, 4)) for i, (s, n) in sorted(want.items())]


def test_denials_choices_and_more_licences(spark):
    cases = [
        (None, "This file is not licensed under the MIT License."),
        (None, "It was never licensed under the Apache License, Version 2.0."),
        ("Apache-2.0 OR MIT", "Licensed under either of Apache License, Version 2.0 or MIT license at your option."),
        ("Apache-2.0 OR MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0"),
        ("EPL-2.0", "This program is made available under the terms of the Eclipse Public License 2.0"),
        ("EUPL-1.2", "Licensed under the European Union Public Licence 1.2"),
        ("CDDL-1.0", "Released under the CDDL 1.0 license"),
        ("MIT", "Released under the MIT License."),
    ]
    found = scanned(spark, [t for _, t in cases])
    assert [(found.get(i), t) for i, (_, t) in enumerate(cases)] == cases


def test_headers_of_many_lines(spark):
    """A header is found by its sentences, however many lines it has."""
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."
    texts = [f"{prose(1, 20)}.\n" + "\n".join(f"// {w}" for w in mpl.split()) + f"\n{prose(2, 9)}"]
    assert scanned(spark, texts) == {0: "MPL-2.0"}


def test_a_text_of_very_many_lines(spark):
    lines = [prose(i, 4) for i in range(20_000)]
    lines[7_000] = "Licensed under the GNU GPL version 3 license"
    lines[15_000] = "the license of poets"
    start = time.time()
    assert scanned(spark, ["\n".join(lines)]) == {0: "GPL-3.0"}
    assert time.time() - start < 60
