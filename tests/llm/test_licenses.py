import re

import seshat.llm.licenses as m

RULES = [(i, k, re.compile(f"(?<= )(?:{p})(?= )", re.ASCII), q, label) for i, k, p, q, label in m.rules()]


def slow(text):
    """Contract columns and labels, one text at a time."""
    low = re.sub("[A-Z]", lambda c: c[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = []
    for phrase, label in m.BASE:
        p = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    norm = " " + " ".join(words) + " " if words else " "
    spans = []
    for i, _, rx, q, label in RULES:  # without gates and keywords
        spans += [(x.start(), -x.end(), -q, i, label) for x in rx.finditer(norm)]
    spans.sort()
    kept = [s for n, s in enumerate(spans) if not any(-o[1] >= -s[1] and -o[2] >= -s[2] for o in spans[:n])]
    base = {b for _, b in places}
    at = [i for i, _ in places]
    return len(words), len(places), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | {s[4] for s in kept}))


def run(spark, rows):
    got = m.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    return sorted(((r.doc_id, (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels)) for r in got), key=lambda x: (x[0] is None, x[0] or 0))


def examples(tree):
    """Strings that a parsed pattern matches: every branch, every optional part there or not, others once or thrice."""
    out = [""]
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "IN":
            more = [chr(x[1]) if str(x[0]) == "LITERAL" else {"CATEGORY_DIGIT": "3", "CATEGORY_WORD": "w"}[str(x[1])] for x in arg]
        elif name == "BRANCH":
            more = [x for b in arg[1] for x in examples(b)]
        elif name == "SUBPATTERN":
            more = examples(arg[3])
        elif name == "MAX_REPEAT":
            low, high, sub = arg
            more = sorted({"".join([x] * n) for x in examples(sub) for n in {low, min(high, max(low, 1))}})
        else:
            raise AssertionError(name)
        out = [a + b for a in out for b in more]
    return out


def test_rules_are_many_and_valid():
    assert len({r[2].pattern for r in RULES}) == len(RULES) > 250
    assert len({r[4] for r in RULES}) > 100


def test_every_match_holds_a_gate_and_the_keyword():
    import re._parser as parser

    for _, keyword, pattern, _, _ in m.rules():
        for x in examples(parser.parse(pattern)):
            assert re.fullmatch(pattern, x), (pattern, x)
            assert keyword in x, (keyword, x)
            assert any(g in f" {x} " for g in m.GATES), x


def test_every_rule_detects(spark):
    import re._parser as parser

    rows = [(i, f"Before it, {examples(parser.parse(p))[0]}. After") for i, _, p, _, _ in m.rules()]
    got = run(spark, rows)
    assert got == sorted((i, slow(x)) for i, x in rows)
    assert all(r[1][5] for r in got)


def test_lower_case_is_a_to_z_only(spark):
    rows = [(1, "L\u0130CENSED BSD \u212a WTFPL"), (2, "m\u0130t license"), (3, "word " * 300_000 + "MIT License")]
    assert run(spark, rows) == sorted((i, slow(x)) for i, x in rows)


def test_matches_brute_force(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0."),
        (2, "GNU Lesser General Public License, version 3 or later; also the General Public License"),
        (3, "CC BY cc-by, CC by: All Rights\nReserved all rights reserved."),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, "SPDX-License-Identifier: GPL-2.0-or-later and MIT License and BSD 3-Clause License"),
        (6, None),
        (7, ""),
        (8, "...;;"),
        (9, "É cc by é. ccby xcc by"),
        (None, "the Mozilla Public License 1.1"),
        (10, "apache " * 3000 + "Apache License 2.0 " * 500),
        (11, "general public license" + "s"),
        (12, "released under the terms of the MIT license. It is in the public domain; CC0 1.0"),
    ]
    assert run(spark, rows) == sorted(((i, slow(x)) for i, x in rows), key=lambda x: (x[0] is None, x[0] or 0))


def test_driver_documents_match_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, rows) == sorted((i, slow(x)) for i, x in rows)


def test_suppression_and_odd_rows(spark):
    df = spark.createDataFrame([(1, "under the GNU Lesser General Public License, version 2.1", "z")] * 2, "doc_id long, text string, labels string").withColumnRenamed("labels", "w")
    got = m.license_scan(df).collect()
    assert [r.labels for r in got] == ["gpl,lgpl-2.1"] * 2  # gpl as its base phrase occurs
    assert [[x.label for x in r.detections] for r in got] == [["lgpl-2.1"]] * 2 and got[0].score > 0.5
    assert m.license_scan(df.limit(0)).collect() == []
