import random

import pytest

import seshat.llm.line_dedup as m
from seshat.llm.queries import SQL, op6_line_dedup

LONG = "one two three four five six seven eight nine"


def test_equals_sql(spark):
    from oracle import same

    d = "/root/testdata/sf0.01"
    assert same(op6_line_dedup(spark, d), SQL["op6_line_dedup"], d) is None


def slow(rows, by="line", least=1):
    """rows: (id, text), ids distinct -> id: (removed, kept_text)."""
    seen, out = set(), {}
    brk = "\n" if by == "line" else "\n\n"
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        gone, kept, at = [], [], 0
        for unit in (text or "").split(brk):
            own = " ".join(unit.lower().split())
            if own and len(own.split()) >= least and own in seen:
                gone.append((at, len(unit)))
            else:
                kept.append(unit)
            seen.add(own)
            at += len(unit) + len(brk)
        out[i] = (gone, None if text is None else brk.join(kept))
    return out


@pytest.mark.parametrize(("by", "least", "part"), [("line", 1, 1 << 20), ("line", 1, 200), ("line", 3, 50), ("paragraph", 1, 300)])
def test_matches_brute_force(spark, monkeypatch, by, least, part):
    """Also with parts so small that a hot unit is compared in many of them."""
    monkeypatch.setattr(m, "PART", part)
    r = random.Random(3)
    pool = ["Menu", "one two three", LONG, "  spaced   OUT line ", "", "é ü ñ"] + [f"line {k} of many" for k in range(40)]
    brk = "\n" if by == "line" else "\n\n"
    rows = [(i * 17 % 1009, brk.join(r.choice(pool).replace("\n", " ") for _ in range(r.randrange(1, 9)))) for i in range(200)]
    rows += [(2000, None), (2001, ""), (2002, brk.join(["Menu"] * 3000)), (2003, "x" * 100_000)]
    if by == "paragraph":
        rows = [(i, x.strip() if x else x) for i, x in rows if not x or brk * 2 not in x and not x.startswith(" ")]
    got = {x.doc_id: ([(s.start, s.length) for s in x.removed], x.kept_text) for x in m.line_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), by=by, least=least).collect()}
    want = slow(rows, by, least)
    if by == "paragraph":  # the break before a paragraph takes the blanks at its start
        got, want = ({i: x[1] and x[1].split() for i, x in y.items()} for y in (got, want))
    assert got == want


def test_first_line_may_be_empty(spark):
    df = spark.createDataFrame([(1, "\nx\n\ny"), (2, "\nx\nz\n")], "doc_id long, text string")
    assert {r.doc_id: (r.kept_text, r.n_units) for r in m.line_dedup(df).collect()} == {1: ("\nx\n\ny", 2), 2: ("\nz\n", 2)}


@pytest.mark.parametrize("by", ["line", "paragraph"])
def test_kept_text(spark, by):
    brk = "\n" if by == "line" else "\n\n"
    rows = [(2, brk.join(["head", LONG.upper() + "  ", "tail"])), (1, LONG), (3, brk.join([LONG, "x", LONG])), (4, None), (5, ""), (6, "short line here" + brk + "short line here")]
    got = {r.doc_id: r for r in m.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), by=by).collect()}
    assert got[1].kept_text == LONG and got[2].kept_text == brk.join(["head", "tail"]) and got[3].kept_text == "x"
    assert got[4].kept_text is None and got[5].kept_text == "" and len(got[6].removed) == 1 and got[6].kept_text == "short line here"
    text = dict(rows)[2]
    (s,) = got[2].removed
    assert text[s.start : s.start + s.length].strip().lower() == LONG


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, LONG, 1), (1, LONG, 1), (None, LONG, 2), (7, LONG + "\n" + LONG, 3)], "doc_id long, text string, unit int").withColumnRenamed("unit", "h1")
    got = sorted(m.line_dedup(df).collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.kept_text for r in got] == [LONG, "", "", ""]
    assert m.line_dedup(df.limit(0)).collect() == []
