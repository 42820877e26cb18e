import random
from collections import Counter

import seshat.llm.quality_rules as m


def slow(text):
    x = text or ""
    words = x.encode().split()
    wins = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if wins[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [s for s in x.split("\n") if s.encode().split()]
    return len(words), sum(len(w.decode()) for w in words), sum(x.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    r = random.Random(1)
    texts = [None, "", " \n\t", "a", "é ü  ñ\n\né ü", "a b c d e f g h " * 3, "x\x1cy z\x85w　v", "a\n" * 5]
    texts += [" ".join(r.choice("ab") for _ in range(r.randrange(60))) + r.choice(["\n", "#|"]) + "x y" for _ in range(100)]
    texts += [x.text for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    for t in texts:
        assert m.counts(t)[:5] == slow(t)


def test_fences_follow_the_group(spark):
    r = random.Random(2)
    rows = []
    for i in range(900):
        lang, size = ("aa", 4) if i % 2 else ("bb", 12)
        rows.append((i, " ".join("".join(r.choice("abcdefgh") for _ in range(size)) for _ in range(60)), lang, "s"))
    odd = " ".join("".join(r.choice("abcdefgh") for _ in range(12)) for _ in range(60))
    rows += [(1000, odd, "aa", "s"), (1001, odd, "bb", "s"), (1002, odd.replace(" ", " $$ "), "bb", "s"), (1003, "too short", "aa", "s"), (1004, odd, "zz", None), (1005, None, None, None)]
    got = {x.doc_id: x for x in m.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[1000].kept and got[1000].failed == ["word_length"] and got[1001].kept
    assert "symbol_share" in got[1002].failed and got[1003].base_failed and not got[1003].kept
    assert got[1004].kept  # fences of everything
    assert got[1005].base_failed and got[1005].n_words == 0
    assert sum(got[i].kept for i in range(900)) > 880


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "a " * 30, None, "s", 1), (1, "b c", "x", None, 2), (1, "b c", "x", None, 2)], "doc_id long, text string, lang string, source string, n_words int")
    assert len(m.quality_rules(df).collect()) == 3
    assert m.quality_rules(df.limit(0)).collect() == []


def test_fences_move_smoothly_with_the_size_of_a_group(spark):
    """A group's fences go from those of everything towards its own, without a size at which they switch."""
    base = [("aa", "s", float(4 + i % 3)) for i in range(2000)]
    high = []
    for n in (10, 99, 100, 101, 1000):
        rows = spark.createDataFrame(base + [("bb", "s", 20.0)] * n, "lang string, source string, word_length double").selectExpr("*", *(f"0D {k}" for k in m.MEASURES if k != "word_length"))
        own, whole = m.fences(rows)
        f, w = own.filter("lang = 'bb'").first(), whole.first()
        high.append(f.weight * f.word_length_high + (1 - f.weight) * w.word_length_high)
    assert high == sorted(high) and high[3] - high[1] < 1 and high[-1] > 22
