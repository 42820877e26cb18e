import random

import numpy as np

import seshat.llm.langid as m


def text(r, lang, n):
    parts = {"aa": ["ka", "lo", "mi", "ta"], "bb": ["sch", "ung", "ein", "ber"], "cc": ["ção", "ã", "os", "dos"]}[lang]
    return " ".join("".join(r.choice(parts) for _ in range(r.randrange(1, 4))) for _ in range(n)).capitalize() + "."


def corpus(spark, n=400):
    r = random.Random(1)
    rows = [(i, text(r, lang, r.randrange(5, 60)), lang) for i in range(n) for lang in [r.choice(["aa", "bb", "cc"])]]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy_mixtures_and_odd_rows(spark):
    rows, df = corpus(spark)
    model = m.learn(df)
    assert model.languages == ["aa", "bb", "cc"]
    got = {r.doc_id: r for r in m.identify(df, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang in rows if got[i].held_out]
    assert held and sum(a == b for a, b in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got.values())
    r = random.Random(2)
    odd = [(1, None), (2, ""), (3, " 12 !?"), (None, text(r, "bb", 40)), (5, text(r, "aa", 60) + " " + text(r, "bb", 30)), (5, text(r, "cc", 5)), (6, "x" * 100_000)]
    out = m.identify(spark.createDataFrame(odd, "doc_id long, text string").selectExpr("*", "1 score", "'q' d", "2 x"), model).collect()
    by = {(x.doc_id, x.lang_pred): x for x in out}
    assert len(out) == 7
    assert all(by[i, "und"].score == 0 and by[i, "und"].languages == [] for i in (1, 2, 3))
    assert (None, "bb") in by and (5, "cc") in by
    mixed = {x.lang: x.share for x in by[5, "aa"].languages}
    assert set(mixed) == {"aa", "bb"} and 0.4 < mixed["aa"] < 0.85
    assert m.identify(df.limit(0), model).collect() == []


def test_no_training_rows(spark):
    _, df = corpus(spark, 3)
    model = m.learn(df.limit(0))
    assert {(r.lang_pred, r.score) for r in m.identify(df, model).collect()} == {("und", 0.0)}


def test_shares_maximise_the_likelihood():
    r = np.random.default_rng(0)
    codes = r.dirichlet(np.ones(3), 16)
    h = r.integers(0, 50, (5, 16)).astype(float)
    model = m.Model(["a", "b", "c"], np.zeros(1), codes)
    _, before = model._shares(h, np.ones((5, 3)))
    for _ in range(200):
        p = r.dirichlet(np.ones(3))
        assert (before >= (h * np.log(codes @ p)).sum(axis=1) - 0.5).all()


def test_grams_do_not_cross_texts():
    g, of = m.grams(["ab", None, "", "cd e"])
    assert of.tolist() == [0, 0, 3, 3, 3]


def test_mixture_of_six_languages(spark):
    """No bound on the number of languages of a text."""
    r = random.Random(9)
    sets = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    word = lambda s: "".join(r.choice(s) for _ in range(6))
    rows = [(i, " ".join(word(sets[i % 6]) for _ in range(60)), f"l{i % 6}") for i in range(240)]
    model = m.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(word(s) for _ in range(150) for s in sets)
    shares, chosen = model.infer([mixed, rows[0][1]])
    assert chosen.tolist() == [6, 1] and shares[0].min() > 0.1
