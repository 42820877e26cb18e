import zlib

import seshat.llm.toxicity as m


def scorer():
    return m.Scorer({"blorf": 1.0}, {"zagg": 0.9})


def test_clauses_not_words():
    s = scorer()
    for toxic in ("you are an idiot", "they are scum", "these people are worthless", "idiot, you did it", "your stupid plan", "stupid idiot", "you blorf", "you're a zaggoni", "I will kill you", "we will crush them", "an idiot. a moron. some scum"):
        assert s.score(toxic) >= 0.7, toxic
    for clean in ("idiot", "Garbage collection runs nightly.", "The report lists garbage and trash.", "a blorf here", "zaggoni there", "idiot " + "and so on " * 5 + "idiot. idiot. idiot", "kill the process", "kill them all", "beat her record", "zagg", "the clown took out the trash", "a stupid thing to forget"):
        assert s.score(clean) < 0.7, clean
    assert s.score("") == s.score(None) == s.score("idio tic words") < 0.1
    assert s.score("he is not an idiot") < 0.7 < s.score("he is an idiot")
    assert s.score("she said you idiot") < 0.7 < s.score("she said hello. you idiot")
    assert s.score("an idiot") < s.score("an idiot. a moron. some scum")


def test_lowered_clauses_do_not_add_up():
    s = scorer()
    quotes = ". ".join(f"She {v} {w} are {x}" for v in ("said you", "wrote that they", "reported that you") for w in ("all", "people") for x in ("idiots", "stupid", "scum", "worthless losers"))
    assert s.score(quotes) < 0.7
    assert s.score("They are not idiots. You are not stupid. He is never worthless. These people aren't scum." * 20) < 0.7
    assert s.score("plain words. " * 200_000 + "a moron") < 0.7 < s.score("plain words. " * 200_000 + "you moron")  # very long


def test_labels_lower_seeds(spark):
    rows = [(f"the stupid gizmo w{'abcdefghij'[i % 10]} runs", 0) for i in range(40)] + [(f"you gronk v{'abcdefghij'[i % 10]} gronk", 1) for i in range(40)]
    s = m.learn(spark.createDataFrame(rows, "text string, toxic int"))
    assert "stupid" not in s.words and s.words["idiot"] == 1.0 and s.words["gronk"] > 0.6
    assert s.score("your stupid gizmo") < 0.7


def test_clauses_have_places():
    text = "All fine. You IDIOT, stop; bye"
    (c,) = scorer().clauses(text)
    assert text[c[0] : c[1]].strip() == "You IDIOT, stop" and c[2] > 1


def test_composition_is_the_product():
    nexts, weights = m.GRAMMAR
    import itertools

    for seq in itertools.product(range(9), repeat=4):
        state, states = 0, [x.start for x in m.MACHINES]
        for c in seq:
            got = [x.step(s, c) for x, s in zip(m.MACHINES, states, strict=True)]
            states = [g[0] for g in got]
            want = (got[0][1] + got[1][1]) * got[2][1] * got[3][1] * got[4][1]
            assert abs(weights[state][c][0] - want) < 1e-12 and weights[state][c][1] == got[3][1] * got[4][1]
            state = nexts[state][c]


def test_learned_words_and_held_out_accuracy(spark):
    rows, labels = [], []
    for i in range(900):
        toxic = i % 3 == 0
        word = f"grumf{'abcdefgh'[i % 8]}o" if toxic else "pleasant"
        rows.append((i, f"the w{'klmnopqrstuvx'[i % 13]} {word} v{'abcdefghijklmnopq'[i % 17]} stood near"))
        labels.append((i, int(toxic)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    s = m.learn(m.training_rows(docs, lab))
    assert "grumf"[:4] in s.stems
    docs = docs.withColumn("text", m.F.concat("text", m.F.lit(" you ", ), m.F.element_at(m.F.split("text", " "), 3)))
    got = {r.doc_id: r for r in m.score_toxicity(docs, s).collect()}
    for i, y in labels:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
    own = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(a == b for a, b in own) / len(own) > 0.95


def test_driver_tables(spark):
    """Held-out labelled rows: recall 0.9 at least, false positives under one in a hundred."""
    d = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = m.score_toxicity(docs, m.learn(m.training_rows(docs, lab))).join(lab, "doc_id").filter("held_out").groupBy("toxic", "predicted").count().collect()
    n = {(r.toxic, r.predicted): r["count"] for r in got}
    assert n.get((0, 1), 0) <= 0.01 * n[0, 0]
    assert n[1, 1] >= 0.9 * (n[1, 1] + n.get((1, 0), 0))


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "you idiot", 1), (1, None, 2), (1, "", 3), (1, "", 3)], "doc_id long, text string, score int")
    got = m.score_toxicity(df, scorer()).collect()
    assert sorted((r.doc_id or 0, r.held_out, r.predicted) for r in got) == [(0, False, 1), (1, False, 0), (1, False, 0), (1, False, 0)] or zlib.crc32(b"1") % 3 == 1
    assert m.score_toxicity(df.limit(0), scorer()).collect() == []
    none = m.learn(df.limit(0).withColumn("toxic", df.score))
    assert none.score("you idiot") >= 0.7 and not none.stems
    kept = m.without_toxic(df, scorer())
    assert kept.columns == df.columns and kept.count() == 3
