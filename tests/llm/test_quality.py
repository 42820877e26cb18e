import random

import seshat.llm.quality as m


def rows(n):
    r = random.Random(3)
    docs, labels = [], []
    for i in range(n):
        good = r.random() < 0.7
        w = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        x = " ".join(w) + "." if good else r.choice([" ".join(w).upper() + "!!", " ".join(f"{a}$$$" for a in w), " ".join([w[0]] * 40)])
        docs.append((i, x, r.choice(["en", None]), f"s{i % 5}"))
        if i % 2:
            labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = rows(1200)
    df, lab = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels + [(5000, 1), (1, None), (3, 7)], "doc_id long, quality int")
    model = m.learn(df, lab)
    got = {r.doc_id: r for r in m.score_quality(df, model).collect()}
    own = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert len(own) > 100 and sum(a == b for a, b in own) / len(own) > 0.95
    assert len(got) == 1200


def test_driver_tables(spark):
    d = "/root/testdata/sf0.1"
    docs, lab = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = m.score_quality(docs, m.learn(docs, lab)).join(lab, "doc_id").filter("held_out and quality is not null").selectExpr("avg(int(predicted = quality)) a", "count(*) n").first()
    assert got.n > 500 and got.a > 0.93


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "", "en", "s"), (1, "", "en", "s"), (2, "a" * 200_000, "en", None)], "doc_id long, text string, lang string, source string").selectExpr("*", "0.1 score", "2 i", "3 x")
    lab = spark.createDataFrame([], "doc_id long, quality int")
    model = m.learn(df, lab)
    got = m.score_quality(df, model).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}
    docs, labels = rows(200)
    model = m.learn(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    got = m.score_quality(df, model).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert m.score_quality(df.limit(0), model).collect() == []


def test_handed_rows_are_all_unlabelled_rows(spark):
    """The sums that Spark adds up equal those over all rows at once, however the rows are dealt."""
    import numpy as np

    docs, _ = rows(300)
    v = m.views(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).orderBy("i").cache()
    got = v.toPandas()
    x = [np.array(got[c].tolist(), float) for c in "am"]
    y = np.array([x[0][i][-2] > 0 for i in range(300)], float)
    models = [m.Logistic().fit(k, y) for k in x]
    want = []
    for k in (0, 1):
        p = models[1 - k].prob(x[1 - k])
        sure = (p >= m.CONFIDENT) | (p <= 1 - m.CONFIDENT)
        want.append(models[k].sums(x[k][sure], (p[sure] > 0.5).astype(float)))
    assert want[1][-1] > 0
    for parts in (1, 7):
        for a, b in zip(m._handed(v.repartition(parts), models), want, strict=True):
            assert np.allclose(a, b)
    assert all(not s.any() for s in m._handed(v.limit(0), models))
