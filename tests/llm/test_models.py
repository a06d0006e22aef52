"""Quality classifier and language mixture: held-out accuracy and defined results for odd rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from vellumgrid.llm import language_mix, quality_model
from tests.llm.conftest import hard_texts, prose

LANGS = {"xx": "ba da ga ma na".split(), "yy": "ert irt ort urt art".split(), "zz": "schl pfl strn kvrt blzt".split()}


def in_language(rng, lang, n):
    return " ".join("".join(rng.choice(LANGS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def quality_rows():
    rng = random.Random(8)
    good = [(i, prose(rng, 60)) for i in range(150)]
    bad = [(500 + i, " ".join(w + rng.choice(["***", "$$$", "###"]) for w in prose(rng, 60).split())) for i in range(60)]
    same = [(800 + i, f"w{i} " * 50) for i in range(40)]
    return good, bad + same


def test_quality_on_held_out_rows(spark):
    good, bad = quality_rows()
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in bad], "doc_id long, quality int, toxic int")
    weights = quality_model.fit(docs, labels, F.col("doc_id") % 3 != 0)
    got = {r["doc_id"]: r for r in quality_model.score(docs, weights).collect()}
    held_out = [i for i, _ in good + bad if i % 3 == 0]
    right = sum(got[i]["predicted"] == (i < 500) for i in held_out)
    assert right >= 0.97 * len(held_out)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_quality_learns_the_same_twice(spark):
    good, bad = quality_rows()
    docs = spark.createDataFrame(good + bad, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 500)) for i, _ in good + bad], "doc_id long, quality int")
    a = quality_model.fit(docs, labels, F.lit(True))
    b = quality_model.fit(docs.repartition(7), labels.repartition(2), F.lit(True))
    assert np.array_equal(a, b)


def test_quality_of_hard_texts(hard, none, spark):
    labels = spark.createDataFrame([(10, 1), (10, None), (41, 0), (41, 1), (20, 0), (None, 1)], "doc_id long, quality int")
    weights = quality_model.fit(hard, labels, F.lit(True))
    rows = quality_model.score(hard, weights).collect()
    assert len(rows) == len(hard_texts())
    blank = {r["score"] for r in rows if r["doc_id"] in (20, 21, 22)}
    assert len(blank) == 1
    assert quality_model.score(none, weights).collect() == []
    assert quality_model.fit(none, labels, F.lit(True)) is None
    assert {r["score"] for r in quality_model.score(hard, None).collect()} == {0.5}
    assert quality_model.fit(hard, labels.limit(0), F.lit(True)) is None


def test_features_do_not_cross_documents():
    together, first = quality_model.features(pa.array(["a b", None, "", "b***", "c c"], pa.string()))
    alone = [quality_model.features(pa.array([t], pa.string()))[0].tolist() for t in ["a b", None, "", "b***", "c c"]]
    assert [together[i:j].tolist() for i, j in zip(first[:-1], first[1:], strict=True)] == alone


def test_languages_on_held_out_rows(spark):
    rng = random.Random(9)
    rows = [(i, in_language(rng, lang, rng.randint(3, 60)), lang) for i, lang in enumerate(sorted(LANGS) * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mix.fit(docs, F.col("doc_id") % 2 == 0)
    got = {r["doc_id"]: r for r in language_mix.identify(docs, model).collect()}
    assert sum(got[i]["lang_pred"] == lang for i, _, lang in rows) >= 0.98 * len(rows)


def test_mixtures_are_taken_apart(spark):
    rng = random.Random(10)
    rows = [(i, in_language(rng, lang, 40), lang) for i, lang in enumerate(sorted(LANGS) * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_mix.fit(docs, F.lit(True))
    mixed = spark.createDataFrame([(1, in_language(rng, "xx", 70) + " " + in_language(rng, "yy", 30))], "doc_id long, text string")
    r = language_mix.identify(mixed, model).first()
    assert r["lang_pred"] == "xx" and set(r["languages"]) == {"xx", "yy"}
    assert abs(r["score"] - 0.7) < 0.1 and abs(sum(r["languages"].values()) - 1) < 1e-6


def test_languages_of_hard_texts(hard, none, spark):
    rows = spark.createDataFrame([(1, "alpha beta", "en"), (2, None, "fr"), (3, "gamma", None)], "doc_id long, text string, lang string")
    model = language_mix.fit(rows, F.lit(True))
    assert model.languages == ["en"]
    got = language_mix.identify(hard, model).collect()
    assert len(got) == len(hard_texts())
    assert {(r["lang_pred"], r["score"]) for r in got if r["doc_id"] in (20, 21, 22)} == {("und", 0.0)}
    assert Counter(r["lang_pred"] for r in got if r["doc_id"] in (10, 44)) == {"en": 3}
    assert language_mix.fit(none, F.lit(True)) is None
    assert {r["lang_pred"] for r in language_mix.identify(hard, None).collect()} == {"und"}
    assert language_mix.identify(none, model).collect() == []


def test_documents_in_one_batch_do_not_touch():
    rng = random.Random(11)
    texts = [in_language(rng, "xx", 5), "", "1 2 3", in_language(rng, "yy", 7), "\0a\0", "b"]
    place, first, doc = language_mix.grams(texts)
    for i, t in enumerate(texts):
        own, _, _ = language_mix.grams([t])
        words = np.flatnonzero(doc == i)
        ends = np.append(first, len(place))
        assert np.array_equal(np.concatenate([place[first[w] : ends[w + 1]] for w in words]) if len(words) else np.empty(0), own)


def test_learning_is_the_plain_loop():
    """The vectorised learner against follow-the-regularised-leader written out feature by feature."""
    rng = np.random.default_rng(1)
    s = quality_model.Settings(epochs=2)
    rows = []
    for _ in range(40):
        at = np.unique(rng.integers(0, 30, 8)).astype(np.int32)
        rows.append((int(rng.integers(0, 2)), np.append(at, 1 << quality_model.BITS).astype(np.int32), np.append(rng.random(len(at)), 1.0).astype(np.float32)))
    z, n = Counter(), Counter()

    def weight(f):
        return 0.0 if abs(z[f]) <= s.l1 else -(z[f] - np.sign(z[f]) * s.l1) / ((s.beta + n[f] ** 0.5) / s.alpha + s.l2)

    for _ in range(s.epochs):
        for y, at, x in rows:
            w = {f: weight(f) for f in at.tolist()}
            p = 1 / (1 + np.exp(-sum(w[f] * v for f, v in zip(at.tolist(), x.tolist(), strict=True))))
            for f, v in zip(at.tolist(), x.tolist(), strict=True):
                g = (p - y) * v
                z[f] += g - ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / s.alpha * w[f]
                n[f] += g * g
    got = quality_model.learn(rows, s)
    assert np.allclose(got[list(n)], [weight(f) for f in n], atol=1e-5) and not np.delete(got, list(n)).any()


def test_quality_does_not_know_ids(spark):
    """Other ids, repeated rows and contradicting labels of one text change no score."""
    good, bad = quality_rows()
    labels = [(i, int(i < 500)) for i, _ in good + bad]
    a = quality_model.fit(spark.createDataFrame(good + bad, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"), F.lit(True))
    moved = [(9000 - i, t) for i, t in good + bad]
    again = moved + [(20000 + i, t) for i, t in moved]
    b_labels = [(9000 - i, y) for i, y in labels] + [(29000 - i, 1) for i, _ in labels]
    b = quality_model.fit(spark.createDataFrame(again, "doc_id long, text string"), spark.createDataFrame(b_labels, "doc_id long, quality int"), F.lit(True))
    assert np.array_equal(a, b)


def test_queries_hold_out_and_decide_as_they_say(spark):
    import zlib

    from vellumgrid.llm import queries

    sf = "/root/testdata/sf0.001"
    crc = lambda i: zlib.crc32(str(i).encode())
    rows = queries.op4_quality(spark, sf).collect()
    assert rows and all(r["held_out"] == (crc(r["doc_id"]) % 4 == 2) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    rows = queries.op5_language(spark, sf).collect()
    assert rows and all(r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)


def plain_mixture(likely, penalty=0.5):
    """Proportions of one document's chosen languages, by loops over its words."""
    n = len(likely[0])

    def fit(w):
        while True:
            new, value = [0.0] * n, 0.0
            for row in likely:
                top = max(row)
                p = [w[k] * np.exp(row[k] - top) for k in range(n)]
                value += np.log(sum(p)) + top
                for k in range(n):
                    new[k] += p[k] / sum(p) / len(likely)
            if max(abs(a - b) for a, b in zip(w, new, strict=True)) < 1e-7:
                return new, value
            w = new

    full, _ = fit([1 / n] * n)
    order = sorted(range(n), key=lambda k: -full[k])
    best = None
    for k in range(1, n + 1):
        start = [max(full[x], 1e-6) if x in order[:k] else 0.0 for x in range(n)]
        w, value = fit([x / sum(start) for x in start])
        value -= penalty * k * np.log(len(likely) + 1)
        if best is None or value > best[0]:
            best = value, w
    return best[1]


def test_mixtures_are_those_of_the_plain_loops():
    rng = np.random.default_rng(12)
    docs = []
    for _ in range(40):
        langs = rng.choice(4, size=rng.integers(1, 4), replace=False)
        likely = rng.normal(-30, 1.5, (rng.integers(5, 80), 4))
        likely[np.arange(len(likely)), rng.choice(langs, len(likely))] += rng.gamma(4, 1.5, len(likely))
        docs.append(likely.astype(np.float32))
    got = language_mix.infer(np.concatenate(docs), np.repeat(np.arange(40), [len(d) for d in docs]), 40)
    for d, share in zip(docs, got, strict=True):
        expected = plain_mixture(d.astype(float).tolist())
        assert int(share.argmax()) == int(np.argmax(expected))
        assert np.abs(share - expected).max() < 0.03 and ((share > 0) == (np.array(expected) > 1e-9)).all()
    # Counted words are as good as repeated ones, and a document is the same in any company.
    for d in docs[:5]:
        twice = language_mix.infer(np.concatenate([d, d]), np.zeros(2 * len(d), int), 1)
        assert np.allclose(twice, language_mix.infer(d, np.zeros(len(d), int), 1, times=np.full(len(d), 2)), atol=1e-4)


def test_very_long_texts_in_blocks(spark, monkeypatch):
    rng = random.Random(13)
    rows = [(i, in_language(rng, lang, 40), lang) for i, lang in enumerate(sorted(LANGS) * 20)]
    model = language_mix.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    text = in_language(rng, "xx", 3000) + " " + in_language(rng, "yy", 1000)
    whole = language_mix.infer(np.add.reduceat(model.tables[language_mix.grams([text])[0]], language_mix.grams([text])[1], axis=0), np.zeros(4000, int), 1)
    monkeypatch.setattr(language_mix, "BLOCK", 1000)
    assert len(list(language_mix.pieces([text, "short", "x" * 5000]))) > 20 and "".join(p[0] for p in language_mix.pieces([text])) == text
    likely, times = language_mix.words_of(text, model.tables)
    assert times.sum() == 4000 and len(likely) < 4000
    assert np.allclose(language_mix.infer(likely, np.zeros(len(likely), int), 1, times=times), whole, atol=2e-3)


def test_multi_megabyte_text(spark):
    rng = random.Random(14)
    rows = [(i, in_language(rng, lang, 40), lang) for i, lang in enumerate(sorted(LANGS) * 20)]
    model = language_mix.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    long = spark.createDataFrame([(1, (in_language(rng, "yy", 2000) + "\n") * 300)], "doc_id long, text string")
    assert language_mix.identify(long, model).first()["lang_pred"] == "yy"
    assert 0 <= quality_model.score(long, np.zeros((1 << quality_model.BITS) + 1, np.float32)).first()["score"] <= 1


def test_words_impossible_in_a_language_leave_no_nan():
    """A likelihood that underflows under all languages of a set is small, not nothing."""
    likely = np.full((2, 3), -400.0, dtype=np.float32)
    likely[0, 0], likely[1, 1] = -5.0, -5.0
    with np.errstate(all="raise", under="ignore"):
        share = language_mix.infer(likely, np.zeros(2, dtype=np.int64), 1, times=np.array([3_000_000, 1]))
        few = language_mix.infer(likely[[0] * 50 + [1]], np.zeros(51, dtype=np.int64), 1)
        many = language_mix.infer(likely[[0, 1]], np.zeros(2, dtype=np.int64), 1, times=np.array([1, 1]))
    for got in (share, few, many):
        assert np.isfinite(got).all() and abs(got.sum() - 1) < 1e-6
    assert share[0, 0] > 0.99 and few[0, 0] > 0.9 and few[0, 1] > 0


def test_a_long_text_with_one_foreign_word_has_a_language(spark, monkeypatch):
    rng = random.Random(21)
    rows = [(i, in_language(rng, lang, 40), lang) for i, lang in enumerate(sorted(LANGS) * 30)]
    model = language_mix.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    model = language_mix.Model(model.languages, model.tables * np.float32(40))  # far apart, as tables over large samples are
    monkeypatch.setattr(language_mix, "BLOCK", 4096)
    text = in_language(rng, "xx", 20_000) + " " + LANGS["zz"][0] * 3
    got = language_mix.identify(spark.createDataFrame([(1, text), (2, "schl ba")], "doc_id long, text string"), model).collect()
    assert [r["lang_pred"] for r in got][0] == "xx" and all(0 < r["score"] <= 1 for r in got)
