"""Language, toxicity and ordinal quality: held-out accuracy, and odd rows."""

import random
import zlib

import numpy as np

from precis.llm import language_id, ordinal_quality, toxicity
from precis.llm.queries import fold, op2_ordinal_quality, op3_toxicity, op4_language_id

SF = "/root/testdata/sf0.1"
ODD = [(90001, None, None), (90002, "", "en"), (90003, "123 !?", "en"), (None, "no id here", None),
       (90004, "x" * 200000, None), (90005, "same row", "en"), (90005, "same row", "en")]


def truth(spark, table, column):
    return {r.doc_id: r[column] for r in spark.read.parquet(f"{SF}/{table}.parquet").select("doc_id", column).collect()}


def test_folds(spark):
    frame = spark.createDataFrame([(i,) for i in range(50)], "doc_id long")
    got = [(r.doc_id, r.f) for r in frame.select("doc_id", fold("doc_id", 5).alias("f")).collect()]
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in got)


def test_language_held_out(spark):
    lang = truth(spark, "documents", "lang")
    out = op4_language_id(spark, SF).collect()
    assert len(out) == len(lang)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.99
    # calibrated: the mean probability is close to the accuracy
    assert abs(np.mean([r.score for r in held]) - np.mean([r.lang_pred == lang[r.doc_id] for r in held])) < 0.02


def test_language_odd_rows(spark):
    docs = spark.createDataFrame(ODD + [(i, "the cat and the dog", "en") for i in range(30)]
                                 + [(100 + i, "der hund und die katze", "de") for i in range(30)],
                                 "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert (model.weights == 0).mean() > 0.9  # sparse
    out = language_id.identify(docs, model).collect()
    assert len(out) == len(ODD) + 60
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (90001, 90002, 90003))
    assert by_id[3].lang_pred == "en" and by_id[103].lang_pred == "de"
    none = docs.where("false")
    assert language_id.identify(none, language_id.train(none)).collect() == []
    assert language_id.identify(docs, language_id.train(none)).first().lang_pred == "und"


def test_ftrl_and_calibration():
    rng = np.random.default_rng(0)
    x = [(np.array([c, 10 + rng.integers(50)]), np.array([1.0, 0.3])) for c in rng.integers(0, 3, 300)]
    y = np.array([r[0][0] for r in x])
    w, b = language_id.ftrl(x, y, 3)
    got = [int(np.argmax(w[:, a] @ v + b)) for a, v in x]
    assert np.mean(np.array(got) == y) > 0.99
    logits = rng.normal(size=(500, 3)) * 5
    p = language_id.softmax(logits / 4.0)
    labels = np.array([rng.choice(3, p=q) for q in p])
    assert 2.5 < language_id.calibrate(logits, labels) < 6.5


def test_toxicity_held_out(spark):
    toxic = truth(spark, "labels", "toxic")
    out = op3_toxicity(spark, SF).collect()
    held = [r for r in out if r.held_out and r.doc_id in toxic]
    assert all(r.predicted == (1 if r.score >= 0.3 else 0) and 0 <= r.score <= 1 for r in out)
    found = sum(r.predicted for r in held if toxic[r.doc_id]) / sum(toxic[r.doc_id] for r in held)
    wrong = sum(r.predicted for r in held if not toxic[r.doc_id]) / sum(1 - toxic[r.doc_id] for r in held)
    assert found > 0.85 and wrong < 0.05


def test_toxicity_odd_rows(spark):
    rnd = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(30)) + (" vileword" if i < 40 else ""), None) for i in range(400)]
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1 if i < 40 else 0) for i in range(0, 400, 2)] + [(None, 1), (7, None)],
                                   "doc_id long, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, labels, F.lit(True))
    out = {r.doc_id: r for r in toxicity.score_toxicity(docs, model).collect()}
    assert all(out[i].predicted == 1 for i in range(40))
    assert sum(out[i].predicted for i in range(40, 400)) == 0
    assert out[90001].score == out[90002].score
    none = docs.where("false")
    empty = toxicity.train(none, labels, F.lit(True))
    assert toxicity.score_toxicity(none, empty).collect() == []
    assert not empty.weights


def test_nnpu_recovers_a_word():
    rng = np.random.default_rng(3)
    positive = [np.array([0, 1 + rng.integers(20)]) for _ in range(100)]
    unlabelled = [np.array([0, 1 + rng.integers(20)]) for _ in range(100)] + [np.array([1 + rng.integers(20)]) for _ in range(900)]
    w, b = toxicity.nnpu(positive, unlabelled, 21, 0.1)
    assert b + w[0] > 1 and b + w[1:].max() < -1


def test_ordinal_held_out(spark):
    quality, toxic = truth(spark, "labels", "quality"), truth(spark, "labels", "toxic")
    out = op2_ordinal_quality(spark, SF).collect()
    grades = {0: [], 1: [], 2: []}
    for r in out:
        assert 0 <= r.tail <= 1 and r.selected == (r.tail >= 0.5) and r.tail <= r.expected_grade <= 2
        if r.held_out and r.doc_id in quality:
            grades[0 if quality[r.doc_id] == 0 else 1 if toxic[r.doc_id] else 2].append(r.expected_grade)
    means = [np.mean(grades[g]) for g in (0, 1, 2)]
    assert means[0] < means[1] < means[2] and means[2] - means[0] > 1


def test_ordinal_thresholds_and_odd_rows(spark):
    rows = [(i, ["bad junk", "fair text", "fine prose"][i % 3] + f" {i}", "g") for i in range(150)]
    docs = spark.createDataFrame(rows + ODD, "doc_id long, text string, tail string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(150)] + [(None, 1), (4, None), (5, 2)], "doc_id long, grade int")
    model = ordinal_quality.train(docs, ratings, 3)
    assert (np.diff(model.thresholds) > 0).all()
    out = {r.doc_id: r for r in ordinal_quality.grade_documents(docs, model).collect()}
    assert all(round(out[i].expected_grade) == i % 3 for i in range(150))
    assert out[90001].expected_grade == out[90002].expected_grade
    none = docs.where("false")
    assert ordinal_quality.grade_documents(none, ordinal_quality.train(none, ratings, 3)).collect() == []


def test_ordinal_sample_is_of_rated_documents(spark, monkeypatch):
    assert ordinal_quality.SAMPLE_ROWS >= 12_000
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, i % 3) for i in range(1000)], "doc_id long, grade int")
    seen = []
    monkeypatch.setattr(ordinal_quality, "SAMPLE_ROWS", 30)
    monkeypatch.setattr(ordinal_quality, "fit", lambda x, grades, levels: seen.append(grades))
    ordinal_quality.train(docs, ratings, 3)
    assert len(seen[0]) == 30  # labels without a document take no place in the sample


def test_ordinal_flat_features(monkeypatch):
    monkeypatch.setattr(ordinal_quality, "CHUNK_ROWS", 3)
    rng = np.random.default_rng(4)
    rows = [(rng.choice(1 << 16, n, replace=False).astype(np.uint16), rng.random(n, dtype=np.float32)) for n in (0, 5, 0, 2, 0, 0, 7, 1, 0)]
    x = ordinal_quality.flat((a.tobytes(), v.tobytes()) for a, v in rows)
    w, by_row = rng.random(1 << 16), rng.random(len(rows))
    assert np.allclose(x.scores(w), [w[a] @ v.astype(float) for a, v in rows])
    want = np.zeros(1 << 16)
    for (a, v), b in zip(rows, by_row):
        want[a] += b * v
    assert np.allclose(x.slopes(by_row), want)


def test_more_languages_than_the_sample_has_room_for(spark):
    from precis.llm import language_id as L

    words = lambda k: " ".join(chr(0x4E00 + 40 * k + j) * 2 for j in range(6))
    rows = [(1000 * k + i, words(k) + " " + "ab"[i % 2], f"l{k:03d}") for k in range(520) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = L.training_sample(docs, "lang", "text", docs.doc_id.cast("string"))
    assert len(set(sample.lang)) == 520 and len(sample) <= 8 * 520


def test_toxic_words_are_learned_however_rare(spark):
    """A word of 4 in 1,000 toxic texts is a sign as good as a frequent one, and words of clean texts count."""
    from pyspark.sql import functions as F

    rnd = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    text = lambda *more: " ".join([rnd.choice(words) for _ in range(12)] + list(more))
    toxic = [text("vileword") for _ in range(996)] + [text("raremean") for _ in range(4)]
    rows = [(i, t) for i, t in enumerate(toxic)] + [(1000 + i, text("gardening" if i % 2 else "plain")) for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 1000)) for i in range(5000)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    assert model.weights["raremean"] > 0 and model.weights["gardening"] < 0
    assert model.score("something raremean") >= 0.3 > model.score("something gardening")
    assert not {"w1", "w2", "w3"} & model.weights.keys()


def test_nnpu_follows_the_gradient_of_its_risk():
    """Against a plain computation of the risk: numeric gradient, first step and descent."""
    rng = np.random.default_rng(8)
    size, prior = 6, 0.3
    rows = lambda n: [np.flatnonzero(rng.random(size) < 0.4) for _ in range(n)]
    positive, unlabelled = rows(30), rows(80)

    def risk(w, b):
        z = lambda side: np.array([b + w[r].sum() for r in side])
        soft = lambda x: np.log1p(np.exp(x))
        corrected = soft(z(unlabelled)).mean() - prior * soft(z(positive)).mean()
        return prior * soft(-z(positive)).mean() + max(0.0, corrected) + toxicity.L2 / 2 * (w ** 2).sum()

    w, b = toxicity.nnpu(positive, unlabelled, size, prior)
    best = risk(w, b)
    assert best < risk(np.zeros(size), float(np.log(prior / (1 - prior))))
    step = 1e-4
    slopes = [(risk(w + step * e, b) - risk(w - step * e, b)) / (2 * step) for e in np.eye(size)]
    slopes.append((risk(w, b + step) - risk(w, b - step)) / (2 * step))
    assert np.abs(slopes).max() < 5e-3  # the risk is convex here: a stationary point is its least value
    for _ in range(200):
        assert best <= risk(w + rng.normal(0, 0.3, size), b + rng.normal(0, 0.3)) + 1e-4


def test_ordinal_fit_is_a_stationary_point(monkeypatch):
    """Against a plain computation of the penalised likelihood, by numeric gradients."""
    rng = np.random.default_rng(3)
    rows, grades = [], []
    for _ in range(60):
        at = np.sort(rng.choice(5, rng.integers(0, 4), replace=False))
        rows.append((at.astype(np.uint16), rng.random(len(at)).astype(np.float32)))
        grades.append(int(np.clip((at == 1).sum() + rng.integers(0, 2) + (rng.random() < 0.2), 0, 2)))
    grades = np.array(grades)

    def loss(w, cuts):
        total = 0.0
        for (at, value), g in zip(rows, grades):
            below = [0.0] + [1 / (1 + np.exp(-(c - w[at] @ value))) for c in cuts] + [1.0]
            total -= np.log(below[g + 1] - below[g])
        return total / len(grades) + ordinal_quality.L2 / 2 * (w ** 2).sum()

    monkeypatch.setattr(ordinal_quality, "STEPS", 1500)
    monkeypatch.setattr(ordinal_quality, "L2", 0.02)
    model = ordinal_quality.fit(ordinal_quality.flat((a.tobytes(), v.tobytes()) for a, v in rows), grades, 3)
    w, cuts, step = model.weights[:5], model.thresholds, 1e-5
    assert not model.weights[5:].any() and cuts[0] < cuts[1]
    slopes = [(loss(w + step * e, cuts) - loss(w - step * e, cuts)) / (2 * step) for e in np.eye(5)]
    slopes += [(loss(w, cuts + step * e) - loss(w, cuts - step * e)) / (2 * step) for e in np.eye(2)]
    assert np.abs(slopes).max() < 1e-3
    # a row without features has the thresholds alone
    assert np.allclose(model.above(None), 1 / (1 + np.exp(cuts)))


def test_ftrl_against_a_plain_loop(monkeypatch):
    """One weight after the other, as the update is written for a single coordinate."""
    monkeypatch.setattr(language_id, "EPOCHS", 2)
    rng = np.random.default_rng(6)
    x = [(np.sort(rng.choice(12, 3, replace=False)), rng.random(3)) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    w, b = language_id.ftrl(x, y, 3)
    bias = 1 << language_id.BITS
    z, n = {}, {}

    def weight(c, k):
        zi, l1 = z.get((c, k), 0.0), 0.0 if k == bias else language_id.L1
        if abs(zi) <= l1:
            return 0.0
        rate = (language_id.BETA + n.get((c, k), 0.0) ** 0.5) / language_id.ALPHA + language_id.L2
        return -(zi - (l1 if zi > 0 else -l1)) / rate

    order = np.random.default_rng(0)
    for _ in range(2):
        for i in order.permutation(len(x)):
            at = [*x[i][0].tolist(), bias]
            value = [*x[i][1].tolist(), 1.0]
            now = {(c, k): weight(c, k) for c in range(3) for k in at}
            logits = [sum(now[c, k] * v for k, v in zip(at, value)) for c in range(3)]
            e = np.exp(np.array(logits) - max(logits))
            p = e / e.sum()
            for c in range(3):
                for k, v in zip(at, value):
                    g = (p[c] - (y[i] == c)) * v
                    sigma = ((n.get((c, k), 0.0) + g * g) ** 0.5 - n.get((c, k), 0.0) ** 0.5) / language_id.ALPHA
                    z[c, k] = z.get((c, k), 0.0) + g - sigma * now[c, k]
                    n[c, k] = n.get((c, k), 0.0) + g * g
    want = np.array([[weight(c, k) for k in range(12)] for c in range(3)])
    assert np.abs(w[:, :12] - want).max() < 1e-5 and not w[:, 12:].any()
    assert np.abs(b - [weight(c, bias) for c in range(3)]).max() < 1e-5
