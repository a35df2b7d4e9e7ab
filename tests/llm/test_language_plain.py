"""The language model against plain versions of its features, its learner and its answers."""

import math
import random
import unicodedata
from collections import Counter

import brute
import numpy as np

from veduta.llm import language


def grams(text):
    """The 1- to 3-grams of a text as a plain loop makes them; a single space is none."""
    shown = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in (text or "").lower())
    if not any(unicodedata.category(c)[0] == "L" for c in shown):
        return Counter()
    line = " " + " ".join(shown.split(" ")) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    return Counter(line[i : i + k] for k in (1, 2, 3) for i in range(len(line) - k + 1) if line[i : i + k] != " ")


def test_grams():
    own = language.Grams()
    for text in ("The house!", "a", "Été, 12 à la mer", "日本語 テキスト", "x\ty\nz  w", "İstanbul", "don't", None, "", "12 !?"):
        places, counts = own(text)
        want = grams(text)
        assert counts.sum() == sum(want.values()) and len(places) <= len(want)
    rng, alone = random.Random(1), {}
    for _ in range(100):
        text = "".join(rng.choice("abcdeé ß") for _ in range(12))
        places = set(own(text)[0].tolist())
        for g in grams(text):
            if len(g) == 3 and " " not in g:
                if g not in alone:  # the place that a text gains by its third letter
                    alone[g] = set(own("x" + g + "x")[0].tolist()) & set(own("y" + g + "y")[0].tolist())
                assert len(alone[g] & places) >= len(set(g)) + 1


def plain_ftrl(rows, labels, n_labels, size, epochs, alpha=0.5, beta=1.0, l1=0.02, l2=0.02, seed=1):
    """Follow-the-regularised-leader, coordinate by coordinate."""
    z = [[0.0] * (size + 1) for _ in range(n_labels)]
    n = [[0.0] * (size + 1) for _ in range(n_labels)]

    def weight(k, i):
        penalty = 0.0 if i == size else l1
        if abs(z[k][i]) <= penalty:
            return 0.0
        return (math.copysign(penalty, z[k][i]) - z[k][i]) / ((beta + math.sqrt(n[k][i])) / alpha + l2)

    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            x = dict(zip(rows[r][0].tolist(), rows[r][1].tolist(), strict=True)) | {size: 1.0}
            score = [sum(weight(k, i) * v for i, v in x.items()) for k in range(n_labels)]
            top = max(score)
            p = [math.exp(s - top) for s in score]
            p = [v / sum(p) for v in p]
            step = []
            for k in range(n_labels):
                for i, v in x.items():
                    g = (p[k] - (labels[r] == k)) * v
                    sigma = (math.sqrt(n[k][i] + g * g) - math.sqrt(n[k][i])) / alpha
                    step.append((k, i, g, g - sigma * weight(k, i)))
            for k, i, g, d in step:
                z[k][i] += d
                n[k][i] += g * g
    w = np.array([[weight(k, i) for i in range(size + 1)] for k in range(n_labels)])
    return w[:, :size], w[:, size]


def test_learner():
    rng = np.random.default_rng(5)
    rows = [(np.sort(rng.choice(40, 6, replace=False)), rng.uniform(0.1, 1, 6)) for _ in range(60)]
    labels = np.array([0 if r[0][0] < 4 else 1 if r[0][-1] > 36 else 2 for r in rows])
    got, want = language.ftrl(rows, labels, 3, 40, 2), plain_ftrl(rows, labels, 3, 40, 2)
    assert np.allclose(got[0], want[0], atol=1e-10) and np.allclose(got[1], want[1], atol=1e-10)
    assert 0 < (want[0] == 0).sum() < want[0].size  # some weights are zero, not all


def test_answers(spark):
    """The registered answer is the softmax of weights and TF-IDF features over the temperature."""
    rng = random.Random(2)
    words = {"en": "the house and garden with water".split(), "de": "das haus und der garten wasser".split(), "fr": "la maison et le jardin eau".split()}
    rows = [(i, " ".join(rng.choices(words[g], k=8)), g, None) for i, g in enumerate(rng.choices(sorted(words), k=240))]
    docs = brute.documents(spark, rows)
    model = language.train(docs)
    held = [r for r in rows if not brute_held_out(r[0])]
    own = language.Grams()
    frequency = Counter(p for r in held for p in set(own(r[1])[0].tolist()))
    for p, n in frequency.most_common(50):
        assert math.isclose(model.idf[p], math.log((1 + len(held)) / (1 + n)) + 1)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.classified(docs, model).collect()}
    for i, text, _, _ in rows:
        places, counts = own(text)
        x = [(1 + math.log(c)) * model.idf[p] for p, c in zip(places, counts, strict=True)]
        length = math.sqrt(sum(v * v for v in x))
        score = [(sum(model.weights[k][p] * v / length for p, v in zip(places, x, strict=True)) + model.intercepts[k]) / model.heat for k in range(3)]
        p = [math.exp(s - max(score)) for s in score]
        best = max(range(3), key=lambda k: p[k])
        assert got[i][0] == model.langs[best] and math.isclose(got[i][1], p[best] / sum(p), rel_tol=1e-5)


def brute_held_out(doc_id):
    import zlib

    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_number_of_languages_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGS", 2)
    rows = [(i, f"text of {g} {i}", g, None) for i, g in enumerate(["a"] * 20 + ["b"] * 30 + ["c"] * 30 + ["d"] * 10)]
    assert language.train(brute.documents(spark, rows)).langs == ["b", "c"]
