"""Language ID: every learned language is kept; the solution against a plain kernel ridge."""

import random

import numpy as np

from tillpoint.llm import langid


def _text(lang: int, seed: int, n: int) -> str:
    """Words of four letters of the language's own."""
    own = random.Random(lang).sample([chr(c) for c in range(0x4E00, 0x4E00 + 4000)], 4)
    rnd = random.Random(seed)
    return " ".join("".join(rnd.choice(own) for _ in range(3)) for _ in range(n))


def test_more_languages_than_a_hundred_and_one_with_long_texts_only(make):
    rows = [(i, _text(i % 130, i, 20), f"l{i % 130:03d}", "s") for i in range(130 * 9)]
    rows += [(10_000 + i, _text(999, i, 1500), "long", "s") for i in range(9)]
    docs = make(rows)
    model = langid.fit(docs)
    assert len(model.langs) == 131 and model.marks.shape[1] <= langid.LANDMARKS_TOTAL
    got = {r.doc_id: (r.lang_pred, r.held_out) for r in langid.identify(docs, model).collect()}
    held = [(i, lang) for i, _, lang, _ in rows if got[i][1]]
    assert sum(got[i][0] == lang for i, lang in held) >= 0.95 * len(held)
    assert all(got[i][0] == "long" for i, lang in held if lang == "long")


def test_more_languages_than_landmarks():
    rows = [(langid.grams(_text(i % 250, i, 12)), f"l{i % 250:03d}") for i in range(500)]
    model = langid.Classifier(rows)
    assert len(model.langs) == 250 and model.marks.shape[1] <= langid.LANDMARKS_TOTAL


def test_solution_is_that_of_a_plain_kernel_ridge():
    """With every training text a landmark the Nyström map is exact."""
    rnd = np.random.default_rng(5)
    sets = [np.unique(rnd.integers(0, 400, 40)) for _ in range(30)]
    langs = ["ab"[i % 3 == 0] for i in range(30)]
    model = langid.Classifier(list(zip(sets, langs)))
    assert model.marks.shape[1] == 30

    def kernel(a, b):
        return np.array([[len(np.intersect1d(x, y)) / np.sqrt(len(x) * len(y)) for y in b] for x in a])

    marks = [g for lang in model.langs for g, x in zip(sets, langs) if x == lang]
    order = [x for lang in model.langs for x in langs if x == lang]
    y = np.array([[float(x == lang) for lang in model.langs] for x in order])
    n = np.array([order.count(x) for x in order], float)  # a row weighs 1 / n
    alpha = np.linalg.solve(kernel(marks, marks) + 1 + langid.RIDGE * np.diag(n), y)
    fresh = [np.unique(rnd.integers(0, 400, 40)) for _ in range(10)]
    want = (kernel(fresh, marks) + 1) @ alpha
    assert np.allclose(model.kernel(fresh) @ model.weights + model.bias, want, atol=1e-3)
