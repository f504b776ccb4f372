import numpy as np
import pytest

from plaudit.operators import evaluation as E


def _df(spark, labels, probs):
    rows = [(int(l), float(p)) for l, p in zip(labels, probs)]
    return spark.createDataFrame(rows, "label int, p double")


def _brute_best(labels, probs):
    best = (-1.0, 0.0)
    for t in sorted(set(probs)):
        hit = probs >= t
        tp, fp, fn = (hit & (labels == 1)).sum(), (hit & (labels == 0)).sum(), (~hit & (labels == 1)).sum()
        pr, rc = tp / max(1, tp + fp), tp / max(1, tp + fn)
        best = max(best, (2 * pr * rc / max(1e-9, pr + rc), t))
    return best


CASES = {
    "separable": (np.r_[np.ones(500), np.zeros(200)], np.r_[np.linspace(0.6, 0.99, 500), np.linspace(0.01, 0.4, 200)]),
    "inverted": (np.r_[np.ones(50), np.zeros(50)], np.r_[np.linspace(0.0, 0.4, 50), np.linspace(0.5, 1.0, 50)]),
    "ties": (np.arange(300) % 2, (np.arange(300) % 7) / 7.0),
    "one_class": (np.ones(20), np.linspace(0.1, 0.9, 20)),
    "noise": (np.random.default_rng(3).integers(0, 2, 3000), np.random.default_rng(4).random(3000).round(3)),
}


@pytest.mark.parametrize("case", CASES)
def test_best_threshold_matches_brute_force(spark, case):
    labels, probs = CASES[case]
    f1, thr = _brute_best(labels, probs)
    got = E.best_threshold(_df(spark, labels, probs)).first()
    assert got.threshold == thr and got.f1_pos == pytest.approx(f1)
    record = E.calibrate(_df(spark, labels, probs)).first()
    assert record.threshold == thr and record.f1_pos == pytest.approx(f1)
    assert record.acc == pytest.approx(((probs >= thr) == (labels == 1)).mean())
    assert record.pos_rate_true == pytest.approx(labels.mean()) and record.n == len(labels)


def test_neutral_rows_do_not_count(spark):
    df = _df(spark, [1, 0, -1, -1], [0.9, 0.2, 0.99, 0.0])
    assert E.confusion(df).first().n == 2 and E.best_threshold(df).first().threshold == 0.9


def test_empty_input(spark):
    df = _df(spark, [-1], [0.3])
    assert E.best_threshold(df).first().threshold == 0.5
    assert E.confusion(df).first().acc == 0


@pytest.mark.parametrize("case", ["separable", "inverted", "ties", "noise"])
def test_auc(spark, case):
    labels, probs = CASES[case]
    pos, neg = probs[labels == 1], probs[labels == 0]
    truth = ((pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean())
    assert E.auc(_df(spark, labels, probs)).first().auc == pytest.approx(truth)


def test_rating_error_and_selection(spark):
    df = spark.createDataFrame([(5, 5), (3, 5), (1, 2)], "pred_rating int, star int")
    r = E.rating_error(df).first()
    assert (r.rating_acc, r.rating_mae, r.n) == (pytest.approx(1 / 3), 1.0, 3)
    m = spark.createDataFrame([("a", 0.8, 0.9, 0.4), ("b", 0.9, 0.9, 0.4)], "model string, acc double, f1_pos double, rating_mae double")
    best = E.best_model(m).first()
    assert best.model == "b" and best.selection == pytest.approx(1.7)
