"""Training by epochs against the same steps in plain numpy."""

import numpy as np
import pytest

from comity.operators import training

TEXTS = [("you idiot fool", 0), ("idiot idiot you", 0), ("lovely day today", 2), ("nice day", 2),
         ("what a bad word", 1), ("bad bad thing", 1), ("a day", 2), ("", 2), (None, 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "tweet string, class int")


def test_epochs_equal_plain_steps(spark):
    train = frame(spark, TEXTS * 3 + [("left out", 7), ("no class", None)]).repartition(4)
    buckets, rate, momentum, decay = 64, 2.0, 0.9, 1e-3
    model, log = training.train_epochs(
        train, frame(spark, TEXTS), epochs=5, buckets=buckets, learning_rate=rate,
        momentum=momentum, weight_decay=decay)
    rows = train.filter("class in (0, 1, 2)").select(
        "class", training.hashed_words("tweet", buckets).alias("words")).collect()
    x = np.zeros((len(rows), buckets + 1))
    for i, r in enumerate(rows):
        for w in r["words"]:
            x[i, w] += 1
        x[i] /= max(1e-300, np.sqrt((x[i] ** 2).sum()))
        x[i, -1] = 1
    y = np.array([r["class"] for r in rows])
    counts = np.bincount(y, minlength=3)
    weight = (len(y) / (3 * counts))[y]
    w, speed, losses, steps = np.zeros((buckets + 1, 3)), 0, [], []
    for _ in range(5):
        p = np.exp(x @ w)
        p /= p.sum(1, keepdims=True)
        losses.append(-(np.log(p[np.arange(len(y)), y]) * weight).sum() / weight.sum())
        slope = x.T @ ((p - np.eye(3)[y]) * weight[:, None]) / weight.sum()
        slope[:-1] += decay * w[:-1]
        speed = momentum * speed - rate * slope
        w = w + speed
        steps.append(w)
    got = log.orderBy("epoch").collect()
    assert np.allclose([r["train_loss"] for r in got], losses, atol=1e-12)
    chosen = [r["epoch"] for r in got if r["selected"]]
    assert len(chosen) == 1 and np.allclose(model.weights, steps[chosen[0] - 1], atol=1e-12)
    best = max(r["f1_macro"] for r in got)
    assert chosen[0] == min(r["epoch"] for r in got if r["f1_macro"] == best)
    assert got[-1]["train_loss"] < got[0]["train_loss"] and got[0]["val_rows"] == len(TEXTS)
    again = {(r["tweet"], r["class"]): r["prediction"] for r in model.transform(frame(spark, TEXTS)).collect()}
    assert again[("you idiot fool", 0)] == 0 and again[("lovely day today", 2)] == 2


def test_no_rows_to_train_on(spark):
    with pytest.raises(ValueError, match="no training rows"):
        training.train_epochs(frame(spark, [("x", 9)]), frame(spark, TEXTS), epochs=1, buckets=8)
    _, log = training.train_epochs(frame(spark, TEXTS), frame(spark, []), epochs=1, buckets=8)
    assert [(r["val_rows"], r["selected"]) for r in log.collect()] == [(0, True)]
