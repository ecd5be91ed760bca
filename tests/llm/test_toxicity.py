"""The kernel against plain Python, and what the judge must and must not react to."""

import random
from itertools import combinations

import numpy as np
import pytest

from hazardlake.llm import toxicity
from hazardlake.session import use_package

INSULTS = ["grubble", "snaffert", "plomik", "drozzel", "vinkhead"]


def plain_kernel(a, b):
    def phi(s):
        s, out = "^" + s, {}
        for p in (3, 4):
            for places in combinations(range(len(s)), p):
                span = places[-1] - places[0]
                if span <= p - 1 + toxicity.REACH:
                    key = "".join(s[i] for i in places)
                    out[key] = out.get(key, 0) + toxicity.DECAY ** (span + 1)
        return out

    x, y = phi(a), phi(b)
    return sum(v * y.get(k, 0) for k, v in x.items()) / np.sqrt(sum(v * v for v in y.values()))


def test_kernel_is_the_sum_over_shared_sequences():
    words = ["idle", "idol", "riddle", "middle", "abcabcabc", "zzzz"]
    got = toxicity._Kernel([w.encode() for w in words]).against([w.encode() for w in words])
    want = [[plain_kernel(a, b) for b in words] for a in words]
    assert np.allclose(got, want, rtol=1e-5)


def test_machine_finds_the_smallest_loss():
    rng = np.random.default_rng(0)
    x = np.hstack([rng.normal(size=(200, 4)), np.ones((200, 1))])
    y, cost = np.sign(x[:, 0] + 0.3 * rng.normal(size=200)), rng.uniform(0.5, 2, 200)
    w = toxicity._svm(x, y, cost)
    loss = lambda w: (w[:-1] @ w[:-1]) / 2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2
    assert all(loss(w) <= loss(w + 1e-3 * rng.normal(size=5)) for _ in range(200))


def test_long_words_are_stretches():
    data = np.frombuffer(b"a" * 200 + b" bb", np.uint8)
    start, end, doc = toxicity.units(data, np.array([0, 203]))
    assert (end - start).max() == toxicity.LONG and end[-2] == 200 and (start[-1], end[-1]) == (201, 203)
    assert set(np.diff(start[:-1])) == {toxicity.STRIDE}


@pytest.fixture(scope="module")
def learned(spark):
    use_package(spark)
    rng = random.Random(4)
    clean = lambda n: " ".join("".join(rng.choice("aeioulmnrst") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    docs, labels = [], []
    for i in range(600):
        text = clean(rng.randrange(20, 80))
        if i % 4 == 0:
            text = f"{text} {INSULTS[i // 4 % 5]} {clean(5)}"
        docs.append((i, text))
        labels.append((i, int(i % 4 == 0)))
    copied = clean(60)  # one toxic text copied often must not make its words toxic
    docs += [(600 + i, copied + " plomik") for i in range(60)]
    labels += [(600 + i, 1) for i in range(60)]
    model = toxicity.learn(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int"))
    return model, clean, copied


@pytest.mark.parametrize("n", [20, 200, 3000])
def test_one_insult_counts_however_long_the_text(spark, learned, n):
    model, clean, _ = learned
    forms = {"as it is": lambda w: w, "hyphen": lambda w: w[:2] + "-" + w[2:], "spelt": " ".join, "cut": lambda w: w[:3] + " " + w[3:]}
    rows = [(f, f"{clean(n // 2)} {g(w)} {clean(n // 2)}") for f, g in forms.items() for w in INSULTS]
    rows += [("none", clean(n)) for _ in range(30)]
    got = toxicity.predict(spark.createDataFrame(rows, "f string, text string"), model).toPandas().groupby("f").predicted.mean()
    # Words of random letters come near an insult about once in fifty thousand.
    assert got["none"] <= max(0.02, n / 30_000) and all(got[f] >= 0.8 for f in forms), got.to_dict()


def test_words_of_a_copied_text_are_not_learned(spark, learned):
    model, _, copied = learned
    assert toxicity.predict(spark.createDataFrame([(copied,)], "text string"), model).first()["predicted"] == 0
