"""Run detection, conversation repair and quality rules against plain Python."""

import random

import brute_text
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.llm import plans, quality, runs, turns, words
from hazardlake.session import use_package

DOC = "doc_id long, text string, lang string, source string, h long, runs int, name string, own string, classes int, n long"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, 2, "x", "y", 3, 4) for r in rows], DOC)


def periodic_texts():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        w = [f"w{rng.randrange(rng.choice([2, 3, 50]))}" for _ in range(rng.randrange(1, 120))]
        if i % 3 == 0:
            w += (w[: rng.randrange(1, 9)] * 30)[: rng.randrange(60)] + w[:5]
        rows.append((i, " \n"[i % 2].join(w), "en"))
    rows += [(200, None, "en"), (201, "", None), (202, " \t\n ", "en"), (203, "a " * 30_000, "en"), (None, "b b b b b b b b b b b b b", "en"),
             (204, "é é é é é é é é é é é é 字", "en"), (7, rows[7][1], "en"), (7, rows[7][1], "en")]
    return rows


def test_runs_of_words():
    rng = random.Random(2)
    for t in range(4000):
        k = rng.choice([1, 2, 2, 3])
        w = [rng.randrange(k) for _ in range(rng.randrange(60))]
        if t % 2:
            w = ([rng.randrange(k) for _ in range(rng.randrange(1, 20))] * 60)[: len(w)]
            if w:
                w[rng.randrange(len(w))] = 9
        least = rng.choice([2, 12])
        s, e, q = runs.find_runs(words.mix(np.array(w, np.uint64) + np.uint64(1)), np.zeros(len(w), np.int64), least)
        assert sorted(zip(s.tolist(), (e - s).tolist(), q.tolist())) == brute_text.runs(w, least), w


def test_neighbouring_texts_share_no_run():
    word = words.mix(np.array([1] * 20, np.uint64))
    s, e, q = runs.find_runs(word, np.repeat([0, 1], [8, 12]))
    assert (s.tolist(), e.tolist(), q.tolist()) == ([8], [20], [1])


def test_periodic_runs(spark):
    use_package(spark)
    rows = periodic_texts()
    got = runs.digest(runs.periodic_runs(runs.planted(table(spark, rows).repartition(3)))).collect()
    want = [(i, *brute_text.periodic(i, t)) for i, t, _ in rows]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert any(w[1] for w in want)
    assert runs.digest(runs.periodic_runs(runs.planted(table(spark, [])))).count() == 0


def test_periodic_runs_keep_the_text_whole(spark):
    use_package(spark)
    text = " ".join(f"x{i}" for i in range(200_000))
    row = runs.periodic_runs(table(spark, [(1, text, None)])).first()
    assert row["collapsed"] == text and row["runs"] == [] and row["n_words"] == 200_000


def talks(seed, n, longest, roles=("system", "user", "assistant", "tool", "", None)):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(1, longest)):
            role = ("user", "assistant")[t % 2] if rng.random() < 0.7 else rng.choice(roles)
            text = rng.choice(["Yes.", "No!", "so", "", " \n", None, "Why? ", f"Text {rng.randrange(9)}.", "é."])
            turn = None if rng.random() < 0.03 else t + (c % 5 == 0) * rng.randrange(3)
            rows.append((c if c else None, turn, role, text))
    return rows


def by_conversation(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, r, x))
    return out


CONV = "conv_id long, turn long, role string, text string, rank int, chunk int, fault int, conv string"


def reported(spark, rows, chunk):
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in rows], CONV).repartition(3)
    found, edits = turns.repair(df, chunk)
    return {r["conv_id"]: tuple(r)[1:] for r in turns.report(df, found, edits).collect()}


@pytest.mark.parametrize("chunk", [1, 3, turns.CHUNK])
def test_repair(spark, chunk):
    use_package(spark)
    rows = talks(4, 60, 14)
    assert reported(spark, rows, chunk) == {c: brute_text.repair(m) for c, m in by_conversation(rows).items()}


def test_repair_of_a_long_conversation_in_chunks(spark):
    """One conversation holds most messages; its chunks start from speculated vectors and states."""
    use_package(spark)
    rng = random.Random(9)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), f"Message {t}" + rng.choice([".", "", "!"])) for t in range(2500)]
    rows += talks(5, 4, 6)
    assert reported(spark, rows, 64) == {c: brute_text.repair(m) for c, m in by_conversation(rows).items()}


def test_chunks_that_never_agree_run_again(spark):
    """Only deletions fit, so every state passes through each chunk unchanged: a speculated state
    is wrong until the true one has come all the way."""
    use_package(spark)
    rows = [(1, 0, "user", "One.")] + [(1, t, "user", " ") for t in range(1, 40)] + [(1, 40, "assistant", "Two.")]
    assert reported(spark, rows, 4) == {1: brute_text.repair([r[1:] for r in rows])}


def test_repaired_messages_follow_the_grammar(spark):
    import re

    use_package(spark)
    df = spark.createDataFrame([(*r, 1, 2, 3, "x") for r in talks(6, 40, 12)], CONV)
    _, edits = turns.repair(df, 4)
    said = edits.filter("role is not null").groupBy("conv").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "nth", "role"))), lambda x: F.left(x["role"], F.lit(1))), "").alias("s"))
    assert all(re.fullmatch("(s?(ua)+)?", r["s"]) for r in said.collect())


def test_repair_of_the_registered_query(spark, tmp_path):
    use_package(spark)
    rows = talks(8, 80, 9)
    spark.createDataFrame([r for r in rows], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    bad = by_conversation(brute_text.damage(rows))
    want = {c: brute_text.repair(bad.get(c, [])) for c in by_conversation(rows)}
    got = {r["conv_id"]: tuple(r)[1:] for r in plans.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == want
    assert reported(spark, [], 4) == {}


def prose(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        common = [f"c{rng.randrange(9)}" for _ in range(40)]
        w = common + [f"rare{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 90))]
        rng.shuffle(w)
        if i % 9 == 4:
            w = [x + "###" for x in w]
        if i % 9 == 5:
            w = [x.upper() for x in w]
        if i % 9 == 6:
            w = ["same", "words", "again"] * 30
        text = " ".join(w).replace(" c1 ", "\n")
        rows.append((i, text, ("en", "fr", None, "rare")[0 if i % 10 < 6 else 1 if i % 10 < 8 else 2 if i % 10 == 8 else 3 if i < 20 else 0]))
    rows += [(n, None, "en"), (n + 1, "", None), (n + 2, " \n ", "fr"), (None, rows[0][1], "en"), (0, rows[0][1], "en"),
             (n + 3, "字" * 300 + " é а" * 60, "en"), (n + 4, "a b\n\na b\n a b\na b\r\n", "en"), (n + 5, "x " * 60_000, None)]
    return rows


def test_quality(spark):
    use_package(spark)
    rows = prose(3, 300)
    got = quality.filter_quality(table(spark, rows).repartition(3)).drop("class_distance", "word_distance").collect()
    want = brute_text.quality(rows)
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert {w[-1] for w in want} == {True, False}
    assert quality.filter_quality(table(spark, [])).count() == 0


def test_quality_without_labels_or_long_texts(spark):
    use_package(spark)
    rows = [(i, "short text", None) for i in range(5)]
    assert [tuple(r)[1:8] for r in quality.filter_quality(table(spark, rows)).collect()] == [(2, 9, 0, 0, 0, True, False)] * 5


def test_common_words_are_exact_over_many_pieces(spark):
    """The bound of the pieces keeps every word that is common over all of them."""
    use_package(spark)
    rng = random.Random(1)
    rows = [(i, " ".join(f"{'p' if i % 2 else 'q'}{min(int(rng.paretovariate(0.5)), 5000)}" for _ in range(80)), "en") for i in range(400)]
    df = table(spark, rows)
    one = quality.references(df.coalesce(1)).filter("lang = 'en'").first()
    many = quality.references(df.repartition(17)).filter("lang = 'en'").first()
    assert one == many and len(one["keys"]) > 30


def test_divergence():
    p, q = np.array([[1, 2, 0, 5], [0, 0, 3, 0]]), np.array([2, 0, 1, 4.0])
    assert np.allclose(quality.distance(p, q) ** 2, [brute_text.divergence(r, q) for r in p.tolist()])
    assert quality.distance(np.array([[1, 1]]), np.array([4, 4]))[0] == 0
