"""The schedule against plain Python, and pipeline stages that leave each other's tables alone."""

import math

import pytest

from hazardlake.llm import mixing
from hazardlake.session import use_package


def plain(sizes, positions, block):
    """{(doc_id): (taken, first_slot, n_slots)}; sizes: {key: (words, target)}, positions: [(doc_id, key, at, size)]"""
    total = sum(t for _, t in sizes.values())
    slots, at, spans = math.ceil(total / block), 0.0, {}
    for k in sorted(sizes):
        spans[k] = (at / total, (at + sizes[k][1]) / total)
        at += sizes[k][1]
    ranks, plan = dict.fromkeys(sizes, 0), []
    need = {}
    for k, (words, target) in sizes.items():
        full, rest = divmod(math.floor(target), words)
        need[k] = full * math.ceil(words / block) + math.ceil(rest / block)
    for i in range(slots):
        p = math.modf(i * mixing.GOLDEN)[0]
        for k, (lo, hi) in spans.items():
            if lo <= p < hi:
                if ranks[k] < need[k]:
                    plan.append((i, k, ranks[k]))
                ranks[k] += 1
    for k in sizes:
        plan += [(slots, k, r) for r in range(ranks[k], need[k])]
    out = {d: [0, None, 0] for d, *_ in positions}
    for slot, k, r in plan:
        words, target = sizes[k]
        epoch, b = divmod(r, math.ceil(words / block))
        end = words if epoch < math.floor(target) // words else math.floor(target) % words
        for d, key, start, n in positions:
            if key == k:
                took = min(start + n, min((b + 1) * block, end)) - max(start, b * block)
                if took > 0:
                    out[d][0] += took
                    out[d][1] = slot if out[d][1] is None else min(out[d][1], slot)
                    out[d][2] += 1
    return {d: tuple(x) for d, x in out.items()}


@pytest.fixture(scope="module")
def table(spark):
    use_package(spark)
    rows = [(i, " ".join(["w"] * (i * 37 % 90)), "aaabbc"[i % 6]) for i in range(120)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


def found(df):
    return {r["doc_id"]: (r["taken"], r["first_slot"], r["n_slots"]) for r in mixing.taken(df, block_words=50).collect()}


def expected(df):
    sizes = mixing.sized(df)
    sources = mixing.targets(sizes)
    return plain({r["key"]: (r["source_size"], r["target"]) for r in sources.collect()},
                 [(r["doc_id"], r["key"], r["at"], r["size"]) for r in mixing.placed(sizes, sources).collect()], 50)


def test_slots_are_those_of_the_points(table):
    assert found(table) == expected(table)


def test_other_points_give_other_slots(table, monkeypatch):
    """The schedule is part of the result: with another ratio the same words come in other slots."""
    before = found(table)
    monkeypatch.setattr(mixing, "GOLDEN", 0.25)
    after = found(table)
    assert after == expected(table)
    assert {d: x[0] for d, x in after.items()} == {d: x[0] for d, x in before.items()} and after != before


def test_stages_leave_other_results_alone(spark, table, tmp_path):
    import corpus_pipeline

    docs = table.selectExpr("doc_id", "text", "'en' as lang", "source", "0L as n_chars")
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        one = stage(spark, docs, str(tmp_path))
        other = stage(spark, docs.filter("doc_id < 10"), str(tmp_path))
        assert one.count() >= other.count() > 0, name
        assert one.count() == stage(spark, docs, str(tmp_path)).count(), name


def test_two_runs_in_one_driver(spark, table, tmp_path):
    import corpus_pipeline

    docs = table.selectExpr("doc_id", "concat('alpha', doc_id, ' ', text, ' beta', doc_id) as text", "'en' as lang", "source", "0L as n_chars")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "no such words here at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    first = corpus_pipeline.run(spark, str(tmp_path))
    second = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, second.collect())) and first.count() > 0
