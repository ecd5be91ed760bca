"""Operators against plain Python on small tables: nulls, empty and long texts, ties, repeats, clashing names."""

import random
import zlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.llm import (chat, graph, language, minhash, mixing, passages, plans, postings, surrogates, tokens,
                            toxicity, vectors)

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component long, hits int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=3, n=60):
    """[(doc_id, text, lang, source)] with copies, near copies, shared passages and odd texts."""
    rng = random.Random(seed)
    shared = sentence(rng, 30, 10_000)
    base = sentence(rng, 120, 10_000)
    rows = []
    for i in range(n):
        text = sentence(rng, rng.randrange(1, 90), 10_000)
        if i % 5 == 0:
            text += "\n" + shared
        if i % 7 == 0:
            w = base.split(" ")
            for _ in range(rng.randrange(5)):
                w[rng.randrange(len(w))] = "changed"
            text = " ".join(w)
        if i % 11 == 3:
            text = rows[-1][1]
        rows.append((i, text, ("en", "de", None)[i % 3], (None, "b", "a", "é")[i % 4]))
    odd = [None, "", "  \t\n", "one", "One TWO", "one two three", "ümläut x y z  a  b ", "a\x1cb\x85c \n d\n e", "😀 <|endoftext|> it's",
           sentence(rng, 30_000), "!!! ... 12 34", "tab\tsep\x0bvt\x0cff\rcr"]
    rows += [(n + i, t, "en", "a") for i, t in enumerate(odd)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, 0, 7, "x", 1, 2) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_near_duplicates(docs, rows, empty):
    got = {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert got == brute.near_duplicates({r[0]: r[1] for r in rows})
    assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_repeats_and_null_ids(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (5, t), (9, "z")], "doc_id long, text string")
    got = sorted((str(r["id"]), r["component_id"] or 0, r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == [("1", 1, True), ("1", 1, True), ("5", 1, False), ("9", 9, True), ("None", 1, True)] or got[-1][0] == "None"
    assert [g for g in got if g[0] != "None"] == [("1", 1, True), ("1", 1, True), ("5", 1, False), ("9", 9, True)]


def test_chain_of_near_copies(spark):
    """Linked only through their neighbours; no two ends are similar."""
    w = [f"w{i}" for i in range(400)]
    df = spark.createDataFrame([(i, " ".join(w[8 * i: 8 * i + 120])) for i in range(30)], "doc_id long, text string")
    want = brute.near_duplicates({r[0]: r[1] for r in df.collect()})
    assert {r["id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()} == want
    assert {v[1] for v in want.values()} == {0}


def test_components(spark):
    links = [(5, 4), (4, 3), (9, 8), (3, 1), (7, 7), (8, 9)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["node"]: r["component"] for r in graph.components(df, "a", "b").collect()}
    assert got == {1: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}
    assert graph.components(df.limit(0), "a", "b").count() == 0


def test_tokens_round_trip(spark, docs, rows, empty, tmp_path):
    from tokenizers import Tokenizer

    tk, at, want = Tokenizer.from_file(plans.tokenizer_path()), 0, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        ids = [*tk.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = plans.token_digest(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == want
    assert plans.token_digest(empty).count() == 0


def test_odd_white_space_is_cut_like_the_tokenizer():
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(plans.tokenizer_path()), tokens.Encoder(plans.tokenizer_path(), 0)
    rng = random.Random(1)
    parts = ["a", "foo", "it's", " ", "  ", "\n", "\t", " ", "　", "\x1c", "é", "1", "!", "<|endoftext|>", "'ll", "\x85", "字"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(3000)]
    for _ in range(3):  # with new, known and partly forgotten words
        ids, size = enc.encode(texts)
        at = 0
        for t, n in zip(texts, size):
            assert ids[at: at + n].tolist() == [*tk.encode(t, add_special_tokens=False).ids, 0], repr(t)
            at += n
        enc._forget()


def test_words_are_learned_once_whatever_stands_around_them():
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(plans.tokenizer_path()), tokens.Encoder(plans.tokenizer_path(), 0)
    words = ["alpha", "Beta", "gé", "don", "x1", "×", "字", "ÿ", "ǆ", "r2d2"]
    texts = [f"{a}{gap}{b}{sign} {c}" for a in words for b in words for c in words
             for gap in ("\n\n", "\t", " \n", "  ", "\r\n") for sign in (",", "***", ".)")]
    ids, size = enc.encode(texts)
    at = 0
    for t, n in zip(texts, size):
        assert ids[at: at + n].tolist() == [*tk.encode(t, add_special_tokens=False).ids, 0], repr(t)
        at += n
    assert len(enc.rows) < 120  # 1,511 when such white space and signs were not cut


def test_line_ends_before_a_special_token():
    from tokenizers import Tokenizer

    tk, enc = Tokenizer.from_file(plans.tokenizer_path()), tokens.Encoder(plans.tokenizer_path(), 0)
    for text in ("a\n\n<|endoftext|>b", "a\n<|endoftext|>\n\nb", "<|endoftext|>", "a, <|endoftext|> ", "a  <|b"):
        assert enc.encode([text])[0].tolist() == [*tk.encode(text, add_special_tokens=False).ids, 0], repr(text)


def test_an_encoder_keeps_its_memory_small():
    import tracemalloc

    enc = tokens.Encoder(plans.tokenizer_path(), 0)
    enc.encode(["warm up"])
    tracemalloc.start()
    try:
        for i in range(0, 350_000, 10_000):
            enc.encode([" ".join(f"w{j:x}" for j in range(i, i + 10_000))])
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert held < 40 << 20  # 58 MB when a dict of bytes held the words


def test_pieces_are_told_apart_whatever_is_forgotten(monkeypatch):
    from tokenizers import Tokenizer

    tk, rng = Tokenizer.from_file(plans.tokenizer_path()), random.Random(5)
    texts = ["", "x" * 1000 + " y", "字" * 300, *(sentence(rng, rng.randrange(60), 900) for _ in range(300))]
    want = [[*tk.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    one = lambda data, start, end: np.full(len(start), 7, np.uint64)
    few = lambda data, start, end: (end - start).astype(np.uint64)
    for name in (None, one, few):
        with monkeypatch.context() as m:
            m.setattr(tokens, "REMEMBERED_BYTES", 20_000)
            if name:
                m.setattr(tokens, "hashes", name)
            enc = tokens.Encoder(plans.tokenizer_path(), 0)
            for _ in range(2):
                for lo in range(0, len(texts), 20):
                    ids, size = enc.encode(texts[lo: lo + 20])
                    assert [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])] == want[lo: lo + 20]
                    # What is held before a call's own pieces: each text has 60 words at most.
                    assert enc._held() < 20_000 + 20 * 60 * (tokens.PIECE_BYTES + 5 + 20) + 10_000
                    assert len(enc.rows) < len(enc.size) and (np.diff(enc.rows.astype(float)) > 0).all()


def test_token_files_are_read_without_a_shuffle_of_ids(spark, docs, tmp_path, capsys):
    path = str(tmp_path / "files")
    tokens.write_tokens(docs.repartition(3), path, plans.tokenizer_path())
    got = tokens.read_tokens(spark, path)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # many files
    try:
        got.explain()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    plan = capsys.readouterr().out
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    at = 0
    for r in got.orderBy("start").collect():
        assert (r["start"], 4 * r["n_tokens"]) == (at, len(r["ids"]))
        at += r["n_tokens"]


@pytest.mark.parametrize("values", [
    [], [7], [2**32 - 1, 0], list(range(300)), [5] * 128, [1] * 120 + [2**31] * 9, [2**32 - 1] * 257,
    np.random.default_rng(0).integers(0, 50_000, 1000).tolist(), np.random.default_rng(1).integers(0, 2**32, 500).tolist()])
@pytest.mark.parametrize("percentile", [1, 50, 90, 100])
def test_patched_blocks(values, percentile):
    ids = np.array(values, np.uint32)
    payload = tokens.pack(ids, percentile)
    assert tokens.unpack(payload).tolist() == values
    for i in range(0, len(values), 61):
        assert tokens.value_at(payload, i) == values[i]


def test_mix(docs, rows, empty):
    sizes, source = {}, {}
    for i, t, _, s in rows:
        source[i] = s
        sizes[s] = sizes.get(s, 0) + len(brute.SPLIT.findall(t or ""))
    want = brute.targets(sizes)
    got = mixing.taken(docs, block_words=64).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(source)
    sums = dict.fromkeys(want, 0)
    for r in got:
        assert r["taken"] <= 2 * r["size"] and r["source_size"] == sizes[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(want[source[r["doc_id"]]])
        sums[source[r["doc_id"]]] += r["taken"]
    assert all(abs(sums[s] - want[s]) < 1 for s in want)
    assert sorted(got) == sorted(mixing.taken(docs.repartition(5), block_words=64).collect())
    assert mixing.taken(empty).count() == 0


def test_schedule_follows_the_weights(spark):
    df = spark.createDataFrame([(i, "w " * 100, s) for i, s in enumerate("aaabbbcccc" * 20)], "doc_id long, text string, source string")
    sources = mixing.targets(mixing.sized(df))
    share = {r["key"]: r["high"] - r["low"] for r in sources.collect()}
    slots = [r["key"] for r in mixing.schedule(sources, 50).orderBy("slot").collect()]
    for lo in range(0, len(slots) - 100, 37):
        for s, p in share.items():
            assert abs(slots[lo: lo + 100].count(s) - 100 * p) < 4


def test_mixed_rows_keep_columns(docs):
    got = mixing.mixed(docs)
    assert got.columns == docs.columns and got.count() > 0


def test_decontamination(spark, docs, rows, empty):
    by = {r[0]: r[1] for r in rows}
    words_of = lambda t: brute.PLAIN.findall(t.translate(brute.FOLD))
    items = [(0, " ".join(words_of(by[10])[-40:])), (1, "ONE two"), (2, ""), (3, None), (4, " ".join(words_of(by[5])[:13]).upper()),
             (12, "one"), (7, "not there at all"), (0, "w1 w2")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    single = {}
    for i, t in items:
        single.setdefault(i, []).append(t)
    want = brute.decontaminate(by, {i: t for i, t in items if i != 0} | {0: single[0][0]})
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"])
           for r in postings.decontaminate(docs, bench.filter("item_id <> 0 or text <> 'w1 w2'")).collect()}
    assert got == want
    assert any(v[3] for v in want.values())
    assert postings.decontaminate(empty, bench).count() == 0
    clean = postings.decontaminate(docs, bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["contaminated"] for r in clean)


def test_proximity(spark, tmp_path):
    df = spark.createDataFrame([(1, "a x b y c"), (2, "a x x x x b"), (3, "b a"), (4, None)], "doc_id long, text string")
    index = postings.build(df, str(tmp_path / "index"))
    asked = postings.phrases(spark.createDataFrame([(0, "a b")], "item_id long, text string"), 13).withColumn("phrase", F.lit("p"))
    found = postings.located(index, postings.near(index, asked, 2))
    assert sorted((r["doc_id"], r["at"] - r["first"]) for r in found.collect()) in ([(1, 0), (3, 1)], [(1, 2), (3, 0)])


def test_passages(spark, docs, rows, empty):
    got = sorted(tuple(r) for r in passages.repeated_passages(docs).collect())
    assert got == sorted(brute.passages([r[:2] for r in rows]))
    assert sum(g[2] for g in got) > 200
    assert passages.repeated_passages(empty).count() == 0


def test_passages_ties_and_null_ids(spark):
    p = " ".join(f"w{i}" for i in range(20))
    table = [(1, p + " x"), (1, p + " x"), (2, p), (None, "y " + p), (None, "y " + p), (0, "short text"), (3, p + " " + p)]
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(4)
    key = lambda r: (str(r[0]), r[1], r[2], r[3])
    assert sorted(map(key, passages.repeated_passages(df).collect())) == sorted(map(key, brute.passages(table)))


def test_vectors(spark):
    rng = np.random.default_rng(4)
    table = []
    for i in range(120):
        v = rng.standard_normal(16)
        if i % 3 and table:
            v = np.array(table[-1][1]) + rng.standard_normal(16) * (0.0, 0.03, 0.2)[i % 3]
        table.append((i, v.tolist(), i % 2 if i % 9 else None if i % 2 else 3))
    for i, v in enumerate([None, [], [0.0] * 16, [1.0, None] * 8, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [1.0] * 16]):
        table.append((200 + i, v, 1))
    table += [(300 + i, [1.0] * 16, 1) for i in range(5)] + [(400, [3.0] * 16, 1), (401, [1.0] * 16, 0)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int").withColumn("id", F.lit(1)).repartition(3)
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got == brute.vectors(table)
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_large_group_of_vectors(spark):
    """More members than a block holds, all linked."""
    rng = np.random.default_rng(2)
    center = rng.standard_normal(32)
    table = [(i, (center + 0.02 * rng.standard_normal(32)).tolist(), 0) for i in range(200)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got == brute.vectors(table)


def test_rotation_estimates_are_unbiased():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((30, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    turn = vectors.rotations(64, 20)
    sign, factor = vectors._codes(x, turn)
    steps, size = vectors._steps(x)
    query = (steps - vectors._offset(64)) * size[:, None]
    assert (np.abs(query - x) <= size[:, None] * 0.5001).all()
    exact = x @ x.T
    est = vectors._rebuilt(sign, factor, turn) @ query.T
    off = ~np.eye(30, dtype=bool)
    error = (est - exact)[off]
    spread = vectors._deviation(factor, 64)[:, None] * np.sqrt(np.maximum(0, 1 - exact**2))
    assert abs(error.mean()) < 0.005 and (np.abs(error) < 5 * (spread[off] + 0.003)).all()


def test_codes_decide_most_pairs(spark):
    """Fewer pairs are recomputed than meet, the links are the same, and a wide bound recomputes more."""
    rng = np.random.default_rng(8)
    center = rng.standard_normal((4, 64))
    table = [(i, (center[i % 4] + 0.55 * rng.standard_normal(64)).tolist(), 0) for i in range(150)]
    table += [(200 + i, (np.array(table[i][1]) + 0.05 * rng.standard_normal(64)).tolist(), 0) for i in range(20)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vectors.near_vectors(df).collect()}
    assert got == brute.vectors(table) and sum(n for n, _, _ in got.values()) == 40
    reps = df.selectExpr("vec_id id", "size(embedding) d", "7L g", "embedding v")
    counts = []
    for sure in (5.0, 1e9):
        plan = vectors.Plan(*vectors.shape(170, 0.98, 1e-7), 0.98, sure)
        coded = reps.mapInArrow(vectors._encode(plan), vectors.CODES)
        left = vectors.undecided(coded, plan).collect()
        counts.append(sum(bin(byte).count("1") for r in left for byte in r["partners"]))
    assert 20 <= counts[0] < counts[1] / 3


def test_preferences(spark):
    table = [(1, "chosen", 0, "user", "hi"), (1, "rejected", 0, "user", "hi"), (1, "chosen", 1, "assistant", "good"),
             (1, "rejected", 1, "assistant", "bad <|im_end|>"), (1, "chosen", 2, "user", "same"), (1, "rejected", 2, "user", "same"),
             (2, "chosen", 0, "user", "alone"), (None, "chosen", 0, "user", "x"), (3, "chosen", 0, None, None),
             (3, "rejected", 0, "user", ""), (3, "rejected", None, "assistant", "late"), (4, "other", 0, "user", "x"),
             (5, "chosen", 0, "user", "a"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a")]
    df = spark.createDataFrame(table, "pair_id long, side string, turn int, role string, text string").withColumn("segment", F.lit(1))
    got = chat.preference_segments(df).collect()
    want = brute.preference(table)
    assert {(r["pair_id"], r["part"], r["turn"], r["role"]): r["copies"] for r in got} == {k[:4]: n for k, n in want.items()}
    assert len(got) == len(want)
    assert {r["segment"] for r in got if r["learn"]} == {
        "<|im_start|>assistant\ngood<|im_end|>\n", "<|im_start|>assistant\nbad < |im_end|><|im_end|>\n", "<|im_start|>assistant\nlate<|im_end|>\n"}
    assert chat.preference_segments(df.limit(0)).count() == 0


def test_other_answers(spark):
    rng = random.Random(12)
    table = []
    for c in [*range(-3, 40, 2), 1 << 40, (1 << 62) + 1]:
        for turn in range(rng.randrange(1, 6)):
            for _ in range(rng.choice((1, 1, 2))):
                table.append((c, turn, rng.choice(("user", "assistant", None, "a<|im_end|>")), rng.choice(("x", "y", None, "<|im_start|>", "é" * 5))))
    table += [(None, 0, "assistant", "lost"), (4, None, "assistant", "late"), (6, 0, "user", "no answer"), (8, 0, "assistant", "é" * 300_000)] + table[:3]
    df = spark.createDataFrame(table, "conv_id long, turn int, role string, text string").withColumn("side", F.lit(1)).repartition(4)
    got = {}
    for r in chat.preference_segments(chat.other_answers(df)).collect():
        got[r["pair_id"], r["part"], r["turn"], r["segment"]] = r["copies"]
    assert got == brute.other_answers(table)
    assert any(k[1] == "prompt" for k in got) and any(k[1] == "rejected" for k in got)
    assert chat.other_answers(df.limit(0)).count() == 0
    alone = chat.preference_segments(chat.other_answers(df.filter("conv_id = 8"))).collect()
    assert [(r["part"], r["learn"]) for r in alone] == [("prompt", False)]


def test_language(spark):
    rng = random.Random(5)
    speak = {"en": "the of and water house with".split(), "de": "der und wasser haus mit für".split(), "fr": "le de et eau maison avec".split()}
    text = lambda lang, n: " ".join(rng.choice(speak[lang]) for _ in range(n))
    table = [(i, text(lang, 30), lang) for i in range(150) for lang in [("en", "de", "fr")[i % 3]]]
    table += [(900, None, "en"), (901, "", "en"), (902, "12 34 … 😀", "de"), (903, "DER WASSER", None), (None, text("fr", 9), "fr"),
              (904, text("en", 60) + " " + text("fr", 40), None), (904, text("en", 60), None)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")).withColumn("language", F.lit(1))
    got = language.identify(df).collect()
    assert len(got) == len(table)
    lang = {(t, i): x for i, t, x in table}
    for r in got:
        if r["doc_id"] is not None and r["doc_id"] < 900:
            assert r["lang_pred"] == lang[r["text"], r["doc_id"]]
            assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert [by[i, t]["lang_pred"] for i, t, _ in table[150:155]] == ["und", "und", "und", "de", "fr"]
    mixed = by[904, table[-2][1]]
    assert set(mixed["languages"]) == {"en", "fr"} and 0.4 < mixed["score"] < 0.8
    assert language.identify(df.limit(0)).count() == 0
    assert {r["lang_pred"] for r in language.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_toxicity_tolerates_inserted_characters(spark):
    rng = random.Random(6)
    syllables = "ba da fe ga ho ka le mi no pe ri so tu va we".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randrange(1, 4)))
    docs, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        w = [word() for _ in range(rng.randrange(5, 40))]
        if bad:
            w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "idiotic"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    extra = ["you scu-mbag here", "an i.d.i.o.t.i.c thing", "i d i o t i c", "bada feho", "", None]
    docs += [(1000 + i, t) for i, t in enumerate(extra)]
    labels += [(2, 0), (5000, 1), (3, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit(1)).withColumn("toxic", F.lit(9))
    out = toxicity.detect(d, spark.createDataFrame(labels, "doc_id long, toxic int"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert len(got) == len(docs)
    right = [got[i]["predicted"] == int(i % 4 == 0) for i in range(600) if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.97
    assert [got[1000 + i]["predicted"] for i in range(6)] == [1, 1, 1, 0, 0, 0]
    assert toxicity.detect(d.limit(0), spark.createDataFrame(labels, "doc_id long, toxic int")).count() == 0
    assert {r["predicted"] for r in toxicity.detect(d, spark.createDataFrame([], "doc_id long, toxic int")).collect()} == {0}


@pytest.mark.parametrize("letters, insults", [
    ("бвгдзклмнпрстаеиоуыя", ["дурачина", "балбесище"]), ("βγδκλμνπρσταεηιου", ["βλακαρας", "ηλιθιος"]),
    ("بتجدرسعفقكلمنهوي", ["حقيرجدا", "سفيهلئيم"]), ("的一是在不了有和人这中大为上个国我以要他", ["傻瓜笨蛋", "混账王八"])])
def test_toxicity_outside_ascii(spark, letters, insults):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    docs, labels = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 40))]
        if i % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(insults))
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 4 == 0)))
    new = ["".join(rng.choice(letters) for _ in range(7)) for _ in range(200)]  # words of the same letters, never seen
    cut = [f"{w[:3]}-{w[3:]}" for w in insults] + [" ".join(insults[0]), insults[1].upper()]
    docs += [(1000 + i, f"{vocabulary[0]} {w} {vocabulary[1]}") for i, w in enumerate(cut + new)]
    got = {r["doc_id"]: r for r in toxicity.detect(spark.createDataFrame(docs, "doc_id long, text string"),
                                                   spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    right = [got[i]["predicted"] == int(i % 4 == 0) for i in range(600) if got[i]["held_out"]]
    assert sum(right) / len(right) > 0.97
    assert [got[1000 + i]["predicted"] for i in range(4)] == [1, 1, 1, 1]
    assert sum(got[1004 + i]["predicted"] for i in range(200)) <= 4


def test_surrogates(spark):
    table = [(1, "Mail anna.b@mail8.example.com or call +1 (386) 555-3733."), (2, "again: Anna.B@mail8.example.com, +13865553733"),
             (3, "host 42.144.35.254, card 4111 1111 1111 1111, GB82 WEST 1234 5698 7654 32"), (4, 'token = "0641917ea4e9feb9cda83477" '),
             (5, "Frau Anna Schmidt kam. Schmidt? Frau Schmidt. Госпожа Анна Иванова и г-н Иванов"), (6, None), (7, ""), (8, "nothing 12.5 here"),
             (None, "x@y.zz")]
    df = spark.createDataFrame(table, "doc_id long, text string").withColumn("kind", F.lit(1)).repartition(3)
    got = {r["doc_id"]: r for r in surrogates.replace_personal(df, b"k").collect()}
    assert (got[6]["text"], got[7]["text"], got[8]["text"]) == (None, "", "nothing 12.5 here")
    for i, t in table:
        if t and i != 8:
            for start, end, _, _ in surrogates.mentions(t):
                assert t[start:end] not in got[i]["text"]
    mail = [m[3] for i in (1, 2) for m in surrogates.mentions(got[i]["text"]) if m[2] == "email"]
    phone = [m[3] for i in (1, 2) for m in surrogates.mentions(got[i]["text"]) if m[2] == "phone"]
    assert len(set(mail)) == 1 and len(set(phone)) == 1 and got[1]["text"].count("(") == 1
    card = [m[3] for m in surrogates.mentions(got[3]["text"]) if m[2] == "card"][0]
    iban = [m[3] for m in surrogates.mentions(got[3]["text"]) if m[2] == "iban"][0]
    assert surrogates._luhn(card[:-1]) == int(card[-1]) and surrogates._mod97(iban) == 1
    names = [m for m in surrogates.mentions(got[5]["text"]) if m[2].startswith("surname_latin")]
    assert len({m[3] for m in names}) == 1 and len(names) == 3
    given = [m for m in surrogates.mentions(got[5]["text"]) if m[2].startswith("given")]
    assert given and all(m[2].endswith("_f") for m in given)
    assert surrogates.replace_personal(df.limit(0), b"k").count() == 0


def test_surrogates_stay_distinct(spark):
    """Two-digit numbers, so that first surrogates meet each other and real entities."""
    df = spark.createDataFrame([("ssn", f"{i:02d}") for i in range(30)], "kind string, name string")
    got = surrogates.assign(df, b"k").collect()
    assert len({r["new"] for r in got}) == len(got) == 30
    assert not {r["new"] for r in got} & {r["name"] for r in got}
    assert any(r["attempt"] > 0 for r in got)


def test_pipeline_stages_bear_odd_rows(spark, docs, tmp_path, rows):
    import corpus_pipeline

    out, kept = docs, docs.columns
    bench = spark.createDataFrame([(1, rows[10][1])], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out, str(tmp_path)).write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert out.columns == kept
    assert out.count() > 20


@pytest.mark.parametrize("lang", [None, "und"])
def test_language_stage_keeps_letters_without_languages(spark, docs, rows, lang):
    import corpus_pipeline

    unlabelled = docs.withColumn("lang", F.lit(lang).cast("string"))
    got = corpus_pipeline.identify_language(spark, unlabelled, "")
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(i for i, t, *_ in rows if any(c.isalpha() for c in t or ""))


def test_near_duplicate_verdicts_move_texts_once(spark):
    """However many ids have a verdict, as without broadcasts; repeated and missing ids have theirs."""
    import corpus_pipeline

    a, b, c, d = (" ".join(f"{x}{i}" for i in range(20)) for x in "abcd")
    rows = [(1, a), (2, a), (2, a), (3, b), (3, b), (4, c), (4, d), (5, None), (5, None), (5, ""), (6, ""), (None, a), (None, a), (None, None)]
    table = spark.createDataFrame([(i, t, "en", "s") for i, t in rows], "doc_id long, text string, lang string, source string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = corpus_pipeline.drop_near_duplicates(spark, table, "")
        got = [(r["doc_id"], r["text"]) for r in out.collect()]
        moves = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert out.columns == table.columns
    assert sorted(map(repr, got)) == sorted(map(repr, [
        (1, a), (3, b), (4, c), (4, d), (5, None), (5, ""), (6, ""), (None, a), (None, a), (None, None)]))
    assert moves.count("Exchange hashpartitioning(doc_id#") == 1


def test_pipeline_equals_plain_python(spark, tmp_path):
    """Row by row. Both sources have equally many words at the mix, which then takes 'a' twice and 'b' once."""
    from itertools import combinations

    import corpus_pipeline
    from tokenizers import Tokenizer

    rng = random.Random(8)
    table = {i: (t, "ab"[i % 2]) for i, t, *_ in corpus(9, 40) if not t or len(t) < 10_000}
    base = sentence(rng, 120, 10_000).split(" ")
    for n, changes in enumerate([(), (20, 50, 80), (30, 90), (10, 40, 70, 100)]):  # similarities with the first: .77, .84, .71
        table[100 + n] = (" ".join(f"new{n}" if i in changes else w for i, w in enumerate(base)), "ab"[n % 2])
    bench = {1: table[10][0]}

    left = {i: t for i, (t, _) in table.items() if any(c.isalpha() for c in t or "")}
    sets = {i: brute.shingles(t, 5) for i, t in left.items()}
    links = [(a, b) for a, b in combinations(sets, 2) if 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])]
    left = {i: left[i] for i, c in brute.component_of(left, links).items() if c == i}
    left = {i: left[i] for i, r in brute.decontaminate(left, bench).items() if not r[3]}
    assert {100, 101, 103} <= set(left) and not {10, 102} & set(left)
    size = {s: sum(len(brute.SPLIT.findall(t)) for i, t in left.items() if table[i][1] == s) for s in "ab"}
    few = min(size, key=size.get)
    left[200] = " ".join(f"fill{i}" for i in range(max(size.values()) - size[few]))
    table[200] = (left[200], few)

    tk, at, want = Tokenizer.from_file(plans.tokenizer_path()), 0, []
    for i in sorted(left):
        ids = [*tk.encode(left[i], add_special_tokens=False).ids, 0]
        for _ in range({"a": 2, "b": 1}[table[i][1]]):
            want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            at += len(ids)
    spark.createDataFrame([(i, t, "en", s) for i, (t, s) in table.items()], "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(bench.items()), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
