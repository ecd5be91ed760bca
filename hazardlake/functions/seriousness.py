"""Seriousness score of a record with several text sources (title, comments, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.functions import text as X
from hazardlake.functions.let import let


def source_hits(text: Column, humour: list[str] = L.HUMOUR, serious: list[str] = L.SERIOUS,
                coastal: list[str] = L.COASTAL) -> Column:
    """Hit counts of one text; a missing text counts nothing. The text is split once."""
    def count(low: Column, tokens: Column) -> Column:
        return F.struct(X.lexicon_count(low, tokens, humour).alias("h"),
                        X.lexicon_count(low, tokens, serious).alias("s"),
                        X.lexicon_count(low, tokens, coastal).alias("c"))

    text = F.lower(F.coalesce(text, F.lit("")))
    return let(text, lambda low: let(X.tokens_of(low), lambda tokens: count(low, tokens)))


def total_hits(hits: list[Column]) -> Column:
    """Sum of the hit counts of several sources."""
    return let(F.array(*hits), lambda all_: F.struct(*[
        reduce(lambda a, b: a + b, [F.get(all_, F.lit(i))[part] for i in range(len(hits))]).alias(part)
        for part in ("h", "s", "c")]))


def verdict(h: Column, s_hits: Column, c_hits: Column) -> Column:
    """Verdict from total hits; every coastal hit weighs 2 in both its scores.

    The struct's serious and coastal fields are the weighted scores.
    """
    c = c_hits * 2
    s = s_hits + c_hits * 2
    w = s + c * F.lit(1.5)
    conf = F.when(h + s + c == 0, F.lit(0.5)).otherwise(F.try_divide(w, h + w))
    serious = F.when(h + s + c == 0, F.lit(True)).otherwise((conf > 0.6) | ((c > 0) & (h < s)))
    veto = h > s + c + 2
    return F.struct((serious & ~veto).alias("is_serious"),
                    F.when(veto, F.lit(1.0) - conf).otherwise(conf).alias("confidence"),
                    h.alias("humour"), s.alias("serious"), c.alias("coastal"))


def score_texts(df: DataFrame, texts: list[str], **lexicons) -> DataFrame:
    """Add ``verdict`` and ``reasons`` for the given text columns.

    Reasons list the first three hits of each kind per source, in source order.
    """
    lists = {"humour": L.HUMOUR, "serious": L.SERIOUS, "coastal": L.COASTAL} | lexicons
    total = total_hits([source_hits(F.col(name), **lists) for name in texts])
    df = df.withColumn("verdict", let(total, lambda t: verdict(t["h"], t["s"], t["c"])))
    v = F.col("verdict")
    notes = []
    for name in texts:
        low = F.lower(F.coalesce(F.col(name), F.lit("")))
        for label, words in (("Humor indicators", lists["humour"]),
                             ("Serious indicators", lists["serious"]),
                             ("Coastal hazard indicators", lists["coastal"])):
            found = F.slice(X.lexicon_hits(low, X.tokens_of(low), words), 1, 3)
            notes.append(F.when(F.size(found) > 0, F.concat(
                F.lit(f"{label} in {name}: "), F.concat_ws(", ", found))))
    quiet = (v["humour"] + v["serious"] + v["coastal"]) == 0
    notes.append(F.when(quiet, F.lit("No clear humor or serious indicators found - defaulting to serious")))
    notes.append(F.when(v["humour"] > v["serious"] + v["coastal"] + 2,
                        F.lit("High humor content detected - marked as non-serious")))
    return df.withColumn("reasons", F.filter(F.array(*notes), lambda r: r.isNotNull()))


def score_threads(records: DataFrame, comments: DataFrame, key: str, texts: list[str],
                  comment_text: str, comment_order: list[str], first: int = 10,
                  **lexicons) -> DataFrame:
    """Score records with the first ``first`` comments of each as further sources.

    Only the first comments count by definition; they are chosen before the shuffle, and
    their hits are summed to one row per record.
    """
    from hazardlake.skew import top_per_key

    early = top_per_key(comments.select(key, comment_text, *comment_order), [key],
                        [F.col(c) for c in comment_order], first)
    hits = early.select(key, source_hits(F.col(comment_text), **lexicons).alias("x"))
    sums = hits.groupBy(key).agg(F.sum("x.h").alias("ch"), F.sum("x.s").alias("cs"),
                                 F.sum("x.c").alias("cc"))
    joined = records.join(sums, key, "left").fillna(0, ["ch", "cs", "cc"])
    own = [source_hits(F.col(name), **lexicons) for name in texts]
    extra = F.struct(F.col("ch").alias("h"), F.col("cs").alias("s"), F.col("cc").alias("c"))
    total = total_hits([*[let(h, lambda x: F.struct(*[x[p].cast("bigint").alias(p) for p in ("h", "s", "c")]))
                          for h in own], extra])
    return (joined.withColumn("verdict", let(total, lambda t: verdict(t["h"], t["s"], t["c"])))
            .drop("ch", "cs", "cc"))
