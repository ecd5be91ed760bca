"""Registered queries over scored pixels: counts, scores, averages, losses, models."""

from pyspark.sql import functions as F

from hazardlake.functions import spectral as P
from hazardlake.operators import evaluate as E
from hazardlake.operators import rasters as R
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import r
from hazardlake.registry import query

def pred():
    return F.col("pred")


def truth():
    return F.col("truth")


CM = """select event, tile, count(*) filter (pred and truth) as tp, count(*) filter (pred and not truth) as fp,
 count(*) filter (not pred and truth) as fn, count(*) filter (not pred and not truth) as tn from eval group by all"""


def _cm(spark, sf):
    return E.confusion(A.evaluation(spark, sf), pred(), truth(), ["event", "tile"])


def _rounded(df, names=("accuracy", "precision", "recall", "f1", "iou", "dice")):
    return df.withColumns({n: r(n) for n in names if n in df.columns})


@query("confusion", "A-12", CM, ("eval",))
def _(spark, sf):
    return _cm(spark, sf)


@query("confusion_by_order", "A-12", CM.replace("event, tile,", "l_orderkey,"), ("eval",))
def _(spark, sf):
    """Small images, where empty truths and empty predictions occur."""
    return E.confusion(A.evaluation(spark, sf), pred(), truth(), ["l_orderkey"])


def _score_sql(mode, src):
    div = {"zero": "case when ({b}) = 0 then 0 else ({a}) / ({b})::double end", "one": "({a}) / greatest({b}, 1)::double",
           "running": "({a}) / greatest({b}, 1)::double", "eps": "({a}) / (({b}) + 1e-8::double)"}[mode]
    d = lambda a, b: div.format(a=a, b=b)
    f1 = {"eps": "2 * precision * recall / (precision + recall + 1e-8::double)",
          "running": "2 * precision * recall / greatest(precision + recall, 1e-8::double)"}.get(mode, "dice")
    return f""", sc as (select *, {d('tp + tn', 'tp + fp + fn + tn')} as accuracy, {d('tp', 'tp + fp')} as precision, {d('tp', 'tp + fn')} as recall,
      {d('tp', 'tp + fp + fn')} as iou, {d('2 * tp', '2 * tp + fp + fn')} as dice from {src}), sf as (select *, {f1} as f1 from sc)"""


OUT = ", ".join(f"round({n}, 6)::double as {n}" for n in ("accuracy", "precision", "recall", "f1", "iou", "dice"))

for _mode in ("zero", "one", "eps", "running"):
    @query(f"scores_{_mode}", "A-13", f", cm as ({CM.replace('event, tile,', 'l_orderkey,')})" + _score_sql(_mode, "cm") + f" select l_orderkey, tp, fp, fn, tn, {OUT} from sf", ("eval",))
    def _(spark, sf, mode=_mode):
        cm = E.confusion(A.evaluation(spark, sf), pred(), truth(), ["l_orderkey"])
        return _rounded(E.scores(cm, mode))


@query("macro_avg", "A-14",
       f", cm as ({CM})" + _score_sql("zero", "cm") + """ select event, count(*) as n_tiles, round(avg(accuracy), 6) as accuracy, round(avg(precision), 6) as precision,
       round(avg(recall), 6) as recall, round(avg(f1), 6) as f1, round(avg(iou), 6) as iou from sf group by rollup (event)""", ("eval",))
def _(spark, sf):
    return _rounded(E.macro_avg(E.scores(_cm(spark, sf), "zero")))


@query("micro_avg", "A-15",
       f", cm as ({CM}), t as (select event, sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, sum(tn)::bigint as tn from cm group by 1)"
       + _score_sql("one", "t") + f" select event, tp, fp, fn, tn, {OUT} from sf", ("eval",))
def _(spark, sf):
    return _rounded(E.micro_avg(_cm(spark, sf), ["event"]))


@query("accuracy_class", "X-28",
       "select l_orderkey, l_linenumber, case when pred and truth then 'TP' when pred then 'FP' when truth then 'FN' else 'TN' end as cls from eval", ("eval",))
def _(spark, sf):
    return A.evaluation(spark, sf).select("l_orderkey", "l_linenumber", P.accuracy_class(pred(), truth()).alias("cls"))


@query("change_class", "X-29",
       "select l_orderkey, l_linenumber, case when pred and truth then 'existing' when truth then 'new' when pred then 'receded' else 'none' end as cls from eval", ("eval",))
def _(spark, sf):
    return A.evaluation(spark, sf).select("l_orderkey", "l_linenumber", P.change_class(pred(), truth()).alias("cls"))


@query("attach_truth", "J-3",
       """, cm as (select l_orderkey, count(*) as n, count(*) filter (pred) as n_pred from eval group by 1)
       select l_orderkey, n, n_pred, case when o_orderstatus <> 'P' then o_orderstatus end as truth from cm left join (select * from orders where o_orderstatus <> 'P') on o_orderkey = l_orderkey""", ("eval",))
def _(spark, sf):
    img = A.evaluation(spark, sf).groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(pred()).alias("n_pred"))
    gt = A.table(spark, sf, "orders").filter("o_orderstatus <> 'P'").selectExpr("o_orderkey as l_orderkey", "o_orderstatus as truth")
    return R.attach(img, gt, ["l_orderkey"])


@query("attach_metrics", "J-4",
       f""", cm as ({CM}) select e.event, t.tile, coalesce(tp, 0) as tp, coalesce(fp, 0) as fp from (select distinct s_suppkey * 2 as tile from supplier) t
       cross join (select distinct event from eval) e left join cm on cm.event = e.event and cm.tile = t.tile""", ("eval",))
def _(spark, sf):
    """Every tile with each event; events are the few flags of line items."""
    events = A.evaluation(spark, sf).agg(F.array_sort(F.collect_set("event"))).scalar()
    t = A.table(spark, sf, "supplier").selectExpr("s_suppkey * 2 as tile").distinct().withColumn("event", F.explode(events))
    m = _cm(spark, sf).select("event", "tile", "tp", "fp")
    return R.attach(t, m, ["event", "tile"], {"tp": 0, "fp": 0}).select("event", "tile", "tp", "fp")


@query("override_scores", "J-20",
       f", cm as ({CM})" + _score_sql("one", "cm") + """ select event, tile, round(case when tile % 3 = 0 then (tile % 10) / 10.0 else f1 end, 6)::double as f1, round(iou, 6) as iou from sf""", ("eval",))
def _(spark, sf):
    calc = E.scores(_cm(spark, sf), "one").select("event", "tile", "f1", "iou")
    rep = calc.selectExpr("event", "tile", "case when tile % 3 = 0 then cast((tile % 10) / 10.0D as string) else 'n/a' end as f1")
    return _rounded(E.override_scores(calc, rep, ["event", "tile"]))


MODELS = """, g as (select event, tile, pos, v > 0 as t from px where phase = 'during'), a as (select event, tile, pos, px.v > 0.05 as p from px join tiles using (event, tile, phase) where phase = 'during' and label <> 3),
  b as (select event, tile, pos, px.v > 0 as q from px join tiles using (event, tile, phase) where phase = 'before' and label <> 5),
  j as (select event, tile, t, coalesce(p, false) as p, coalesce(q, false) as q from g left join a using (event, tile, pos) left join b using (event, tile, pos)),
  f as (select event, tile, coalesce(2.0::double * count(*) filter (p and t) / nullif(count(*) filter (p) + count(*) filter (t), 0), 0) as f1_a,
    coalesce(2.0::double * count(*) filter (q and t) / nullif(count(*) filter (q) + count(*) filter (t), 0), 0) as f1_b from j group by all)"""


def _models(spark, sf):
    t = A.tiles(spark, sf)
    mask = lambda c: F.expr(f"transform(v, x -> cast(x > {c} as int))")
    g = t.filter("phase = 'during'").select("event", "tile", mask("0").alias("t"))
    a = t.filter("phase = 'during' and label <> 3").select("event", "tile", mask("0.05D").alias("a"))
    b = t.filter("phase = 'before' and label <> 5").select("event", "tile", mask("0").alias("b"))
    return E.compare_models(R.attach(R.attach(g, a), b), "t", "a", "b", ["event", "tile"])


@query("compare_models", "J-14", MODELS + " select event, tile, round(f1_a, 6) as f1_a, round(f1_b, 6) as f1_b from f", ("tiles", "px"))
def _(spark, sf):
    return _models(spark, sf).withColumns({"f1_a": r("f1_a"), "f1_b": r("f1_b")})


@query("model_wins", "A-25", MODELS + " select count(*) filter (f1_a > f1_b) as a_better, count(*) filter (f1_b > f1_a) as b_better, round(avg(f1_a), 6) as avg_a, round(avg(f1_b), 6) as avg_b from f", ("tiles", "px"))
def _(spark, sf):
    return E.model_wins(_models(spark, sf)).withColumns({"avg_a": r("avg_a"), "avg_b": r("avg_b")})


@query("soft_dice", "A-28",
       """, i as (select event, tile, sum(score * truth::int) as i, sum(score) + sum(truth::int) as u from eval group by all)
       select round(1 - avg((2 * i + 1) / (u + 1)), 8) as dice_loss from i""", ("eval",))
def _(spark, sf):
    return E.soft_dice(A.evaluation(spark, sf), "score", truth(), ["event", "tile"]).withColumn("dice_loss", r("dice_loss", 8))


CL = "(select truth::int as t, greatest(1e-7::double, least(1 - 1e-7::double, score)) as p from eval)"


@query("bce_loss", "A-28", f"select round(avg(-t * ln(p) - (1 - t) * ln(1 - p)), 8) as bce from {CL}", ("eval",))
def _(spark, sf):
    return E.bce(A.evaluation(spark, sf), "score", truth()).withColumn("bce", r("bce", 8))


@query("bce_logits_loss", "A-28",
       "select round(avg(-(truth::int) * ln(1 / (1 + exp(-x))) - (1 - truth::int) * ln(1 - 1 / (1 + exp(-x)))), 8) as bce from (select truth, score * 6 - 3 as x from eval)", ("eval",))
def _(spark, sf):
    e = A.evaluation(spark, sf).withColumn("x", F.col("score") * 6 - 3)
    return E.bce_logits(e, "x", truth()).withColumn("bce", r("bce", 8))


@query("focal_loss", "A-28",
       f"select round(avg(0.25 * (1 - (t * p + (1 - t) * (1 - p))) ** 2 * (-t * ln(p) - (1 - t) * ln(1 - p))), 8) as focal from {CL}", ("eval",))
def _(spark, sf):
    return E.focal(A.evaluation(spark, sf), "score", truth()).withColumn("focal", r("focal", 8))
