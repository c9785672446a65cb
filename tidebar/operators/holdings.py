"""Holdings against a tree's sell rules and next tranche."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions import logic as L
from tidebar.plans import dsl
from tidebar.plans.compile import Compiler, apart, calendar, with_kinds


def entries(frame: DataFrame, holdings: DataFrame) -> DataFrame:
    """holdings with entry_i: the product's first bar on or after the entry date; null without one."""
    first = frame.select("product", "i", "date").join(holdings.select("product", "entry_date").distinct(), "product").where("date >= entry_date").groupBy("product", "entry_date").agg(F.min("i").alias("entry_i"))
    return holdings.join(first, ["product", "entry_date"], "left")


def status(bars: DataFrame, tree: dsl.Tree, holdings: DataFrame, answers: dict | None = None, spot: DataFrame | None = None) -> DataFrame:
    """holdings (product[, n], entry_date, cost, filled) -> a row each, at the product's last bar, with entry_i, ret, days,
    sells array<struct<rule, hit>> in written order and next_tranche struct<label, hit>, null where all or none is filled.

    n tells a product's holdings apart, 0 without such a column. spot (sym, date, spot): a price that counts for the returns
    of its day. Manual leaves are unknown. A holding without a bar since its entry has nulls.
    """
    rules = [(tree.sells(ps[0]), tree.tranches(ps[0])) for ps in tree.kinds]
    exprs = [r["when"] for sells, tranches in rules for r in [*sells, *tranches] if r["when"] is not None]
    frame, base = calendar(bars, tree.products, exprs)
    holdings = holdings if "n" in holdings.columns else holdings.withColumn("n", F.lit(0))
    held = entries(frame, holdings).select("product", "n", "entry_date", "entry_i", "cost", "filled")
    price = F.col("self_close")
    if spot is not None:
        frame, price = frame.join(spot.select(F.col("sym").alias("product"), "date", "spot"), ["product", "date"], "left"), F.coalesce("spot", "self_close")
    rows = apart(with_kinds(frame, tree).join(held, "product"), "n")  # windows part holdings
    rows = rows.withColumn("pos_ret", F.when(F.col("i") >= F.col("entry_i"), (price / F.col("cost") - 1) * 100))
    rows = rows.select(
        "*", F.when(F.col("i") >= F.col("entry_i"), (F.col("i") - F.col("entry_i")).cast("double")).alias("pos_days"), F.max("pos_ret").over(L.up_to()).alias("pos_maxret"), F.min("pos_ret").over(L.up_to()).alias("pos_minret"),
        F.lit(None).cast("double").alias("pos_filled"), F.lit(None).cast("double").alias("pos_sold"), *[F.lit(None).cast("double").alias(f"pos_filled_{x}") for x in sorted({n["rule"] for e in exprs for n in dsl.walk(e) if "pos" in n and "rule" in n})],
    )
    compiler = Compiler(base, list(tree.products), None, answers, named="own")
    nodes = [([(r["label"], compiler.node(r["when"])) for r in sells], [(t["label"], None if t["when"] is None else compiler.node(t["when"])) for t in tranches]) for sells, tranches in rules]
    rows = compiler.plan.build(rows)
    pair = lambda label, n: F.struct(F.lit(label).alias("label"), (F.lit(None).cast("boolean") if n is None else F.col(n.name)).alias("hit"))
    kind = "array<struct<label:string,hit:boolean>>"
    sells, tranches = F.when(F.lit(False), F.array().cast(kind)), F.when(F.lit(False), F.array().cast(kind))
    for k, (own, later) in enumerate(nodes):
        sells = sells.when(F.col("kind") == k, F.array(*[pair(*x) for x in own]).cast(kind))
        tranches = tranches.when(F.col("kind") == k, F.array(*[pair(*x) for x in later]).cast(kind))
    last = F.max("i").over(L.Window.partitionBy("product"))
    upcoming = F.when(F.col("filled") > 0, F.get(tranches, F.col("filled")))
    out = rows.select(F.col("own").alias("product"), "n", "entry_date", "entry_i", "i", last.alias("last"), F.col("pos_ret").alias("ret"), F.col("pos_days").alias("days"), sells.alias("sells"), upcoming.alias("next_tranche"))
    known = lambda c: F.when(F.col("entry_i").isNotNull(), F.col(c)).alias(c)
    return out.where("i = last").select("product", "n", "entry_date", "entry_i", "ret", "days", known("sells"), known("next_tranche"))
