"""What a tree says of each of its products now, or at the end of a day."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebar.functions import logic as L
from tidebar.operators.holdings import status
from tidebar.plans import dsl
from tidebar.plans.compile import LADDER, VIEWS, Ladder, decisions, weight_alternatives
from tidebar.sources import bars as S

ASKED = "array<struct<gate:string,label:string>>"
HELD = ("n", "entry_date", "ret", "days", "sells", "next_tranche")


def asked(tree: dsl.Tree, product: str) -> list[tuple[str, str]]:
    """(gate, label) of the manual leaves of a product's rules, but for those to sell by; each once, in written order."""
    leaves = [(do, n) for do, _, e in tree.expressions(product) if do != dsl.SELL for n in dsl.walk(e) if dsl.is_manual(n)]
    return list(dict.fromkeys((do, n.get("label") or n.get("manual") or dsl.manual_key(n)) for do, n in leaves))


def decide(bars: DataFrame, tree: dsl.Tree, day: str | None = None, holdings: DataFrame | None = None, answers: dict | None = None, closes: DataFrame | None = None, asof=None, atoms: DataFrame | None = None, ladder: Ladder = LADDER) -> DataFrame:
    """A row for each of the tree's products on its last bar, or its last one up to a day: (product, has_data, date, close,
    change, key, rung, the opt and pes views of block and buy, weight, alternatives, confirmed, warmup, incomplete, asked,
    holdings).

    A product without a bar has has_data = false and the key `unknown`; of the others but asked, nothing. close is the spot
    price where atoms give one, change how far in percent it is from the close of the bar before. incomplete: whether
    fewer bars are confirmed than the rules need. holdings: those of `status`, by n; null without one.
    """
    bars = bars if day is None else S.until(bars, day)
    return summed_up(decisions(bars, tree, answers, closes, asof, atoms, ladder=ladder), bars, tree, day, holdings, answers, asof, atoms)


def summed_up(decided: DataFrame, bars: DataFrame, tree: dsl.Tree, day: str | None = None, holdings: DataFrame | None = None, answers: dict | None = None, asof=None, atoms: DataFrame | None = None) -> DataFrame:
    """The rows of `decide` from the decisions of all days of these bars."""
    decided = weight_alternatives(decided)
    before = F.lag("close").over(L.by_day())
    of = ("date", "close", "before", "key", "rung", *VIEWS, "weight", "alternatives", "confirmed", "warmup")
    last = decided.withColumn("before", before).groupBy("product").agg(F.max_by(F.struct(*of), "i").alias("v")).select("product", "v.*")
    spot = None
    if atoms is not None:
        spot = S.spot(atoms, asof)
        spot = spot if day is None else S.until(spot, day)
        last = last.join(spot.select(F.col("sym").alias("product"), "spot"), "product", "left").withColumn("close", F.coalesce("spot", "close"))
    labels = {ps[0]: asked(tree, ps[0]) for ps in tree.kinds}
    rows = [(p, labels[ps[0]]) for ps in tree.kinds for p in ps]
    every = bars.sparkSession.createDataFrame(rows, f"product string, asked {ASKED}")
    out = every.join(last.withColumn("has_data", F.lit(True)), "product", "left")
    if holdings is None:
        out = out.withColumn("holdings", F.lit(None))
    else:
        mine = status(bars, tree, holdings, answers, spot).groupBy("product").agg(F.sort_array(F.collect_list(F.struct(*HELD))).alias("holdings"))
        out = out.join(mine, "product", "left")
    change = (F.try_divide(F.col("close"), F.nullif(F.col("before"), F.lit(0.0))) - 1) * 100
    return out.select(
        "product", F.coalesce("has_data", F.lit(False)).alias("has_data"), "date", "close", change.alias("change"), F.coalesce("key", F.lit("unknown")).alias("key"), "rung", *VIEWS, "weight", "alternatives", "confirmed", "warmup",
        (F.col("confirmed") < F.col("warmup")).alias("incomplete"), "asked", "holdings",
    )
