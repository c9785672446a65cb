"""Scenarios: what a tree decides on the last day of made-up series, all of them in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import logic as L
from tidebar.operators.compare import outcome, verdict
from tidebar.plans import dsl
from tidebar.plans.compile import Compiler, apart, by_kind, calendar, decisions, with_kinds

#: Days of a series, the first weekday of its calendar, volume, and how a symbol without a series moves.
DAYS, FIRST_DAY, VOLUME = 60, "2000-01-03", 1_000_000.0
START, GROWTH, SWING = 100.0, 1.001, 0.002
EXPECTED = ("block", "buy", "wait", "sell")


def series_bars(scenarios: DataFrame, series: DataFrame, symbols: list[str]) -> DataFrame:
    """scenarios (scenario, days), series (scenario, sym, open, high, low, close, volume: arrays) -> bars with `scenario`.

    A series ends on the last day; days before its first value have that value. A field without values is the close, volume
    a constant. Each of the symbols without a series rises slowly. Days are weekdays.
    """
    all_ = scenarios.select("scenario", F.coalesce("days", F.lit(DAYS)).alias("days"))
    pairs = all_.withColumn("sym", F.explode(F.array(*map(F.lit, symbols)))).unionByName(all_.join(series.select("scenario", "sym"), "scenario")).distinct()
    own = pairs.join(series, ["scenario", "sym"], "left").withColumn("n", F.explode(F.sequence(F.lit(0), F.col("days") - 1)))
    at = lambda c: F.get(c, F.greatest(F.lit(0), F.size(c) - F.col("days") + F.col("n")))
    given = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    any_given = F.greatest(*[given(F.col(f)) for f in dsl.FIELDS])
    rising = START * F.pow(F.lit(GROWTH), F.col("n"))
    close = F.when(given(F.col("close")), at(F.col("close"))).when(any_given, START).otherwise(rising)
    swing = {"high": 1 + SWING, "low": 1 - SWING, "open": 1.0}
    fields = {f: F.when(given(F.col(f)), at(F.col(f))).when(any_given, close).otherwise(rising * by) for f, by in swing.items()}
    fields |= {"close": close, "volume": F.when(given(F.col("volume")), at(F.col("volume"))).otherwise(VOLUME)}
    day = F.date_add(F.lit(FIRST_DAY).cast("date"), (F.floor(F.col("n") / 5) * 7 + F.col("n") % 5).cast("int"))
    return own.select("scenario", "sym", F.date_format(day, "yyyyMMdd").alias("date"), *[fields[f].cast("double").alias(f) for f in dsl.FIELDS])


def sell_outcomes(bars: DataFrame, tree: dsl.Tree, by: str) -> DataFrame:
    """(by, product, sells): whether a holding bought at the first close is sold on the last day, distinct over manual leaves
    unknown, true and false: `sell`, or `hold` where no rule fires; nothing where that stays open."""
    rules = [tree.sells(ps[0]) for ps in tree.kinds]
    frame, base = calendar(bars, tree.products, [r["when"] for own in rules for r in own], by=by)
    frame = apart(with_kinds(frame, tree), by)
    whole = L.by_day().rowsBetween(L.Window.unboundedPreceding, L.Window.unboundedFollowing)
    rows = frame.withColumn("pos_ret", (F.col("self_close") / F.first("self_close").over(L.by_day()) - 1) * 100)
    rows = rows.select("*", F.col("i").cast("double").alias("pos_days"), F.max("pos_ret").over(L.up_to()).alias("pos_maxret"), F.min("pos_ret").over(L.up_to()).alias("pos_minret"), F.max("i").over(whole).alias("last"))
    unknown = {"pos_filled", "pos_sold", *(f"pos_filled_{n['rule']}" for own in rules for r in own for n in dsl.walk(r["when"]) if "pos" in n and "rule" in n)}
    rows = rows.select("*", *[F.lit(None).cast("double").alias(c) for c in sorted(unknown)])
    found: list[Column] = []
    for name, manual in (("asked", None), ("yes", True), ("no", False)):
        compiler = Compiler(base, list(tree.products), manual, named="own", prefix=f"s_{name}")
        nodes = [[compiler.node(r["when"], manual).name for r in own] for own in rules]
        rows = compiler.plan.build(rows)
        rows = rows.select("*", *[L.any3([F.col(n) for n in own]).alias(f"hit_{name}_{k}") for k, own in enumerate(nodes)])
        found.append(by_kind([f"hit_{name}_{k}" for k in range(len(rules))], "boolean"))
    word = lambda c: F.when(c, "sell").when(~c, "hold")
    return rows.where("i = last").select(by, F.col("own").alias("product"), F.array_distinct(F.array_compact(F.array(*map(word, found)))).alias("sells"))


def results(scenarios: DataFrame, series: DataFrame, tree: dsl.Tree) -> DataFrame:
    """scenarios (scenario, product, days, expect, pct) -> with `result`: match, match if confirmed, mismatch, not reproducible
    or malformed, for products or outcomes that don't exist.

    Each scenario is a world of its own: its series, and its product's decision on the last day in both views of manual
    leaves, or for an expected sale whether a holding since the first day is sold.
    """
    symbols = sorted({x for p in tree.products for x in tree.symbols(p)})
    sound = F.col("product").isin(list(tree.products)) & F.col("expect").isin(*EXPECTED)
    bars = series_bars(scenarios.where(sound).select("scenario", "days").distinct(), series, symbols)
    last = outcome(decisions(bars, tree, by="scenario")).groupBy("scenario", "product").agg(F.max_by(F.struct("opt", "pes", "weight", "weight_yes", "weight_no"), "i").alias("v")).select("scenario", "product", "v.*")
    met = scenarios.join(last, ["scenario", "product"], "left").join(sell_outcomes(bars, tree, "scenario"), ["scenario", "product"], "left")
    seen = F.when(F.col("expect") == "sell", F.coalesce("sells", F.array().cast("array<string>"))).otherwise(F.array_distinct(F.array_compact(F.array("opt", "pes"))))
    return met.select("scenario", "product", "days", "expect", "pct", F.when(~F.coalesce(sound, F.lit(False)), "malformed").otherwise(verdict(seen)).alias("result"))
