"""Signals, forward returns, the trade walk and the money simulation."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.functions import logic as L
from tidebar.plans import dsl
from tidebar.plans.compile import decisions, reach
from tidebar.sources.bars import epoch

HORIZONS = (5, 10, 20)
#: Per market commission, tax on sells, slippage and initial cash; US where unknown.
MARKETS = {"US": (0.001, 0.0, 0.0, 100000.0), "KR": (0.00015, 0.0018, 0.0, 100000000.0)}
#: Per market how far a price can move in a day, and the size of its ticks; None where nothing binds.
LIMITS = {"US": (None, None), "KR": (0.3, None)}
DAY, YEAR_DAYS = 86400, 365
TINY = 1e-12


def signal_starts(graded: DataFrame, by: str = "key") -> DataFrame:
    """graded with `start`: whether the day begins a run of its grade."""
    return graded.withColumn("start", ~F.lag(by).over(L.by_day()).eqNullSafe(F.col(by)))


def forward_returns(graded: DataFrame, horizons=HORIZONS) -> DataFrame:
    """Adds fwd_h: percent from the next open to the close h bars on; null past the end or for an open of 0."""
    entry = F.nullif(F.lead("open", 1).over(L.by_day()), F.lit(0.0))
    return graded.select("*", *[((F.try_divide(F.lead("close", h).over(L.by_day()), entry) - 1) * 100).alias(f"fwd_{h}") for h in horizons])


def forward_stats(graded: DataFrame, horizons=HORIZONS) -> DataFrame:
    """(product, grade, horizon, days, signals, n, avg, median, win) over the starts of runs."""
    rows = forward_returns(signal_starts(graded), horizons)
    long = rows.select("product", F.col("key").alias("grade"), "start", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select("product", "grade", "start", "x.*")
    hit = F.when(F.col("start"), F.col("r"))
    return long.groupBy("product", "grade", "horizon").agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("start").cast("long")).alias("signals"), F.count(hit).alias("n"), F.avg(hit).alias("avg"), F.median(hit).alias("median"), (F.avg((hit > 0).cast("double")) * 100).alias("win"))


class AtLeast(float):
    """A number of which only this lower bound is known."""


def _exact(x):
    return None if isinstance(x, AtLeast) else x


def _combined(op: str, node: dict, xs: list):
    """An operator of one day's values, under three-valued logic."""
    if op in ("all", "any", "atleast"):
        yes, unknown = sum(x is True for x in xs), sum(x is None for x in xs)
        n = {"all": len(xs), "any": 1, "atleast": node.get("atleast")}[op]
        return True if yes >= n else None if yes + unknown >= n else False
    if op == "not":
        return None if xs[0] is None else not xs[0]
    if op == "case":
        for c, v in zip(xs[:-1:2], xs[1:-1:2], strict=True):
            if c is None or c:
                return None if c is None else v
        return xs[-1]
    if any(x is None for x in xs):
        return None
    a, b = xs if len(xs) == 2 else (xs[0], None)
    bounds = isinstance(a, AtLeast), isinstance(b, AtLeast)
    if op in dsl.CMP:
        hit = {"gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]
        # more on the left makes gt and ge truer, more on the right lt and le
        return hit if not any(bounds) else None if all(bounds) else True if hit and (op in ("gt", "ge")) == bounds[0] else False if not hit and (op in ("lt", "le")) == bounds[0] else None
    if op == "add" and bounds != (True, True) or op == "sub" and bounds == (True, False):
        return (AtLeast if any(bounds) else float)(a + b if op == "add" else a - b)
    if any(bounds):
        return None
    return {"abs": lambda: abs(a), "add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: a / b if b else None, "max": lambda: max(a, b), "min": lambda: min(a, b)}[op]()


def stepper(node: object, leaf) -> Callable[[int], object]:
    """A function that gives the expression's value on a day, from leaf(node, day). It is called once for each day, in order.

    A window keeps its last values, the highest and lowest of them a falling or rising queue; a since-operator the day of
    its last true or unknown condition and what it has gathered since.
    """
    if dsl.is_number(node):
        return lambda d: float(node)
    if node == dsl.UNKNOWN:
        return lambda d: None
    if "col" in node or "pos" in node or dsl.is_manual(node):
        return lambda d: leaf(node, d)
    op, below = dsl.op_of(node), [stepper(x, leaf) for x in dsl.children(node)]
    if op in ("lag", *dsl.WINDOW):
        if node[op][1] == dsl.UNKNOWN:
            return lambda d: None
        return (_lagged if op == "lag" else _summed if op == "sum" else _extreme)(op, node[op][1], below[0])
    if op in ("barssince", *dsl.SINCE):
        return _since(op, below)
    return lambda d: _combined(op, node, [f(d) for f in below])


def _lagged(op: str, n: int, value):
    held: deque = deque(maxlen=n + 1)

    def step(d: int):
        held.append(value(d))
        return held[0] if len(held) == n + 1 else None

    return step


def _summed(op: str, n: int, value):
    held: deque = deque(maxlen=n)

    def step(d: int):
        held.append(_exact(value(d)))
        return math.fsum(held) if len(held) == n and None not in held else None

    return step


def _extreme(op: str, n: int, value):
    best: deque = deque()  # (day, value), values from the best on
    beaten = (lambda old, new: old <= new) if op == "highest" else (lambda old, new: old >= new)
    seen, unknown = 0, None

    def step(d: int):
        nonlocal seen, unknown
        x = _exact(value(d))
        seen += 1
        if x is None:
            unknown = d
        else:
            while best and beaten(best[-1][1], x):
                best.pop()
            best.append((d, x))
        while best and best[0][0] <= d - n:
            best.popleft()
        return best[0][1] if seen >= n and (unknown is None or unknown <= d - n) else None

    return step


def _since(op: str, below: list):
    last, broken, first, held = None, None, None, None  # days of the last true and unknown condition, and of the first step; what is kept

    def step(d: int):
        nonlocal last, broken, first, held
        hit, x = below[0](d), _exact(below[1](d)) if len(below) > 1 else None
        first = d if first is None else first
        if hit is None:
            broken = d
        if hit:
            last, held = d, x
        elif op in ("minsince", "maxsince") and held is not None:
            held = None if x is None or hit is None else (min if op == "minsince" else max)(held, x)
        known = last is not None and (broken is None or broken < last) and d - last < L.STREAK_CAP
        if op != "barssince":
            return held if known else None
        if known:
            return float(d - last)
        least = min(L.STREAK_CAP, d - (first - 1 if broken is None else broken))
        return AtLeast(least) if least > 0 else None

    return step


def split_residual(node: object, more: dict[str, object]) -> object:
    """The node with its largest parts that read no position put into `more` as named expressions."""
    if not isinstance(node, dict) or "pos" in node:
        return node
    if not dsl.uses_pos(node):
        return {"col": next((k for k, e in more.items() if e == node), None) or more.setdefault(f"walk_{len(more)}", node) and f"walk_{len(more) - 1}"}
    op = dsl.op_of(node)
    out = {k: v for k, v in node.items() if k not in dsl.META}
    match dsl.FORMS[op].shape:
        case "node":
            return {op: split_residual(out[op], more)}
        case "case":
            return {"case": [[split_residual(x, more) for x in pair] for pair in out["case"]], "else": split_residual(out["else"], more)}
        case "count":
            return {op: out[op], "of": [split_residual(x, more) for x in out["of"]]}
        case "span":
            return {op: [split_residual(out[op][0], more), out[op][1]]}
    return {op: [split_residual(x, more) for x in out[op]]}


TRADE = "product string, entry string, entry_px double, exit string, closed boolean, days int, ret double, fixed20 double, buys array<struct<date:string,i:int,px:double,qty:double,tranche:string,flags:array<string>>>, sells array<struct<date:string,i:int,px:double,qty:double,rule:string>>"


def walk_trades(days: pd.DataFrame, product: str, sells: list[dict], tranches: list[dict], weighted: bool) -> list[dict]:
    """Trades of one product: entries at the open after a signal's first day, sells and further tranches in written order.

    A purchase is its tranche's part of the weight of the day that decides it; an unknown weight counts as all, and is
    flagged with the purchase. weighted: whether the product has a weight at all.
    """
    o, c, date, start, weight = (days[k].tolist() for k in ("open", "close", "date", "start", "weight"))
    known = {k: days[k].tolist() for k in days.columns}
    n, found, free = len(days), [], 0
    first = tranches[0] if tranches and tranches[0]["x"] != dsl.UNKNOWN else None
    real = lambda x: x is not None and x == x
    before = max([reach(r["when"]) for r in [*sells, *tranches] if r["when"] is not None], default=0)

    def bought_on(d: int, tranche: dict | None) -> dict:
        flags = [] if real(weight[d]) else ["weight_unknown" if weighted else "weight_unset"]
        part = 1.0 if tranche is None else tranche["x"] if dsl.is_number(tranche["x"]) else 0.0
        return {"date": date[d + 1], "i": d + 1, "px": o[d + 1], "qty": (weight[d] / 100 if not flags else 1.0) * part, "tranche": tranche["label"] if tranche else "FULL", "flags": flags}

    for s in range(n):
        e = s + 1
        if not start[s] or e >= n or e < free or not real(o[e]) or not o[e]:
            continue
        buys, sold = [bought_on(s, first)], []
        if buys[0]["qty"] <= TINY:
            continue
        done, fired, was, best, worst, ret, end = 1, set(), {}, None, None, None, None

        def leaf(node, d):
            if "col" in node:
                x = known[node["col"]][d]
                x = None if x is None or x != x else bool(x) if isinstance(x, bool) else x
                return AtLeast(x) if x is not None and known.get(f"{node['col']}_lb", never)[d] is True else x
            if "pos" not in node:
                return False
            if d < e:
                return None
            held = [b for b in buys if b["i"] <= d]
            return {"ret": ret, "days": float(d - e), "maxret": best, "minret": worst, "filled": float(sum("rule" not in node or b["tranche"] == node["rule"] for b in held)), "sold": sum(x["qty"] for x in sold if x["i"] <= d) / sum(b["qty"] for b in held)}[node["pos"]]

        never = [None] * n
        rules = [stepper(r["when"], leaf) for r in sells]
        later = [None if t["when"] is None else stepper(t["when"], leaf) for t in tranches]
        for d in range(max(0, e - before), n):
            if d >= e:
                cost = sum(b["qty"] * b["px"] for b in buys if b["i"] <= d) / sum(b["qty"] for b in buys if b["i"] <= d)
                ret = (c[d] / cost - 1) * 100 if real(c[d]) else None
                if ret is not None:
                    best, worst = (ret, ret) if best is None else (max(best, ret), min(worst, ret))
            hits, open_ = [f(d) is True for f in rules], [f is not None and f(d) is True for f in later]
            if d < e:
                continue
            bought = sum(b["qty"] for b in buys)
            held_day, sold_today = bought - sum(x["qty"] for x in sold), False
            for k, (rule, hit) in enumerate(zip(sells, hits, strict=True)):
                rising, was[k] = hit and not was.get(k, False), hit
                if not hit or k in fired and not (rule["repeat"] and rising and d > e):
                    continue
                fired.add(k)
                left = bought - sum(x["qty"] for x in sold)
                if d + 1 >= n or not real(o[d + 1]) or not o[d + 1] or not dsl.is_number(rule["x"]):
                    continue
                q = min(left, rule["x"] * (bought if rule["of"] == "bought" else left))
                if q > TINY:
                    sold.append({"date": date[d + 1], "i": d + 1, "px": o[d + 1], "qty": q, "rule": rule["label"]})
                    sold_today = True
            if sold_today and bought - sum(x["qty"] for x in sold) <= 1e-9:
                end = d + 1
                break
            if not sold_today and held_day > TINY and done < len(tranches) and first and open_[done] and dsl.is_number(tranches[done]["x"]) and d + 1 < n and real(o[d + 1]) and o[d + 1]:
                buys.append(bought_on(d, tranches[done]))
                done += 1
        spent, left = sum(b["qty"] * b["px"] for b in buys), sum(b["qty"] for b in buys) - sum(x["qty"] for x in sold)
        last = end if end is not None else n - 1
        value = sum(x["qty"] * x["px"] for x in sold) + (left * next((x for x in reversed(c) if real(x)), 0.0) if end is None else 0.0)
        fixed = (c[e + 19] / o[e] - 1) * 100 if e + 19 < n and real(c[e + 19]) else None
        found.append({"product": product, "entry": date[e], "entry_px": o[e], "exit": date[end] if end is not None else None, "closed": end is not None, "days": last - e, "ret": (value / spent - 1) * 100, "fixed20": fixed, "buys": buys, "sells": sold})
        if end is None:
            break
        free = end + 1
    return found


def trades(bars: DataFrame, tree: dsl.Tree) -> DataFrame:
    """The walk's trades of every product. Conditions without a position are columns; only the rest runs in the walk, one
    product's days at a time. A later tranche without a condition or with an unknown ratio is never bought."""
    more: dict[str, object] = {}
    rules = [([{**r, "when": split_residual(r["when"], more)} for r in tree.sells(ps[0])], [{**t, "when": split_residual(t["when"], more)} for t in tree.tranches(ps[0])]) for ps in tree.kinds]
    kind_of, weighted = tree.kind_of, [tree.weight(ps[0]) is not None for ps in tree.kinds]
    rows = signal_starts(decisions(bars, tree, more=more)).withColumn("start", F.col("start") & (F.col("key") == "buy"))
    rows = rows.select("product", "i", "date", "open", "close", "weight", "start", *[c for c in rows.columns if c.removesuffix("_lb") in more])

    def run(days: pd.DataFrame) -> pd.DataFrame:
        product = days["product"].iloc[0]
        found = walk_trades(days.sort_values("i", ignore_index=True), product, *rules[kind_of[product]], weighted[kind_of[product]])
        return pd.DataFrame(found, columns=[x.split(" ")[0] for x in TRADE.split(", ")])

    return rows.groupBy("product").applyInPandas(run, TRADE)


def size_notes(tree: dsl.Tree) -> list[tuple[str, str, str]]:
    """(product, kind, label): ratios that the rules leave open. `tranche`: the first is, so all is bought at once; `sell`: that rule sells nothing."""
    out = []
    for p in tree.products:
        out += [(p, "tranche", t["label"]) for t in tree.tranches(p)[:1] if t["x"] == dsl.UNKNOWN]
        out += [(p, "sell", r["label"]) for r in tree.sells(p) if r["x"] == dsl.UNKNOWN]
    return out


def exit_policy(tree: dsl.Tree, product: str) -> str:
    """`book` where the product has rules to sell by, else `none`: then no trades are made up, and signals are judged by returns alone."""
    return "book" if tree.sells(product) else "none"


def trade_stats(found: DataFrame) -> DataFrame:
    """Per product: trades, closed and open ones; win, avg, median, days over the closed; the same of holding 20 days; how
    often each sell rule and each later tranche was filled, sorted by name; purchases, and those whose weight was unset or unknown."""
    done = F.when(F.col("closed"), F.col("ret"))
    flagged = lambda k: F.filter("buys", lambda x: F.array_contains(x["flags"], k))
    out = found.groupBy("product").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(F.col("closed").cast("long")).alias("closed"), F.sum((~F.col("closed")).cast("long")).alias("open"), F.avg(done).alias("avg"), F.median(done).alias("median"),
        (F.avg((done > 0).cast("double")) * 100).alias("win"), F.avg(F.when(F.col("closed"), F.col("days"))).alias("days"), F.avg("fixed20").alias("fixed20"), (F.avg((F.col("fixed20") > 0).cast("double")) * 100).alias("fixed20_win"),
        F.sum(F.size("buys")).alias("buys"), *[F.sum(F.size(flagged(k))).alias(k) for k in ("weight_unset", "weight_unknown")],
    )
    for name, hits in (("rule_hits", F.transform("sells", lambda x: x["rule"])), ("tranche_hits", F.transform(F.slice("buys", 2, 1 << 30), lambda x: x["tranche"]))):
        counts = found.select("product", F.explode(hits).alias("k")).groupBy("product", "k").agg(F.count(F.lit(1)).alias("n"))
        text = F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "k", F.col("n").cast("string")))), ",")
        out = out.join(counts.groupBy("product").agg(text.alias(name)), "product", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return out


def position_facts(found: DataFrame, bars: DataFrame) -> DataFrame:
    """Of each product's open trade: entry price, average price of what is held, return in percent at the last close,
    highest and lowest close since the entry, and days held."""
    total = lambda c, value: F.aggregate(c, F.lit(0.0), lambda a, x: a + value(x))
    units = total("buys", lambda x: x["qty"]) - total("sells", lambda x: x["qty"])
    spent = total("buys", lambda x: x["qty"] * x["px"]) - total("sells", lambda x: x["qty"] * x["px"])
    rows = found.where("not closed").select("product", "entry", "entry_px", "days", F.when(units > TINY, spent / units).otherwise(F.col("entry_px")).alias("avg_px"))
    held = rows.join(bars.select(F.col("sym").alias("product"), "date", L.number(F.col("close")).alias("close")), "product").where("date >= entry")
    out = held.groupBy("product", "entry", "entry_px", "avg_px", "days").agg(F.max_by("close", "date").alias("last"), F.max("close").alias("high"), F.min("close").alias("low"))
    return out.select("product", "entry", "entry_px", "avg_px", ((F.nullif(F.col("last"), F.lit(0.0)) / F.col("avg_px") - 1) * 100).alias("ret"), "high", "low", "days")


def portfolio_orders(found: DataFrame) -> DataFrame:
    """(product, i, units, px, sells): signed units per bar, the last leg's price, and whether it sells."""
    leg = lambda c, sign: F.transform(c, lambda x: F.struct(x["i"].alias("i"), (x["qty"] * sign).alias("units"), x["px"].alias("px")))
    legs = found.select("product", F.explode(F.concat(leg("buys", 1.0), leg("sells", -1.0))).alias("x")).select("product", "x.*")
    return legs.groupBy("product", "i").agg(F.sum("units").alias("units"), F.max("px").alias("px"), (F.min("units") < 0).alias("sells"))


def market_params(markets: DataFrame) -> DataFrame:
    """markets (product, market) -> with commission, tax, slippage and cash; those of US where the market is unknown."""
    table = F.create_map(*[x for k, v in MARKETS.items() for x in (F.lit(k), F.struct(*[F.lit(n).alias(c) for c, n in zip(("commission", "tax", "slippage", "cash"), v, strict=True)]))])
    return markets.select("product", F.coalesce(F.get(F.map_values(F.map_filter(table, lambda k, _: k == F.col("market"))), F.lit(0)), table["US"]).alias("p")).select("product", "p.*")


def ledger(orders: DataFrame, markets: DataFrame) -> DataFrame:
    """(product, i, shares, cash) after each order bar.

    A purchase is units of the initial cash at the order's price, or as much as the cash pays for with its commission; a
    sale is that part of the shares held which its units are of the units held. Orders are folded product by product.
    """
    own = orders.groupBy("product").agg(F.sort_array(F.collect_list(F.struct("i", "units", "px"))).alias("orders")).join(market_params(markets), "product")
    zero = F.lit(0.0)

    def step(a: Column, x: Column) -> Column:
        now = a["now"]
        price = x["px"] * (1 + F.signum(x["units"]) * F.col("slippage"))
        bought = F.greatest(zero, F.least(x["units"] * F.col("cash") / price, now["cash"] / (price * (1 + F.col("commission")))))
        part = F.when(now["units"] > TINY, F.least(F.lit(1.0), -x["units"] / now["units"])).otherwise(zero)
        buys = x["units"] > 0
        state = F.struct(
            x["i"].alias("i"),
            F.when(buys, now["shares"] + bought).otherwise(now["shares"] * (1 - part)).alias("shares"),
            F.when(buys, now["cash"] - bought * price * (1 + F.col("commission"))).otherwise(now["cash"] + now["shares"] * part * price * (1 - F.col("commission") - F.col("tax"))).alias("cash"),
            F.greatest(zero, now["units"] + x["units"]).alias("units"),
        )
        return F.transform(F.array(state), lambda n: F.struct(n.alias("now"), F.concat(a["all"], F.array(n)).alias("all")))[0]

    kind = "struct<i:int,shares:double,cash:double,units:double>"
    start = F.struct(F.struct(F.lit(-1).alias("i"), zero.alias("shares"), F.col("cash").alias("cash"), zero.alias("units")).cast(kind).alias("now"), F.array().cast(f"array<{kind}>").alias("all"))
    return own.select("product", F.explode(F.aggregate("orders", start, step)["all"]).alias("x")).select("product", "x.i", "x.shares", "x.cash")


def equity(bars: DataFrame, orders: DataFrame, markets: DataFrame | None = None) -> DataFrame:
    """(product, i, date, value): cash and shares at the close on every bar of the products with orders.

    markets (product, market); US where None. A missing close is the one before, at the start the one after.
    """
    markets = orders.select("product").distinct().withColumn("market", F.lit("US")) if markets is None else markets
    rows = bars.join(orders.select("product").distinct(), F.col("sym") == F.col("product")).select("product", "date", L.number(F.col("close")).alias("close"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("product").orderBy("date")) - 1)
    rows = rows.join(ledger(orders, markets), ["product", "i"], "left").join(market_params(markets).select("product", F.col("cash").alias("first")), "product")
    after = L.by_day().rowsBetween(0, Window.unboundedFollowing)
    close = F.coalesce(F.last("close", ignorenulls=True).over(L.up_to()), F.first("close", ignorenulls=True).over(after))
    held = F.coalesce(F.last("shares", ignorenulls=True).over(L.up_to()), F.lit(0.0))
    cash = F.coalesce(F.last("cash", ignorenulls=True).over(L.up_to()), F.col("first"))
    return rows.select("product", "i", "date", (cash + held * close).alias("value"), "first")


def limits_unapplied(markets: DataFrame) -> DataFrame:
    """markets (product, market) -> (product, limits array<string>): limits of the market that `ledger` doesn't heed, as fills
    are at the orders' prices whatever they are; those of US where the market is unknown."""
    names = lambda k: F.array(*map(F.lit, [n for n, v in zip(("price_limit", "tick"), LIMITS[k], strict=True) if v is not None])).cast("array<string>")
    of = reduce(lambda c, k: F.when(F.col("market") == k, names(k)).otherwise(c), [k for k in LIMITS if k != "US"], names("US"))
    return markets.select("product", of.alias("limits"))


def portfolio_stats(curve: DataFrame) -> DataFrame:
    """(product, total_return, max_drawdown, sharpe): percent of the initial cash; percent of the highest value so far, not
    negative; returns from bar to bar, the first against the initial cash, over a year of 365 days. Bars are a day apart, or
    where their keys have a time (more than 8 digits), as far as the median of their distances."""
    before = F.coalesce(F.lag("value").over(L.by_day()), F.col("first"))
    at = epoch(F.when(F.length("date") > 8, F.col("date")))
    rows = curve.select("product", "i", "value", "first", (at - F.lag(at).over(L.by_day())).alias("step"), (F.try_divide(F.col("value"), before) - 1).alias("r"), (1 - F.col("value") / F.max("value").over(L.up_to())).alias("down"))
    bars = YEAR_DAYS * DAY / F.coalesce(F.nullif(F.median("step"), F.lit(0.0)), F.lit(float(DAY)))
    return rows.groupBy("product").agg(((F.max_by("value", "i") / F.first("first") - 1) * 100).alias("total_return"), (F.max("down") * 100).alias("max_drawdown"), (F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(bars)).alias("sharpe"))


def period_results(graded: DataFrame, periods: tuple[int, ...] = (365, 1095), today: str | None = None, horizons=HORIZONS) -> DataFrame:
    """A row per product and period of so many days up to today (by default its last day): (product, period, start, days,
    grades array<struct<grade, days, signals, returns array<struct<horizon, n, avg, median, win>>>>, baseline, the same array
    over all days, buy_hold).

    All periods are one pass over the days: a day counts in each period that holds it. A run of a grade that began before
    the period begins on its first day; returns look beyond it.
    """
    last = F.max("date").over(Window.partitionBy("product")) if today is None else F.lit(today)
    rows = forward_returns(graded, horizons).withColumn("today", F.to_date(last, "yyyyMMdd"))
    first = lambda p: F.date_format(F.date_sub("today", p), "yyyyMMdd")
    rows = rows.withColumn("p", F.explode(F.array(*[F.struct(F.lit(p).alias("period"), first(p).alias("start_day")) for p in periods]))).select("*", "p.*").where("date >= start_day and date <= date_format(today, 'yyyyMMdd')")
    by = Window.partitionBy("product", "period").orderBy("i")
    rows = rows.withColumn("start", ~F.lag("key").over(by).eqNullSafe(F.col("key")))
    key = ["product", "period"]
    long = rows.select(*key, "start_day", "key", "start", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"fwd_{h}").alias("r")) for h in horizons])).alias("x")).select(*key, "key", "start", "x.*")

    def stats(r: Column) -> list[Column]:
        return [F.count(r).alias("n"), F.avg(r).alias("avg"), F.median(r).alias("median"), (F.avg((r > 0).cast("double")) * 100).alias("win")]

    returns = F.sort_array(F.collect_list(F.struct("horizon", "n", "avg", "median", "win")))
    hit = F.when(F.col("start"), F.col("r"))
    by_grade = long.groupBy(*key, "key", "horizon").agg(*stats(hit)).groupBy(*key, "key").agg(returns.alias("returns"))
    counts = rows.groupBy(*key, "key").agg(F.count(F.lit(1)).alias("days"), F.sum(F.col("start").cast("long")).alias("signals"))
    grades = counts.join(by_grade, [*key, "key"]).groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col("key").alias("grade"), "days", "signals", "returns"))).alias("grades"))
    base = long.groupBy(*key, "horizon").agg(*stats(F.col("r"))).groupBy(*key).agg(returns.alias("baseline"))
    held = rows.groupBy(*key).agg(F.min("start_day").alias("start"), F.count(F.lit(1)).alias("days"), F.when(F.count(F.lit(1)) >= 2, (F.try_divide(F.max_by("close", "i"), F.min_by("close", "i")) - 1) * 100).alias("buy_hold"))
    return held.join(grades, key).join(base, key).select(*key, "start", "days", "grades", "baseline", "buy_hold")
