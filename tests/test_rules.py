"""Grammar, three-valued logic, since-operators, positions and streaming against plain Python."""

import copy
import datetime as dt
import itertools
import json
import os
import random
import shutil
import subprocess
import sys
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebar.functions.text import lines, marks, unwrap_titles
from tidebar.operators import compare, latest
from tidebar.operators import scenarios as Z
from tidebar.operators.backtest import AtLeast, equity, exit_policy, limits_unapplied, portfolio_stats, position_facts, size_notes, stepper, trade_stats, trades
from tidebar.plans import dsl
from tidebar.plans.compile import decisions, evaluate, ladder_of
from tidebar.queries import wrapped_titles
from tidebar.sources import bars as sources
from tidebar.sources import sessions, texts
from tidebar.streaming.hub import ATOMS, BARS, Hub

C = {"px": "close", "sym": "$self"}
UP_ONE = {"gt": [C, 1]}
GOOD = {"node": lambda op: {op: C if op == "abs" else UP_ONE}, "pair": lambda op: {op: [C, 2]}, "list": lambda op: {op: [UP_ONE]}, "span": lambda op: {op: [C, 3]}, "count": lambda op: {op: 1, "of": [UP_ONE]}, "case": lambda op: {op: [[UP_ONE, 1]], "else": 0}}
WRONG = {
    "node": [[C, 1], "y", True], "pair": [[C], [C, 1, 1], C, [C, "y"], [C, False]], "list": [C, 3, [True]], "span": [[C], [C, 1, 1], [C, -1], [C, 1.5], [C, True], [3, "y"], C], "count": [0, -2, 1.5, True, "y"],
    "case": [[], [[UP_ONE]], [UP_ONE, 1], UP_ONE, [[UP_ONE, "y"]]],
}


def bad_nodes():
    """Every operator with an argument of a wrong shape, with a key too many, and beside another one; and wrong leaves."""
    for op, form in dsl.FORMS.items():
        if form.shape == "leaf":
            continue
        good = GOOD[form.shape](op)
        yield from ({**good, op: x} for x in WRONG[form.shape])
        yield from ({**good, "size": 1}, {**good, **({"abs": C} if op != "abs" else {"not": UP_ONE})})
        yield from ({k: v for k, v in good.items() if k != key} for key in form.keys)
        if form.least:
            yield {**good, op: [C, form.least - 1]}
    leaf = {"px": "low", "sym": "Q"}
    yield from ({**leaf, "px": "last"}, {"px": "low"}, {**leaf, "sym": " "}, {**leaf, "sym": "$other"}, {**leaf, "sym": 7}, *({**leaf, "tf": x} for x in ("h", "0m", "3y", "", 5)))
    yield from ({"manual": " "}, {"manual": 3}, {"pos": "size"}, {"pos": "sold", "rule": "r"}, {"col": "x", "kind": "num"}, {}, {"label": "only"}, None, "close", False, [C])


@pytest.mark.parametrize("node", list(bad_nodes()), ids=str)
def test_bad_nodes(node):
    with pytest.raises(dsl.RuleError):
        dsl.validate(node)


@pytest.mark.parametrize("op", [op for op, form in dsl.FORMS.items() if form.shape != "leaf"])
def test_good_forms(op):
    dsl.validate(GOOD[dsl.FORMS[op].shape](op))
    dsl.validate({**GOOD[dsl.FORMS[op].shape](op), "label": "named", "on": ["A"]})


def test_good_nodes():
    dsl.validate({"all": [{"gt": [C, {"div": [{"sum": [C, 20]}, 20]}], "label": "x"}, {"atleast": 2, "of": [{"manual": "m"}, {"ge": [{"px": "volume", "sym": "X", "tf": "15m"}, "?"]}]}]})


W = {"gt": [C, 1]}
IX_UP = {"gt": [{"px": "close", "sym": "$index"}, 0]}
TREE = dsl.synthetic({"A": {"index": "B"}, "B": {"index": "A"}}, {"label": "up", "value": W}, dsl.rule("buy", dsl.BUY, {"all": [{"rule": "up"}, IX_UP]}, on=["A"]), dsl.rule("sell", dsl.SELL, W, ("held", 1)))


def changed(path, value):
    """TREE with the place at the path replaced, or left out where the value is None."""
    out = copy.deepcopy(TREE)
    at = out
    for k in path[:-1]:
        at = at[k]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


BUYS, SELLS = ("rules", 1), ("rules", 2)
CHANGES = [
    *((("version",), x) for x in (None, 1, "3")), *((("products",), x) for x in (None, {}, [])), *((("rules",), x) for x in (None, [], {})), (("extra",), 1), (("products", "A", "colour"), 1), ((*BUYS, "colour"), 1),
    ((*BUYS, "label"), None), ((*BUYS, "label"), " "), ((*BUYS, "label"), "sell"), ((*BUYS, "then"), None), ((*BUYS, "then"), []), ((*BUYS, "on"), ["Q"]), ((*BUYS, "skip"), "why not"), ((*BUYS, "then", 0, "do"), "wait"),
    ((*BUYS, "then", 0, "when"), None), ((*BUYS, "then", 0, "when"), {"px": "mid", "sym": "A"}), ((*BUYS, "then", 0, "repeat"), True), ((*BUYS, "then", 0, "qty"), {"of": "held", "x": 1}), ((*BUYS, "then", 0, "colour"), 1),
    ((*SELLS, "then", 0, "qty"), {"of": "budget", "x": 1}), ((*SELLS, "then", 0, "repeat"), 2), ((*SELLS, "then", 0, "when"), None), (("rules", 0, "value"), {"sum": [C]}), (("products", "A", "index"), None),
]


@pytest.mark.parametrize("change", CHANGES, ids=str)
def test_bad_trees(change):
    dsl.Tree(TREE)
    with pytest.raises(dsl.RuleError):
        dsl.Tree(changed(*change))


def test_inlining_and_warmup():
    tree = dsl.Tree({**TREE, "rules": [*TREE["rules"], {"label": "a", "value": {"rule": "b"}}, {"label": "b", "value": {"rule": "a"}}, dsl.rule("c", dsl.BUY, {"rule": "none"})]})
    assert tree.expand({"rule": "a"})["manual"] and tree.gate("A", dsl.BUY)["any"][1]["manual"] and tree.gate("B", dsl.BUY) == {"any": [tree.gate("A", dsl.BUY)["any"][1]]}
    assert dsl.warmup({"gt": [C, {"highest": [{"lag": [C, 5]}, 20]}]}) == 24
    assert dsl.logic_key({"lt": [C, 1]}) == dsl.logic_key({"gt": [1, {**C, "tf": "1d"}]})


def bars(spark, **series):
    rows = [(s, f"2021{k:04d}", *([None if x is None else float(x)] * 4 if not isinstance(x, tuple) else [float(x[0]), float(max(x)), float(min(x)), float(x[1])]), 1000.0) for s, xs in series.items() for k, x in enumerate(xs)]
    return spark.createDataFrame(rows, BARS)


def series(frame, *names):
    return [[r[n] for r in sorted(frame.collect(), key=lambda r: (r["product"], r["i"]))] for n in names]


def test_kleene_logic(spark):
    """All combinations of three unknown-able conditions against the fill-in definition."""
    states = list(itertools.product([1, -1, None], repeat=3))
    frame = bars(spark, **{s: [x[k] for x in states] for k, s in enumerate("ABC")})
    cond = lambda s: {"gt": [{"px": "close", "sym": s}, 0]}
    abc = [cond("$self"), cond("B"), cond("C")]
    found = series(evaluate(frame, {"A": {}}, {"all": {"all": abc}, "any": {"any": abc}, "two": {"atleast": 2, "of": abc}, "case": {"case": [[abc[0], 1], [abc[1], 2]], "else": 3}}), "all", "any", "two", "case")
    for k, x in enumerate(states):
        fills = [[v > 0 for v in f] for f in itertools.product(*[[v] if v else [1, -1] for v in x])]
        for row, test in zip(found, (all, any, lambda f: sum(f) >= 2), strict=False):
            results = {test(f) for f in fills}
            assert row[k] == (results.pop() if len(results) == 1 else None)
        a, b = x[0], x[1]
        assert found[3][k] == (None if a is None else 1 if a > 0 else None if b is None else 2 if b > 0 else 3)


def test_since_operators(spark):
    rng = random.Random(7)
    data = {s: [rng.choice([1, -1, None, 2, -2]) for _ in range(80)] for s in "ABCD"}
    up = {"gt": [C, 1]}
    frame = evaluate(bars(spark, **data), {s: {} for s in data}, {"b": {"barssince": up}, "over": {"ge": [{"barssince": up}, 3]}, "v": {"valuewhen": [up, C]}, "m": {"minsince": [{"ge": [C, 1]}, C]}, "s": {"sum": [C, 3]}})
    found = dict(zip("bovms", series(frame, "b", "over", "v", "m", "s"), strict=True))
    at = 0
    for s in sorted(data):
        x = data[s]
        for i in range(80):
            j = next((j for j in range(i, -1, -1) if x[j] is None or x[j] > 1), -1)
            known = j >= 0 and x[j] is not None
            assert found["b"][at] == (i - j if known else None) and found["v"][at] == (x[j] if known else None)
            assert found["o"][at] == (i - j >= 3 if known else True if i - j >= 3 else None)
            j = next((j for j in range(i, -1, -1) if x[j] is None or x[j] >= 1), -1)
            assert found["m"][at] == (min(x[j : i + 1]) if j >= 0 and x[j] is not None else None)
            assert found["s"][at] == (sum(x[i - 2 : i + 1]) if i >= 2 and None not in x[i - 2 : i + 1] else None)
            at += 1


def test_causal(spark):
    """The last row over a truncated history equals that day's row over the full one."""
    data = {"A": [100 + (k * 37 % 23) for k in range(60)], "B": [50 + (k * 17 % 13) for k in range(60)]}
    tree = dsl.Tree(dsl.synthetic({"A": {"index": "B"}}, dsl.rule("x", dsl.BUY, {"gt": [C, {"highest": [{"lag": [C, 1]}, 5]}]}), dsl.rule("y", dsl.BLOCK, {"gt": [{"barssince": {"gt": [{"px": "close", "sym": "$index"}, 60]}}, 2]})))
    full = series(decisions(bars(spark, **data), tree), "key")[0]
    for n in (10, 33):
        assert series(decisions(bars(spark, **{s: x[:n] for s, x in data.items()}), tree), "key")[0] == full[:n]


R = {"pos": "ret"}


def run_trades(spark, rows, *rules):
    first = dsl.rule("go", dsl.BUY, {"all": [{"le": [{"px": "volume", "sym": "$self"}, 1000]}, {"ge": [1, 1]}]})
    tree = dsl.Tree(dsl.synthetic(["X"], first, *rules))
    return sorted(trades(bars(spark, X=rows), tree).collect(), key=lambda r: r["entry"])


def test_trade_in_parts(spark):
    """Bought at the second open for 40: half goes once 25 % are gained, what is left once a peak of 50 % is half lost again."""
    rows = [(40, 40), (40, 44), (46, 50), (52, 60), (61, 55), (50, 48), (47, 30), (30, 30)]
    rules = [dsl.rule("half", dsl.SELL, {"ge": [R, 25]}, ("bought", 0.5)), dsl.rule("back", dsl.SELL, {"all": [{"ge": [{"pos": "maxret"}, 50]}, {"lt": [R, 25]}]}, ("held", 1))]
    found = run_trades(spark, rows, *rules)[0]
    # +25 % at the close of 50 (day 2): half at the next open, 52. The peak of 60 is +50 %; the close of 48 is +20 %: the rest at 47.
    assert [(x["i"], x["px"], x["qty"], x["rule"]) for x in found["sells"]] == [(3, 52.0, 0.5, "half"), (6, 47.0, 0.5, "back")]
    assert found["closed"] and found["days"] == 5 and abs(found["ret"] - ((52 + 47) / 2 / 40 - 1) * 100) < 1e-9


def test_repeated_and_unknown_quantities(spark):
    """A rule fires once; one that repeats, at each rise; one with an unknown quantity sells nothing."""
    rows = [(10, 10), (10, 12), (12, 10), (10, 12), (12, 12), (12, 10)]
    over = {"ge": [R, 19]}
    once, again, unknown = (run_trades(spark, rows, dsl.rule("s", dsl.SELL, over, ("held", x), **more))[0]["sells"] for x, more in ((0.5, {}), (0.5, {"repeat": True}), ("?", {})))
    assert [(x["i"], x["qty"]) for x in once] == [(2, 0.5)] and [(x["i"], x["qty"]) for x in again] == [(2, 0.5), (4, 0.25)] and not unknown


def test_second_tranche(spark):
    rows = [(10, 10), (10, 12), (13, 13), (13, 13)]
    tree = dsl.Tree(dsl.synthetic(["X"], dsl.rule("go", dsl.BUY, {"all": []}), dsl.rule("one", dsl.BUY, None, ("budget", 0.25)), dsl.rule("two", dsl.BUY, {"ge": [R, 19]}, ("budget", 0.75))))
    found = trades(bars(spark, X=rows), tree)
    assert [(x["i"], x["px"], x["qty"], x["tranche"]) for x in found.first()["buys"]] == [(1, 10.0, 0.25, "one"), (2, 13.0, 0.75, "two")]
    facts = position_facts(found, bars(spark, X=rows)).first()
    assert abs(facts["avg_px"] - (0.25 * 10 + 0.75 * 13)) < 1e-9 and facts["high"] == 13 and facts["days"] == 2
    stats = trade_stats(found).first()
    assert (stats["trades"], stats["open"], stats["buys"], stats["tranche_hits"], stats["rule_hits"]) == (1, 1, 2, "two:1", "")


def test_ledger_keeps_shares_and_cash(spark):
    """All in at 100, out at 50: the curve stays where the sale left it, whatever the price does, and buys for what is left."""
    prices = [100, 100, 50, 100, 100, 100]
    rows = bars(spark, X=prices)
    orders = spark.createDataFrame([("X", 0, 1.0, 100.0), ("X", 2, -1.0, 50.0)], "product string, i int, units double, px double")
    curve = [r["value"] for r in sorted(equity(rows, orders).collect(), key=lambda r: r["i"])]
    shares = 100000 / (100 * 1.001)
    out = shares * 50 * (1 - 0.001)
    assert [round(x, 6) for x in curve] == [round(x, 6) for x in (shares * 100, shares * 100, out, out, out, out)]
    more = orders.union(spark.createDataFrame([("X", 3, 1.0, 100.0), ("X", 4, -0.5, 100.0)], orders.schema))
    later = [r["value"] for r in sorted(equity(rows, more).collect(), key=lambda r: r["i"])]
    held = out / (100 * 1.001)
    assert abs(later[3] - held * 100) < 1e-6 and abs(later[4] - (held / 2 * 100 + held / 2 * 100 * (1 - 0.001))) < 1e-6 and min(later) > 0
    stats = portfolio_stats(equity(rows, orders)).first()
    assert abs(stats["total_return"] - (out / 1000 - 100)) < 1e-9 and abs(stats["max_drawdown"] - (1 - out / (shares * 100)) * 100) < 1e-9
    korean = equity(rows, orders, spark.createDataFrame([("X", "KR")], "product string, market string")).where("i = 5").first()["value"]
    assert abs(korean - 1e8 / (100 * 1.00015) * 50 * (1 - 0.00015 - 0.0018)) < 1e-2


def test_intraday_leaves(spark):
    """The value at the last bar of the tf stands on its day alone; without atoms such a leaf is refused."""
    daily = spark.createDataFrame([("A", f"2021010{d}", 1.0, 1.0, 1.0, 1.0, 1.0) for d in (1, 2, 3)], BARS)
    ticks = [("2021-01-02 10:01:00", 5.0), ("2021-01-02 10:20:00", 7.0), ("2021-01-02 10:40:00", 9.0), ("2021-01-02 11:00:00", 2.0)]
    atoms = spark.createDataFrame([("A", t, x, x, x, x, 1.0) for t, x in ticks], "sym string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.to_timestamp("ts"))
    leaf = {"px": "close", "sym": "$self", "tf": "15m"}
    exprs = {"x": {"sub": [leaf, {"lag": [leaf, 1]}]}, "mixed": {"all": [{"gt": [leaf, 8]}, {"gt": [C, 0]}]}}
    run = lambda asof: [(r["x"], r["mixed"]) for r in sorted(evaluate(daily, {"A": {}}, exprs, atoms=atoms, asof=asof).collect(), key=lambda r: r["i"])]
    assert run("2021-01-02 10:45:00") == [(None, None), (2.0, True), (None, None)]
    assert run("2021-01-02 12:00:00") == [(None, None), (-7.0, False), (None, None)]
    with pytest.raises(dsl.RuleError):
        evaluate(daily, {"A": {}}, exprs)


def test_unjudged_rules_and_alignment():
    up, down = {"gt": [C, 1]}, {"lt": [C, 1]}
    tree = lambda *rules: dsl.Tree(dsl.synthetic(["X"], *rules))
    a, b = tree(dsl.rule("p", dsl.BUY, up), dsl.rule("q", dsl.SELL, down)), tree(dsl.rule("r", dsl.BUY, {"lt": [1, C]}))
    final = tree(dsl.rule("p", dsl.BUY, up), dsl.rule("q", dsl.SELL, down), dsl.rule("n", dsl.SELL, up), dsl.rule("w", dsl.SELL, {"gt": [C, 5]}, why="page 3"))
    assert compare.unjudged(final, a, b) == [("q", "a"), ("n", "new")]
    assert compare.pair_rules(a, b, "X")[0] and len(compare.duplicates(tree(dsl.rule("x", dsl.SELL, up), dsl.rule("y", dsl.SELL, {"lt": [1, C]})), "X")) == 1
    other = {"px": "close", "sym": "Y"}
    pairs = compare.align([up, {"all": [up, down]}, {"manual": "m"}], [{"all": [up, {"gt": [C, 9]}]}, {"lt": [1, C]}, {"gt": [other, 7]}])
    assert pairs[0] == (up, {"lt": [1, C]}) and pairs[1][1] == {"all": [up, {"gt": [C, 9]}]} and pairs[2] == ({"manual": "m"}, None) and pairs[3] == (None, {"gt": [other, 7]})
    assert compare.manual_heads(tree(dsl.rule("m", dsl.BUY, {"all": [{"manual": "news: good"}, {"manual": "news: good"}, {"manual": "else"}, {"gt": [C, "?"]}]})), ("news",)) == {"news": 1, "": 2}


def test_wrapped_titles_reads_texts_once(spark, tmp_path):
    texts = [(1, "a\nb\n\nd\na\nb\nc"), (2, "one"), (3, ""), (4, None), (5, "x\n\ny\nz\nx y\nChapter 3. Deep\n가\n7-1. q\n, 가 2\n나\n다 \n라\n가-2!\n나다\nw")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = wrapped_titles(spark, str(tmp_path))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange hashpartitioning") == 1
    found = {(r["slug"], r["line"]): (r["key"], r["title"], r["body_line"]) for r in out.collect()}
    assert found == {
        (1, 1): ("1-1", "a-b", 3), (1, 5): ("1-1", "a-b", 7), (2, 1): ("1-1", "one", 2), (3, 1): ("1-1", "", 2),
        (5, 1): ("1-1", "x-", 2), (5, 5): ("1-1", "x y", 6), (5, 8): ("7-1", "q-2-1. , 가 2", 10), (5, 9): ("2-1", ", 가 2-나-다", 12), (5, 13): ("2-1", ", 가 2-나-다", 15),
    }


def test_titles_positions_and_spot(spark, tmp_path):
    text = "1-1. A long title that\ngoes on here\nBody.\n1-2. Short\nBody."
    rows = lines(spark.createDataFrame([("b", text)], "slug string, text string"), "slug", "text")
    contents = spark.createDataFrame([("b", "1-1", "A long title that goes on here"), ("b", "1-2", "Other")], "slug string, key string, toc string")
    found = {r["key"]: (r["title"], r["body_line"]) for r in unwrap_titles(rows, marks(rows), contents).collect()}
    assert found == {"1-1": ("A long title that goes on here", 3), "1-2": ("Short", 5)}
    path = tmp_path / "positions.json"
    path.write_text('{"positions": [{"prod": "A", "entry_date": "20210101", "entry_px": 2.5}, {"prod": "A", "entry_date": "20210105", "entry_px": 3, "filled": 2}]}')
    assert [(r["product"], r["n"], r["cost"], r["filled"]) for r in sources.positions(spark, str(path)).orderBy("n").collect()] == [("A", 0, 2.5, 1), ("A", 1, 3.0, 2)]
    daily = spark.createDataFrame([("A", d, 1.0, 1.0, 1.0, 1.0, 1.0) for d in ("20210101", "20210102")], BARS)
    atoms = spark.createDataFrame([("A", "2021-01-02 10:00:00", 8.0)], "sym string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    assert [r["close"] for r in sources.overlay_spot(daily, atoms, "2021-01-03 00:00:00").orderBy("date").collect()] == [1.0, 8.0]


def test_stream_replay_equals_batch(spark, tmp_path):
    tree = dsl.Tree(dsl.synthetic({"A": {"index": "B"}, "Z": {}}, dsl.rule("x", dsl.BUY, {"gt": [C, {"lag": [C, 1]}]}), dsl.rule("y", dsl.BLOCK, {"lt": [{"px": "close", "sym": "$index"}, 5]}, on=["A"])))
    schema = BARS + ", arrived long"
    feeds = [[("A", 0, 1), ("B", 0, 9), ("Z", 0, 1)], [("A", 1, 2)], [("B", 1, 9)], [("A", 1, 2)], [("A", 1, 0.5), ("Z", 1, 3)]]
    rows = [[(s, f"2021{d:04d}", *[float(x)] * 4, 1.0, n) for s, d, x in f] for n, f in enumerate(feeds)]
    hub = Hub(spark, str(tmp_path / "hub"), tree)
    for n, r in enumerate(rows):
        path = str(tmp_path / f"in/{n}")
        spark.createDataFrame(r, schema).coalesce(1).write.parquet(path)
        source = spark.readStream.schema(schema).parquet(path)
        hub.on_batch(spark.read.schema(schema).parquet(path), n) if n else hub.start(source, str(tmp_path / "check"), None).awaitTermination()
    events = {(r["batch"], r["product"]) for r in hub.events().collect()}
    assert events == {(0, "A"), (0, "Z"), (1, "A"), (2, "A"), (4, "A"), (4, "Z")}
    last = {r["product"]: r["key"] for r in hub.verdicts().collect()}
    batch = {r["product"]: r["key"] for r in sorted(decisions(hub.bars(), tree).collect(), key=lambda r: r["i"])}
    assert last == batch


def test_hub_goes_on_after_a_restart(spark, tmp_path):
    """A second hub on the same path and checkpoint keeps earlier bars; a replay of its last batch changes nothing."""
    tree = dsl.Tree(dsl.synthetic({"A": {}}, dsl.rule("b", dsl.BUY, {"gt": [C, {"lag": [C, 1]}]})))
    schema = f"{BARS}, arrived long"
    bar = lambda date, x: ("A", date, x, x, x, x, 1.0, int(date))
    folder, path = str(tmp_path / "in"), str(tmp_path / "hub")
    for date, x in (("20210101", 1.0), ("20210102", 2.0), ("20210103", 3.0)):
        spark.createDataFrame([bar(date, x)], schema).coalesce(1).write.mode("append").parquet(folder)
        Hub(spark, path, tree).start(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "check"), None).awaitTermination()
    hub = Hub(spark, path, tree)
    state = lambda: (sorted((r["date"], r["close"]) for r in hub.bars().collect()), sorted((r["batch"], r["date"], r["key"]) for r in hub.events().collect()))
    before = state()
    assert before[0] == [("20210101", 1.0), ("20210102", 2.0), ("20210103", 3.0)] and [b for b, *_ in before[1]] == [0, 1, 2]
    assert before[1][2][2] == before[1][1][2] != before[1][0][2]  # known from the second bar on
    Hub(spark, path, tree).on_batch(spark.createDataFrame([bar("20210103", 3.0)], schema), 2)
    assert state() == before
    os.makedirs(f"{path}/bars/batch=9/month=202101")  # a batch that was never completed
    assert state() == before
    for k in range(3, 7):
        hub.on_batch(spark.createDataFrame([bar("20210103", float(k))], schema), k)
        assert {r["date"]: r["close"] for r in hub.bars().collect()}["20210103"] == k
    assert hub.commits() == [5, 6] and [x for x in sorted(os.listdir(f"{path}/bars")) if x.startswith("batch")] == ["batch=5", "batch=6", "batch=9"]  # one more for a replay, older ones gone
    assert [x for x in sorted(os.listdir(f"{path}/verdicts"))] == ["batch=5", "batch=6"]
    hub.on_batch(spark.createDataFrame([bar("20210103", 6.0)], schema), 7)  # nothing new: nothing written
    assert hub.commits() == [5, 6] and not os.path.exists(f"{path}/bars/batch=7")


def test_hub_killed_before_the_verdicts(spark, tmp_path, monkeypatch):
    """Killed after the bars were written: the same batch again publishes what the first run would have."""
    tree = dsl.Tree(dsl.synthetic({"A": {}}, dsl.rule("b", dsl.BUY, {"gt": [C, {"lag": [C, 1]}]})))
    batch = spark.createDataFrame([("A", f"2021010{d}", *[float(d)] * 4, 1.0, d) for d in (1, 2)], f"{BARS}, arrived long")
    hub = Hub(spark, str(tmp_path / "hub"), tree)
    monkeypatch.setattr("tidebar.streaming.hub.decisions", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        hub.on_batch(batch, 0)
    monkeypatch.undo()
    Hub(spark, str(tmp_path / "hub"), tree).on_batch(batch, 0)
    assert [(r["product"], r["date"], r["key"]) for r in hub.verdicts().collect()] == [("A", "20210102", "buy")] and hub.bars().count() == 2


def test_rest_stands_without_llm(tmp_path):
    """The registry imports when the training-data operators are deleted."""
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run(["cp", "-r", f"{repo}/tidebar", f"{repo}/__spark_entry__.py", str(tmp_path)], check=True)
    shutil.rmtree(tmp_path / "tidebar/llm", ignore_errors=True)  # gone already where the folder was deleted
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'op1_secrets' in e.queries())"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True)
    assert out.stdout.split()[1] == "False" and int(out.stdout.split()[0]) > 40


def ticks(spark, *rows):
    """Rows (sym, time or day, price, arrived) of a batch: atoms where the time has hours, else daily bars."""
    schema = f"{BARS}, ts timestamp, arrived long"
    made = [(s, at[:10].replace("-", ""), *[float(x)] * 4, 1.0, dt.datetime.fromisoformat(at) if len(at) > 10 else None, n) for s, at, x, n in rows]
    return spark.createDataFrame(made, schema)


def current(hub):
    return {(r["book"], r["product"]): r for r in hub.verdicts().collect()}


RISES = dsl.rule("rise", dsl.BUY, {"gt": [C, {"lag": [C, 1]}]})


def test_one_event_per_book_with_kept_verdicts(spark, tmp_path):
    """Only woken products are judged; an event has all of the book's products; observers that fail stop no other; a restart keeps all."""
    books = {"one": dsl.Tree(dsl.synthetic(["A", "B"], RISES)), "two": dsl.Tree(dsl.synthetic(["B", "D"], RISES))}
    seen = []

    def broken(event):
        raise ValueError("reader")

    hub = Hub(spark, str(tmp_path / "hub"), books, publish=broken)
    end = hub.subscribe(lambda event: seen.append(sorted((r["book"], r["product"], r["key"], r["judged"]) for r in event.collect())))
    hub.on_batch(ticks(spark, *[(s, f"2021-01-0{d}", d, d) for s in "ABD" for d in (1, 2)]), 0)
    assert seen == [[("one", "A", "buy", 0), ("one", "B", "buy", 0)], [("two", "B", "buy", 0), ("two", "D", "buy", 0)]]
    hub.on_batch(ticks(spark, ("A", "2021-01-03", 1, 1)), 1)
    assert seen[2:] == [[("one", "A", "avoid", 1), ("one", "B", "buy", 0)]]
    end()
    again = Hub(spark, str(tmp_path / "hub"), books)
    again.on_batch(ticks(spark, ("D", "2021-01-03", 1, 1)), 2)
    assert {k: (r["key"], r["judged"]) for k, r in current(again).items()} == {("one", "A"): ("avoid", 1), ("one", "B"): ("buy", 0), ("two", "B"): ("buy", 0), ("two", "D"): ("avoid", 2)} and len(seen) == 3
    for (book, product), r in current(again).items():
        batch = decisions(again.bars(), books[book]).where(F.col("product") == product).orderBy(F.col("i").desc()).first()
        assert (r["key"], r["date"], r["close"]) == (batch["key"], batch["date"], batch["close"])
    again.on_batch(ticks(spark, ("A", "2021-01-03", 1, 1)), 1)  # an old batch again, after a restart from an older checkpoint
    assert current(again)["one", "A"]["key"] == "avoid"


def test_atoms_late_and_corrected_give_the_batch_result(spark, tmp_path):
    """Atoms in any order, repeated and corrected: store and verdicts are those of all atoms at once; those over seven days old go."""
    leaf = {"px": "close", "sym": "$self", "tf": "15m"}
    tree = dsl.Tree(dsl.synthetic(["A", "Z"], dsl.rule("m", dsl.BUY, {"gt": [leaf, {"lag": [leaf, 1]}]})))
    daily = [(s, f"2021-01-{d:02d}", 5, 0) for s in "AZ" for d in (8, 9)]
    atoms = [("A", "2021-01-01 10:00:00", 1, 1), ("A", "2021-01-09 10:00:00", 5, 2), ("A", "2021-01-09 10:20:00", 7, 3), ("A", "2021-01-09 10:40:00", 6, 5), ("A", "2021-01-09 10:40:00", 9, 4), ("Z", "2021-01-09 10:41:00", 3, 6)]
    hub = Hub(spark, str(tmp_path / "hub"), tree, now=lambda: dt.datetime(2021, 1, 9, 10, 50))
    order = [atoms[4], atoms[5], atoms[2], atoms[3], atoms[1], atoms[0]]
    for n, rows_ in enumerate([daily, *[[x] for x in order]]):
        hub.on_batch(ticks(spark, *rows_), n)
    stored = sorted((r["sym"], str(r["ts"]), r["close"]) for r in hub.atoms().collect())
    assert stored == [("A", "2021-01-09 10:00:00", 5.0), ("A", "2021-01-09 10:20:00", 7.0), ("A", "2021-01-09 10:40:00", 6.0), ("Z", "2021-01-09 10:41:00", 3.0)]
    found = current(hub)
    one = Hub(spark, str(tmp_path / "one"), tree, now=lambda: dt.datetime(2021, 1, 9, 10, 50))
    one.on_batch(ticks(spark, *daily, *atoms), 0)
    assert {k: r[1:7] for k, r in found.items()} == {k: r[1:7] for k, r in current(one).items()}
    assert found["book", "A"]["close"] == 6.0 and found["book", "A"]["key"] == "avoid" and found["book", "Z"]["close"] == 3.0  # spot prices
    hub.on_batch(ticks(spark, ("A", "2021-01-09 10:40:00", 8, 9)), 9)  # a correction
    assert current(hub)["book", "A"]["key"] == "buy" and current(hub)["book", "A"]["judged"] == 9 and current(hub)["book", "Z"]["judged"] != 9
    hub.on_batch(ticks(spark, ("Z", "2021-01-17 09:00:00", 4, 10)), 10)
    assert [r["sym"] for r in hub.atoms().collect()] == ["Z"] and list(hub.state()["atoms"]) == ["20210117"]


def test_changed_positions_wake_their_book(spark, tmp_path):
    """The file's content alone, not its time, wakes all products of its book; holdings stand beside the grade."""
    tree = dsl.Tree(dsl.synthetic(["A", "B"], RISES, dsl.rule("out", dsl.SELL, {"ge": [{"pos": "ret"}, 50]}, ("held", 1))))
    file = tmp_path / "positions.json"
    hub = Hub(spark, str(tmp_path / "hub"), {"mine": tree, "other": tree}, positions={"mine": str(file)})
    hub.on_batch(ticks(spark, *[(s, f"2021-01-0{d}", 10 * d, d) for s in "AB" for d in (1, 2, 3)]), 0)
    assert current(hub)["mine", "A"]["holdings"] is None
    text = '{"positions": [{"prod": "A", "entry_date": "20210102", "entry_px": 20}, {"prod": "A", "entry_date": "20210103", "entry_px": 25}]}'
    file.write_text(text)
    hub.on_batch(ticks(spark).where("false"), 1)
    found = current(hub)
    assert {k: r["judged"] for k, r in found.items()} == {("mine", "A"): 1, ("mine", "B"): 1, ("other", "A"): 0, ("other", "B"): 0}
    assert [(h["n"], round(h["ret"], 6), h["days"], h["sells"][0]["hit"]) for h in found["mine", "A"]["holdings"]] == [(0, 50.0, 1.0, True), (1, 20.0, 0.0, False)] and found["mine", "B"]["holdings"] is None
    file.write_text(text)
    hub.on_batch(ticks(spark).where("false"), 2)
    assert hub.commits()[-1] == 1
    hub.on_batch(ticks(spark, ("A", "2021-01-03 12:00:00", 40, 9)), 3)  # returns at the spot price
    assert [round(h["ret"], 6) for h in current(hub)["mine", "A"]["holdings"]] == [100.0, 60.0]
    file.unlink()
    hub.on_batch(ticks(spark).where("false"), 4)
    assert current(hub)["mine", "A"]["holdings"] is None and current(hub)["mine", "A"]["judged"] == 4


def test_hub_settles_by_its_clock(spark, tmp_path):
    """Until a session has closed by the clock, its bar decides nothing; the next batch after the close does."""
    at = [dt.datetime(2021, 1, 3, 20, 0)]
    sessions = spark.createDataFrame([("A", f"2021010{d}", dt.datetime(2021, 1, d, 21, 0)) for d in (1, 2, 3)], "sym string, date string, close_utc timestamp")
    hub = Hub(spark, str(tmp_path / "hub"), dsl.Tree(dsl.synthetic(["A"], RISES)), now=lambda: at[0], sessions=sessions)
    hub.on_batch(ticks(spark, *[("A", f"2021-01-0{d}", x, d) for d, x in ((1, 1), (2, 2), (3, 1))]), 0)
    found = current(hub)["book", "A"]
    assert (found["key"], found["date"], found["confirmed"], found["close"]) == ("buy", "20210103", 1, 1.0)
    at[0] = dt.datetime(2021, 1, 3, 21, 0)
    hub.on_batch(ticks(spark, ("A", "2021-01-03", 1.5, 4)), 1)
    assert (current(hub)["book", "A"]["key"], current(hub)["book", "A"]["confirmed"]) == ("avoid", 2)


def test_ticks_without_data_see_a_changed_file(spark, tmp_path):
    """A running stream judges a book anew when its positions file appears, though no bar arrives; then atoms come as a file."""
    tree = dsl.Tree(dsl.synthetic(["A"], RISES, dsl.rule("out", dsl.SELL, {"ge": [R, 50]}, ("held", 1))))
    folder, file = str(tmp_path / "in"), tmp_path / "positions.json"
    ticks(spark, ("A", "2021-01-01", 1, 0), ("A", "2021-01-02", 2, 1)).coalesce(1).write.parquet(folder)
    schema = ticks(spark).schema
    hub = Hub(spark, str(tmp_path / "hub"), {"mine": tree}, positions={"mine": str(file)})
    query = hub.start(spark.readStream.schema(schema).parquet(folder), str(tmp_path / "check"), "1 second")

    def wait(test):
        for _ in range(120):
            found = current(hub).get(("mine", "A"))
            if found is not None and test(found):
                return found
            assert query.isActive, query.exception()
            time.sleep(0.5)
        raise AssertionError(found)

    try:
        assert wait(lambda r: True)["holdings"] is None
        file.write_text('{"positions": [{"prod": "A", "entry_date": "20210101", "entry_px": 1}]}')
        assert wait(lambda r: r["holdings"])["holdings"][0]["ret"] == 100.0
        ticks(spark, ("A", "2021-01-02 15:00:00", 4, 2)).coalesce(1).write.mode("append").parquet(folder)
        found = wait(lambda r: r["close"] == 4.0)
        assert found["holdings"][0]["ret"] == 300.0 and found["key"] == "buy"
    finally:
        query.stop()


def test_backfill_fetches_once_for_each_start(spark, tmp_path):
    """Symbols are fetched when they are first wanted, and again for an earlier start; those without bars are asked for once."""
    asked = []

    def fetch(symbols, start):
        names = sorted(r[0] for r in symbols.collect())
        asked.append((names, start))
        return bars(spark, **{s: [1, 2] for s in names if s != "N"})

    clock = lambda: dt.datetime(2022, 6, 1)
    path = str(tmp_path / "hub")
    hub = Hub(spark, path, dsl.Tree(dsl.synthetic(["A", "N"], RISES)), fetch=fetch, now=clock)
    hub.on_batch(ticks(spark).where("false"), 0)
    assert asked == [(["A", "N"], "20210117")] and {k: r["key"] for k, r in current(hub).items()} == {("book", "A"): "buy"}
    hub.on_batch(ticks(spark, ("A", "2022-05-31", 1, 1)), 1)
    assert len(asked) == 1 and current(hub)["book", "A"]["key"] == "avoid" and hub.bars().count() == 3
    more = Hub(spark, path, dsl.Tree(dsl.synthetic({"A": {"index": "I"}, "B": {}}, RISES, dsl.rule("i", dsl.BLOCK, {"lt": [{"px": "close", "sym": "$index"}, 0]}, on=["A"]))), fetch=fetch, now=lambda: dt.datetime(2022, 7, 1))
    more.on_batch(ticks(spark).where("false"), 2)
    assert asked[1:] == [(["B", "I"], "20210216")]
    early = Hub(spark, path, more.sources, fetch=fetch, now=clock, extra_days=365)
    early.on_batch(ticks(spark).where("false"), 3)
    assert asked[2:] == [(["A", "B", "I"], "20200118")]
    assert {(r["sym"], r["start"]) for r in early.loaded().collect()} == {("A", "20200118"), ("B", "20200118"), ("I", "20200118"), ("N", "20210117")}
    assert early.requests().count() == 7


def test_books_from_files(spark, tmp_path):
    """A tree file that changes wakes its book; one that can't be read gives an error and no verdicts, and stops no other book."""
    file = tmp_path / "tree.json"
    tree = dsl.synthetic(["A"], RISES)
    file.write_text(json.dumps(tree))
    hub = Hub(spark, str(tmp_path / "hub"), {"file": str(file), "fixed": dsl.Tree(tree)})
    hub.on_batch(ticks(spark, ("A", "2021-01-01", 1, 0), ("A", "2021-01-02", 2, 1)), 0)
    assert {k: r["key"] for k, r in current(hub).items()} == {("file", "A"): "buy", ("fixed", "A"): "buy"}
    file.write_text(json.dumps(dsl.synthetic(["A"], dsl.rule("fall", dsl.BUY, {"lt": [C, {"lag": [C, 1]}]}))))
    hub.on_batch(ticks(spark).where("false"), 1)
    assert {k: (r["key"], r["judged"]) for k, r in current(hub).items()} == {("file", "A"): ("avoid", 1), ("fixed", "A"): ("buy", 0)}
    assert [r["key"] for r in hub.judge_with("file", {}).collect()] == ["avoid"]
    file.write_text('{"version": 2}')
    hub.on_batch(ticks(spark, ("A", "2021-01-03", 3, 2)), 2)
    found = current(hub)
    assert found["fixed", "A"]["judged"] == 2 and "version 3" in found["file", None]["error"] and len(found) == 2
    file.write_text(json.dumps(tree))
    hub.on_batch(ticks(spark).where("false"), 3)
    assert {k: r["error"] for k, r in current(hub).items()} == {("file", "A"): None, ("fixed", "A"): None}


def test_plans_do_not_grow_with_products(spark):
    """2,000 products of a few kinds are one plan of few columns; many kinds are judged by several plans."""
    products = {f"P{k}": {"index": "P0"} for k in range(2000)}
    own = [dsl.rule(f"over {j}", dsl.BUY, {"gt": [C, j]}, on=[p for k, p in enumerate(products) if k % 3 == j]) for j in range(3)]
    tree = dsl.Tree(dsl.synthetic(products, *own, dsl.rule("index", dsl.BLOCK, {"gt": [{"px": "close", "sym": "$index"}, 100]}), dsl.rule("w", dsl.BUY, None, ("cash", 5))))
    frame = spark.range(2000).select(F.concat(F.lit("P"), F.col("id").cast("string")).alias("sym"), F.lit("20210101").alias("date"), *[(F.col("id") % 4).cast("double").alias(f) for f in sources.FIELDS])
    began = time.time()
    found = decisions(frame, tree)
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 60_000
    rows_ = found.collect()
    assert time.time() - began < 20 and len(rows_) == 2000
    assert all((r["key"] == "buy") == (int(r["product"][1:]) % 4 > int(r["product"][1:]) % 3) and r["weight"] == 5 for r in rows_)
    many = dsl.Tree(dsl.synthetic({f"P{k}": {} for k in range(60)}, *[dsl.rule(f"r{k}", dsl.BUY, {"gt": [C, k % 4]}, on=[f"P{k}"]) for k in range(60)]))
    assert len(many.kinds) == 60 and {r["key"] for r in decisions(frame, many).collect()} == {"avoid"}


def plain_value(node, days, i):
    """A node's value on day i by looking back over the days, as the operators are defined; days: {name: list}. Bounds are ('least', n)."""
    at = lambda x, k: plain_value(x, days, k)
    exact = lambda x: None if isinstance(x, tuple) else x
    if isinstance(node, (int, float)):
        return float(node)
    if "pos" in node:
        return days[node["pos"]][i]
    op = dsl.op_of(node)
    v = node[op]
    if op == "lag":
        return at(v[0], i - v[1]) if i >= v[1] else None
    if op in dsl.WINDOW:
        xs = [exact(at(v[0], k)) for k in range(i - v[1] + 1, i + 1)] if i >= v[1] - 1 else [None]
        return None if None in xs else {"sum": sum, "highest": max, "lowest": min}[op](xs)
    if op in ("barssince", *dsl.SINCE):
        c, seen = (v if op == "barssince" else v[0]), []
        for k in range(i, max(-1, i - 400), -1):
            hit = at(c, k)
            if hit is None:
                return ("least", float(i - k)) if op == "barssince" and i > k else None
            seen.append(exact(at(v[1], k)) if op != "barssince" else None)
            if hit:
                return float(i - k) if op == "barssince" else seen[-1] if op == "valuewhen" else None if None in seen else (min if op == "minsince" else max)(seen)
        least = min(400, i + 1)
        return ("least", float(least)) if op == "barssince" else None
    xs = [at(x, i) for x in dsl.children(node)]
    if any(isinstance(x, tuple) for x in xs):
        (a, la), (b, lb) = ((x[1], True) if isinstance(x, tuple) else (x, False) for x in xs)
        if a is None or b is None or la and lb:
            return None
        if op in ("add", "sub"):
            return ("least", a + b if op == "add" else a - b) if op == "add" or la else None
        return {("gt", True): True if a > b else None, ("ge", True): True if a >= b else None, ("lt", True): False if a >= b else None, ("le", True): False if a > b else None,
                ("lt", False): True if b > a else None, ("le", False): True if b >= a else None, ("gt", False): False if b >= a else None, ("ge", False): False if b > a else None}[op, la]
    if op == "not":
        return None if xs[0] is None else not xs[0]
    if op in ("all", "any"):
        return (False if False in xs else None if None in xs else True) if op == "all" else (True if True in xs else None if None in xs else False)
    if None in xs:
        return None
    a, b = xs
    return {"add": a + b, "sub": a - b, "mul": a * b, "gt": a > b, "ge": a >= b, "lt": a < b, "le": a <= b}[op]


def test_operators_over_position_values():
    """Every operator that looks back, nested too, step by step against looking back over all days; values are unknown before the entry and now and then after."""
    rng = random.Random(9)
    ret, held = {"pos": "ret"}, {"pos": "days"}
    over = {"ge": [ret, 2]}
    nodes = [{op: [ret, n]} for op in (*dsl.WINDOW, "lag") for n in (1, 2, 5)] + [{"lag": [ret, 0]}, {"barssince": over}, *({op: [over, ret]} for op in dsl.SINCE), {"ge": [{"barssince": over}, 3]}, {"lt": [{"barssince": over}, 3]}, {"le": [4, {"barssince": over}]}]
    nodes += [{"gt": [{"add": [{"barssince": over}, held]}, 8]}, {"gt": [{"sub": [{"barssince": over}, 1]}, 2]}, {"gt": [{"sub": [9, {"barssince": over}]}, 2]}, {"lag": [{"barssince": over}, 2]}, {"highest": [{"lag": [ret, 2]}, 3]}, {"barssince": {"gt": [ret, {"lowest": [{"lag": [ret, 1]}, 3]}]}}]
    nodes += [{"sum": [{"barssince": over}, 2]}, {"maxsince": [{"not": over}, {"mul": [ret, -1]}]}, {"all": [{"any": [over, {"gt": [held, 5]}]}, {"gt": [{"highest": [ret, 3]}, 1]}]}]
    for _ in range(30):
        entry = rng.randrange(0, 6)
        values = [None if k < entry or rng.random() < 0.08 else float(rng.randrange(-4, 5)) for k in range(40)]
        days = {"ret": values, "days": [None if k < entry else float(k - entry) for k in range(40)]}
        for node in nodes:
            step = stepper(node, lambda leaf, d, days=days: days[leaf["pos"]][d])
            for k in range(40):
                found, want = step(k), plain_value(node, days, k)
                assert (("least", float(found)) if isinstance(found, AtLeast) else found) == want, (node, k, values)


def test_trailing_stop_and_lower_bounds_in_a_walk(spark):
    """Sold once the return is 10 below the highest of three days; a bound from the bars beside it decides only what it can."""
    rows = [(10, 10), (10, 12), (12, 13), (13, 13.5), (13, 12), (12, 12), (12, 12)]
    found = run_trades(spark, rows, dsl.rule("trail", dsl.SELL, {"lt": [R, {"sub": [{"highest": [R, 3]}, 10]}]}, ("held", 1)))[0]
    assert [(x["i"], x["px"]) for x in found["sells"]] == [(5, 12.0)]
    # never over 50: at least so many bars, which is more than a small number of days, and not known to be fewer
    since = {"barssince": {"gt": [C, 50]}}
    more = run_trades(spark, rows, dsl.rule("more", dsl.SELL, {"gt": [since, {"pos": "days"}]}, ("held", 1)))[0]
    less = run_trades(spark, rows, dsl.rule("less", dsl.SELL, {"lt": [since, {"add": [{"pos": "days"}, 99]}]}, ("held", 1)))[0]
    assert [x["i"] for x in more["sells"]] == [2] and not less["sells"]


def test_sizes_with_flags(spark):
    """A purchase takes the weight of the day that decides it; an unknown weight counts as all and is flagged."""
    rows = [(10, 10), (10, 12), (13, 13), (13, 13)]
    up = {"gt": [C, {"lag": [C, 1]}]}
    tree = lambda *more: dsl.Tree(dsl.synthetic(["X"], dsl.rule("go", dsl.BUY, {"all": []}), dsl.rule("one", dsl.BUY, None, ("budget", 0.5)), dsl.rule("two", dsl.BUY, {"ge": [R, 19]}, ("budget", 0.5)), *more))
    weighted = trades(bars(spark, X=rows), tree(dsl.rule("w", dsl.BUY, None, ("cash", {"case": [[up, 40]], "else": 20}))))
    assert [(x["i"], x["qty"], x["flags"]) for x in weighted.first()["buys"]] == [(1, 0.5, ["weight_unknown"]), (2, 0.2, [])]
    stats = trade_stats(weighted).first()
    assert (stats["buys"], stats["weight_unset"], stats["weight_unknown"]) == (2, 0, 1)
    stats = trade_stats(trades(bars(spark, X=rows), tree())).first()
    assert (stats["buys"], stats["weight_unset"], stats["weight_unknown"]) == (2, 2, 0)
    open_ = dsl.Tree(dsl.synthetic(["X"], dsl.rule("one", dsl.BUY, None, ("budget", "?")), dsl.rule("s", dsl.SELL, up, ("held", "?")), dsl.rule("t", dsl.SELL, up, ("held", 1))))
    assert size_notes(open_) == [("X", "tranche", "one"), ("X", "sell", "s")] and exit_policy(open_, "X") == "book" and exit_policy(tree(), "X") == "none"


def test_ladders(spark):
    table = lambda *rows_: spark.createDataFrame(rows_, "place int, key string, opt_block string, opt_buy string, pes_block string, pes_buy string")
    with pytest.raises(dsl.RuleError):
        ladder_of(table((0, "a", "true", None, None, None)))
    tree = dsl.Tree(dsl.synthetic(["X"], dsl.rule("m", dsl.BUY, {"all": [{"gt": [C, 1]}, {"manual": "m"}]}), dsl.rule("b", dsl.BLOCK, {"gt": [{"lag": [C, 1]}, 1]})))
    steps = ladder_of(table((2, "unclear", "unknown", None, None, None), (1, "ask", "false", "true", None, "false"), (3, "no", None, None, None, None)))
    found = [(r["key"], r["rung"]) for r in sorted(decisions(bars(spark, X=[2, 0, 2, 2]), tree, ladder=steps).collect(), key=lambda r: r["i"])]
    assert found == [("unknown", None), ("no", None), ("ask", 0), ("no", None)]


def test_scenarios_on_made_up_series(spark):
    """Short series are filled at the front, long ones cut; other symbols rise slowly; sales are those of a holding since the first day."""
    series = spark.createDataFrame([("s1", "X", None, None, None, [5.0, 6.0], [7.0]), ("s2", "X", None, [9.0] * 80, None, [float(k) for k in range(80)], None)], "scenario string, sym string, open array<double>, high array<double>, low array<double>, close array<double>, volume array<double>")
    made = Z.series_bars(spark.createDataFrame([("s1", 4), ("s2", None)], "scenario string, days int"), series, ["Y"])
    own = {k: [(r["date"], r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in made.where(f"scenario = '{k[0]}' and sym = '{k[1]}'").orderBy("date").collect()] for k in (("s1", "X"), ("s1", "Y"), ("s2", "X"))}
    assert [x[0] for x in own["s1", "X"]] == ["20000103", "20000104", "20000105", "20000106"] and [x[1:] for x in own["s1", "X"]] == [(5.0, 5.0, 5.0, 5.0, 7.0)] * 3 + [(6.0, 6.0, 6.0, 6.0, 7.0)]
    assert own["s1", "Y"][2][4] == 100 * 1.001**2 and own["s1", "Y"][2][2] == pytest.approx(100 * 1.001**2 * 1.002) and own["s1", "Y"][0][5] == 1e6
    assert len(own["s2", "X"]) == 60 and own["s2", "X"][0][4] == 20.0 and own["s2", "X"][-1][:3] == ("20000324", 79.0, 9.0)
    tree = dsl.Tree(dsl.synthetic({"X": {"index": "Y"}}, dsl.rule("b", dsl.BUY, {"all": [{"gt": [C, {"lag": [C, 1]}]}, {"gt": [{"px": "close", "sym": "$index"}, 50]}, {"manual": "m"}]}), dsl.rule("s", dsl.SELL, {"all": [{"ge": [R, 10]}, {"manual": "n"}]}, ("held", 1)), dsl.rule("t", dsl.SELL, {"ge": [R, 50]}, ("held", 1))))
    asked = [("s1", "X", 4, "buy", None), ("s1", "X", 4, "wait", None), ("s1", "X", 4, "block", None), ("s1", "X", 4, "sell", None), ("s2", "X", None, "sell", None), ("s2", "X", None, "buy", 40.0), ("s1", "Q", 4, "buy", None), ("s1", "X", 4, "sit", None), ("s3", "X", 4, "sell", None)]
    found = Z.results(spark.createDataFrame(asked, "scenario string, product string, days int, expect string, pct double"), series, tree).collect()
    assert Counter((r["scenario"], r["product"], r["expect"], r["result"]) for r in found) == Counter([("s1", "X", "buy", "match if confirmed"), ("s1", "X", "wait", "match if confirmed"), ("s1", "X", "block", "mismatch"), ("s1", "X", "sell", "match if confirmed"), ("s2", "X", "sell", "match"), ("s2", "X", "buy", "mismatch"), ("s1", "Q", "buy", "malformed"), ("s1", "X", "sit", "malformed"), ("s3", "X", "sell", "mismatch")])


def test_texts_of_a_manifest(spark, tmp_path):
    """Absent, empty and present files; live books first."""
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/a.txt").write_text("Erste Zeile\nzweite é", encoding="utf-8")
    (tmp_path / "raw/empty book.txt").write_text("")
    (tmp_path / "raw/unnamed.txt").write_text("x")
    (tmp_path / "books.json").write_text('{"site": "s", "books": [{"slug": "a", "title": "A"}, {"slug": "e", "file": "empty book.txt", "live": true}, {"slug": "gone"}]}')
    books = texts.manifest(spark, str(tmp_path / "books.json"))
    found = {r["slug"]: r for r in texts.texts(books, str(tmp_path / "raw")).collect()}
    assert {k: (r["text"], r["chars"], r["missing"]) for k, r in found.items()} == {"a": ("Erste Zeile\nzweite é", 20, False), "e": ("", 0, False), "gone": (None, None, True)}
    assert texts.default_slug(books) == "e" and texts.default_slug(books.where("slug <> 'e'")) == "a" and texts.default_slug(books.where("false")) is None


def test_lint_and_uncovered_rules(spark):
    named, other = {"gt": [C, 1], "label": "n"}, {"gt": [C, 2], "label": "n"}
    tree = dsl.Tree(dsl.synthetic(["X"], dsl.rule("a", dsl.BUY, {"all": [named, other, {"manual": "unsaid: x"}, {"manual": "unsaid: y (taste)", "label": "t"}]}), dsl.rule("b", dsl.SELL, {"gt": [{"px": "close", "sym": "?"}, 1]}), dsl.rule("c", dsl.SELL, {"lt": [1, {"px": "close", "sym": "?"}]}),
                                  {"label": "unused", "value": named}, {"label": "used", "value": named}, dsl.rule("d", dsl.BLOCK, {"rule": "used"}), {"label": "left", "skip": "no data"}))
    assert set(compare.lint(tree, "unsaid", "(taste)")) == {("unknown symbol", "b"), ("unknown symbol", "c"), ("nameless", "unsaid: x"), *(("nameless", dsl.manual_key(tree.sells("X")[k]["when"])) for k in (0, 1)), ("unclassified", "unsaid: x"), ("duplicates", "b, c"), ("ambiguous", "n")}
    shown = spark.createDataFrame([("a", dsl.BUY, 1), ("c", dsl.BUY, 1)], "label string, do string, n int")
    found = {(r["label"], r["do"], r["nth"], r["kind"]) for r in compare.uncovered(spark, tree, shown).collect()}
    assert found == {("b", dsl.SELL, 0, "branch"), ("c", dsl.SELL, 0, "branch"), ("d", dsl.BLOCK, 0, "branch"), ("unused", None, 0, "name"), ("left", None, 0, "skip")}


def test_alignment_is_the_best_of_all():
    """Against every possible pairing, over small lists with equal, like and unlike conditions."""
    rng = random.Random(2)
    pool = [{"gt": [C, 1]}, {"lt": [1, C]}, {"gt": [C, 2]}, {"all": [{"gt": [C, 1]}, {"lt": [C, 5]}]}, {"all": [{"gt": [C, 1]}, {"lt": [C, 6]}, UP_ONE]}, {"manual": "m", "label": "z"}, {"barssince": UP_ONE}, {"ge": [{"sum": [C, 3]}, 2], "label": "z"}]
    for _ in range(60):
        xs, ys = ([rng.choice(pool) for _ in range(rng.randrange(0, 5))] for _ in range(2))
        price = lambda pairs: sum(0.5 if x is None or y is None else compare.unlikeness(x, y) for x, y in pairs)
        options = [[(x, None if j is None else ys[j]) for x, j in zip(xs, js, strict=True)] + [(None, y) for j, y in enumerate(ys) if j not in js] for js in itertools.product([None, *range(len(ys))], repeat=len(xs)) if len({j for j in js if j is not None}) == sum(j is not None for j in js)]
        found = compare.align(xs, ys)
        assert [x for x, _ in found if x is not None] == xs and sum(y is not None for _, y in found) == len(ys)
        assert price(found) == pytest.approx(min(map(price, options)))


def test_intraday_looks_back_no_further_than_it_must(spark):
    """The value at the last time over a cut axis is that over all times, for windows, since-operators up to their cap, and symbols that are no product."""
    rng = random.Random(3)
    base = dt.datetime(2021, 1, 4, 0, 0)
    made = [(s, base + dt.timedelta(minutes=k), *[float(rng.randrange(1, 9))] * 4, 1.0) for s in "AX" for k in range(1000) if s == "A" or k % 3]
    atoms = spark.createDataFrame(made, ATOMS)
    a, x = {"px": "close", "sym": "$self"}, {"px": "close", "sym": "X"}
    exprs = {
        "sum": {"sum": [a, 7]}, "since": {"barssince": {"gt": [a, 7]}}, "never": {"ge": [{"barssince": {"gt": [a, 99]}}, 400]}, "beyond": {"gt": [{"barssince": {"gt": [a, 99]}}, 400]}, "other": {"gt": [{"highest": [{"lag": [a, 3]}, 20]}, {"lag": [x, 1]}]},
        "nested": {"valuewhen": [{"gt": [a, {"highest": [{"lag": [a, 1]}, 2]}]}, {"sum": [a, 3]}]},
    }
    daily = spark.createDataFrame([("A", "20210104", 1.0, 1.0, 1.0, 1.0, 1.0)], BARS)
    leaves = lambda e: json.loads(json.dumps(e).replace('"px": "close"', '"px": "close", "tf": "1m"'))
    found = evaluate(daily, {"A": {}}, {k: leaves(e) for k, e in exprs.items()}, atoms=atoms).first()
    whole = evaluate(atoms.select("sym", F.date_format("ts", "yyyyMMddHHmmss").alias("date"), *sources.FIELDS), {"A": {}}, exprs).orderBy(F.col("i").desc()).first()
    assert {k: found[k] for k in exprs} == {k: whole[k] for k in exprs} and found["never"] is True and found["beyond"] is None and found["sum"] is not None


def days_in(spark, *years):
    return spark.sql(" union all ".join(f"select explode(sequence(date'{y}-01-01', date'{y}-12-31')) as day" for y in years))


def test_sessions_of_known_years(spark):
    """The rests of two years in the US as published, summer time, early closes, and exceptions that replace the rules."""
    rests = {
        2021: "0101 0118 0215 0402 0531 0705 0906 1125 1224", 2022: "0117 0221 0415 0530 0620 0704 0905 1124 1226", 2024: "0101 0115 0219 0329 0527 0619 0704 0902 1128 1225",
        1997: "0101 0217 0328 0526 0704 0901 1127 1225",
    }
    found = sessions.sessions(days_in(spark, *rests), ("US",)).collect()
    for year, closed in rests.items():
        days = [dt.date(year, 1, 1) + dt.timedelta(n) for n in range(366)]
        want = {f"{d:%Y%m%d}" for d in days if d.year == year and d.weekday() < 5} - {f"{year}{x}" for x in closed.split()}
        assert {r["date"] for r in found if r["date"][:4] == str(year)} == want
    at = {r["date"]: (f"{r['open_utc']:%H:%M}", f"{r['close_utc']:%H:%M}", r["is_half"]) for r in found}
    assert at["20240308"] == ("14:30", "21:00", False) and at["20240311"] == ("13:30", "20:00", False)
    assert at["20241129"] == at["20241224"] == ("14:30", "18:00", True) and at["20240703"] == ("13:30", "17:00", True) and not at["20210702"][2]
    own = spark.createDataFrame([("KR", "20240101", "10:00", "15:30"), ("KR", "20241114", "10:00", "16:30"), ("KR", "20240209", None, None), ("KR", "20240105", "09:00", "12:00"), ("US", "20240102", None, None)], "market string, date string, opens string, closes string")
    korean = {r["date"]: (f"{r['open_utc']:%H:%M}", f"{r['close_utc']:%H:%M}", r["is_half"]) for r in sessions.sessions(days_in(spark, 2024), ("KR",), own).collect()}
    assert korean["20240101"] == ("01:00", "06:30", False) and korean["20241114"] == ("01:00", "07:30", False) and korean["20240105"] == ("00:00", "03:00", True) and korean["20240102"] == ("00:00", "06:30", False)
    assert not {"20240209", "20240301", "20241231", "20240106"} & set(korean)
    assert sessions.sessions(days_in(spark, 2024).where("false")).count() == 0
    with pytest.raises(ValueError):
        sessions.sessions(days_in(spark, 2024), ("XX",))


def test_sessions_do_not_depend_on_the_session_time_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    seconds = lambda: sorted((r["date"], r["c"]) for r in sessions.sessions(days_in(spark, 2024), ("US",)).select("date", F.unix_seconds("close_utc").alias("c")).collect())
    want = seconds()
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Seoul")
        assert seconds() == want
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_easter(spark):
    known = {1818: "0322", 1943: "0425", 1954: "0418", 1981: "0419", 2000: "0423", 2024: "0331", 2025: "0420", 2038: "0425", 2049: "0418", 2285: "0322"}
    rows = spark.createDataFrame([(y,) for y in known], "y int").select("y", F.date_format(sessions.easter(F.col("y")), "MMdd").alias("e")).collect()
    assert {r["y"]: r["e"] for r in rows} == known


def test_markets_of_symbols(spark):
    symbols = spark.createDataFrame([("005930",), ("0001A0",), ("SPY",), ("BRK.B",), ("spy",), ("2-HIGH",), ("005930",), (None,), ("GOLD",)], "sym string")
    listed = spark.createDataFrame([("GOLD", "KR"), ("2-HIGH", "US"), ("OTHER", "US")], "sym string, market string")
    assert {r["sym"]: r["market"] for r in sessions.markets_of(symbols).collect()} == {"005930": "KR", "0001A0": "KR", "SPY": "US", "BRK.B": "US", "spy": None, "2-HIGH": None, None: None, "GOLD": "US"}
    found = sessions.markets_of(symbols, listed)
    assert found.count() == 8 and {r["sym"]: r["market"] for r in found.where("sym in ('GOLD', '2-HIGH', 'SPY')").collect()} == {"GOLD": "KR", "2-HIGH": "US", "SPY": "US"}
    assert {r["market"] for r in sessions.markets_of(symbols, shapes=()).collect()} == {None}


def test_sharpe_of_bars_within_a_day(spark):
    """Keys with a time: the year has as many bars as their median distance gives; days, or a single bar, are a day apart."""
    values = [100.0, 110.0, 104.5, 115.0, 113.0]
    rs = [0.0] + [b / a - 1 for a, b in itertools.pairwise(values)]
    mean = sum(rs) / 5
    daily = mean / (sum((r - mean) ** 2 for r in rs) / 4) ** 0.5 * 365**0.5
    stats = {}
    for name, keys in {"day": [f"2024010{k}" for k in range(1, 6)], "minute": [f"20240101100{k}" for k in (0, 5, 6, 7, 8)], "gap": ["202401012300", "202401020000", "202401020100", "202401090000", "202401090100"]}.items():
        rows = spark.createDataFrame([("X", k, d, v, 100.0) for k, (d, v) in enumerate(zip(keys, values, strict=True))], "product string, i int, date string, value double, first double")
        stats[name] = portfolio_stats(rows).first()["sharpe"]
    assert abs(stats["day"] - daily) < 1e-9 and abs(stats["minute"] - daily * 1440**0.5) < 1e-6 and abs(stats["gap"] - daily * 24**0.5) < 1e-6
    one = spark.createDataFrame([("X", 0, "202401010900", 100.0, 100.0)], "product string, i int, date string, value double, first double")
    assert portfolio_stats(one).first()["sharpe"] is None


def test_limits_that_fills_do_not_heed(spark):
    markets = spark.createDataFrame([("A", "US"), ("B", "KR"), ("C", None), ("D", "XX")], "product string, market string")
    assert {r["product"]: r["limits"] for r in limits_unapplied(markets).collect()} == {"A": [], "B": ["price_limit"], "C": [], "D": []}


def test_decide_for_every_product(spark):
    """One row per product: without a bar unknown, with spot price and change, open questions once each, holdings by number."""
    ask = {"any": [{"manual": "calm"}, {"gt": [C, "?"], "label": "big"}]}
    tree = dsl.Tree(dsl.synthetic(["A", "B", "N"], RISES, dsl.rule("w", dsl.BLOCK, {"not": ask}), dsl.rule("w2", dsl.BLOCK, {"not": ask}, on=["A"]), dsl.rule("s", dsl.SELL, {"all": [{"manual": "sold"}, {"ge": [R, 10]}]}, ("held", 1))))
    dates = ["20210104", "20210105", "20210106"]
    rows = spark.createDataFrame([(s, d, x, x, x, x, 1.0) for s, xs in (("A", (10.0, 20.0, 30.0)), ("B", (5.0,))) for d, x in zip(dates, xs)], BARS)
    held = spark.createDataFrame([("A", 1, dates[1], 25.0, 1), ("A", 0, dates[0], 15.0, 1), ("N", 0, dates[0], 1.0, 1)], "product string, n int, entry_date string, cost double, filled int")
    found = {r["product"]: r for r in latest.decide(rows, tree, holdings=held).collect()}
    assert {p: (r["has_data"], r["date"], r["close"], r["key"], r["incomplete"]) for p, r in found.items()} == {"A": (True, dates[2], 30.0, "buy", False), "B": (True, dates[0], 5.0, "unknown", True), "N": (False, None, None, "unknown", None)}
    assert abs(found["A"]["change"] - 50) < 1e-9 and found["B"]["change"] is None and found["A"]["opt_buy"] and found["A"]["pes_block"] and not found["A"]["opt_block"]
    assert {p: sorted(x["label"] for x in r["asked"]) for p, r in found.items()} == {p: ["big", "calm"] for p in "ABN"}
    assert [(h["n"], h["ret"], h["sells"][0]["hit"]) for h in found["A"]["holdings"]] == [(0, 100.0, None), (1, (30 / 25 - 1) * 100, None)] and found["B"]["holdings"] is None and found["N"]["holdings"] is None
    early = {r["product"]: r for r in latest.decide(rows, tree, dates[1], answers={("A", "calm"): False}).collect()}
    assert (early["A"]["date"], early["A"]["close"], early["A"]["holdings"]) == (dates[1], 20.0, None)
    atoms = spark.createDataFrame([("A", "2021-01-06 10:00:00", 40.0)], "sym string, ts string, close double").withColumn("ts", F.to_timestamp("ts"))
    live = {r["product"]: r for r in latest.decide(rows, tree, atoms=atoms).collect()}
    assert live["A"]["close"] == 40.0 and abs(live["A"]["change"] - 100) < 1e-9 and live["B"]["close"] == 5.0
    assert {r["product"]: r["key"] for r in latest.decide(rows.where("false"), tree).collect()} == {p: "unknown" for p in "ABN"}


def test_hub_has_a_verdict_for_products_without_bars(spark, tmp_path):
    tree = dsl.Tree(dsl.synthetic(["A", "N"], RISES))
    hub = Hub(spark, str(tmp_path / "hub"), tree, every=True)
    hub.on_batch(ticks(spark, ("A", "2021-01-01", 1, 1), ("A", "2021-01-02", 2, 2)), 0)
    assert {p: (r["key"], r["date"], r["change"]) for (_, p), r in current(hub).items()} == {"A": ("buy", "20210102", 100.0), "N": ("unknown", None, None)}
    hub.on_batch(ticks(spark, ("N", "2021-01-01", 1, 3), ("N", "2021-01-02", 2, 4)), 1)
    assert {p: (r["key"], r["judged"]) for (_, p), r in current(hub).items()} == {"A": ("buy", 0), "N": ("buy", 1)}


def test_hub_fetches_atoms_once(spark, tmp_path):
    """Atoms of symbols that the rules read are asked for once, a new book's too; what the batch brings counts before them."""
    leaf = {"px": "close", "sym": "$self", "tf": "15m"}
    tree = lambda *ps: dsl.Tree(dsl.synthetic(list(ps), dsl.rule("m", dsl.BUY, {"gt": [leaf, {"lag": [leaf, 1]}]})))
    asked = []

    def fetch(symbols, start):
        own = sorted(r["sym"] for r in symbols.collect())
        asked.append((own, start))
        return spark.createDataFrame([(s, f"2021-01-09 10:{m}:00", *[float(x)] * 4, 1.0) for s in own for m, x in ((10, 5), (20, 7))], "sym string, ts string, open double, high double, low double, close double, volume double").withColumn("ts", F.to_timestamp("ts"))

    make = lambda books: Hub(spark, str(tmp_path / "hub"), books, now=lambda: dt.datetime(2021, 1, 9, 10, 50), fetch_atoms=fetch)
    make({"one": tree("A")}).on_batch(ticks(spark, ("A", "2021-01-08", 5, 0), ("A", "2021-01-09", 5, 1), ("A", "2021-01-09 10:20:00", 3, 2)), 0)
    hub = make({"one": tree("A"), "two": tree("A", "Z")})
    assert asked == [(["A"], "20210102")] and (current(hub)["one", "A"]["key"], current(hub)["one", "A"]["close"]) == ("avoid", 3.0)
    hub.on_batch(ticks(spark, ("Z", "2021-01-08", 5, 3), ("Z", "2021-01-09", 5, 4)), 1)
    hub.on_batch(ticks(spark, ("Z", "2021-01-09", 6, 5)), 2)
    assert asked[1:] == [(["Z"], "20210102")] and (current(hub)["two", "Z"]["key"], current(hub)["two", "Z"]["close"]) == ("buy", 7.0)
    assert {(r["sym"], r["close"]) for r in hub.atoms().collect()} == {("A", 5.0), ("A", 3.0), ("Z", 5.0), ("Z", 7.0)} and {r["sym"] for r in hub.loaded(kind="loaded_atoms").collect()} == {"A", "Z"}


def test_hub_with_a_session_calendar(spark, tmp_path):
    """Settling by the calendar of each symbol's market: Friday's bar counts once New York has closed."""
    at = [dt.datetime(2024, 3, 8, 20, 59)]
    hub = Hub(spark, str(tmp_path / "hub"), dsl.Tree(dsl.synthetic(["SPY"], RISES)), now=lambda: at[0], sessions=sessions.closes)
    hub.on_batch(ticks(spark, *[("SPY", f"2024-03-0{d}", x, d) for d, x in ((6, 1), (7, 2), (8, 1))]), 0)
    assert (current(hub)["book", "SPY"]["key"], current(hub)["book", "SPY"]["confirmed"]) == ("buy", 1)
    at[0] = dt.datetime(2024, 3, 8, 21, 0)
    hub.on_batch(ticks(spark, ("SPY", "2024-03-08", 1.5, 9)), 1)
    assert (current(hub)["book", "SPY"]["key"], current(hub)["book", "SPY"]["confirmed"]) == ("avoid", 2)
