"""Expressions to columns: equal sub-expressions are one node, nodes of one depth are one projection.

Spark allows no window inside a window's argument, so each node becomes a column of the frame (product, i, date, ...),
depth by depth; all windows share one exchange and sort by (product, i).
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.functions import logic as L
from tidebar.plans import dsl
from tidebar.sources.bars import resample

NUM, BOUND, BOOL = "num", "bound", "bool"


@dataclass
class Node:
    name: str
    kind: str
    depth: int


@dataclass
class Plan:
    """Columns by depth; build() adds them to a frame."""

    levels: dict[int, dict[str, Column]] = field(default_factory=dict)

    def build(self, frame: DataFrame) -> DataFrame:
        for depth in sorted(self.levels):
            frame = frame.select("*", *[c.alias(n) for n, c in self.levels[depth].items()])
        return frame


class Compiler:
    """manual: value of manual leaves (True, False or None for unknown), turned round below each not; answers:
    {(product, key): value} beat it and are not turned. base: {(sym, field): column of the frame}; settled: {sym: column
    that says whether a day's bar is settled}; named: the column that has the product's name, where `product`, by which
    windows part, is more than that."""

    def __init__(self, base: dict[tuple[str, str], str], products: list[str], manual: bool | None = None, answers: dict | None = None, settled: dict[str, str] | None = None, prefix: str = "n", named: str = "product"):
        self.base, self.products, self.answers, self.settled, self.prefix = base, products, answers or {}, settled or {}, prefix
        self.manual, self.named = manual, named
        self.plan = Plan()
        self.nodes: dict[str, Node] = {}

    def add(self, column: Column, kind: str, depth: int, bound: Column | None = None) -> Node:
        name = f"{self.prefix}{len(self.nodes)}_{depth}_{sum(map(len, self.plan.levels.values()))}"
        level = self.plan.levels.setdefault(depth, {})
        level[name] = column
        if bound is not None:
            level[name + "_lb"] = bound
        return Node(name, kind, depth)

    def node(self, expr: object, manual: bool | None = ...) -> Node:
        manual = self.manual if manual is ... else manual
        polar = manual if any(dsl.is_manual(n) for n in dsl.walk(expr)) else None
        key = json.dumps([dsl.bare(expr), [n.get("on") for n in dsl.walk(expr)], polar], ensure_ascii=False)
        if key not in self.nodes:
            self.nodes[key] = self._settle(expr, self._make(expr, manual))
        return self.nodes[key]

    def _settle(self, expr: object, n: Node) -> Node:
        """With an as-of time, the value at the last settled bar of the expression's symbols, where these settle alike on
        all of a product's days; not for manual, position, intraday or bound nodes."""
        if not self.settled or n.kind == BOUND or not isinstance(expr, dict) or any(dsl.is_manual(x) or "pos" in x or "col" in x for x in dsl.walk(expr)) or not dsl.symbols(expr):
            return n
        flags = sorted({self.settled[x] for x in dsl.symbols(expr)})
        pulled = F.last(F.when(F.col(flags[0]), F.struct(F.col(n.name).alias("v"))), ignorenulls=True).over(L.up_to())["v"]
        if len(flags) > 1:
            alike = F.min(F.when(F.least(*flags) == F.greatest(*flags), 1).otherwise(0)).over(L.Window.partitionBy("product")) == 1
            pulled = F.when(alike, pulled).otherwise(F.col(n.name))
        return self.add(pulled, n.kind, n.depth + 1)

    def num(self, expr: object, manual) -> tuple[Column, Node, Column | None]:
        """(value, node, lower-bound flag); booleans count as 0 and 1."""
        n = self.node(expr, manual)
        c = F.col(n.name)
        return c.cast("double") if n.kind == BOOL else c, n, F.col(n.name + "_lb") if n.kind == BOUND else None

    def exact(self, expr: object, manual) -> tuple[Column, Node]:
        """The value, null where only a bound is known."""
        c, n, lb = self.num(expr, manual)
        return (F.when(~lb, c) if lb is not None else c), n

    def bool_(self, expr: object, manual) -> tuple[Column, Node]:
        n = self.node(expr, manual)
        if n.kind != BOOL:
            raise dsl.RuleError(f"a condition is needed, not a number: {expr!r}")
        return F.col(n.name), n

    def _answer(self, key: str, manual: bool | None) -> Column:
        out = F.lit(manual).cast("boolean")
        for value in (True, False):
            if own := [p for (p, k), v in self.answers.items() if k == key and v is value]:
                out = F.when(F.col(self.named).isin(own), value).otherwise(out)
        return out

    def _make(self, expr: object, manual: bool | None) -> Node:
        if dsl.is_number(expr):
            return self.add(F.lit(float(expr)), NUM, 0)
        if expr == dsl.UNKNOWN:
            return self.add(F.lit(None).cast("double"), NUM, 0)
        op = dsl.op_of(expr)
        v = expr[op]
        if dsl.is_manual(expr):
            n = self.add(self._answer(dsl.manual_key(expr), manual), BOOL, 0)
        elif op == "col":
            n = self.add(F.col(v), expr["kind"], 0)
        elif op == "px" and expr.get("tf", "1d") != "1d":
            raise dsl.RuleError(f"an intraday leaf needs atoms: {expr!r}")
        elif op == "px":
            n = self.add(F.col(self.base[expr["sym"], v]), NUM, 0)
        elif op == "pos":
            n = self.add(F.col("pos_filled_" + expr["rule"] if "rule" in expr else f"pos_{v}").cast("double"), NUM, 0)
        elif op in dsl.ARITH:
            (a, x, la), (b, y, lb) = self.num(v[0], manual), self.num(v[1], manual)
            depth = max(x.depth, y.depth) + 1
            one = op == "add" and (la is None) != (lb is None) or op == "sub" and la is not None and lb is None
            if one:
                n = self.add(a + b if op == "add" else a - b, BOUND, depth, la if la is not None else lb)
            else:
                a, b = (F.when(~f, c) if f is not None else c for c, f in ((a, la), (b, lb)))
                value = {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b, "div": lambda: L.divide(a, b), "max": lambda: L.both(F.greatest, a, b), "min": lambda: L.both(F.least, a, b)}[op]()
                n = self.add(value, NUM, depth)
        elif op in dsl.CMP:
            (a, x, la), (b, y, lb) = self.num(v[0], manual), self.num(v[1], manual)
            n = self.add(L.compare(op, a, b, la, lb), BOOL, max(x.depth, y.depth) + 1)
        elif op == "abs":
            a, x = self.exact(v, manual)
            n = self.add(F.abs(a), NUM, x.depth + 1)
        elif op == "case":
            conditions, values = [self.bool_(c, manual) for c, _ in v], [self.num(x, manual) for _, x in v] + [self.num(expr["else"], manual)]
            depth = max(x.depth for _, x in conditions + [(0, n) for _, n, _ in values]) + 1
            pairs = lambda pick: [(c, pick(x)) for (c, _), x in zip(conditions, values, strict=False)]
            value = L.case3(pairs(lambda x: x[0]), values[-1][0], "double")
            flag = lambda x: F.lit(False) if x[2] is None else x[2]
            bound = L.case3(pairs(flag), flag(values[-1]), "boolean") if any(x[2] is not None for x in values) else None
            n = self.add(value, NUM if bound is None else BOUND, depth, bound)
        elif op in dsl.WINDOW or op == "lag":
            if v[1] == dsl.UNKNOWN:
                n = self.add(F.lit(None).cast("double"), NUM, 0)
            elif op == "lag":
                c, x, lb = self.num(v[0], manual)
                at = lambda c: F.lag(c, v[1]).over(L.by_day()) if v[1] else c
                n = self.add(at(c), x.kind if x.kind == BOUND else NUM, x.depth + 1, at(lb) if lb is not None else None)
            else:
                c, x = self.exact(v[0], manual)
                n = self.add(L.strict({"sum": F.sum, "highest": F.max, "lowest": F.min}[op], c, v[1]), NUM, x.depth + 1)
        elif op in ("all", "any"):
            parts = [self.bool_(c, manual) for c in v]
            n = self.add((L.all3 if op == "all" else L.any3)([c for c, _ in parts]), BOOL, max([x.depth for _, x in parts], default=-1) + 1)
        elif op == "atleast":
            parts = [self.bool_(c, manual) for c in expr["of"]]
            n = self.add(L.atleast(v, [c for c, _ in parts]), BOOL, max([x.depth for _, x in parts], default=-1) + 1)
        elif op == "not":
            c, x = self.bool_(v, None if manual is None else not manual)
            n = self.add(~c, BOOL, x.depth + 1)
        else:
            n = self._since(op, v, manual)
        if expr.get("on"):
            off = F.lit(True) if n.kind == BOOL else F.lit(None).cast("double")
            n = self.add(F.when(F.col(self.named).isin(expr["on"]), F.col(n.name)).otherwise(off), BOOL if n.kind == BOOL else NUM, n.depth + 1)
        return n

    def _since(self, op: str, v: object, manual) -> Node:
        condition = v if op == "barssince" else v[0]
        c, x = self.bool_(condition, manual)
        marks = L.since(c)
        lt, ln = (self.add(marks[k], NUM, x.depth + 1) for k in ("lt", "ln"))
        if op == "barssince":
            value, bound = L.barssince(F.col(lt.name), F.col(ln.name))
            return self.add(value, BOUND, lt.depth + 1, bound)
        s, y = self.exact(v[1], manual)
        depth = max(lt.depth, y.depth) + 1
        if op == "valuewhen":
            return self.add(L.valuewhen(F.col(lt.name), F.col(ln.name), c, s), NUM, depth)
        return self.add(L.extreme_since(F.min if op == "minsince" else F.max, lt.name, F.col(ln.name), c, s), NUM, depth)


def calendar(bars: DataFrame, products: dict[str, dict], exprs: list[object], closes: DataFrame | None = None, asof=None, by: str | None = None) -> tuple[DataFrame, dict]:
    """(frame, base): a row per product and own bar date, with i and the price columns that the expressions read.

    by: a column of the bars that tells worlds apart which don't see each other's bars.

    closes ([sym,] date, close_utc) and asof: adds base[sym, "settled"], whether that symbol's session had closed by asof;
    a symbol without any known session is always settled.
    """
    wanted = {(n["sym"], n["px"]) for e in exprs for n in dsl.walk(e) if "px" in n and n.get("tf", "1d") == "1d"} | {("$self", "close")}
    names = list(products)
    others = {s for s, _ in wanted} - {"$self"}
    read = sorted({*names, *(others - {"$index"}), *((products[p].get("index") for p in names if products[p].get("index")) if "$index" in others else ())})
    bars, keys = bars.where(F.col("sym").isin(read)), [by] if by else []
    frame = bars.where(F.col("sym").isin(names)).select(*keys, F.col("sym").alias("product"), "date", *[L.number(F.col(f)).alias(f"self_{f}") for f in dsl.FIELDS])
    frame = frame.withColumn("i", F.row_number().over(L.Window.partitionBy(*keys, "product").orderBy("date")) - 1)
    if "$index" in others:
        roles = bars.sparkSession.createDataFrame([(p, products[p].get("index") or "") for p in names], "product string, index_sym string")
        frame = frame.join(F.broadcast(roles), "product")  # a row for each of the tree's products
    base = {("$self", f): f"self_{f}" for f in dsl.FIELDS}
    tags = {"$self": "self"}
    for sym in sorted(others):
        fields = sorted({f for s, f in wanted if s == sym})
        tag = tags[sym] = "index" if sym == "$index" else f"t{len(base)}"
        other = bars.select(*keys, F.col("sym").alias(f"{tag}_sym"), "date", *[L.number(F.col(f)).alias(f"{tag}_{f}") for f in fields])
        if sym == "$index":
            frame = frame.join(other, [*keys, "index_sym", "date"], "left")
        else:
            frame = frame.join(other.where(F.col(f"{tag}_sym") == sym).drop(f"{tag}_sym"), [*keys, "date"], "left")
        base |= {(sym, f): f"{tag}_{f}" for f in fields}
    if asof is not None and closes is not None:
        for sym, tag in tags.items():
            name = f"settled_{tag}"
            own = closes.select(F.col("date").alias(f"{name}_date"), *([F.col("sym").alias(f"{name}_sym")] if "sym" in closes.columns else []), F.col("close_utc").alias(f"{name}_close"))
            on = F.col("date") == F.col(f"{name}_date")
            if "sym" in closes.columns:
                on = on & (F.col(f"{name}_sym") == (F.lit(sym) if sym not in dsl.ROLES else F.col("product" if sym == "$self" else "index_sym")))
            frame = frame.join(own, on, "left").drop(f"{name}_date", f"{name}_sym")
            known = F.max(f"{name}_close").over(L.Window.partitionBy("product")).isNotNull()
            frame = frame.withColumn(name, F.when(known, F.coalesce(F.col(f"{name}_close") <= F.lit(asof).cast("timestamp"), F.lit(False))).otherwise(True)).drop(f"{name}_close")
            base[sym, "settled"] = name
    return frame.drop("index_sym"), base


def settled_columns(base: dict) -> dict[str, str]:
    return {s: c for (s, f), c in base.items() if f == "settled"}


def intraday(frame: DataFrame, atoms: DataFrame | None, products: dict[str, dict], exprs: dict[str, object], manual: bool | None = None, answers: dict | None = None, asof=None, tag: str = "atom") -> tuple[DataFrame, dict[str, object]]:
    """(frame, exprs) with the largest parts that read one intraday tf turned into columns.

    Such a part is evaluated on the bars that the atoms up to asof make, over the times of all symbols; its value at the last of
    them stands in the row of that time's day (or the product's last row), and nothing in the others.
    """
    parts: dict[str, tuple[str, object]] = {}

    def tfs(node: object) -> set[str]:
        return {n.get("tf", "1d") for n in dsl.walk(node) if "px" in n}

    def split(node: object) -> object:
        if isinstance(node, list):
            return [split(x) for x in node]
        if not isinstance(node, dict):
            return node
        own = tfs(node) if set(node) - set(dsl.META) else set()
        if len(own) == 1 and own != {"1d"}:
            name = f"{tag}{len(parts)}"
            parts[name] = (own.pop(), node)
            return {"col": name, "kind": BOOL if dsl.op_of(node) in (*dsl.CMP, "all", "any", "atleast", "not") else NUM}
        return node if own <= {"1d"} else {k: v if k in dsl.META else split(v) for k, v in node.items()}

    out = {k: split(e) for k, e in exprs.items()}
    if not parts:
        return frame, out
    if atoms is None:
        raise dsl.RuleError("intraday leaves need atoms")
    spark = frame.sparkSession
    for tf in sorted({t for t, _ in parts.values()}):
        own = {k: _daily_leaves(e) for k, (t, e) in parts.items() if t == tf}
        names = {n["sym"] for e in own.values() for n in dsl.walk(e) if "px" in n}
        wanted = {*products, *(names - set(dsl.ROLES)), *(v.get("index") for v in products.values() if v.get("index"))}
        known = atoms.where(F.col("sym").isin(sorted(wanted)))
        bars = resample(known if asof is None else known.where(F.col("ts") <= F.lit(asof).cast("timestamp")), tf)
        bars = bars.select("sym", F.date_format("ts", "yyyyMMddHHmmss").alias("date"), *dsl.FIELDS)
        # the axis are the times of all symbols; of these the value at the last one depends on the last few alone
        times = bars.select("date").distinct().orderBy(F.col("date").desc()).limit(1 + max(map(reach, own.values())))
        times = times.agg(F.collect_list("date").alias("dates")).select(F.lit(0).alias("one"), "dates", F.array_min("dates").alias("least"))
        axis = spark.createDataFrame([(p, 0) for p in products], "sym string, one int").join(F.broadcast(times), "one").select("sym", F.explode("dates").alias("date"))
        late = bars.withColumn("one", F.lit(0)).join(F.broadcast(times.select("one", "least")), "one").where("date >= least").select(*bars.columns)
        others = late.where(~F.col("sym").isin(list(products)))
        found = evaluate(axis.join(late, ["sym", "date"], "left").unionByName(others), products, own, manual, answers)
        last = found.groupBy("product").agg(F.max("date").alias("at"), *[F.max_by(k, "date").alias(k) for k in own])
        day = F.substring("at", 1, 8)
        frame = frame.join(last, "product", "left")
        here = F.max(F.when(F.col("date") == day, F.col("i"))).over(L.Window.partitionBy("product"))
        row = F.coalesce(here, F.max("i").over(L.Window.partitionBy("product")))
        frame = frame.withColumn("atom_row", row).select(*[c for c in frame.columns if c not in own and c != "at"], *[F.when(F.col("i") == F.col("atom_row"), F.col(k)).alias(k) for k in own])
    return frame, out


def reach(node: object) -> int:
    """How many bars before a bar its value can depend on."""
    if not isinstance(node, dict):
        return 0
    op = dsl.op_of(node)
    inner = max(map(reach, dsl.children(node)), default=0)
    if op in (*dsl.SINCE, "barssince"):
        return inner + L.STREAK_CAP
    return inner + node[op][1] if op in (*dsl.WINDOW, "lag") and node[op][1] != dsl.UNKNOWN else inner


def _daily_leaves(node: object) -> object:
    if isinstance(node, dict):
        return {k: _daily_leaves(v) for k, v in node.items() if k != "tf"}
    return [_daily_leaves(x) for x in node] if isinstance(node, list) else node


def evaluate(bars: DataFrame, products: dict[str, dict], exprs: dict[str, object], manual: bool | None = None, answers: dict | None = None, closes: DataFrame | None = None, asof=None, atoms: DataFrame | None = None) -> DataFrame:
    """(product, i, date, self_* prices, one column per named expression)."""
    for e in exprs.values():
        dsl.validate(e)
    frame, base = calendar(bars, products, list(exprs.values()), closes, asof)
    frame, exprs = intraday(frame, atoms, products, exprs, manual, answers, asof)
    compiler = Compiler(base, list(products), manual, answers, settled_columns(base))
    nodes = {k: compiler.node(e) for k, e in exprs.items()}
    out = compiler.plan.build(frame)
    value = lambda n: F.when(~F.col(n.name + "_lb"), F.col(n.name)) if n.kind == BOUND else F.col(n.name)
    return out.select("product", "i", "date", *[f"self_{f}" for f in dsl.FIELDS], *[c for _, c in sorted(settled_columns(base).items())], *[value(n).alias(k) for k, n in nodes.items()])


class Rung(NamedTuple):
    """A grade, and the values that columns such as opt_buy or pes_block must have for it: true, false, or None for unknown."""

    key: str
    when: dict[str, bool | None]


class Ladder(NamedTuple):
    rungs: list[Rung]
    default: str


#: Fixed value: what is bought, if manual leaves are taken as favourable; anything else is avoided.
LADDER = Ladder([Rung("buy", {"opt_block": False, "opt_buy": True})], "avoid")
VIEWS = ("opt_block", "opt_buy", "pes_block", "pes_buy")


def ladder_of(table: DataFrame) -> Ladder:
    """table (place, key, opt_block, opt_buy, pes_block, pes_buy), the last four strings `true`, `false`, `unknown` or null for
    any -> its rungs by place; the last one must want nothing and is the default. A ladder is a few rows."""
    rows = table.orderBy("place").collect()
    wants = [{c: {"true": True, "false": False, "unknown": None}[r[c]] for c in VIEWS if r[c] is not None} for r in rows]
    if not rows or wants[-1]:
        raise dsl.RuleError("a ladder ends in a rung that wants nothing")
    return Ladder([Rung(r["key"], w) for r, w in zip(rows, wants, strict=True)][:-1], rows[-1]["key"])


#: Kinds of products, each with rules of its own, that one plan judges; more are judged by several plans.
KINDS = 24


def decisions(bars: DataFrame, tree: dsl.Tree, answers: dict | None = None, closes: DataFrame | None = None, asof=None, atoms: DataFrame | None = None, more: dict[str, object] | None = None, ladder: Ladder = LADDER, by: str | None = None) -> DataFrame:
    """A grade per product and day: (product, i, date, open, close, key, rung, opt/pes block and buy, weight and the weights with
    manual leaves true and false, confirmed, warmup), and the columns of `more`, {name: expression}.

    Manual leaves are taken as favourable in the opt columns and as unfavourable in the pes columns. confirmed: the last
    index that all symbols of the product have settled, -1 without one. key: that of the ladder's first rung whose wanted
    values are all met, and rung its number from 0; null, with the ladder's last key, where none is; `unknown` while fewer
    bars are confirmed than the rules need. more: a column whose value can be a lower bound has another, name_lb, that
    tells so. by: a column of the bars that tells worlds apart, and is returned first. The plan's size follows the kinds of products (sets
    of rules that concern them), not their number.
    """
    more = more or {}
    if len(tree.kinds) > KINDS:
        few = [[p for k in tree.kinds[n : n + KINDS] for p in k] for n in range(0, len(tree.kinds), KINDS)]
        return reduce(DataFrame.unionByName, [decisions(bars, tree.only(ps), answers, closes, asof, atoms, more, ladder, by) for ps in few])
    first = [ps[0] for ps in tree.kinds]
    gates = {(k, do): tree.gate(p, do) for k, p in enumerate(first) for do in (dsl.BLOCK, dsl.BUY)}
    weight = {k: w for k, p in enumerate(first) if (w := tree.weight(p)) is not None}
    daily = {k: {n["sym"] for do in (dsl.BLOCK, dsl.BUY) for n in dsl.walk(gates[k, do]) if "px" in n and n.get("tf", "1d") == "1d"} or {"$self"} for k in range(len(first))}
    frame, base = calendar(bars, tree.products, [*(e for p in first for _, _, e in tree.expressions(p)), *more.values()], closes, asof, by)
    if by and any(dsl.atom_symbols(e) for e in [*gates.values(), *weight.values()]):
        raise dsl.RuleError("intraday leaves don't go with several worlds")
    if any(dsl.atom_symbols(e) for e in [*gates.values(), *weight.values()]):
        names = {**{f"g{n}": k for n, k in enumerate(gates)}, **{f"w{k}": k for k in weight}}
        frame, out = intraday(frame, atoms, tree.products, {n: gates[k] if n[0] == "g" else weight[k] for n, k in names.items()}, None, answers, asof)
        gates, weight = {k: out[n] for n, k in names.items() if n[0] == "g"}, {k: out[n] for n, k in names.items() if n[0] == "w"}
    # one compiler: without manual leaves below, the views of a condition are one node
    frame = with_kinds(frame, tree)
    frame = apart(frame, by) if by else frame
    compiler = Compiler(base, list(tree.products), None, answers, settled_columns(base), named="own" if by else "product")
    columns = {f"{view}_{name}": [compiler.node(gates[k, do], good if do == dsl.BUY else not good).name for k in range(len(first))] for view, good in (("opt", True), ("pes", False)) for do, name in ((dsl.BLOCK, "block"), (dsl.BUY, "buy"))}
    weights = {name: [compiler.node(weight[k], m).name if k in weight else None for k in range(len(first))] for name, m in (("weight", None), ("weight_yes", True), ("weight_no", False))}
    extra = {k: compiler.node(e, False) for k, e in more.items()}
    frame = compiler.plan.build(frame)
    confirmed, flags = F.col("i"), settled_columns(base)
    if flags:
        frame = frame.select("*", *[F.max(F.when(F.col(c), F.col("i"))).over(L.up_to()).alias(f"last_{c}") for c in flags.values()])
        frame = frame.select("*", *[F.array_min(F.array(*[F.coalesce(f"last_{flags[x]}", F.lit(-1)) for x in sorted(own)])).alias(f"confirmed_{k}") for k, own in daily.items()])
        confirmed = by_kind([f"confirmed_{k}" for k in daily], "int")
    warmups = [tree.warmup(p) for p in first]
    warmup = reduce(lambda c, n: c.when(F.col("kind").isin([k for k, w in enumerate(warmups) if w == n]), n), sorted({*warmups}), F.when(F.lit(False), 0))
    frame = frame.select("*", *[by_kind(names, "boolean").alias(k) for k, names in columns.items()], *[by_kind(names, "double").alias(k) for k, names in weights.items()], F.coalesce(confirmed, F.lit(-1)).alias("confirmed"), warmup.alias("warmup"))
    key, rung = F.when(F.col("confirmed") < F.col("warmup"), "unknown"), F.when(F.col("confirmed") < F.col("warmup"), F.lit(None).cast("int"))
    for k, step in enumerate(ladder.rungs):
        met = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(want)) for c, want in step.when.items()], F.lit(True))
        key, rung = key.when(met, step.key), rung.when(met, k)
    who = [by, F.col("own").alias("product")] if by else ["product"]
    return frame.select(*who, "i", "date", F.col("self_open").alias("open"), F.col("self_close").alias("close"), key.otherwise(ladder.default).alias("key"), rung.alias("rung"), *columns, *weights, "confirmed", "warmup", *[c for k, n in extra.items() for c in ([F.col(n.name).alias(k)] + [F.col(n.name + "_lb").alias(k + "_lb")] * (n.kind == BOUND))])


def with_kinds(frame: DataFrame, tree: dsl.Tree) -> DataFrame:
    """frame with `kind`: which of the tree's kinds of products a row's product is."""
    if len(tree.kinds) == 1:
        return frame.withColumn("kind", F.lit(0))
    table = frame.sparkSession.createDataFrame(list(tree.kind_of.items()), "product string, kind int")
    return frame.join(F.broadcast(table), "product")  # a row for each of the tree's products


def apart(frame: DataFrame, *keys: str) -> DataFrame:
    """frame with `product`, by which windows part, made a struct of the keys and the product's name, which becomes `own`."""
    return frame.withColumn("own", F.col("product")).withColumn("product", F.struct(*keys, "own"))


def by_kind(names: list[str | None], kind: str) -> Column:
    """For each row, the column that is named for its kind of product; null without one."""
    kinds: dict[str, list[int]] = {}
    for k, name in enumerate(names):
        if name is not None:
            kinds.setdefault(name, []).append(k)
    if len(kinds) == 1 and None not in names:
        return F.col(next(iter(kinds)))
    out = None
    for name, own in kinds.items():
        test = F.col("kind").isin(own)
        out = F.when(test, F.col(name)) if out is None else out.when(test, F.col(name))
    return F.lit(None).cast(kind) if out is None else out.cast(kind)


def weight_alternatives(graded: DataFrame) -> DataFrame:
    """graded with `alternatives`: where manual leaves leave the weight unknown, the sorted distinct weights they allow."""
    alt = F.array_sort(F.array_distinct(F.array_compact(F.array("weight_yes", "weight_no"))))
    return graded.withColumn("alternatives", F.when(F.col("weight").isNull() & (F.size(alt) > 0), alt))


def cash_remainder(graded: DataFrame, weighted: list[str]) -> DataFrame:
    """(date, cash): what the weights of the weighted products leave of 100, at least 0; null if one is unknown."""
    rows = graded.where(F.col("product").isin(weighted)).groupBy("date").agg(F.bool_and(F.col("weight").isNotNull()).alias("known"), F.sum("weight").alias("total"))
    return rows.select("date", F.when(F.col("known"), F.greatest(F.lit(0.0), 100 - F.col("total"))).alias("cash"))


def evidence(bars: DataFrame, tree: dsl.Tree, answers: dict | None = None) -> DataFrame:
    """What each part of a product's block and buy conditions is on its last bar: (product, date, path, label, truth, number,
    at_least). path: the gate, then operators and places, such as buy.any[0].gt[1]; truth: of conditions, number: of other
    parts, null where unknown; at_least: whether only a lower bound is known. Manual leaves are unknown unless answered.
    """
    first = [ps[0] for ps in tree.kinds]
    gates = [{"block": tree.gate(p, dsl.BLOCK), "buy": tree.gate(p, dsl.BUY)} for p in first]
    frame, base = calendar(bars, tree.products, [e for g in gates for e in g.values()])
    compiler = Compiler(base, list(tree.products), None, answers)

    def parts(path: str, node: object):
        yield path, node.get("label") if isinstance(node, dict) else None, compiler.node(node)
        for k, x in enumerate(dsl.children(node)):
            yield from parts(f"{path}.{dsl.op_of(node)}[{k}]", x)

    found = [[x for name, e in g.items() for x in parts(name, e)] for g in gates]
    frame = compiler.plan.build(with_kinds(frame, tree))
    last = frame.withColumn("last", F.max("i").over(L.Window.partitionBy("product"))).where("i = last")

    def row(path: str, label: str | None, n: Node) -> Column:
        value, none = F.col(n.name), lambda kind: F.lit(None).cast(kind)
        number = none("double") if n.kind == BOOL else value.cast("double")
        return F.struct(F.lit(path).alias("path"), F.lit(label).cast("string").alias("label"), (value if n.kind == BOOL else none("boolean")).alias("truth"), number.alias("number"), F.coalesce(F.col(n.name + "_lb") if n.kind == BOUND else none("boolean"), F.lit(False)).alias("at_least"))

    rows = None
    for k, own in enumerate(found):
        rows = (F.when if rows is None else rows.when)(F.col("kind") == k, F.array(*[row(*x) for x in own]))
    return last.select("product", "date", F.explode(rows).alias("x")).select("product", "date", "x.*")


def reasons(found: DataFrame, most: int = 3) -> DataFrame:
    """evidence() -> (product, date, gate, met, unknown): of each gate, the labels of its first conditions, in written order,
    that are true, and of those that are unknown; at most so many each."""
    own = found.where(F.col("path").rlike(r"^\w+\.any\[[0-9]+\]$") & F.col("label").isNotNull())
    at = F.struct(F.regexp_extract("path", r"\[([0-9]+)\]$", 1).cast("int").alias("n"), F.col("label"))
    first = lambda test: F.transform(F.slice(F.array_sort(F.collect_list(F.when(test, at))), 1, most), lambda x: x["label"])
    return own.groupBy("product", "date", F.split_part("path", F.lit("."), F.lit(1)).alias("gate")).agg(first(F.col("truth")).alias("met"), first(F.col("truth").isNull()).alias("unknown"))
