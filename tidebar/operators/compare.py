"""Two candidate trees side by side, and checks of one tree's conditions."""

from __future__ import annotations

import json
import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebar.plans import dsl
from tidebar.plans.compile import evaluate


def disagreements(a: DataFrame, b: DataFrame, column: str = "key") -> DataFrame:
    """(product, i, date, a, b, same) for the days of both."""
    return a.select("product", "i", "date", F.col(column).alias("a")).join(b.select("product", "i", F.col(column).alias("b")), ["product", "i"]).withColumn("same", F.col("a").eqNullSafe(F.col("b")))


def agreement(days: DataFrame) -> DataFrame:
    return days.groupBy("product").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("same")).cast("long")).alias("differ"), F.avg(F.col("same").cast("double")).alias("agreement"))


SECTIONS = {"block": ("opt_block", "pes_block"), "buy": ("opt_buy", "pes_buy"), "weight": ("weight",), "grade": ("key",)}


def sections(a: DataFrame, b: DataFrame) -> DataFrame:
    """(product, section, i, date, same) of two trees' decisions: block and buy in both views, the weight, and the grade."""
    columns = sorted({c for v in SECTIONS.values() for c in v})
    both = a.select("product", "i", "date", *columns).join(b.select("product", "i", *[F.col(c).alias(f"b_{c}") for c in columns]), ["product", "i"])
    same = lambda names: reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"b_{c}")) for c in names])
    found = F.explode(F.array(*[F.struct(F.lit(k).alias("section"), same(v).alias("same")) for k, v in SECTIONS.items()])).alias("x")
    return both.select("product", "i", "date", found).select("product", "x.section", "i", "date", "x.same")


def behaviour_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """values (product, i, label, value) of two trees -> (product, a, b): labels that agree on all days, and are known on one."""
    x, y = a.select("product", "i", F.col("label").alias("a"), F.col("value").alias("va")), b.select("product", "i", F.col("label").alias("b"), F.col("value").alias("vb"))
    pairs = x.join(y, ["product", "i"]).groupBy("product", "a", "b").agg(F.bool_and(F.col("va").eqNullSafe(F.col("vb"))).alias("same"), F.bool_or(F.col("va").isNotNull()).alias("known"))
    return pairs.where("same and known").select("product", "a", "b")


def sample(days: DataFrame, per: int) -> DataFrame:
    """Of each product's disagreeing days, `per` at even distance."""
    w = Window.partitionBy("product")
    rows = days.where("not same").select("*", F.row_number().over(w.orderBy("i")).alias("rn"), F.count(F.lit(1)).over(w).alias("of"))
    step = F.greatest(F.lit(1), F.floor(F.col("of") / per))
    return rows.where(((F.col("rn") - 1) % step == 0) & ((F.col("rn") - 1) / step < per)).drop("rn", "of")


def long(evaluated: DataFrame, labels: list[str]) -> DataFrame:
    """(product, i, label, value) of boolean columns."""
    return evaluated.select("product", "i", F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(k).alias("value")) for k in labels])).alias("x")).select("product", "i", "x.*")


def fire_rates(values: DataFrame) -> DataFrame:
    """How often each condition is true and unknown, and what that flags."""
    out = values.groupBy("product", "label").agg(F.count(F.lit(1)).alias("days"), F.sum(F.coalesce(F.col("value").cast("long"), F.lit(0))).alias("fired"), F.sum(F.col("value").isNull().cast("long")).alias("unknown"))
    flag = F.when(F.col("unknown") == F.col("days"), "always unknown").when(F.col("fired") == 0, "never").when(F.col("fired") > 0.95 * F.col("days"), "nearly always").when(F.col("unknown") > 0.05 * F.col("days"), "often unknown")
    return out.withColumn("flag", flag)


def implications(values: DataFrame) -> DataFrame:
    """(product, a, b, same, implies): pairs of conditions that agree on all days, or where a true has b true."""
    a, b = values.select("product", "i", F.col("label").alias("a"), F.col("value").alias("va")), values.select("product", "i", F.col("label").alias("b"), F.col("value").alias("vb"))
    pairs = a.join(b, ["product", "i"]).where("a <> b").groupBy("product", "a", "b").agg(F.bool_and(F.col("va").eqNullSafe(F.col("vb"))).alias("same"), F.bool_and(~F.coalesce("va", F.lit(False)) | F.coalesce("vb", F.lit(False))).alias("implies"))
    return pairs.where("same or implies")


def weight_overflow(weights: DataFrame) -> DataFrame:
    """(date, total) of days whose weights exceed 100; one that manual leaves leave open counts as the most they allow."""
    most = F.coalesce("weight", F.greatest("weight_yes", "weight_no"))  # greatest passes over nulls
    return weights.groupBy("date").agg(F.sum(most).alias("total")).where("total > 100 + 1e-9")


def pair_rules(a: dsl.Tree, b: dsl.Tree, product: str) -> tuple[set, set, set]:
    """Canonical keys of the product's expressions that both trees, only a, and only b have."""
    x, y = ({(do, dsl.logic_key(e)) for do, _, e in t.expressions(product)} for t in (a, b))
    return x & y, x - y, y - x


def duplicates(tree: dsl.Tree, product: str) -> list[list[str]]:
    """Labels of rules that mean the same."""
    by: dict = {}
    for do, label, e in tree.expressions(product):
        by.setdefault((do, dsl.logic_key(e)), []).append(label)
    return [v for v in by.values() if len(v) > 1]


def features(node: object) -> Counter:
    """How often each operator stands in a condition, with the numbers and fields beside it but whatever the symbols."""
    found: Counter = Counter()
    for n in dsl.walk(node):
        op = dsl.op_of(n)
        found[op, n[op] if isinstance(n[op], str) else tuple(x for x in (n[op] if isinstance(n[op], list) else [n[op]]) if dsl.is_number(x))] += 1
    return found


def unlikeness(x: object, y: object) -> float:
    """0 for conditions of one meaning, up to 1 for those without a feature in common; a shared label halves it."""
    if dsl.logic_key(x) == dsl.logic_key(y):
        return 0.0
    a, b = features(x), features(y)
    apart = 1 - 2 * (a & b).total() / max(1, a.total() + b.total())
    named = isinstance(x, dict) and isinstance(y, dict) and x.get("label") and x.get("label") == y.get("label")
    return max(apart, 1e-6) / (2 if named else 1)


def align(xs: list, ys: list) -> list[tuple]:
    """The pairing of two lists of conditions with the least sum of unlikeness: (x, y), (x, None) and (None, y).

    An x or y without a partner counts hardly less than one half, so what has nothing in common is not paired. Found by shortest augmenting
    paths: one x after the other gets a place, and others move where that is cheaper for all.
    """
    n, m = len(xs), len(ys)
    # one further place for each x, where it stays alone
    cost = [[unlikeness(x, y) - 0.5 for y in ys] + [0.5 - 1e-9 if k == j else math.inf for j in range(n)] for k, x in enumerate(xs)]
    row_price, place_price, owner = [0.0] * n, [0.0] * (n + m), [None] * (n + m)
    for new in range(n):
        reach, back, done, at, place = [math.inf] * (n + m), [None] * (n + m), set(), new, None
        while at is not None:
            base = 0.0 if place is None else reach[place]
            for j in set(range(n + m)) - done:
                step = base + cost[at][j] - row_price[at] - place_price[j]
                if step < reach[j]:
                    reach[j], back[j] = step, place
            place = min(set(range(n + m)) - done, key=lambda j: reach[j])
            done.add(place)
            at = owner[place]
        for j in done - {place}:
            row_price[owner[j]] += reach[place] - reach[j]
            place_price[j] -= reach[place] - reach[j]
        row_price[new] += reach[place]
        while place is not None:
            owner[place] = new if back[place] is None else owner[back[place]]
            place = back[place]
    mate = {k: j for j, k in enumerate(owner[:m]) if k is not None}
    return [(x, ys[mate[k]] if k in mate else None) for k, x in enumerate(xs)] + [(None, y) for j, y in enumerate(ys) if owner[j] is None]


def condition_pairs(bars: DataFrame, a: dsl.Tree, b: dsl.Tree) -> DataFrame:
    """How two trees' conditions differ on the days: (product, gate, a, b, same_meaning, days, differ).

    Of each product that both have, the conditions that block or buy are paired by meaning and likeness. a and b are labels,
    null for one without a partner; differ: the days on which the two values differ, or on which a lone one isn't false.
    """
    names: dict[str, str] = {}
    exprs: dict[str, object] = {}

    def name(node: object) -> str | None:
        if node is None:
            return None
        key = dsl.logic_key(node)
        if key not in names:
            names[key] = f"c{len(names)}"
            exprs[names[key]] = node
        return names[key]

    made: dict[tuple, list] = {}
    rows = []
    for p in a.products:
        if p in b.products:
            kind = a.kind_of[p], b.kind_of[p]
            if kind not in made:
                made[kind] = [(word, x, y) for do, word in ((dsl.BLOCK, "block"), (dsl.BUY, "buy")) for x, y in align(a.gate(p, do)["any"], b.gate(p, do)["any"])]
            label = lambda n: n.get("label") if isinstance(n, dict) else None
            rows += [(p, gate, label(x), label(y), name(x), name(y), x is not None and y is not None and name(x) == name(y)) for gate, x, y in made[kind]]
    pairs = bars.sparkSession.createDataFrame(rows, "product string, gate string, a string, b string, of_a string, of_b string, same_meaning boolean")
    shared = {p: v for p, v in a.products.items() if p in b.products}
    values = evaluate(bars, shared, exprs)
    held = values.select("product", "i", F.create_map(*[x for k in exprs for x in (F.lit(k), F.col(k))]).alias("v"))
    met = held.join(F.broadcast(pairs), "product")  # a few rows for each product of the trees
    of = lambda c: F.when(F.col(c).isNotNull(), F.col("v")[F.col(c)]).when(F.col(c).isNull(), False)
    return met.groupBy("product", "gate", "a", "b", "same_meaning").agg(F.count(F.lit(1)).alias("days"), F.sum((~of("of_a").eqNullSafe(of("of_b"))).cast("long")).alias("differ"))


def manual_heads(tree: dsl.Tree, heads: tuple[str, ...]) -> dict[str, int]:
    """How many distinct manual reasons begin with each head and a colon; "" counts those of none."""
    found = {dsl.manual_key(n): n for p in tree.products for _, _, e in tree.expressions(p) for n in dsl.walk(e) if dsl.is_manual(n)}
    out: dict[str, int] = {}
    for n in found.values():
        head = next((h for h in heads if str(n.get("manual", "")).startswith(f"{h}:")), "")
        out[head] = out.get(head, 0) + 1
    return out


def unjudged(tree: dsl.Tree, a: dsl.Tree, b: dsl.Tree) -> list[tuple[str, str]]:
    """(label, side) of the tree's rules that the two candidates don't both have and that give no `why`; side: a, b or new."""
    keys = lambda t: {r["label"]: json.dumps([[x.get("do"), dsl.logic_key(t.expand(x.get("when"), value=r.get("value"))), x.get("qty")] for x in r.get("then") or []], sort_keys=True, ensure_ascii=False) for r in t.rules if "then" in r}
    in_a, in_b = set(keys(a).values()), set(keys(b).values())
    side = {label: "both" if k in in_a and k in in_b else "a" if k in in_a else "b" if k in in_b else "new" for label, k in keys(tree).items()}
    return [(r["label"], side[r["label"]]) for r in tree.rules if side.get(r["label"], "both") != "both" and not r.get("why")]


def lint(tree: dsl.Tree, head: str = "", mark: str = "") -> list[tuple[str, str]]:
    """(what, label) of what an author should look at, each once: a price of an `unknown symbol`; a `nameless` manual leaf; an
    `unclassified` one, whose sentence begins with `head` while neither it nor its label holds `mark`; an `ambiguous` label
    of several meanings; `duplicates`, the labels of rules of one kind that mean the same."""
    found, meanings = [], {}
    for p in (ps[0] for ps in tree.kinds):
        for _, rule, e in tree.expressions(p):
            for n in dsl.walk(e):
                label = n.get("label")
                if n.get("sym") == dsl.UNKNOWN:
                    found.append(("unknown symbol", rule))
                if dsl.is_manual(n) and not label:
                    found.append(("nameless", dsl.manual_key(n)))
                said = n.get("manual")
                if head and said and said.startswith(head) and mark not in f"{said} {label or ''}":
                    found.append(("unclassified", label or said))
                if label:
                    meanings.setdefault(label, set()).add(dsl.logic_key(n))
        found += [("duplicates", ", ".join(labels)) for labels in duplicates(tree, p)]
    found += [("ambiguous", label) for label, keys in meanings.items() if len(keys) > 1]
    return list(dict.fromkeys(found))


def uncovered(spark, tree: dsl.Tree, shown: DataFrame) -> DataFrame:
    """shown (label, do, n: how many of the rule's branches for that verb a screen has) -> (label, do, nth, kind) of what it
    lacks: `branch`, counted from 0; `skip` for rules that could not be written; `name` for named conditions that no other
    rule uses."""
    used = {n["rule"] for r in tree.rules for n in _mentions([r.get("value"), r.get("then")])}
    rows = [(r["label"], b["do"], sum(x["do"] == b["do"] for x in r["then"][:k]), "branch") for r in tree.rules for k, b in enumerate(r.get("then") or [])]
    rows += [(r["label"], None, 0, "skip" if "skip" in r else "name") for r in tree.rules if "skip" in r or "then" not in r and r["label"] not in used]
    table = spark.createDataFrame(rows, "label string, do string, nth int, kind string")
    count = shown.groupBy("label", "do").agg(F.sum("n").alias("n"))
    met = table.join(count, (table["label"] == count["label"]) & table["do"].eqNullSafe(count["do"]), "left").select(table["*"], F.coalesce("n", F.lit(0)).alias("n"))
    return met.where("nth >= n").drop("n")


def _mentions(x: object):
    """Nodes that stand for a named condition."""
    if isinstance(x, dict) and set(x) - set(dsl.META) == {"rule"}:
        yield x
    for y in x.values() if isinstance(x, dict) else x if isinstance(x, list) else ():
        yield from _mentions(y)


def outcome(decided: DataFrame) -> DataFrame:
    """decided with opt and pes: block, buy or wait as each view has it; null where a view leaves it open."""
    of = lambda v: F.when(F.col(f"{v}_block"), "block").when(~F.col(f"{v}_block") & F.col(f"{v}_buy"), "buy").when(~F.col(f"{v}_block") & ~F.col(f"{v}_buy"), "wait")
    return decided.select("*", of("opt").alias("opt"), of("pes").alias("pes"))


def scenario_results(decided: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (product, date, expect[, pct]) against the decisions of their days: match, match if confirmed, mismatch or
    not reproducible; a weight asked for must be the known one, or one of those that manual leaves allow."""
    rows = wanted.join(outcome(decided), ["product", "date"], "left")
    seen = F.array_distinct(F.array_compact(F.array("opt", "pes")))
    return rows.select("product", "date", "expect", "pct", verdict(seen).alias("result"))


def verdict(seen: Column) -> Column:
    """What a scenario's `expect` and `pct` say of the outcomes seen, and of the weight."""
    weight = F.when(F.col("weight").isNotNull(), F.abs(F.col("weight") - F.col("pct")) <= 1e-6).otherwise(F.coalesce(F.array_contains(F.array_compact(F.array("weight_yes", "weight_no")), F.col("pct")), F.lit(False)))
    wrong = F.col("pct").isNotNull() & (F.col("expect") == "buy") & ~F.coalesce(weight, F.lit(False))
    return F.when(wrong, "mismatch").when(F.size(seen) == 0, "not reproducible").when(seen == F.array("expect"), "match").when(F.array_contains(seen, F.col("expect")), "match if confirmed").otherwise("mismatch")
