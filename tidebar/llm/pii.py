"""Personal data by weak supervision, in DataFrame operations only.

Base spans come from exact patterns and always stay. Looser patterns add candidate spans. Labelers vote on every span:
the form (regular expression), a gazetteer (domains, calling codes, issuers' ranges and lengths, reserved ranges), and
three of the context before it (words of its kind, words against it, a label with a colon). Expectation-maximisation over
the counts of vote patterns estimates each labeler's reliability; the patterns' posteriors then train a naive-Bayes span
classifier on discrete features, which decides on the added spans. Vote patterns and feature values are few by
construction, whatever the input: only their counts reach the driver.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import cut

#: Base kinds in their order. The look-behinds let a match begin only at the start of a run or where the
#: last match ended, which finds the same leftmost matches in linear time.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Patterns of the kinds that the classifier may add.
ADDED = {
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])",
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "spelled_email": r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]++ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]++ ?[\[(](?:dot|DOT)[\])] ?[A-Za-z]{2,10}",
}
#: What a text must hold for a pattern to be tried.
HINTS = {
    "email": lambda t: F.contains(t, F.lit("@")), "phone": lambda t: F.contains(t, F.lit("+")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
    "local_phone": lambda t: t.rlike(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"), "national_id": lambda t: t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}"),
    "spelled_email": lambda t: t.rlike(r"[\[(](?:at|AT)[\])]"),
}
#: Top-level domains; country calling codes; card issuers' leading digits and lengths; reserved addresses;
#: area codes and numbers that are never issued.
DOMAINS = (
    "com org net edu gov mil int info biz io ai app dev co me tv cc name pro online site shop tech store cloud blog xyz us uk ca au nz ie in za sg hk "
    "de at ch fr be nl lu it es pt gr pl cz sk hu ro bg hr si rs ua ru by se no dk fi is ee lv lt tr il ae sa eg ma ng ke br ar cl mx pe jp kr cn tw th vn id my ph eu"
)
CALLING_CODES = "1|7|2[07]|2[1-689][0-9]|3[0-469]|3[578][0-9]|4[013-9]|42[0-9]|5[1-8]|5[09][0-9]|6[0-6]|6[7-9][0-9]|8[1246]|8[0578][0-9]|9[0-58]|9[679][0-9]"
ISSUERS = "4[0-9]{12}(?:[0-9]{3}){0,2}|(?:5[1-5]|222[1-9]|22[3-9][0-9]|2[3-6][0-9]{2}|27[01][0-9]|2720)[0-9]{12,14}|3[47][0-9]{13}|3(?:0[0-5]|[689][0-9])[0-9]{11,16}|6(?:011|4[4-9][0-9]|5[0-9]{2})[0-9]{12,15}|35(?:2[89]|[3-8][0-9])[0-9]{12,15}|62[0-9]{14,17}|(?:5[06789]|6[037])[0-9]{12,17}"
RESERVED = r"0+\.|127\.|255\.|2(?:2[4-9]|3[0-9]|4[0-9]|5[0-5])\."
_DOMAIN = r"(?i)\b(?:" + "|".join(DOMAINS.split()) + ")$"
GAZETTEER = {
    "email": _DOMAIN, "spelled_email": _DOMAIN, "ip": f"^(?!{RESERVED})", "card": f"^(?:{ISSUERS})$", "phone": rf"^\+[^0-9]*(?:{CALLING_CODES})",
    "local_phone": r"^\(?[2-9](?!11)[0-9]{2}\)?[ .-][2-9](?!11)[0-9]{2}", "national_id": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
}
#: Words before a span that speak for its kind, and words that speak against any.
FOR_WORDS = {
    "email": r"e-?mail|mail|contact|write|reach|send|reply|address|from|to", "spelled_email": r"e-?mail|mail|contact|write|reach|send|reply|address|from|to",
    "ip": r"ip|address|host|server|client|login|connected|peer|gateway|from", "card": r"card|visa|mastercard|amex|credit|debit|payment|pay|charged?|account",
    "phone": r"phone|tel|telephone|call|mobile|cell|fax|contact|dial|ring|whatsapp|at|or", "local_phone": r"phone|tel|telephone|call|mobile|cell|fax|contact|dial|ring|whatsapp|at",
    "national_id": r"ssn|social|security|identity|id|taxpayer|tax",
}
AGAINST_WORDS = r"version|isbn|issn|doi|order|invoice|serial|part|model|build|release|ticket|lot|section|page|figure|table|chapter|sku|item"
KINDS = [*PATTERNS, *ADDED]
FEATURES = "kind", "length", "digits", "before", "after", "context", "label"
LABELERS = "form", "listed", "said", "against", "label"
SPANS = "array<struct<start:int,k:int,end:int,kind:string,m:string,left:string,right:string>>"


def bound(c: Column, use) -> Column:
    """use(c), with c evaluated once, wherever `use` names it."""
    return F.transform(F.array(c), use)[0]


def scan(items: Column, start: Column, step, emit, kind: str) -> Column:
    """array<kind> of emit(state, item) for each item, where state is step(state, item) of the items before it.

    In two levels, since an array grows by copying: blocks of about sqrt(n) items, then the blocks.
    """
    none = F.array().cast(f"array<{kind}>")

    def over(items: Column) -> Column:
        n = F.size(items)
        width = F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / width).cast("int")), lambda k: F.slice(items, k * width + 1, width))
        add = lambda a, x: F.struct(step(a["state"], x).alias("state"), F.concat(a["out"], F.array(emit(a["state"], x))).alias("out"))
        inner = lambda state, block: F.aggregate(block, F.struct(state.alias("state"), none.alias("out")), add)
        join = lambda a, block: bound(inner(a["state"], block), lambda r: F.struct(r["state"].alias("state"), F.concat(a["outs"], F.array(r["out"])).alias("outs")))
        return F.flatten(F.aggregate(blocks, F.struct(start.alias("state"), F.array().cast(f"array<array<{kind}>>").alias("outs")), join)["outs"])

    return bound(items, lambda x: F.when(F.size(x) > 0, over(x)).otherwise(none))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, m, left, right>> of the pattern's leftmost non-overlapping matches; start and end in code
    points; left: up to 40 characters before, of the gap and the match before it; right: one character after."""
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    last = lambda c, n: F.right(F.coalesce(c, F.lit("")), F.lit(n))
    around = lambda b: F.transform(b["found"], lambda m, i: F.struct(
        F.length(F.get(b["gaps"], i)).alias("gap"), F.length(m).alias("n"), m.alias("m"), last(F.concat(last(F.get(b["found"], i - 1), 40), last(F.get(b["gaps"], i), 40)), 40).alias("left"),
        F.left(F.concat(F.left(F.get(b["gaps"], i + 1), F.lit(1)), F.coalesce(F.left(F.get(b["found"], i + 1), F.lit(1)), F.lit(""))), F.lit(1)).alias("right"),
    ))
    emit = lambda at, x: F.struct((at + x["gap"]).alias("start"), (at + x["gap"] + x["n"]).alias("end"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))
    return scan(bound(both, around), F.lit(0), lambda at, x: at + x["gap"] + x["n"], emit, "struct<start:int,end:int,m:string,left:string,right:string>")


def apart(more: Column, base: Column) -> Column:
    """The spans of `more` that overlap none of `base`: by the furthest end of base spans before, and the next start after."""
    of = lambda x, added: F.struct(x["start"].alias("start"), F.lit(added).alias("added"), x["end"].alias("end"), x["k"].alias("k"), x["kind"].alias("kind"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right"))
    item = "struct<start:int,added:int,end:int,k:int,kind:string,m:string,left:string,right:string>"
    both = F.array_sort(F.concat(F.transform(base, lambda x: of(x, 0)), F.transform(more, lambda x: of(x, 1))))
    with_state = lambda state, x: F.struct(x.alias("x"), state.alias("edge"))
    before = scan(both, F.lit(0), lambda e, x: F.when(x["added"] == 0, F.greatest(e, x["end"])).otherwise(e), with_state, f"struct<x:{item},edge:int>")
    free = F.transform(F.filter(before, lambda p: (p["x"]["added"] == 0) | (p["edge"] <= p["x"]["start"])), lambda p: p["x"])
    after = scan(F.reverse(free), F.lit(2**31 - 1), lambda e, x: F.when(x["added"] == 0, x["start"]).otherwise(e), with_state, f"struct<x:{item},edge:int>")
    kept = F.filter(after, lambda p: (p["x"]["added"] == 1) & (p["edge"] >= p["x"]["end"]))
    out = F.reverse(F.transform(kept, lambda p: F.struct(*[p["x"][c].alias(c) for c in ("start", "k", "end", "kind", "m", "left", "right")])))
    return F.when((F.size(more) > 0) & (F.size(base) > 0), out).otherwise(more)


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5)))
    return F.aggregate(each, F.lit(0).cast("long"), lambda a, d: a + F.coalesce(d.cast("long"), F.lit(0))) % 10 == 0


def valid(kind: str, m: Column) -> Column:
    """Whether a match of a base kind counts."""
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(m, r"\."), lambda p: F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255)
    if kind == "card":
        return F.length(digits(m)).between(14, 19) & luhn(digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(10, 15)
    return F.lit(True)


def _spans(text: Column, kind: str, pattern: str) -> Column:
    """array<struct<start, k, end, kind, m, left, right>> of valid matches; k: the kind's rank."""
    kept = F.filter(matches(text, pattern), lambda x: valid(kind, x["m"]))
    out = F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"), x["left"].alias("left"), x["right"].alias("right")))
    return F.when(HINTS[kind](text), out).otherwise(F.array().cast(SPANS))


def _shape(c: Column) -> Column:
    return F.when(F.length(c) == 0, "edge").when(c.rlike(r"\s"), "space").when(c.rlike("[0-9]"), "digit").when(c.rlike("[A-Za-z]"), "letter").otherwise("mark")


def _by_kind(x: Column, use) -> Column:
    return reduce(lambda c, kind: c.when(x["kind"] == kind, use(kind)), KINDS, F.when(F.lit(False), False))


def _said(x: Column) -> Column:
    return _by_kind(x, lambda kind: x["left"].rlike(rf"(?i)\b(?:{FOR_WORDS[kind]})\b"))


def _against(x: Column) -> Column:
    return x["left"].rlike(rf"(?i)\b(?:{AGAINST_WORDS})\b")


def _label(x: Column) -> Column:
    return x["left"].rlike(r"[A-Za-z][\"']?\s*[:=]\s*[\"']?$")


def _features(x: Column) -> dict[str, Column]:
    n = F.length(digits(x["m"]))
    return {
        "kind": x["kind"], "length": F.least(F.floor(F.length(x["m"]) / 4), F.lit(12)).cast("string"), "digits": F.least(n, F.lit(20)).cast("string"),
        "before": _shape(F.right(x["left"], F.lit(1))), "after": _shape(x["right"]), "context": F.when(_against(x), "against").when(_said(x), "for").otherwise("none"), "label": _label(x).cast("string"),
    }


def _votes(x: Column) -> Column:
    """struct of the labelers' votes, each 1 (personal data), -1 (not) or 0 (abstains)."""
    form = F.when(x["kind"] == "ip", 0).when(x["kind"] == "email", F.when(x["m"].rlike(r"\.[A-Za-z]{2,}$"), 1).otherwise(-1)).when(_shape(x["right"]).isin("digit", "letter"), -1).otherwise(1)
    listed = _by_kind(x, lambda kind: (digits(x["m"]) if kind == "card" else x["m"]).rlike(GAZETTEER[kind]))
    votes = form, F.when(listed, 1).otherwise(-1), F.when(_said(x), 1).otherwise(0), F.when(_against(x), -1).otherwise(0), F.when(_label(x), 1).otherwise(0)
    return F.struct(*[v.cast("int").alias(n) for n, v in zip(LABELERS, votes, strict=True)])


def expectation_maximisation(counts: dict[tuple[int, ...], float], rounds: int = 50) -> dict[tuple[int, ...], float]:
    """Vote pattern -> count, to vote pattern -> probability of personal data; labelers are independent given the class."""
    if not counts:
        return {}
    width = len(next(iter(counts)))
    post = {p: 1 / (1 + math.exp(-sum(p) - 0.5)) for p in counts}
    for _ in range(rounds):
        yes, no = 1.0 + sum(c * post[p] for p, c in counts.items()), 1.0 + sum(c * (1 - post[p]) for p, c in counts.items())
        rate = [{v: ((1 + sum(c * post[p] for p, c in counts.items() if p[i] == v)) / (yes + 2), (1 + sum(c * (1 - post[p]) for p, c in counts.items() if p[i] == v)) / (no + 2)) for v in (-1, 0, 1)} for i in range(width)]
        post = {p: 1 / (1 + math.exp(-(math.log(yes / no) + sum(math.log(rate[i][v][0] / rate[i][v][1]) for i, v in enumerate(p))))) for p in counts}
    return post


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows as (id, spans array<struct<start, k, end, kind, base>>), ordered by start, then kind.

    Offsets are code points, end exclusive. Base spans (email, ip, card, phone) are exactly the patterns' valid matches;
    added ones don't overlap a base span. Null text counts as empty; repeated rows come back repeated; further columns
    are ignored; an empty table gives no rows, one without spans learns nothing and adds nothing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = reduce(F.concat, [_spans(text, k, p) for k, p in PATTERNS.items()])
    more = reduce(F.concat, [_spans(text, k, p) for k, p in ADDED.items()])
    found = docs.select(F.col(id_col).alias("id"), bound(F.struct(base.alias("base"), more.alias("more")), lambda f: F.struct(f["base"].alias("base"), apart(f["more"], f["base"]).alias("more"))).alias("f"))
    found = cut(found.select("id", "f.base", "f.more"), "span-candidates")
    each = found.select(F.explode(F.concat("base", "more")).alias("x"))
    voted = each.select("x", _votes(F.col("x")).alias("v"))
    counts = {tuple(r["v"]): r["count"] for r in voted.groupBy("v").count().collect()}
    post = expectation_maximisation(counts)
    chance = reduce(lambda c, kv: c.when(reduce(lambda a, b: a & b, [F.col(f"v.{n}") == x for n, x in zip(LABELERS, kv[0], strict=True)]), kv[1]), post.items(), F.when(F.lit(False), 0.5)).otherwise(0.5)
    seen = voted.select(F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), c.alias("value")) for n, c in _features(F.col("x")).items()])).alias("f"), chance.alias("p"))
    table = seen.groupBy("f.feature", "f.value").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()
    total = sum(r["yes"] for r in table if r["feature"] == "kind"), sum(r["no"] for r in table if r["feature"] == "kind")
    odds = {(r["feature"], r["value"]): math.log((r["yes"] + 1) / (total[0] + 2)) - math.log((r["no"] + 1) / (total[1] + 2)) for r in table}
    prior = math.log((total[0] + 1) / (total[1] + 1))

    def score(x: Column) -> Column:
        known = _features(x)
        per = [reduce(lambda c, kv, f=f: c.when(known[f] == kv[0], kv[1]), [(v, o) for (g, v), o in odds.items() if g == f], F.when(F.lit(False), 0.0)).otherwise(0.0) for f in FEATURES]
        return reduce(add, per) + F.lit(prior)

    out = lambda name, is_base: F.transform(name, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(is_base).alias("base")))
    accepted = F.when(F.size("more") > 0, F.filter("more", lambda x: score(x) > 0)).otherwise(F.col("more"))
    return found.withColumn("more", accepted).select(F.col("id").alias(id_col), F.array_sort(F.concat(out("base", True), out("more", False))).alias("spans"))
