"""Live decisions: micro-batches of bars and atoms are merged into a store, and only what they change is judged again."""

from __future__ import annotations

import hashlib
import json
import logging
from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.operators.latest import summed_up
from tidebar.plans import dsl
from tidebar.plans.compile import decisions
from tidebar.sources import bars as S

BARS = "sym string, date string, open double, high double, low double, close double, volume double"
ATOMS = "sym string, ts timestamp, open double, high double, low double, close double, volume double"
ATOM_DAYS = 7  # atoms older than this before the newest one are forgotten, and refused where they arrive so late
WARMUP_DAYS = 500  # history that is asked for before the first day of interest
VERDICT = """book string, product string, date string, close double, change double, key string, weight double, alternatives array<double>, confirmed int, warmup int,
holdings array<struct<n:int,entry_date:string,ret:double,days:double,sells:array<struct<label:string,hit:boolean>>,next_tranche:struct<label:string,hit:boolean>>>, error string, judged long"""
EMPTY = {"bars": {}, "atoms": {}, "newest": None, "verdicts": None, "loaded": None, "loaded_atoms": None, "books": {}, "positions": {}}
log = logging.getLogger("tidebar")


class Hub:
    """Bars, atoms, wanted history and current verdicts of some books below one shared path.

    A batch has rows of BARS with `arrived`, and rows of atoms where it has a column `ts` that isn't null. Of each
    (sym, date) or (sym, ts) the row that arrived last counts. Batch n writes the months of bars, and days of atoms, in
    which a row differs from the store; then it judges the products whose symbols changed, and all products of a book whose
    tree or positions file changed in content. Each book that has such products gets one event, with a verdict for every
    product: new ones, and those kept from earlier batches.

    The last thing that a batch writes is its commit, a line of JSON that names the newest folder of everything. A reader
    sees the newest complete commit; a replay of batch n starts from the newest commit below n and writes the same again.
    Two commits, and what they name, are kept. A path goes with one checkpoint, whose restart goes on from the last commit.

    books: trees by name, or paths of tree files, which are read again at each batch; a tree that can't be read gives an
    event with `error` and no verdicts. positions: paths of positions files by book. fetch(symbols, start): bars of a
    DataFrame of symbols from a day on; symbols that the books need are fetched once, and again where an earlier start is
    wanted; fetch_atoms(symbols, start): the same for atoms of the last seven days. now: the clock, read once per batch;
    sessions: (sym, date, close_utc), or a function of bars that gives them, from which settling follows. every: whether
    products without a bar have a verdict too, `unknown`.
    """

    def __init__(self, spark: SparkSession, path: str, books: dsl.Tree | dict[str, dsl.Tree | str], publish: Callable[[DataFrame], None] | None = None, positions: dict[str, str] | None = None,
                 fetch: Callable[[DataFrame, str], DataFrame] | None = None, now: Callable[[], datetime] | None = None, sessions: DataFrame | Callable[[DataFrame], DataFrame] | None = None, extra_days: int = 0,
                 fetch_atoms: Callable[[DataFrame, str], DataFrame] | None = None, every: bool = False):
        self.spark, self.path = spark, path
        self.sources = {"book": books} if isinstance(books, dsl.Tree) else dict(books)
        self.positions, self.fetch, self.now, self.sessions, self.extra_days = positions or {}, fetch, now, sessions, extra_days
        self.fetch_atoms, self.every, self.observers = fetch_atoms, every, [publish] if publish else []

    def _closes(self, bars: DataFrame) -> DataFrame | None:
        return self.sessions(bars) if callable(self.sessions) else self.sessions

    # commits

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def commits(self) -> list[int]:
        fs, p = self._fs(f"{self.path}/commits/batch=*/_SUCCESS")
        return sorted(int(s.getPath().getParent().getName()[6:]) for s in fs.globStatus(p) or [])

    def state(self, below: int | None = None) -> dict:
        """What the newest commit, or that below a number, names."""
        some = [n for n in self.commits() if below is None or n < below]
        held = json.loads(self.spark.read.text(f"{self.path}/commits/batch={some[-1]}").first()[0]) if some else {}
        return json.loads(json.dumps(EMPTY)) | held

    def _commit(self, number: int, state: dict) -> None:
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/commits/batch={number}")
        before = self.state(number)
        for n in [n for n in self.commits() if n < number][:-1]:  # mostly one
            old = self.state(n + 1)
            for kind, part in (("bars", "month"), ("atoms", "day")):
                for name, at in old[kind].items():
                    if at not in (state[kind].get(name), before[kind].get(name)):
                        self._delete(f"{self.path}/{kind}/batch={at}/{part}={name}")
            for kind in ("verdicts", "loaded", "loaded_atoms"):
                if old.get(kind) not in (None, state[kind], before.get(kind)):
                    self._delete(f"{self.path}/{kind}/batch={old[kind]}")
            self._delete(f"{self.path}/commits/batch={n}")

    def _delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)
        if (parent := p.getParent()).getName().startswith("batch=") and not any(s.isDirectory() for s in fs.listStatus(parent)):
            fs.delete(parent, True)

    def _stored(self, kind: str, schema: str, part: str, held: dict[str, int]) -> DataFrame:
        if not held:
            return self.spark.createDataFrame([], schema)
        paths = [f"{self.path}/{kind}/batch={n}/{part}={name}" for name, n in sorted(held.items())]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(*paths).select(*[f.split(" ")[0] for f in schema.split(", ")])

    # what is stored

    def bars(self, below: int | None = None) -> DataFrame:
        return self._stored("bars", BARS, "month", self.state(below)["bars"])

    def atoms(self, below: int | None = None) -> DataFrame:
        return self._stored("atoms", ATOMS, "day", self.state(below)["atoms"])

    def verdicts(self, below: int | None = None) -> DataFrame:
        """The current verdict of each book and product."""
        n = self.state(below)["verdicts"]
        return self.spark.createDataFrame([], VERDICT) if n is None else self.spark.read.schema(VERDICT).parquet(f"{self.path}/verdicts/batch={n}")

    def loaded(self, below: int | None = None, kind: str = "loaded") -> DataFrame:
        """(sym, start): history that was fetched; of atoms, where kind is loaded_atoms."""
        n = self.state(below)[kind]
        schema = "sym string, start string"
        return self.spark.createDataFrame([], schema) if n is None else self.spark.read.schema(schema).parquet(f"{self.path}/{kind}/batch={n}")

    def requests(self) -> DataFrame:
        """(sym, start, batch): all bars that were ever asked for."""
        return self.spark.read.schema("sym string, start string, batch long").parquet(f"{self.path}/requests").select("sym", "start", "batch")

    def events(self) -> DataFrame:
        """The verdicts that each batch gave anew."""
        return self.spark.read.parquet(f"{self.path}/events").drop("part")

    # a batch

    def _merged(self, kind: str, schema: str, part: str, of: Column, rows: DataFrame, held: dict[str, int], number: int) -> list[str]:
        """Write the parts of the store in which one of the rows differs from what is held; the names of these parts."""
        own = rows.withColumn(part, of)
        names = [r[0] for r in own.select(part).distinct().collect()]  # months or days of one tick or backfill
        old = self._stored(kind, schema, part, {k: n for k, n in held.items() if k in names})
        new = own.join(old.withColumn("same", F.lit(True)), [own[c].eqNullSafe(old[c]) for c in old.columns], "left_anti")
        touched = [r[0] for r in new.select(part).distinct().collect()]
        if touched:
            old = self._stored(kind, schema, part, {k: n for k, n in held.items() if k in touched}).withColumn(part, of)
            key = "date" if kind == "bars" else "ts"
            S.upsert(old, new.select(*old.columns), key).repartition(part).write.partitionBy(part).mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")
        return touched

    def _changed(self, kind: str, schema: str, part: str, touched: list[str], before: dict[str, int], after: dict[str, int]) -> DataFrame:
        old, new = (self._stored(kind, schema, part, {k: n for k, n in held.items() if k in touched}) for held in (before, after))
        return S.changed_symbols(old, new)

    def _open(self) -> tuple[dict[str, dsl.Tree | str], dict[str, str]]:
        """(trees, or why one can't be read; a fingerprint of each book's rules)."""
        trees, prints = {}, {}
        for book, source in self.sources.items():
            try:
                trees[book] = source if isinstance(source, dsl.Tree) else dsl.Tree(json.loads(self.spark.read.text(source, wholetext=True).first()[0]))
                prints[book] = dsl.bare(trees[book].data)
            except (dsl.RuleError, ValueError) as e:
                trees[book] = prints[book] = f"{type(e).__name__}: {e}"
        return trees, {k: hashlib.sha256(v.encode()).hexdigest() for k, v in prints.items()}

    def _print(self, book: str) -> str | None:
        """A fingerprint of the positions file's content; null without a file."""
        path = self.positions.get(book)
        if path is None or not (lambda fs, p: fs.exists(p))(*self._fs(path)):
            return None
        return self.spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]

    def _backfill(self, trees: dict, state: dict, number: int, now: datetime | None, kind: str = "loaded") -> DataFrame | None:
        """Fetch what is wanted and not loaded, once for each start; the bars, or where kind is loaded_atoms the atoms."""
        fetch, schema, days = (self.fetch, BARS, WARMUP_DAYS + self.extra_days) if kind == "loaded" else (self.fetch_atoms, ATOMS, ATOM_DAYS)
        if fetch is None:
            return None
        start, of = S.since(now, days), dsl.Tree.symbols if kind == "loaded" else dsl.Tree.atom_symbols
        wanted = self.spark.createDataFrame([(x, start) for t in trees.values() if isinstance(t, dsl.Tree) for p in t.products for x in of(t, p)], "sym string, start string").distinct()
        both, todo = S.needs(self.loaded(number, kind), wanted)
        starts = [r[0] for r in todo.select("start").distinct().collect()]  # the start of this batch, or a few
        if not starts:
            return None
        if kind == "loaded":
            todo.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{self.path}/requests/part={number}")
        both.write.mode("overwrite").parquet(f"{self.path}/{kind}/batch={number}")
        state[kind] = number
        found = [fetch(todo.where(F.col("start") == x).select("sym"), x) for x in starts]
        return reduce(DataFrame.unionByName, [f.select(*[c.split(" ")[0] for c in schema.split(", ")]) for f in found])

    def _judged(self, book: str, tree: dsl.Tree, products: list[str], bars: DataFrame, atoms: DataFrame, now: datetime | None, number: int, held_any: bool) -> DataFrame:
        """The verdicts of some products on their last bar, with the spot price and the holdings."""
        own = tree.only(products)
        symbols = sorted({x for p in products for x in own.symbols(p) | own.atom_symbols(p)})
        bars, atoms = bars.where(F.col("sym").isin(symbols)), atoms.where(F.col("sym").isin(symbols))
        mine = S.positions(self.spark, self.positions[book]).where(F.col("product").isin(products)) if held_any else None
        decided = decisions(bars, own, closes=self._closes(bars), asof=now, atoms=atoms)
        out = summed_up(decided, bars, own, holdings=mine, asof=now, atoms=atoms)
        out = out if self.every else out.where("has_data")
        kinds = {c.split(" ")[0]: c.split(" ", 1)[1] for c in VERDICT.replace("\n", " ").split(", ")}
        made = {**{c: F.col(c) for c in ("product", "date", "close", "change", "key", "weight", "alternatives", "confirmed", "warmup", "holdings")}, "book": F.lit(book), "error": F.lit(None), "judged": F.lit(number)}
        return out.select(*[made[c].cast(kind).alias(c) for c, kind in kinds.items()])

    def on_batch(self, batch: DataFrame, number: int) -> None:
        before = self.state(number)
        state, now = json.loads(json.dumps(before)), self.now() if self.now else None
        trees, prints = self._open()
        fields = F.struct(*S.FIELDS)
        daily = batch.where("ts is null") if "ts" in batch.columns else batch
        rows = daily.groupBy("sym", "date").agg(F.max_by(fields, "arrived").alias("b")).select("sym", "date", "b.*")
        if (more := self._backfill(trees, state, number, now)) is not None:
            rows = S.upsert(more, rows)
        month = F.substring("date", 1, 6)
        touched = self._merged("bars", BARS, "month", month, rows, before["bars"], number)
        state["bars"] |= dict.fromkeys(touched, number)
        changed = self._changed("bars", BARS, "month", touched, before["bars"], state["bars"]) if touched else None
        names = [c.split(" ")[0] for c in ATOMS.split(", ")]
        atoms = batch.where("ts is not null").select(*names, "arrived") if "ts" in batch.columns else None
        if (more := self._backfill(trees, state, number, now, "loaded_atoms")) is not None:
            more = more.where("ts is not null").withColumn("arrived", F.lit(-(2**63)))  # what the batch brings counts before it
            atoms = more if atoms is None else more.unionByName(atoms)
        if atoms is not None:
            changed = self._atoms(atoms, before, state, number, changed)
        woken = self._woken(trees, prints, before, state, changed)
        if woken:
            self._publish(trees, woken, before, state, number, now)
        if state != before or not self.commits():
            self._commit(number, state)
        if woken:
            self._tell(number, list(woken))

    def _atoms(self, batch: DataFrame, before: dict, state: dict, number: int, changed: DataFrame | None) -> DataFrame | None:
        newest = batch.agg(F.max("ts")).first()[0]
        if newest is None:
            return changed
        state["newest"] = max(newest.isoformat(sep=" "), before["newest"] or "")
        least = datetime.fromisoformat(state["newest"]) - timedelta(days=ATOM_DAYS)
        late = batch.where(F.col("ts") >= F.lit(least))
        rows = late.groupBy("sym", "ts").agg(F.max_by(F.struct(*S.FIELDS), "arrived").alias("b")).select("sym", "ts", "b.*")
        touched = self._merged("atoms", ATOMS, "day", F.date_format("ts", "yyyyMMdd"), rows, before["atoms"], number)
        state["atoms"] = {k: n for k, n in (before["atoms"] | dict.fromkeys(touched, number)).items() if k >= f"{least:%Y%m%d}"}
        if not touched:
            return changed
        atoms = self._changed("atoms", ATOMS, "day", touched, before["atoms"], state["atoms"])
        return atoms if changed is None else changed.union(atoms).distinct()

    def _woken(self, trees: dict, prints: dict, before: dict, state: dict, changed: DataFrame | None) -> dict[str, list[str]]:
        """The products of each book that must be judged: those of changed symbols, or all where rules or positions changed."""
        out: dict[str, list[str]] = {}
        if changed is not None:
            pairs = [(x, b, p) for b, t in trees.items() if isinstance(t, dsl.Tree) for p in t.products for x in t.symbols(p) | t.atom_symbols(p)]
            for r in S.woken(changed, self.spark.createDataFrame(pairs, "symbol string, book string, product string")).collect():  # products of the books
                out.setdefault(r["book"], []).append(r["product"])
        for book, tree in trees.items():
            held = self._print(book)
            if prints[book] != before["books"].get(book) or held != before["positions"].get(book):
                out[book] = list(tree.products) if isinstance(tree, dsl.Tree) else []
            state["books"][book], state["positions"][book] = prints[book], held
        for kind in ("books", "positions"):
            state[kind] = {b: v for b, v in state[kind].items() if b in trees}
        return {b: sorted(ps) for b, ps in out.items()}

    def _publish(self, trees: dict, woken: dict, before: dict, state: dict, number: int, now: datetime | None) -> None:
        bars, atoms = self._stored("bars", BARS, "month", state["bars"]), self._stored("atoms", ATOMS, "day", state["atoms"])
        fresh = [self.spark.createDataFrame([], VERDICT)]
        for book, products in woken.items():
            tree = trees[book]
            try:
                if isinstance(tree, str):
                    raise dsl.RuleError(tree)
                fresh += [self._judged(book, tree, products, bars, atoms, now, number, state["positions"].get(book) is not None)] if products else []
            except dsl.RuleError as e:  # one book's rules don't stop the others
                row = {"book": book, "error": str(e), "judged": number}
                fresh.append(self.spark.createDataFrame([row], VERDICT))
        new = reduce(DataFrame.unionByName, fresh)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{self.path}/events/part={number}")
        new = self.spark.read.schema(VERDICT).parquet(f"{self.path}/events/part={number}")
        old = self.verdicts(number)
        pairs = [(b, p) for b, t in trees.items() if isinstance(t, dsl.Tree) for p in t.products]
        kept = old.join(self.spark.createDataFrame(pairs, "book string, product string"), ["book", "product"], "left_semi").join(new.select("book", "product"), ["book", "product"], "left_anti")
        kept.unionByName(new).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/verdicts/batch={number}")
        state["verdicts"] = number

    def subscribe(self, observer: Callable[[DataFrame], None]) -> Callable[[], None]:
        """Have observer(event) called with each event; the result ends that."""
        self.observers.append(observer)
        return lambda: self.observers.remove(observer)

    def _tell(self, number: int, books: list[str]) -> None:
        """One event per book to every observer, after the commit; one that fails doesn't stop the others."""
        verdicts = self.verdicts(number + 1)
        for book in books:
            for observer in list(self.observers):
                try:
                    observer(verdicts.where(F.col("book") == book))
                except Exception:
                    log.exception("an observer of %s failed on batch %d", book, number)

    def judge_with(self, book: str, answers: dict) -> DataFrame:
        """Decisions of a book's products on their last bar under a person's answers; nothing is stored or published."""
        tree = self._open()[0][book]
        if isinstance(tree, str):
            raise dsl.RuleError(tree)
        bars = self.bars()
        decided = decisions(bars, tree, answers, closes=self._closes(bars), asof=self.now() if self.now else None, atoms=self.atoms())
        return decided.groupBy("product").agg(F.max_by(F.struct("date", "close", "key", "weight"), "i").alias("v")).select("product", "v.*")

    def start(self, source: DataFrame, checkpoint: str, interval: str | None = "15 seconds"):
        """Run on a stream of batches. With an interval there is a batch at each tick, even without data, since a tree or
        positions file may have changed; without one, what the source has is taken and the stream ends."""
        if interval:
            nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in source.schema.fields]
            ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load().where("value < 0").select(*nothing)
            source = source.unionByName(ticks)
        writer = source.writeStream.foreachBatch(self.on_batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
