"""Bars and their store: adapters of the tables, resampling, upsert, change detection, subscriptions."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebar.plans.dsl import tf_seconds

FIELDS = ("open", "high", "low", "close", "volume")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars (sym, date, open, high, low, close, volume) by order priority; first and last by key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("sym"), F.date_format("o_orderdate", "yyyyMMdd").alias("date"), "o_orderkey", "o_totalprice")
    return o.groupBy("sym", "date").agg(
        F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"),
        F.max_by("o_totalprice", "o_orderkey").alias("close"), F.count(F.lit(1)).cast("double").alias("volume"),
    )


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms (sym, ts, open..volume) of the events: one per event; `seq` breaks ties of time."""
    e = table(spark, sf_dir, "events").where("ts is not null")
    v = F.col("value").cast("double")
    return e.select(F.col("event_type").alias("sym"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), *[v.alias(f) for f in FIELDS[:4]], F.lit(1.0).alias("volume"))


def iso_atoms(rows: DataFrame, at: str = "dt") -> DataFrame:
    """Rows with times as ISO text -> with `ts` in its place, and `date`, its day in UTC. A text without a zone is in UTC; those
    that are no time are dropped."""
    ts = F.try_to_timestamp(F.regexp_replace(F.trim(F.col(at)), " ", "T"))
    return rows.withColumn("ts", ts).where("ts is not null").withColumn("date", F.date_format("ts", "yyyyMMdd")).drop(at)


def until(bars: DataFrame, day: str) -> DataFrame:
    """What was known at the end of a day."""
    return bars.where(F.col("date") <= day)


def bucket(ts: Column, tf: str) -> Column:
    s = tf_seconds(tf)
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / s) * s)


def resample(atoms: DataFrame, tf: str) -> DataFrame:
    """Bars of tf on the UTC epoch grid; an unknown tf leaves the atoms as they are. The partial last bucket stays."""
    if tf_seconds(tf) is None:
        return atoms
    at = F.struct("ts", "seq") if "seq" in atoms.columns else F.col("ts")
    return atoms.withColumn("bucket", bucket(F.col("ts"), tf)).groupBy("sym", "bucket").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.sum("volume").alias("volume"),
    ).withColumnRenamed("bucket", "ts")


def daily(atoms: DataFrame) -> DataFrame:
    return resample(atoms, "1d").select("sym", F.date_format("ts", "yyyyMMdd").alias("date"), *FIELDS)


def upsert(old: DataFrame, new: DataFrame, key: str = "date") -> DataFrame:
    """Old and new bars; for a symbol and date (or other key) in both, the new one. Nothing is ever deleted."""
    both = old.withColumn("version", F.lit(0)).unionByName(new.withColumn("version", F.lit(1)))
    newest = F.row_number().over(Window.partitionBy("sym", key).orderBy(F.col("version").desc()))
    return both.withColumn("rn", newest).where("rn = 1").drop("rn", "version")


def changed_symbols(old: DataFrame, merged: DataFrame) -> DataFrame:
    return merged.exceptAll(old.select(*merged.columns)).select("sym").distinct()


def woken(changed: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """subscriptions (symbol, book, product) that a changed symbol wakes, each (book, product) once."""
    return subscriptions.join(changed, subscriptions["symbol"] == changed["sym"]).select("book", "product").distinct()


def missing_symbols(wanted: DataFrame, bars: DataFrame) -> DataFrame:
    return wanted.join(bars.select("sym").distinct(), "sym", "left_anti")


def recent(bars: DataFrame, day: str, n: int) -> DataFrame:
    """The last n bars of each symbol up to a day."""
    rank = F.row_number().over(Window.partitionBy("sym").orderBy(F.col("date").desc()))
    return until(bars, day).withColumn("rn", rank).where(F.col("rn") <= n)


def spot(atoms: DataFrame, asof=None) -> DataFrame:
    """(sym, date, spot): the last known close up to asof, or at all."""
    at = F.struct("ts", "seq") if "seq" in atoms.columns else F.col("ts")
    known = atoms.where("close is not null")
    known = known if asof is None else known.where(F.col("ts") <= F.lit(asof).cast("timestamp"))
    return known.groupBy("sym").agg(F.max_by("close", at).alias("spot"), F.date_format(F.max("ts"), "yyyyMMdd").alias("date"))


def overlay_spot(bars: DataFrame, atoms: DataFrame, asof) -> DataFrame:
    """Bars with the spot price as the close of its day."""
    return bars.join(spot(atoms, asof), ["sym", "date"], "left").withColumn("close", F.coalesce("spot", "close")).drop("spot")


def history(bars: DataFrame, starts: DataFrame) -> DataFrame:
    """starts (sym, start): each symbol's bars from its start on; the least start prunes the scan."""
    least = starts.agg(F.min("start")).first()[0]
    own = bars if least is None else bars.where(F.col("date") >= least)
    return own.join(starts.groupBy("sym").agg(F.min("start").alias("start")), "sym").where("date >= start").drop("start")


def years_window(bars: DataFrame, today: str, years: float) -> DataFrame:
    """Bars of the last `years` times 365 days."""
    return bars.where(F.col("date") >= F.date_format(F.date_sub(F.to_date(F.lit(today), "yyyyMMdd"), int(365 * years)), "yyyyMMdd"))


def session_closes(markets: DataFrame, sessions: DataFrame) -> DataFrame:
    """markets (sym, market), sessions (market, date, close_utc) -> (sym, date, close_utc); symbols of no market have none."""
    return markets.where("market is not null").join(sessions.where("close_utc is not null"), "market").select("sym", "date", "close_utc")


def confirmed(bars: DataFrame, closes: DataFrame, now) -> DataFrame:
    """bars with `confirmed`: whether the session had closed by now; true where the symbol has no known session at all."""
    known = closes.groupBy("sym").agg(F.count(F.lit(1)).alias("known"))
    rows = bars.join(closes, ["sym", "date"], "left").join(known, "sym", "left")
    return rows.withColumn("confirmed", F.col("known").isNull() | F.coalesce(F.col("close_utc") <= F.lit(now).cast("timestamp"), F.lit(False))).drop("close_utc", "known")


def epoch(key: Column) -> Column:
    """Seconds of a UTC time written in 8, 12 or 14 digits."""
    return F.unix_timestamp(F.rpad(key, 14, "0"), "yyyyMMddHHmmss")


def since(now: datetime | None, days: int) -> str:
    """The day so many days before now (by default, the present time) in UTC."""
    return f"{(now or datetime.now(timezone.utc)) - timedelta(days=days):%Y%m%d}"


def needs(old: DataFrame, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Wanted history: old and asked (sym, start) -> (all wants, each symbol's earliest start; those to fetch: new or earlier)."""
    both = old.unionByName(asked).groupBy("sym").agg(F.min("start").alias("start"))
    return both, both.join(old.groupBy("sym").agg(F.min("start").alias("had")), "sym", "left").where("had is null or start < had").select("sym", "start")


def positions(spark: SparkSession, path: str) -> DataFrame:
    """A positions file ({"positions": [{prod, entry_date, entry_px, filled}]}) as (product, n, entry_date, cost, filled); n numbers a product's."""
    row = "array<struct<prod:string,entry_date:string,entry_px:double,filled:int>>"
    rows = spark.read.schema(f"positions {row}").json(path, multiLine=True).select(F.posexplode("positions").alias("at", "x"))
    n = F.row_number().over(Window.partitionBy("x.prod").orderBy("at")) - 1
    return rows.select(F.col("x.prod").alias("product"), n.alias("n"), "x.entry_date", F.col("x.entry_px").alias("cost"), F.coalesce("x.filled", F.lit(1)).alias("filled"))
