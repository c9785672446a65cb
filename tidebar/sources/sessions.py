"""Regular sessions of markets, and the market of a symbol."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebar.sources.bars import session_closes

#: Time zone, opening, closing and early closing of each market's regular session.
HOURS = {"US": ("America/New_York", "09:30", "16:00", "13:00"), "KR": ("Asia/Seoul", "09:00", "15:30", "15:30")}

#: How the symbols of each market are written; the first that fits counts.
SHAPES = (("KR", "^[0-9][0-9A-Z]{5}$"), ("US", r"^[A-Z]{1,5}([.-][A-Z])?$"))

MONDAY, THURSDAY, FRIDAY, SATURDAY = 0, 3, 4, 5


def _on(d: Column, month: int, day: int) -> Column:
    return (F.month(d) == month) & (F.day(d) == day)


def _nth(d: Column, month: int, weekday: int, n: int) -> Column:
    """Whether it is the month's n-th such weekday, or its last one where n is -1."""
    place = F.day(d) > F.day(F.last_day(d)) - 7 if n == -1 else F.floor((F.day(d) - 1) / 7) == n - 1
    return (F.month(d) == month) & (F.weekday(d) == weekday) & place


def _observed(d: Column, month: int, day: int, early: bool = True) -> Column:
    """The date itself, the Monday after where it is a Sunday, and (early) the Friday before where it is a Saturday."""
    moved = (F.weekday(d) == MONDAY) & _on(F.date_sub(d, 1), month, day)
    return _on(d, month, day) | moved | ((F.weekday(d) == FRIDAY) & _on(F.date_add(d, 1), month, day) & F.lit(early))


def easter(year: Column) -> Column:
    """Easter Sunday of the Gregorian calendar: the Sunday after the full moon that the cycle of 19 years, the century's
    leap days and the moon's drift give."""
    whole = lambda x: F.floor(x).cast("int")
    golden, century = year % 19, whole(year / 100)
    epact = (19 * golden + century - whole(century / 4) - whole((century - whole((century + 8) / 25) + 1) / 3) + 15) % 30
    past = (32 + 2 * (century % 4) + 2 * whole(year % 100 / 4) - epact - year % 4) % 7  # days from the full moon to Sunday
    late = whole((golden + 11 * epact + 22 * past) / 451)
    return F.date_add(F.make_date(year, F.lit(3), F.lit(22)), epact + past - 7 * late)


def closed(market: str, d: Column) -> Column:
    """Whether the market rests on a date by its standing rules. Days that no rule gives (feasts of the moon, mourning,
    storms) are handed to `sessions` as exceptions."""
    if market == "US":
        rests = [
            _observed(d, 1, 1, early=False), _nth(d, 1, MONDAY, 3) & (F.year(d) >= 1998), _nth(d, 2, MONDAY, 3), d == F.date_sub(easter(F.year(d)), 2), _nth(d, 5, MONDAY, -1),
            _observed(d, 6, 19) & (F.year(d) >= 2022), _observed(d, 7, 4), _nth(d, 9, MONDAY, 1), _nth(d, 11, THURSDAY, 4), _observed(d, 12, 25),
        ]
    elif market == "KR":
        rests = [_on(d, *x) for x in ((1, 1), (3, 1), (5, 1), (5, 5), (6, 6), (8, 15), (10, 3), (10, 9), (12, 25), (12, 31))]
    else:
        raise ValueError(f"a market without rules: {market!r}")
    return reduce(lambda x, y: x | y, rests) | (F.weekday(d) >= SATURDAY)


def half(market: str, d: Column) -> Column:
    """Whether the market closes early: in the US on the day after Thanksgiving, before a feast of July or December in
    mid-week."""
    if market != "US":
        return F.lit(False)
    return _nth(F.date_sub(d, 1), 11, THURSDAY, 4) | ((F.weekday(d) <= THURSDAY) & (_on(d, 7, 3) | _on(d, 12, 24)))


def days_of(bars: DataFrame) -> DataFrame:
    """(day): every date from the first to the last of bars."""
    ends = bars.agg(F.to_date(F.min("date"), "yyyyMMdd").alias("a"), F.to_date(F.max("date"), "yyyyMMdd").alias("b")).where("a is not null")
    return ends.select(F.explode(F.sequence("a", "b")).alias("day"))


def sessions(days: DataFrame, markets: tuple[str, ...] = tuple(HOURS), exceptions: DataFrame | None = None) -> DataFrame:
    """days (day date) -> (market, date, open_utc, close_utc, is_half) of the days on which each market has a session.

    exceptions (market, date, opens, closes): local times HH:mm that take the place of the rules on that date; without times
    the market rests. Times follow the clocks of the market's place, summer time included. A session is half where it closes
    before the usual time.
    """
    rules = [F.struct(F.lit(m).alias("market"), closed(m, F.col("day")).alias("closed"), half(m, F.col("day")).alias("half")) for m in markets]
    rows = days.where("day is not null").select("day").distinct().select("day", F.date_format("day", "yyyyMMdd").alias("date"), F.explode(F.array(*rules)).alias("x")).select("day", "date", "x.*")
    hours = lambda k: F.element_at(F.create_map(*[x for m in markets for x in (F.lit(m), F.lit(HOURS[m][k]))]), F.col("market"))
    opens, closes = F.when(~F.col("closed"), hours(1)), F.when(~F.col("closed"), F.when(F.col("half"), hours(3)).otherwise(hours(2)))
    if exceptions is not None:
        own = exceptions.groupBy("market", "date").agg(F.max(F.struct("opens", "closes")).alias("own"))
        rows = rows.join(own, ["market", "date"], "left")
        opens, closes = (F.when(F.col("own").isNotNull(), F.col(f"own.{c}")).otherwise(v) for c, v in (("opens", opens), ("closes", closes)))
    rows = rows.select("market", "day", "date", opens.alias("opens"), closes.alias("closes")).where("opens is not null and closes is not null")
    part = lambda c, k: F.split(c, ":")[k].cast("int")
    utc = lambda c: F.make_timestamp(F.year("day"), F.month("day"), F.day("day"), part(c, 0), part(c, 1), F.lit(0), hours(0))
    return rows.select("market", "date", utc("opens").alias("open_utc"), utc("closes").alias("close_utc"), (F.col("closes") < hours(2)).alias("is_half"))


def markets_of(symbols: DataFrame, listed: DataFrame | None = None, shapes: tuple[tuple[str, str], ...] = SHAPES) -> DataFrame:
    """symbols (sym) -> (sym, market): the listed one (sym, market), else the first whose way of writing fits, else null."""
    fits = F.coalesce(*[F.when(F.col("sym").rlike(pattern), market) for market, pattern in shapes]) if shapes else F.lit(None).cast("string")
    rows = symbols.select("sym").distinct()
    if listed is None:
        return rows.select("sym", fits.alias("market"))
    own = listed.groupBy("sym").agg(F.max("market").alias("listed"))
    return rows.join(own, "sym", "left").select("sym", F.coalesce("listed", fits).alias("market"))


def closes(bars: DataFrame, listed: DataFrame | None = None, exceptions: DataFrame | None = None) -> DataFrame:
    """(sym, date, close_utc) of the sessions of the bars' symbols from the first to the last day of bars; symbols of no known
    market have none."""
    return session_closes(markets_of(bars.where("sym is not null"), listed), sessions(days_of(bars), exceptions=exceptions))
