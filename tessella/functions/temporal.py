"""Dates, times and durations.

date is a DATE, localdatetime a TIMESTAMP_NTZ; the others are structs: datetime (_dt local time,
_offset seconds, _zone), time (_tm nanoseconds of the day, _offset), localtime (_lt nanoseconds of
the day), duration (_months, _days, _nanos).  Timestamps hold microseconds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..cypher.errors import CypherError
from .values import DATE, LOCAL, LONG, NULL, STRING, Val, is_duration, is_map, is_number, lit, null

DATETIME = T.StructType().add("_dt", T.TimestampNTZType()).add("_offset", T.LongType()).add("_zone", T.StringType())
TIME = T.StructType().add("_tm", T.LongType()).add("_offset", T.LongType())
LOCALTIME = T.StructType().add("_lt", T.LongType())
DURATION = T.StructType().add("_months", T.LongType()).add("_days", T.LongType()).add("_nanos", T.LongType())
SECOND, DAY = 10**9, 86_400 * 10**9


def kind(t: T.DataType) -> str | None:
    if t == DATE:
        return "date"
    if t == LOCAL:
        return "localdatetime"
    names = tuple(t.fieldNames()) if isinstance(t, T.StructType) else ()
    return {("_dt", "_offset", "_zone"): "datetime", ("_tm", "_offset"): "time", ("_lt",): "localtime", ("_months", "_days", "_nanos"): "duration"}.get(names)


def is_temporal(t: T.DataType) -> bool:
    return kind(t) is not None


def _long(c) -> Column:
    return (c if isinstance(c, Column) else F.lit(c)).cast("long")


def _fdiv(a: Column, n: int) -> Column:
    return F.floor(a / F.lit(n)).cast("long") if n < 1000 else ((a - F.pmod(a, F.lit(n).cast("long"))) / F.lit(n)).cast("long")


def _tdiv(a: Column, n: int) -> Column:
    """Towards zero."""
    return F.when(a >= 0, _fdiv(a, n)).otherwise(-_fdiv(-a, n))


def date_of(v: Val) -> Column:
    k = kind(v.type)
    if k == "date":
        return v.col
    if k == "localdatetime":
        return v.col.cast("date")
    if k == "datetime":
        return v.col["_dt"].cast("date")
    return F.lit("1970-01-01").cast("date")


def _nanos_of_ts(ts: Column) -> Column:
    whole = (_long(F.hour(ts)) * 3600 + _long(F.minute(ts)) * 60) * SECOND
    return whole + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long") * 1000


def nanos_of(v: Val) -> Column:
    """Nanoseconds of the day."""
    k = kind(v.type)
    if k == "localdatetime":
        return _nanos_of_ts(v.col)
    if k == "datetime":
        return _nanos_of_ts(v.col["_dt"])
    if k == "time":
        return v.col["_tm"]
    if k == "localtime":
        return v.col["_lt"]
    return F.when(v.col.isNotNull(), _long(0))


def offset_of(v: Val) -> Column:
    return v.col["_offset"] if kind(v.type) in ("datetime", "time") else _long(0)


def _stamp(date: Column, nanos: Column) -> Column:
    micros = _fdiv(nanos, 1000)
    return date.cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (micros.cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))


def _epoch_day(d: Column) -> Column:
    return _long(F.datediff(d, F.lit("1970-01-01").cast("date")))


def sort_key(v: Val) -> Column:
    k = kind(v.type)
    if k in ("date", "localdatetime"):
        return v.col
    if k == "datetime":
        return F.when(v.col.isNotNull(), (_epoch_day(date_of(v)) * 86_400_000_000 + _fdiv(nanos_of(v), 1000)) - v.col["_offset"] * 1_000_000)
    if k == "time":
        return v.col["_tm"] - v.col["_offset"] * SECOND
    if k == "localtime":
        return v.col["_lt"]
    return v.col["_months"] * 2_629_746 * SECOND + v.col["_days"] * DAY + v.col["_nanos"]


# --- text ------------------------------------------------------------------------------------


def _two(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def _clock(n: Column) -> Column:
    sub = F.pmod(n, _long(SECOND))
    fraction = F.when(sub == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(sub.cast("string"), 9, "0"), "0+$", "")))
    sec = F.pmod(_fdiv(n, SECOND), _long(60))
    tail = F.when((sec == 0) & (sub == 0), "").otherwise(F.concat(F.lit(":"), _two(sec), fraction))
    return F.concat(_two(_fdiv(n, 3600 * SECOND)), F.lit(":"), _two(F.pmod(_fdiv(n, 60 * SECOND), _long(60))), tail)


def _offset_text(o: Column) -> Column:
    a = F.abs(o)
    tail = F.when(F.pmod(a, _long(60)) == 0, "").otherwise(F.concat(F.lit(":"), _two(F.pmod(a, _long(60)))))
    return F.when(o == 0, "Z").otherwise(F.concat(F.when(o < 0, "-").otherwise("+"), _two(_fdiv(a, 3600)), F.lit(":"), _two(F.pmod(_fdiv(a, 60), _long(60))), tail))


def iso_text(v: Val) -> Column:
    k = kind(v.type)
    if k == "date":
        return F.date_format(v.col, "yyyy-MM-dd")
    if k == "localtime":
        return _clock(v.col["_lt"])
    if k == "time":
        return F.concat(_clock(v.col["_tm"]), _offset_text(v.col["_offset"]))
    if k == "localdatetime":
        return F.concat(F.date_format(v.col, "yyyy-MM-dd"), F.lit("T"), _clock(nanos_of(v)))
    if k == "datetime":
        zone = F.when(v.col["_zone"].isNull(), "").otherwise(F.concat(F.lit("["), v.col["_zone"], F.lit("]")))
        return F.concat(F.date_format(v.col["_dt"], "yyyy-MM-dd"), F.lit("T"), _clock(nanos_of(v)), _offset_text(v.col["_offset"]), zone)
    m, d, n = v.col["_months"], v.col["_days"], v.col["_nanos"]
    part = lambda c, s: F.when(c == 0, "").otherwise(F.concat(c.cast("string"), F.lit(s)))
    h, minute, rest = _tdiv(n, 3600 * SECOND), _tdiv(n, 60 * SECOND), n - _tdiv(n, 60 * SECOND) * 60 * SECOND
    whole, sub = _tdiv(rest, SECOND), F.abs(rest - _tdiv(rest, SECOND) * SECOND)
    sec = F.concat(F.when((rest < 0) & (whole == 0), "-").otherwise(""), whole.cast("string"), F.when(sub == 0, "").otherwise(F.concat(F.lit("."), F.regexp_replace(F.lpad(sub.cast("string"), 9, "0"), "0+$", ""))), F.lit("S"))
    clock = F.concat(part(h, "H"), part(minute - h * 60, "M"), F.when(rest == 0, "").otherwise(sec))
    y = _tdiv(m, 12)
    out = F.concat(F.lit("P"), part(y, "Y"), part(m - y * 12, "M"), part(d, "D"), F.when(n == 0, "").otherwise(F.concat(F.lit("T"), clock)))
    return F.when(out == "P", "PT0S").otherwise(out)


# --- construction ----------------------------------------------------------------------------

_KEYS = {"year", "quarter", "month", "week", "dayofweek", "ordinalday", "dayofquarter", "day", "hour", "minute", "second", "millisecond", "microsecond", "nanosecond", "timezone", "date", "time", "datetime"}


def _build_date(m: dict[str, Val], base: Column | None) -> Column:
    get = lambda k: _long(m[k].col) if k in m else None
    first = F.lit("1970-01-01").cast("date")
    src = base if base is not None else None
    year = get("year") if "year" in m else _long(F.year(src)) if src is not None else _long(F.year(first))
    jan1 = F.make_date(year.cast("int"), F.lit(1), F.lit(1))
    if "week" in m:
        jan4 = F.make_date((get("year") if "year" in m else _long(F.extract(F.lit("YEAROFWEEK"), src)) if src is not None else _long(1970)).cast("int"), F.lit(1), F.lit(4))
        monday = F.date_sub(jan4, F.weekday(jan4))
        dow = get("dayofweek") if "dayofweek" in m else _long(F.weekday(src) + 1) if src is not None else _long(1)
        return F.date_add(monday, ((get("week") - 1) * 7 + dow - 1).cast("int"))
    if "ordinalday" in m:
        return F.date_add(jan1, (get("ordinalday") - 1).cast("int"))
    if "quarter" in m or "dayofquarter" in m:
        quarter = get("quarter") if "quarter" in m else _long(F.quarter(src)) if src is not None else _long(1)
        start = F.add_months(jan1, ((quarter - 1) * 3).cast("int"))
        if "dayofquarter" in m:
            day = get("dayofquarter")
        elif src is not None:
            # the same month of the quarter and day of the month
            moved = F.add_months(start, ((F.month(src) - 1) % 3).cast("int"))
            return F.date_add(moved, (F.least(F.dayofmonth(src), F.dayofmonth(F.last_day(moved))) - 1).cast("int"))
        else:
            day = _long(1)
        return F.date_add(start, (day - 1).cast("int"))
    month = get("month") if "month" in m else _long(F.month(src)) if src is not None else _long(1)
    if "day" in m:
        day = get("day")
    elif src is not None:
        day = F.least(_long(F.dayofmonth(src)), _long(F.dayofmonth(F.last_day(F.make_date(year.cast("int"), month.cast("int"), F.lit(1))))))
    else:
        day = _long(1)
    return F.make_date(year.cast("int"), month.cast("int"), day.cast("int"))


def _build_nanos(m: dict[str, Val], base: Column | None) -> Column:
    def part(key: str, unit: int, wrap: int) -> Column:
        if key in m:
            return _long(m[key].col) * unit
        return _fdiv(F.pmod(base, _long(unit * wrap)), unit) * unit if base is not None else _long(0)

    out = part("hour", 3600 * SECOND, 24) + part("minute", 60 * SECOND, 60) + part("second", SECOND, 60)
    if {"millisecond", "microsecond", "nanosecond"} & m.keys():
        return out + sum((_long(m[k].col) * u for k, u in (("millisecond", 10**6), ("microsecond", 1000), ("nanosecond", 1)) if k in m), _long(0))
    return out + (F.pmod(base, _long(SECOND)) if base is not None else _long(0))


def _offset_at(zone: Val, local: Column) -> tuple[Column, Column]:
    """(offset in seconds, zone name or NULL) of a written time zone."""
    z = zone.col
    fixed = F.regexp_extract(z, "^([+-])(\\d\\d):?(\\d\\d)?:?(\\d\\d)?$", 0) != ""
    piece = lambda g: F.coalesce(_int(F.regexp_extract(z, "^([+-])(\\d\\d):?(\\d\\d)?:?(\\d\\d)?$", g)), _long(0))
    seconds = piece(2) * 3600 + piece(3) * 60 + piece(4)
    seconds = F.when(F.substring(z, 1, 1) == "-", -seconds).otherwise(seconds)
    if isinstance(zone.const, str) and (zone.const[:1] in "+-" or zone.const.upper() == "Z"):
        return (_long(0) if zone.const.upper() == "Z" else seconds), F.lit(None).cast("string")
    utc = F.to_utc_timestamp(local.cast("timestamp"), F.when(fixed | (z == "Z"), "UTC").otherwise(z))
    named = F.unix_seconds(local.cast("timestamp")) - F.unix_seconds(utc)
    return F.when(z == "Z", _long(0)).when(fixed, seconds).otherwise(named), F.when(fixed | (z == "Z"), None).otherwise(z)


def _from_map(k: str, m: dict[str, Val]) -> Val:
    m = {x.lower(): v for x, v in m.items()}
    unknown = m.keys() - _KEYS
    if unknown:
        raise CypherError("InvalidArgumentValue", f"unknown temporal key {sorted(unknown)[0]}")
    date_base = m.get("date") or m.get("datetime")
    time_base = m.get("time") or m.get("datetime")
    date = _build_date(m, date_of(date_base) if date_base else None)
    nanos = _build_nanos(m, nanos_of(time_base) if time_base else None)
    if k == "date":
        return Val(date, DATE)
    if k == "localtime":
        return Val(F.struct(nanos.alias("_lt")), LOCALTIME)
    stamp = _stamp(date, nanos)
    if k == "localdatetime":
        return Val(stamp, LOCAL)
    if "timezone" in m:
        offset, zone = _offset_at(m["timezone"], stamp)
    else:
        offset, zone = (offset_of(time_base), F.lit(None).cast("string")) if time_base else (_long(0), F.lit(None).cast("string"))
    if k == "time":
        return Val(F.struct(nanos.alias("_tm"), offset.alias("_offset")), TIME)
    return Val(F.struct(stamp.alias("_dt"), offset.alias("_offset"), zone.alias("_zone")), DATETIME)


_DATE_RE = "^(\\d{4})(?:-?(?:W(\\d{2})(?:-?(\\d))?|Q(\\d)(?:-?(\\d{2}))?|(\\d{3})(?!\\d)|(\\d{2})(?:-?(\\d{2}))?))?"
_TIME_RE = "(\\d{2})(?::?(\\d{2})(?::?(\\d{2})(?:[.,](\\d{1,9}))?)?)?"
_ZONE_RE = "(Z|[+-]\\d{2}(?::?\\d{2}(?::?\\d{2})?)?)?(?:\\[([^\\]]+)\\])?$"


def _int(c: Column) -> Column:
    return F.when(c != "", c).try_cast("long")


def _parse_date(s: Column) -> Column:
    g = lambda n: _int(F.regexp_extract(s, _DATE_RE, n))
    year, week, dow, quarter, of_quarter, ordinal, month, day = (g(n) for n in range(1, 9))
    jan1, jan4 = F.make_date(year.cast("int"), F.lit(1), F.lit(1)), F.make_date(year.cast("int"), F.lit(1), F.lit(4))
    by_week = F.date_add(F.date_sub(jan4, F.weekday(jan4)), ((week - 1) * 7 + F.coalesce(dow, _long(1)) - 1).cast("int"))
    by_quarter = F.date_add(F.add_months(jan1, ((quarter - 1) * 3).cast("int")), (F.coalesce(of_quarter, _long(1)) - 1).cast("int"))
    written = F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), F.lpad(F.coalesce(month, _long(1)).cast("string"), 2, "0"), F.lpad(F.coalesce(day, _long(1)).cast("string"), 2, "0"))
    return F.when(year.isNull(), None).when(week.isNotNull(), by_week).when(quarter.isNotNull(), by_quarter).when(ordinal.isNotNull(), F.date_add(jan1, (ordinal - 1).cast("int"))).otherwise(written.try_cast("date"))


def _parse_nanos(s: Column, before: str) -> Column:
    g = lambda n: F.coalesce(_int(F.regexp_extract(s, before + _TIME_RE, n)), _long(0))
    fraction = F.rpad(F.regexp_extract(s, before + _TIME_RE, 4), 9, "0").cast("long")
    return (g(1) * 3600 + g(2) * 60 + g(3)) * SECOND + fraction


def _from_text(k: str, v: Val) -> Val:
    s = v.col
    if k == "date":
        return Val(_parse_date(s), DATE)
    clock = F.when(F.contains(s, F.lit("T")), F.substring_index(s, "T", -1)).otherwise(s if k in ("time", "localtime") else F.lit("00"))
    clock = F.when(F.contains(s, F.lit("[")), F.concat(F.substring_index(F.substring_index(s, "[", 1), "T", -1), F.lit("["), F.substring_index(s, "[", -1))).otherwise(clock)
    nanos = _parse_nanos(clock, "^")
    if k == "localtime":
        return Val(F.when(s.isNotNull(), F.struct(nanos.alias("_lt"))), LOCALTIME)
    written, named = F.regexp_extract(clock, _ZONE_RE, 1), F.regexp_extract(clock, _ZONE_RE, 2)
    if k == "time":
        offset, _ = _offset_at(Val(F.when(written == "", "Z").otherwise(written), STRING), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
        return Val(F.when(s.isNotNull(), F.struct(nanos.alias("_tm"), offset.alias("_offset"))), TIME)
    stamp = _stamp(_parse_date(F.substring_index(s, "T", 1)), nanos)
    if k == "localdatetime":
        return Val(stamp, LOCAL)
    zone = F.when(written != "", written).when(named != "", named).otherwise("Z")
    offset, _ = _offset_at(Val(zone, STRING), stamp)
    return Val(F.when(s.isNotNull(), F.struct(stamp.alias("_dt"), offset.alias("_offset"), F.nullif(named, F.lit("")).alias("_zone"))), DATETIME)


def construct(k: str, args: list[Val]) -> Val:
    """date(), time() ... from a map, text, another temporal value, or nothing (the epoch)."""
    if not args:
        return _from_map(k, {"year": lit(1970)})
    v = args[0]
    if v.type == NULL:
        return null({"date": DATE, "localdatetime": LOCAL, "datetime": DATETIME, "time": TIME, "localtime": LOCALTIME}[k])
    if v.type == STRING:
        return _from_text(k, v)
    if v.fields is not None:
        return _from_map(k, v.fields)
    if is_temporal(v.type):
        if k == "date":
            return Val(date_of(v), DATE)
        if k == "localdatetime":
            return Val(_stamp(date_of(v), nanos_of(v)), LOCAL)
        if k == "localtime":
            return Val(F.when(v.col.isNotNull(), F.struct(nanos_of(v).alias("_lt"))), LOCALTIME)
        if k == "time":
            return Val(F.when(v.col.isNotNull(), F.struct(nanos_of(v).alias("_tm"), offset_of(v).alias("_offset"))), TIME)
        zone = v.col["_zone"] if kind(v.type) == "datetime" else F.lit(None).cast("string")
        return Val(F.when(v.col.isNotNull(), F.struct(_stamp(date_of(v), nanos_of(v)).alias("_dt"), offset_of(v).alias("_offset"), zone.alias("_zone"))), DATETIME)
    if is_map(v.type):
        return _from_map(k, {f.name: Val(v.col[f.name], f.dataType) for f in v.type.fields})
    raise CypherError("InvalidArgumentType", k)


def from_epoch(args: list[Val], millis: bool) -> Val:
    base = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    n = _long(args[0].col) * 10**6 if millis else _long(args[0].col) * SECOND + (_long(args[1].col) if len(args) > 1 else _long(0))
    stamp = base + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (_fdiv(n, 1000).cast("decimal(20,0)") / F.lit(1_000_000)).cast("decimal(18,6)"))
    return Val(F.struct(stamp.alias("_dt"), _long(0).alias("_offset"), F.lit(None).cast("string").alias("_zone")), DATETIME)


def truncate(k: str, args: list[Val]) -> Val:
    if len(args) < 2 or not isinstance(args[0].const, str):
        raise CypherError("InvalidArgumentType", f"{k}.truncate takes a unit's name and a value")
    unit, v = args[0].const.lower(), args[1]
    d, n = date_of(v), nanos_of(v)
    spans = {"day": DAY, "hour": 3600 * SECOND, "minute": 60 * SECOND, "second": SECOND, "millisecond": 10**6, "microsecond": 1000}
    years = {"millennium": 1000, "century": 100, "decade": 10, "year": 1}
    if unit in years:
        d, n = F.make_date((_fdiv(_long(F.year(d)), years[unit]) * years[unit]).cast("int"), F.lit(1), F.lit(1)), _long(0)
    elif unit == "weekyear":
        jan4 = F.make_date(F.extract(F.lit("YEAROFWEEK"), d).cast("int"), F.lit(1), F.lit(4))
        d, n = F.date_sub(jan4, F.weekday(jan4)), _long(0)
    elif unit in ("quarter", "month", "week"):
        d, n = F.trunc(d, unit), _long(0)
    elif unit in spans:
        n = n - F.pmod(n, _long(spans[unit])) if unit != "day" else _long(0)
    else:
        raise CypherError("InvalidArgumentValue", f"unit {unit}")
    base = {"date": Val(d, DATE), "time": Val(F.struct(n.alias("_lt")), LOCALTIME)}
    m = dict(args[2].fields or {}) if len(args) > 2 else {}
    lower = {x.lower() for x in m}
    sub = {"millisecond": 10**6, "microsecond": 1000}
    if lower & {"nanosecond", "microsecond", "millisecond"} and unit in sub:
        # finer fields add to what the unit leaves
        left = F.pmod(n, _long(SECOND))
        m["nanosecond"] = Val(left + (m["nanosecond"].col if "nanosecond" in m else _long(0)), LONG)
    if "dayofweek" in lower and "week" not in lower:
        m["week"], m["year"] = Val(_long(F.weekofyear(d)), LONG), Val(_long(F.extract(F.lit("YEAROFWEEK"), d)), LONG)
    if k in ("time", "datetime") and "timezone" not in lower:
        out = _from_map("localdatetime", m | base)
        if k == "time":
            return Val(F.struct(nanos_of(out).alias("_tm"), offset_of(v).alias("_offset")), TIME)
        zone = v.col["_zone"] if kind(v.type) == "datetime" else F.lit(None).cast("string")
        return Val(F.struct(out.col.alias("_dt"), offset_of(v).alias("_offset"), zone.alias("_zone")), DATETIME)
    out = _from_map(k, m | base)
    return Val(F.when(v.col.isNotNull(), out.col), out.type)


# --- durations -------------------------------------------------------------------------------

_PARTS = {"years": ("m", 12), "quarters": ("m", 3), "months": ("m", 1), "weeks": ("d", 7), "days": ("d", 1), "hours": ("n", 3600 * SECOND), "minutes": ("n", 60 * SECOND), "seconds": ("n", SECOND), "milliseconds": ("n", 10**6), "microseconds": ("n", 1000), "nanoseconds": ("n", 1)}
_MONTH_NANOS = 2_629_746 * SECOND


def _struct(m: Column, d: Column, n: Column) -> Val:
    return Val(F.struct(_long(m).alias("_months"), _long(d).alias("_days"), _long(n).alias("_nanos")), DURATION)


def _cascade(m: Column, d: Column, n: Column) -> Val:
    """Doubles to whole parts: fractions of months go to days, of days to nanoseconds."""
    whole_m = F.when(m >= 0, F.floor(m)).otherwise(F.ceil(m))
    d = d + (m - whole_m) * (_MONTH_NANOS / DAY)
    whole_d = F.when(d >= 0, F.floor(d + 1e-12)).otherwise(F.ceil(d - 1e-12))
    return _struct(whole_m, whole_d, F.round(n + (d - whole_d) * DAY))


def duration(args: list[Val]) -> Val:
    v = args[0]
    if v.type == NULL or is_duration(v.type):
        return v if v.type != NULL else null(DURATION)
    if v.type == STRING:
        s = v.col
        sign = "([-+]?\\d+(?:[.,]\\d+)?)"
        get = lambda pattern: F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(s, pattern, 1), ",", "."), F.lit("")).try_cast("double"), F.lit(0.0))
        date, time = "^[^T]*?", "T.*?"
        m = get(date + sign + "Y") * 12 + get(date + sign + "M")
        d = get(date + sign + "W") * 7 + get(date + sign + "D")
        n = get(time + sign + "H") * (3600 * SECOND) + get(time + sign + "M") * (60 * SECOND)
        sec = F.coalesce(F.nullif(F.regexp_replace(F.regexp_extract(s, time + sign + "S", 1), ",", "."), F.lit("")).try_cast("decimal(28,9)"), F.lit(0).cast("decimal(28,9)"))
        base = _cascade(m, d, n)
        by_parts = F.struct(base.col["_months"].alias("_months"), base.col["_days"].alias("_days"), (base.col["_nanos"] + (sec * SECOND).cast("long")).alias("_nanos"))
        whole = "^P(\\d{4})-(\\d{2})-(\\d{2})T(\\d{2}):(\\d{2}):(\\d{2})$"
        g = lambda k: F.coalesce(_int(F.regexp_extract(s, whole, k)), _long(0))
        by_clock = F.struct((g(1) * 12 + g(2)).alias("_months"), g(3).alias("_days"), ((g(4) * 3600 + g(5) * 60 + g(6)) * SECOND).alias("_nanos"))
        return Val(F.when(s.isNull(), None).when(F.rlike(s, F.lit(whole)), by_clock).otherwise(by_parts), DURATION)
    fields = v.fields if v.fields is not None else {f.name: Val(v.col[f.name], f.dataType) for f in v.type.fields} if is_map(v.type) else None
    if fields is None:
        raise CypherError("InvalidArgumentType", "duration")
    if unknown := {k.lower() for k in fields} - _PARTS.keys():
        raise CypherError("InvalidArgumentValue", f"unknown duration key {sorted(unknown)[0]}")
    if all(x.type == LONG for x in fields.values()):
        total = {p: sum((_long(x.col) * _PARTS[k.lower()][1] for k, x in fields.items() if _PARTS[k.lower()][0] == p), _long(0)) for p in "mdn"}
        return _struct(total["m"], total["d"], total["n"])
    total = {p: sum((x.col.cast("double") * float(_PARTS[k.lower()][1]) for k, x in fields.items() if _PARTS[k.lower()][0] == p), F.lit(0.0)) for p in "mdn"}
    return _cascade(total["m"], total["d"], total["n"])


def scaled(op: str, a: Val, b: Val) -> Val:
    v, by = (a, b) if is_duration(a.type) else (b, a)
    if not is_number(by.type) or op == "/" and not is_duration(a.type):
        return null()
    if op == "*" and by.type == LONG:
        return _struct(v.col["_months"] * by.col, v.col["_days"] * by.col, v.col["_nanos"] * by.col)
    f = by.col.cast("double") if op == "*" else F.try_divide(F.lit(1.0), by.col.cast("double"))
    return _cascade(v.col["_months"] * f, v.col["_days"] * f, v.col["_nanos"] * f)


def plus(a: Val, b: Val, sign: int) -> Val:
    if is_duration(a.type) and is_duration(b.type):
        return _struct(*[a.col[k] + b.col[k] * sign for k in ("_months", "_days", "_nanos")])
    if is_duration(a.type) and sign == 1:
        a, b = b, a
    if not is_duration(b.type) or not is_temporal(a.type):
        return null()
    m, d, n = (b.col[k] * sign for k in ("_months", "_days", "_nanos"))
    k = kind(a.type)
    day = F.date_add(F.add_months(date_of(a), m.cast("int")), d.cast("int"))
    if k == "date":
        return Val(F.date_add(day, _tdiv(n, DAY).cast("int")), DATE)
    total = nanos_of(a) + n
    if k == "localtime":
        return Val(F.struct(F.pmod(total, _long(DAY)).alias("_lt")), LOCALTIME)
    if k == "time":
        return Val(F.struct(F.pmod(total, _long(DAY)).alias("_tm"), a.col["_offset"].alias("_offset")), TIME)
    stamp = _stamp(F.date_add(day, _fdiv(total, DAY).cast("int")), F.pmod(total, _long(DAY)))
    if k == "localdatetime":
        return Val(stamp, LOCAL)
    return Val(F.struct(stamp.alias("_dt"), a.col["_offset"].alias("_offset"), a.col["_zone"].alias("_zone")), DATETIME)


def between(how: str, args: list[Val]) -> Val:
    """duration.between, .inMonths, .inDays, .inSeconds."""
    a, b = args
    if NULL in (a.type, b.type):
        return null(DURATION)
    ka, kb = kind(a.type), kind(b.type)
    has_date = {"date", "localdatetime", "datetime"}
    da, db = date_of(a), date_of(b)
    if ka not in has_date:
        da = db
    if kb not in has_date:
        db = da
    na, nb = nanos_of(a), nanos_of(b)
    if {ka, kb} <= {"datetime", "time"}:
        na, nb = na - offset_of(a) * SECOND, nb - offset_of(b) * SECOND
        da, na = F.date_add(da, _fdiv(na, DAY).cast("int")), F.pmod(na, _long(DAY))
        db, nb = F.date_add(db, _fdiv(nb, DAY).cast("int")), F.pmod(nb, _long(DAY))
    days = _epoch_day(db) - _epoch_day(da)
    if how == "inseconds":
        return _struct(_long(0), _long(0), days * DAY + nb - na)
    forward = (days > 0) | (days == 0) & (nb >= na)
    if how == "indays":
        part = F.when(forward & (days > 0) & (nb < na), -1).when(~forward & (days < 0) & (nb > na), 1).otherwise(0)
        return _struct(_long(0), days + part, _long(0))
    months = (_long(F.year(db)) - _long(F.year(da))) * 12 + F.month(db) - F.month(da)
    at = F.add_months(da, months.cast("int"))
    over = F.when(forward & ((at > db) | (at == db) & (na > nb)), -1).when(~forward & ((at < db) | (at == db) & (na < nb)), 1).otherwise(0)
    months = months + over
    if how == "inmonths":
        return _struct(months, _long(0), _long(0))
    at = F.add_months(da, months.cast("int"))
    left = _epoch_day(db) - _epoch_day(at)
    part = F.when(forward & (left > 0) & (nb < na), -1).when(~forward & (left < 0) & (nb > na), 1).otherwise(0)
    return _struct(months, left + part, nb - na - part * DAY)


# --- accessors -------------------------------------------------------------------------------


def accessor(v: Val, key: str) -> Val | None:
    k, key = kind(v.type), key.lower()
    if k == "duration":
        m, d, n = v.col["_months"], v.col["_days"], v.col["_nanos"]
        mod = lambda a, x: F.pmod(a, _long(x))
        table = {
            "years": _fdiv(m, 12), "quarters": _fdiv(m, 3), "months": m, "weeks": _fdiv(d, 7), "days": d, "hours": _fdiv(n, 3600 * SECOND), "minutes": _fdiv(n, 60 * SECOND), "seconds": _fdiv(n, SECOND), "milliseconds": _fdiv(n, 10**6),
            "microseconds": _fdiv(n, 1000), "nanoseconds": n, "quartersofyear": _fdiv(mod(m, 12), 3), "monthsofquarter": mod(m, 3), "monthsofyear": mod(m, 12), "daysofweek": mod(d, 7), "minutesofhour": mod(_fdiv(n, 60 * SECOND), 60),
            "secondsofminute": mod(_fdiv(n, SECOND), 60), "millisecondsofsecond": mod(_fdiv(n, 10**6), 1000), "microsecondsofsecond": mod(_fdiv(n, 1000), 10**6), "nanosecondsofsecond": mod(n, SECOND),
        }
        return Val(table[key], LONG) if key in table else None
    if k in ("date", "localdatetime", "datetime"):
        d = date_of(v)
        table = {
            "year": F.year, "quarter": F.quarter, "month": F.month, "week": F.weekofyear, "weekyear": lambda x: F.extract(F.lit("YEAROFWEEK"), x), "day": F.dayofmonth, "ordinalday": F.dayofyear, "weekday": lambda x: F.weekday(x) + 1, "dayofweek": lambda x: F.weekday(x) + 1,
            "dayofquarter": lambda x: F.datediff(x, F.trunc(x, "quarter")) + 1,
        }
        if key in table:
            return Val(_long(table[key](d)), LONG)
    if k != "date":
        n = nanos_of(v)
        table = {"hour": _fdiv(n, 3600 * SECOND), "minute": F.pmod(_fdiv(n, 60 * SECOND), _long(60)), "second": F.pmod(_fdiv(n, SECOND), _long(60)), "millisecond": _fdiv(F.pmod(n, _long(SECOND)), 10**6), "microsecond": _fdiv(F.pmod(n, _long(SECOND)), 1000), "nanosecond": F.pmod(n, _long(SECOND))}
        if key in table:
            return Val(table[key], LONG)
    if k in ("datetime", "time"):
        o = v.col["_offset"]
        if key in ("offset", "timezone"):
            text = _offset_text(o)
            return Val(F.coalesce(v.col["_zone"], text) if key == "timezone" and k == "datetime" else text, STRING)
        if key in ("offsetminutes", "offsetseconds"):
            return Val(_tdiv(o, 60) if key == "offsetminutes" else o, LONG)
    if k == "datetime" and key in ("epochseconds", "epochmillis"):
        return Val(_fdiv(sort_key(v), 10**6 if key == "epochseconds" else 1000), LONG)
    return None

