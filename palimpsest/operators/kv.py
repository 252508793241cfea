"""Key-value commands over an overlaid table.

A dataset of keys is a table with the key as primary key and one column for
each kind of value. A read command is a column expression over a key's row, a
write command gives the new row as expressions over the old one; so the same
command runs on one key or, with ``each``, on all keys that match a pattern,
in one Spark job, and a write is one more segment of the overlay.
"""

from __future__ import annotations

import datetime
import json
import random
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotSupported, OverlayError, SyntaxProblem
from ..session import OverlaySession
from ..state import DEAD

_strings_map, _strings_array = T.MapType(T.StringType(), T.StringType()), T.ArrayType(T.StringType())
SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("type", T.StringType()), T.StructField("str", T.BinaryType()), T.StructField("hash", _strings_map), T.StructField("list", _strings_array), T.StructField("set", _strings_array),
    T.StructField("zset", T.ArrayType(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("member", T.StringType())]))),
    T.StructField("stream", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("fields", _strings_map)]))), T.StructField("expire_at", T.TimestampType()),
])
VALUES = ("str", "hash", "list", "set", "zset", "stream")
#: The value column of each type; fixed values.
COLUMN_OF = {"string": "str", "hash": "hash", "list": "list", "set": "set", "zset": "zset", "stream": "stream", "hll": "set", "geo": "hash"}

#: Commands that only concern the connection or server, that run scripts, and that are refused; fixed values.
SESSION = frozenset("PING ECHO QUIT AUTH SELECT INFO CONFIG TIME COMMAND CLIENT CLUSTER WAIT WAITAOF PUBSUB SLOWLOG MEMORY LATENCY MODULE RESET HELLO SUBSCRIBE PSUBSCRIBE SSUBSCRIBE UNSUBSCRIBE PUNSUBSCRIBE SUNSUBSCRIBE UNWATCH".split())
SCRIPTS = frozenset("EVAL EVALSHA EVALRO EVALSHA_RO FCALL FCALL_RO FUNCTION SCRIPT".split())
REFUSED = frozenset("DEBUG SHUTDOWN REPLICAOF SLAVEOF FAILOVER BGSAVE BGREWRITEAOF PUBLISH SWAPDB MOVE".split())


class WrongType(OverlayError):
    sqlstate = "WRONGTYPE"


def glob(pattern: str) -> str:
    """A key pattern (*, ?, [set], backslash) as a regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and "]" in pattern[i:]:
            j = pattern.index("]", i)
            out.append("[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]")
            i = j
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out.append(re.escape(pattern[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


# -- small expressions ---------------------------------------------------------------------

_text = lambda c: c.cast("string")
_bytes = lambda c: c.cast("string").cast("binary")


def _or(name: str) -> Column:
    """A value column, empty where the key is missing."""
    empty = F.create_map() if name == "hash" else F.array()
    return F.coalesce(F.col(name), empty.cast(SCHEMA[name].dataType))


_strings = lambda values: F.array(*[F.lit(str(v)) for v in values]).cast("array<string>")


def _slice(array: Column, start: int, stop: int) -> Column:
    """Elements start..stop, both counted from 0 and from the end if negative."""
    n = F.size(array)
    a = F.greatest(F.lit(start) if start >= 0 else n + start, F.lit(0))
    b = F.least(F.lit(stop) if stop >= 0 else n + stop, n - 1)
    return F.when(b >= a, F.slice(array, a + 1, F.greatest(b - a + 1, F.lit(1)))).otherwise(F.slice(array, 1, 0))


def _score(member: str) -> Column:
    return F.get(F.filter(F.col("zset"), lambda e: e["member"] == member), F.lit(0))["score"]


def _score_in(entries: Column, member: str | Column) -> Column:
    return F.get(F.filter(entries, lambda e: e["member"] == member), F.lit(0))["score"]


def _bound(text: str) -> Callable[[Column, bool], Column]:
    """A score bound: number, (number, -inf, +inf."""
    open_ = text.startswith("(")
    value = float(text.lstrip("(").replace("+inf", "inf"))
    return lambda s, low: (s > value if open_ else s >= value) if low else (s < value if open_ else s <= value)


def _by_score(low: str, high: str) -> Column:
    a, b = _bound(str(low)), _bound(str(high))
    return F.filter(_or("zset"), lambda e: a(e["score"], True) & b(e["score"], False))


def _by_lex(low: str, high: str) -> Column:
    def side(text: str, is_low: bool) -> Callable[[Column], Column]:
        if text in ("-", "+"):
            return lambda m: F.lit((text == "-") == is_low)
        value = text[1:]
        if text[0] == "[":
            return (lambda m: m >= value) if is_low else (lambda m: m <= value)
        return (lambda m: m > value) if is_low else (lambda m: m < value)

    a, b = side(low, True), side(high, False)
    return F.filter(_or("zset"), lambda e: a(e["member"]) & b(e["member"]))


def _members(zset: Column, args: Sequence = ()) -> Column:
    """Members, or member and score in turn with WITHSCORES."""
    if any(str(a).upper() == "WITHSCORES" for a in args):
        return F.flatten(F.transform(zset, lambda e: F.array(e["member"], _number(e["score"]))))
    return F.transform(zset, lambda e: e["member"])


def _number(c: Column) -> Column:
    """A double as text, whole numbers without a point."""
    return F.when(c == F.floor(c), F.floor(c).cast("string")).otherwise(c.cast("string"))


def _sorted(entries: Column) -> Column:
    return F.array_sort(entries)


def _byte_at(i: int) -> Column:
    return F.coalesce(F.conv(F.nullif(F.substring(F.hex(F.col("str")), 2 * i + 1, 2), F.lit("")), 16, 10).cast("int"), F.lit(0))


def _haversine(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    lon1, lat1, lon2, lat2 = (F.radians(x) for x in (*a, *b))
    h = F.pow(F.sin((lat2 - lat1) / 2), 2) + F.cos(lat1) * F.cos(lat2) * F.pow(F.sin((lon2 - lon1) / 2), 2)
    return F.lit(2 * 6372797.560856) * F.asin(F.sqrt(h))


def _place(member: Column | str) -> tuple[Column, Column]:
    p = F.split(F.col("hash")[member] if isinstance(member, str) else F.col("hash").getItem(member), " ")
    return p[0].cast("double"), p[1].cast("double")


UNITS = {"m": 1.0, "km": 1000.0, "mi": 1609.34, "ft": 0.3048}

# -- reads: (type the key must have or None, expression of the arguments, value for a missing key) -----


@dataclass(frozen=True)
class Read:
    kind: str | None
    value: Callable[..., Column]
    missing: Any = None


def _random(array: Column, n: int = 1, salt: int | None = None) -> Column:
    """n different elements drawn at random, or, if n is negative, -n elements that may repeat. One salt gives one draw."""
    salt = random.getrandbits(62) if salt is None else salt
    if n < 0:
        return F.transform(F.sequence(F.lit(1), F.lit(-n)), lambda i: F.get(array, F.pmod(F.xxhash64(F.lit(salt), i), F.greatest(F.size(array), F.lit(1))).cast("int")))
    return F.slice(F.transform(F.array_sort(F.transform(array, lambda x: F.struct(F.xxhash64(F.lit(salt), x).alias("h"), x.alias("x")))), lambda e: e["x"]), 1, n)


def _random_with(array: Column, n: Any, o: Sequence, word: str, value: Callable[[Column], Column]) -> Column:
    """Random names, each followed by its value where the option says so."""
    names = _random(array, int(n))
    if word not in [str(x).upper() for x in o]:
        return names
    return F.flatten(F.transform(names, lambda m: F.array(m, value(m))))


def _geo_rows(center: tuple[Column, Column]) -> Column:
    """(d, m, lon, lat) of all members, nearest first."""
    place = lambda m, i: F.split(F.col("hash")[m], " ")[i].cast("double")
    rows = F.transform(F.map_keys(F.col("hash")), lambda m: F.struct(_haversine(center, (place(m, 0), place(m, 1))).alias("d"), m.alias("m"), place(m, 0).alias("lon"), place(m, 1).alias("lat")))
    return F.array_sort(rows)


def _geo_reply(rows: Column, unit: str, o: Sequence) -> Column:
    """Members in order, up to COUNT of them, with what the options ask for."""
    upper = [str(x).upper() for x in o]
    rows = F.reverse(rows) if "DESC" in upper else rows
    if "COUNT" in upper:
        rows = F.slice(rows, 1, int(o[upper.index("COUNT") + 1]))
    distance = lambda e: F.format_string("%.4f", F.round(e["d"] / UNITS[unit.lower()], 4))
    more = [f for word, f in (("WITHDIST", lambda e: [distance(e)]), ("WITHCOORD", lambda e: [_number(e["lon"]), _number(e["lat"])])) if word in upper]
    if not more:
        return F.transform(rows, lambda e: e["m"])
    return F.transform(rows, lambda e: F.array(e["m"], *[c for f in more for c in f(e)]))


def _geo_near(center: tuple[Column, Column], radius: Any, unit: str, o: Sequence = ()) -> Column:
    limit = float(radius) * UNITS[unit.lower()]
    return _geo_reply(F.filter(_geo_rows(center), lambda e: e["d"] <= limit), unit, o)


def _geo_box(center: tuple[Column, Column], width: Any, height: Any, unit: str, o: Sequence) -> Column:
    """Within half the height along the meridian and half the width along the member's parallel."""
    w, h = float(width) * UNITS[unit.lower()] / 2, float(height) * UNITS[unit.lower()] / 2
    up = lambda e: F.lit(6372797.560856) * F.abs(F.radians(e["lat"] - center[1]))
    along = lambda e: _haversine((center[0], e["lat"]), (e["lon"], e["lat"]))
    return _geo_reply(F.filter(_geo_rows(center), lambda e: (up(e) <= h) & (along(e) <= w)), unit, o)


def _lpos(value: str, *o: Any) -> Column:
    """Places of a value: the RANKth from the start (or, if negative, from the end), COUNT of them (0: all), within MAXLEN elements."""
    rank, count, most = int(_option(o, "RANK", 1)), _option(o, "COUNT", None), int(_option(o, "MAXLEN", 0))
    n = F.size(F.col("list"))
    found = F.filter(F.transform(F.col("list"), lambda x, i: F.when(x == str(value), i.cast("long"))), lambda i: i.isNotNull())
    if most:
        found = F.filter(found, lambda i: i < most if rank > 0 else i >= n - most)
    if rank < 0:
        found = F.reverse(found)
    if count is None:
        return F.get(found, F.lit(abs(rank) - 1))
    return F.slice(found, F.lit(abs(rank)), F.lit(int(count)) if int(count) else F.size(F.col("list")) + 1)


def _getrange(start: int, stop: int) -> Column:
    n = F.octet_length(F.col("str"))
    a = F.greatest(F.lit(int(start)) if int(start) >= 0 else n + int(start), F.lit(0))
    b = F.least(F.lit(int(stop)) if int(stop) >= 0 else n + int(stop), n - 1)
    return F.when(b >= a, _text(F.unhex(F.substring(F.hex(F.col("str")), a * 2 + 1, (b - a + 1) * 2)))).otherwise("")


def _bits() -> Column:
    return F.concat_ws("", F.transform(F.filter(F.split(F.hex(F.coalesce(F.col("str"), F.lit(b""))), ""), lambda c: c != ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0")))


def _bit_range(o: Sequence) -> tuple[Column, Column]:
    """(bits from the first one asked for to the last, place of the first) by [start [end [BYTE | BIT]]]."""
    unit = 1 if o and str(o[-1]).upper() == "BIT" else 8
    o = [int(x) for x in o if str(x).upper() not in ("BIT", "BYTE")]
    n = F.length(_bits()) / unit
    place = lambda i: F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))
    first = place(o[0]) if o else F.lit(0)
    last = F.least(place(o[1]), n - 1) if len(o) > 1 else n - 1
    if len(o) > 1 and o[1] < 0:
        last = F.least(n + o[1], n - 1)
    at = (first * unit).cast("int")
    return F.substring(_bits(), at + 1, F.greatest((last - first + 1) * unit, F.lit(0)).cast("int")), at


def _bitcount(*o: Any) -> Column:
    return F.length(F.replace(_bit_range(o)[0], F.lit("0"))).cast("long")


def _bitpos(bit: Any, *o: Any) -> Column:
    """The first such bit, -1 if there is none; zeros follow the string where no end is given."""
    bits, at = _bit_range(o)
    ended = len([x for x in o if str(x).upper() not in ("BIT", "BYTE")]) > 1
    beyond = F.lit(-1) if ended or str(bit) == "1" else F.when(F.length(bits) > 0, F.length(_bits())).otherwise(-1)
    return F.when(F.instr(bits, str(bit)) > 0, F.instr(bits, str(bit)) - 1 + at).otherwise(beyond).cast("long")


_wide = lambda c: c.cast("decimal(20,0)")


def _field_at(kind: str, at: Any) -> tuple[bool, int, int]:
    """(signed, bits, place) of a bit field; a place with # counts fields."""
    width = int(str(kind)[1:])
    return str(kind)[0].lower() == "i", width, int(str(at)[1:]) * width if str(at).startswith("#") else int(at)


def _field(bits: Column, kind: str, at: Any) -> Column:
    """The number in a bit field; bits beyond the string are 0."""
    signed, width, place = _field_at(kind, at)
    value = _wide(F.conv(F.rpad(F.substring(bits, place + 1, width), width, "0"), 2, 10))
    return F.when(value >= Decimal(1 << (width - 1)), value - Decimal(1 << width)).otherwise(value).cast("long") if signed else value.cast("long")


def _fields(*ops: Any) -> Column:
    """GET type place, any number of times."""
    return F.array(*[_field(_bits(), ops[i + 1], ops[i + 2]) for i in range(0, len(ops), 3)])


READS: dict[str, Read] = {
    "GET": Read("string", lambda: _text(F.col("str"))),
    "GETRANGE": Read("string", _getrange, ""),
    "STRLEN": Read("string", lambda: F.octet_length(F.col("str")).cast("long"), 0),
    "TYPE": Read(None, lambda: F.when(F.col("type").isin("hll"), "string").when(F.col("type") == "geo", "zset").otherwise(F.col("type")), "none"),
    "DUMP": Read(None, lambda: F.to_json(F.struct("type", F.base64("str").alias("str"), "hash", "list", "set", "zset", "stream"))),
    "HGET": Read("hash", lambda f: F.col("hash")[str(f)]),
    "HGETALL": Read("hash", lambda: F.col("hash"), {}),
    "HMGET": Read("hash", lambda *fs: F.array(*[F.col("hash")[str(f)] for f in fs])),
    "HKEYS": Read("hash", lambda: F.array_sort(F.map_keys(F.col("hash"))), []),
    "HVALS": Read("hash", lambda: F.transform(F.array_sort(F.map_keys(F.col("hash"))), lambda k: F.col("hash")[k]), []),
    "HLEN": Read("hash", lambda: F.size(F.col("hash")).cast("long"), 0),
    "HEXISTS": Read("hash", lambda f: F.map_contains_key(F.col("hash"), str(f)).cast("int"), 0),
    "HSCAN": Read("hash", lambda cursor=0, *a: F.map_filter(F.col("hash"), lambda k, v: k.rlike(glob(_option(a, "MATCH", "*")))), {}),
    "HSTRLEN": Read("hash", lambda f: F.coalesce(F.octet_length(F.col("hash")[str(f)]), F.lit(0)).cast("long"), 0),
    "HRANDFIELD": Read("hash", lambda n=1, *o: _random_with(F.map_keys(F.col("hash")), n, o, "WITHVALUES", lambda k: F.col("hash")[k]), []),
    "LRANGE": Read("list", lambda a, b: _slice(F.col("list"), int(a), int(b)), []),
    "LINDEX": Read("list", lambda i: F.get(F.col("list"), F.lit(int(i)) if int(i) >= 0 else F.size(F.col("list")) + int(i))),
    "LLEN": Read("list", lambda: F.size(F.col("list")).cast("long"), 0),
    "LPOS": Read("list", _lpos),
    "SMEMBERS": Read("set", lambda: F.array_sort(F.col("set")), []),
    "SISMEMBER": Read("set", lambda m: F.array_contains(F.col("set"), str(m)).cast("int"), 0),
    "SMISMEMBER": Read("set", lambda *ms: F.array(*[F.array_contains(F.col("set"), str(m)).cast("int") for m in ms])),
    "SCARD": Read("set", lambda: F.size(F.col("set")).cast("long"), 0),
    "SRANDMEMBER": Read("set", lambda n=1: _random(F.col("set"), int(n)), []),
    "SSCAN": Read("set", lambda cursor=0, *a: F.filter(F.array_sort(F.col("set")), lambda m: m.rlike(glob(_option(a, "MATCH", "*")))), []),
    "ZRANGE": Read("zset", lambda a, b, *o: _zrange(a, b, o), []),
    "ZRANGEBYSCORE": Read("zset", lambda a, b, *o: _members(_limit(_by_score(a, b), o), o), []),
    "ZRANGEBYLEX": Read("zset", lambda a, b, *o: _members(_limit(_by_lex(a, b), o)), []),
    "ZREVRANGE": Read("zset", lambda a, b, *o: _members(_slice(F.reverse(F.col("zset")), int(a), int(b)), o), []),
    "ZREVRANGEBYSCORE": Read("zset", lambda b, a, *o: _members(_limit(F.reverse(_by_score(a, b)), o), o), []),
    "ZREVRANGEBYLEX": Read("zset", lambda b, a, *o: _members(_limit(F.reverse(_by_lex(a, b)), o)), []),
    "ZRANK": Read("zset", lambda m: F.nullif(F.array_position(F.transform(F.col("zset"), lambda e: e["member"]), str(m)), F.lit(0)) - 1),
    "ZREVRANK": Read("zset", lambda m: F.nullif(F.array_position(F.transform(F.reverse(F.col("zset")), lambda e: e["member"]), str(m)), F.lit(0)) - 1),
    "ZSCORE": Read("zset", lambda m: _score(str(m))),
    "ZMSCORE": Read("zset", lambda *ms: F.array(*[_score(str(m)) for m in ms])),
    "ZCARD": Read("zset", lambda: F.size(F.col("zset")).cast("long"), 0),
    "ZCOUNT": Read("zset", lambda a, b: F.size(_by_score(a, b)).cast("long"), 0),
    "ZLEXCOUNT": Read("zset", lambda a, b: F.size(_by_lex(a, b)).cast("long"), 0),
    "ZSCAN": Read("zset", lambda cursor=0, *a: _members(F.filter(F.col("zset"), lambda e: e["member"].rlike(glob(_option(a, "MATCH", "*")))), ["WITHSCORES"]), []),
    "ZRANDMEMBER": Read("zset", lambda n=1, *o: _random_with(F.transform(F.col("zset"), lambda e: e["member"]), n, o, "WITHSCORES", lambda m: _number(F.filter(F.col("zset"), lambda e: e["member"] == m)[0]["score"])), []),
    "XLEN": Read("stream", lambda: F.size(F.col("stream")).cast("long"), 0),
    "XRANGE": Read("stream", lambda a="-", b="+", *o: _limit_count(_ids(a, b), o), []),
    "XREVRANGE": Read("stream", lambda b="+", a="-", *o: _limit_count(F.reverse(_ids(a, b)), o), []),
    "PFCOUNT": Read("hll", lambda: F.size(F.col("set")).cast("long"), 0),
    "GETBIT": Read("string", lambda i: F.shiftright(_byte_at(int(i) // 8), 7 - int(i) % 8).bitwiseAND(1), 0),
    "BITCOUNT": Read("string", _bitcount, 0),
    "BITPOS": Read("string", _bitpos, lambda bit, *a: -1 if str(bit) == "1" else 0),
    "BITFIELD_RO": Read("string", _fields, lambda *a: [0] * (len(a) // 3)),
    "GEODIST": Read("geo", lambda a, b, unit="m": F.round(_haversine(_place(str(a)), _place(str(b))) / UNITS[str(unit).lower()], 4)),
    "GEOPOS": Read("geo", lambda *ms: F.array(*[F.col("hash")[str(m)] for m in ms])),
    "GEOHASH": Read("geo", lambda *ms: F.array(*[_geohash(_place(str(m))) for m in ms])),
    "GEORADIUS": Read("geo", lambda lon, lat, r, unit, *a: _geo_near((F.lit(float(lon)), F.lit(float(lat))), r, unit, a), []),
    "GEORADIUSBYMEMBER": Read("geo", lambda m, r, unit, *a: _geo_near(_place(str(m)), r, unit, a), []),
    "GEOSEARCH": Read("geo", lambda *a: _geo_search(a), []),
    "SORT": Read(None, lambda *a: _sort(a), []),
}


def _option(args: Sequence, name: str, default: Any) -> Any:
    upper = [str(a).upper() for a in args]
    return args[upper.index(name) + 1] if name in upper else default


def _limit(array: Column, args: Sequence) -> Column:
    upper = [str(a).upper() for a in args]
    if "LIMIT" not in upper:
        return array
    i = upper.index("LIMIT")
    offset, n = int(args[i + 1]), int(args[i + 2])
    return F.slice(array, offset + 1, n) if n >= 0 else F.slice(array, F.lit(offset + 1), F.greatest(F.size(array), F.lit(0)))


def _limit_count(array: Column, args: Sequence) -> Column:
    n = _option(args, "COUNT", None)
    return array if n is None else F.slice(array, 1, int(n))


def _zrange(a: Any, b: Any, o: Sequence) -> Column:
    upper = [str(x).upper() for x in o]
    rev = "REV" in upper
    if "BYSCORE" in upper:
        found = _by_score(b, a) if rev else _by_score(a, b)
    elif "BYLEX" in upper:
        found = _by_lex(b, a) if rev else _by_lex(a, b)
    else:
        return _members(_slice(F.reverse(F.col("zset")) if rev else F.col("zset"), int(a), int(b)), o)
    return _members(_limit(F.reverse(found) if rev else found, o), o)


def _id_key(i: Column) -> Column:
    """Entry ids sort by both numbers."""
    p = F.split(i, "-")
    return F.struct(p[0].cast("long"), F.coalesce(F.get(p, F.lit(1)).cast("long"), F.lit(0)))


def _ids(low: str, high: str) -> Column:
    out = F.col("stream")
    if low != "-":
        strict = low.startswith("(")
        key = _id_key(F.lit(low.lstrip("(")))
        out = F.filter(out, lambda e: _id_key(e["id"]) > key if strict else _id_key(e["id"]) >= key)
    if high != "+":
        key = _id_key(F.lit(high if "-" in high else f"{high}-{2**62}"))
        out = F.filter(out, lambda e: _id_key(e["id"]) <= key)
    return out


def _geohash(place: tuple[Column, Column]) -> Column:
    """Eleven characters of the usual base 32, from the interleaved bits of both numbers."""
    alphabet = "0123456789bcdefghjkmnpqrstuvwxyz"
    lon = F.floor((place[0] + 180) / 360 * float(1 << 28)).cast("long")
    lat = F.floor((place[1] + 90) / 180 * float(1 << 27)).cast("long")
    bits = F.concat_ws("", *[x for i in range(28) for x in ([F.shiftright(lon, 27 - i).bitwiseAND(1).cast("string")] + ([F.shiftright(lat, 26 - i).bitwiseAND(1).cast("string")] if i < 27 else []))])
    return F.concat(*[F.substring(F.lit(alphabet), F.conv(F.substring(bits, 5 * i + 1, 5), 2, 10).cast("int") + 1, F.lit(1)) for i in range(11)])


def _geo_search(a: Sequence) -> Column:
    upper = [str(x).upper() for x in a]
    if "FROMMEMBER" in upper:
        center = _place(str(a[upper.index("FROMMEMBER") + 1]))
    else:
        i = upper.index("FROMLONLAT")
        center = (F.lit(float(a[i + 1])), F.lit(float(a[i + 2])))
    if "BYBOX" in upper:
        i = upper.index("BYBOX")
        return _geo_box(center, a[i + 1], a[i + 2], str(a[i + 3]), a)
    i = upper.index("BYRADIUS")
    return _geo_near(center, a[i + 1], str(a[i + 2]), a)


def _sort(a: Sequence) -> Column:
    upper = [str(x).upper() for x in a]
    items = F.coalesce(F.col("list"), F.col("set"), F.transform(F.col("zset"), lambda e: e["member"]))
    if "ALPHA" in upper:
        out = F.array_sort(items)
    else:
        out = F.transform(F.array_sort(F.transform(items, lambda x: F.struct(x.cast("double").alias("n"), x.alias("x")))), lambda e: e["x"])
    return _limit(F.reverse(out) if "DESC" in upper else out, a)


# -- writes: new values of the row's columns and the reply -----------------------------------------


@dataclass(frozen=True)
class Change:
    """New value column (of ``kind``), reply, and whether the row is written at all. Extra columns override."""

    kind: str
    value: Column | None
    reply: Column
    when: Column | None = None
    extra: dict[str, Column] | None = None


_num = lambda c: F.coalesce(_text(c).try_cast("long"), F.lit(0))


def _set(now: datetime.datetime, value: Any, *o: Any) -> Change:
    upper = [str(x).upper() for x in o]
    expire: Column = F.lit(None).cast("timestamp")
    for name, scale, absolute in (("EX", 1, False), ("PX", 0.001, False), ("EXAT", 1, True), ("PXAT", 0.001, True)):
        if name in upper:
            n = float(o[upper.index(name) + 1]) * scale
            expire = F.timestamp_seconds(F.lit(n if absolute else now.timestamp() + n))
    if "KEEPTTL" in upper:
        expire = F.col("expire_at")
    when = ~F.col("type").isNotNull() if "NX" in upper else F.col("type").isNotNull() if "XX" in upper else None
    ok = F.lit("OK") if when is None else F.when(when, "OK")
    return Change("string", _bytes(F.lit(str(value))), _text(F.col("str")) if "GET" in upper else ok, when, {"expire_at": expire})


def _incr(by: Column) -> Change:
    return Change("string", _bytes(_num(F.col("str")) + by), _num(F.col("str")) + by)


def _hset(pairs: Sequence) -> Change:
    names = list(dict.fromkeys(str(f) for f in pairs[::2]))
    last = {str(f): str(v) for f, v in zip(pairs[::2], pairs[1::2])}
    new = F.create_map(*[x for f in names for x in (F.lit(f), F.lit(last[f]))])
    kept = F.map_filter(_or("hash"), lambda k, v: ~k.isin(*names))
    return Change("hash", F.map_concat(kept, new), F.lit(len(names)) - F.size(F.array_intersect(F.map_keys(_or("hash")), _strings(names))))


def _zadd(a: Sequence) -> Change:
    a = list(a)
    flags = set()
    while a and str(a[0]).upper() in ("NX", "XX", "GT", "LT", "CH", "INCR"):
        flags.add(str(a.pop(0)).upper())
    pairs = {str(m): float(s) for s, m in zip(a[::2], a[1::2])}
    old = _or("zset")
    entries = []
    for m, s in pairs.items():
        was = _score_in(old, m)
        value: Column = F.lit(s)
        if "INCR" in flags:
            value = F.coalesce(was, F.lit(0.0)) + s
        if "NX" in flags:
            value = F.coalesce(was, value)
        if "XX" in flags:
            value = F.when(was.isNotNull(), value)
        if "GT" in flags:
            value = F.coalesce(F.greatest(was, value), value)
        if "LT" in flags:
            value = F.coalesce(F.least(was, value), value)
        entries.append(F.struct(value.cast("double").alias("score"), F.lit(m).alias("member")))
    new = F.filter(F.array(*entries), lambda e: e["score"].isNotNull())
    kept = F.filter(old, lambda e: ~e["member"].isin(*pairs))
    value = _sorted(F.concat(kept, new))
    reply = F.size(value) - F.size(old) if "INCR" not in flags else F.get(new, F.lit(0))["score"]
    return Change("zset", value, reply)


def _zremove(entries: Column) -> Change:
    members = F.transform(entries, lambda e: e["member"])
    return Change("zset", F.filter(_or("zset"), lambda e: ~F.array_contains(members, e["member"])), F.size(members))


def _lrem(count: int, value: str) -> Column:
    value = str(value)
    if count == 0:
        return F.filter(_or("list"), lambda x: x != value)
    source = _or("list") if count > 0 else F.reverse(_or("list"))
    seen = lambda i: F.size(F.filter(F.slice(source, F.lit(1), i + 1), lambda y: y == value))
    kept = F.filter(source, lambda x, i: (x != value) | (seen(i) > abs(count)))
    return kept if count > 0 else F.reverse(kept)


def _linsert(where: str, pivot: str, value: str) -> Change:
    at = F.array_position(_or("list"), str(pivot)).cast("int")
    place = at if where.upper() == "BEFORE" else at + 1
    new = F.concat(F.slice(_or("list"), F.lit(1), F.greatest(place - 1, F.lit(0))), _strings([value]), F.slice(_or("list"), F.greatest(place, F.lit(1)), F.size(_or("list")) + 1))
    return Change("list", new, F.when(~F.col("type").isNotNull(), 0).when(at == 0, -1).otherwise(F.size(_or("list")) + 1), at > 0)


def _setbit(at: int, bit: int) -> Change:
    byte, shift = at // 8, 7 - at % 8
    text = F.rpad(F.coalesce(F.hex(F.col("str")), F.lit("")), F.greatest(F.length(F.coalesce(F.hex(F.col("str")), F.lit(""))), F.lit(2 * (byte + 1))), F.lit("0"))
    old = F.conv(F.substring(text, 2 * byte + 1, 2), 16, 10).cast("int")
    new = old.bitwiseOR(1 << shift) if bit else old.bitwiseAND(0xFF ^ (1 << shift))
    out = F.concat(F.substring(text, 1, 2 * byte), F.lpad(F.hex(new), 2, "0"), F.substring(text, 2 * byte + 3, 1 << 30))
    return Change("string", F.unhex(out), F.shiftright(old, shift).bitwiseAND(1))


def _xadd(now: datetime.datetime, i: str, *pairs: Any) -> Change:
    last = F.when(F.size(_or("stream")) > 0, F.element_at(_or("stream"), -1)["id"])
    ms = str(int(now.timestamp() * 1000))
    if i == "*":
        same = F.split(last, "-")[0] == ms
        new = F.concat(F.lit(ms + "-"), F.when(same, (F.split(last, "-")[1].cast("long") + 1).cast("string")).otherwise("0"))
    else:
        new = F.lit(i if "-" in i else f"{i}-0")
    fields = F.create_map(*[F.lit(str(x)) for x in pairs])
    return Change("stream", F.concat(_or("stream"), F.array(F.struct(new.alias("id"), fields.alias("fields")))), new)


def _trim(o: Sequence) -> Change:
    n = int([x for x in o if str(x).lstrip("~=").isdigit()][0])
    size = F.size(_or("stream"))
    return Change("stream", F.slice(_or("stream"), F.greatest(size - n, F.lit(0)) + 1, F.lit(max(n, 0))), F.greatest(size - n, F.lit(0)))


def _expire(at: Column) -> Change:
    return Change("", None, F.when(F.col("type").isNotNull(), 1).otherwise(0), F.col("type").isNotNull(), {"expire_at": at})


WRITES: dict[str, Callable[..., Change]] = {
    "SET": _set,
    "SETNX": lambda now, v: Change("string", _bytes(F.lit(str(v))), (~F.col("type").isNotNull()).cast("int"), ~F.col("type").isNotNull()),
    "SETEX": lambda now, s, v: _set(now, v, "EX", s),
    "PSETEX": lambda now, ms, v: _set(now, v, "PX", ms),
    "APPEND": lambda now, v: Change("string", F.concat(F.coalesce(F.col("str"), F.lit(b"")), _bytes(F.lit(str(v)))), F.coalesce(F.octet_length(F.col("str")), F.lit(0)) + len(str(v).encode())),
    "INCR": lambda now: _incr(F.lit(1)), "INCRBY": lambda now, n: _incr(F.lit(int(n))), "DECR": lambda now: _incr(F.lit(-1)), "DECRBY": lambda now, n: _incr(F.lit(-int(n))),
    "INCRBYFLOAT": lambda now, n: Change("string", _bytes(_number(F.coalesce(_text(F.col("str")).cast("double"), F.lit(0.0)) + float(n))), _number(F.coalesce(_text(F.col("str")).cast("double"), F.lit(0.0)) + float(n))),
    "GETSET": lambda now, v: Change("string", _bytes(F.lit(str(v))), _text(F.col("str")), None, {"expire_at": F.lit(None).cast("timestamp")}),
    "SETRANGE": lambda now, at, v: _setrange(int(at), str(v)),
    "GETDEL": lambda now: Change("string", F.lit(None).cast("binary"), _text(F.col("str"))),
    "GETEX": lambda now, *o: Change("", None, _text(F.col("str")), F.col("type").isNotNull(), {"expire_at": _getex(now, o)}),
    "HSET": lambda now, *p: _hset(p), "HMSET": lambda now, *p: Change("hash", _hset(p).value, F.lit("OK")),
    "HSETNX": lambda now, f, v: Change("hash", _hset((f, v)).value, F.when(F.coalesce(F.map_contains_key(F.col("hash"), str(f)), F.lit(False)), 0).otherwise(1), ~F.coalesce(F.map_contains_key(F.col("hash"), str(f)), F.lit(False))),
    "HINCRBY": lambda now, f, n: Change("hash", _hput(str(f), (F.coalesce(F.col("hash")[str(f)].cast("long"), F.lit(0)) + int(n)).cast("string")), F.coalesce(F.col("hash")[str(f)].cast("long"), F.lit(0)) + int(n)),
    "HINCRBYFLOAT": lambda now, f, n: Change("hash", _hput(str(f), _number(F.coalesce(F.col("hash")[str(f)].cast("double"), F.lit(0.0)) + float(n))), _number(F.coalesce(F.col("hash")[str(f)].cast("double"), F.lit(0.0)) + float(n))),
    "HDEL": lambda now, *fs: Change("hash", F.map_filter(_or("hash"), lambda k, v: ~k.isin(*[str(f) for f in fs])), F.size(F.array_intersect(F.map_keys(_or("hash")), _strings(fs)))),
    "LPUSH": lambda now, *v: Change("list", F.concat(_strings(v[::-1]), _or("list")), F.size(_or("list")) + len(v)),
    "RPUSH": lambda now, *v: Change("list", F.concat(_or("list"), _strings(v)), F.size(_or("list")) + len(v)),
    "LPUSHX": lambda now, *v: Change("list", F.concat(_strings(v[::-1]), _or("list")), F.when(F.col("type").isNotNull(), F.size(_or("list")) + len(v)).otherwise(0), F.col("type").isNotNull()),
    "RPUSHX": lambda now, *v: Change("list", F.concat(_or("list"), _strings(v)), F.when(F.col("type").isNotNull(), F.size(_or("list")) + len(v)).otherwise(0), F.col("type").isNotNull()),
    "LSET": lambda now, i, v: Change("list", F.transform(_or("list"), lambda x, n: F.when(n == (F.lit(int(i)) if int(i) >= 0 else F.size(F.col("list")) + int(i)), str(v)).otherwise(x)), F.lit("OK"), F.col("type").isNotNull()),
    "LINSERT": lambda now, w, p, v: _linsert(str(w), p, v),
    "LPOP": lambda now, n=None: Change("list", _slice(_or("list"), int(n or 1), -1), F.get(F.col("list"), F.lit(0)) if n is None else F.slice(_or("list"), 1, int(n))),
    "RPOP": lambda now, n=None: Change("list", _slice(_or("list"), 0, -1 - int(n or 1)), F.get(F.reverse(_or("list")), F.lit(0)) if n is None else F.slice(F.reverse(_or("list")), 1, int(n))),
    "LREM": lambda now, n, v: Change("list", _lrem(int(n), v), F.size(_or("list")) - F.size(_lrem(int(n), v))),
    "LTRIM": lambda now, a, b: Change("list", _slice(_or("list"), int(a), int(b)), F.lit("OK")),
    "SADD": lambda now, *m: Change("set", F.array_sort(F.array_union(_or("set"), _strings(m))), F.size(F.array_except(_strings(m), _or("set")))),
    "SREM": lambda now, *m: Change("set", F.array_except(_or("set"), _strings(m)), F.size(F.array_intersect(_or("set"), _strings(m)))),
    "SPOP": lambda now, n=None: _spop(n),
    "ZADD": lambda now, *a: _zadd(a), "ZINCRBY": lambda now, n, m: _zadd(("INCR", n, m)),
    "ZREM": lambda now, *m: _zremove(F.filter(_or("zset"), lambda e: e["member"].isin(*[str(x) for x in m]))),
    "ZREMRANGEBYSCORE": lambda now, a, b: _zremove(_by_score(a, b)), "ZREMRANGEBYLEX": lambda now, a, b: _zremove(_by_lex(a, b)), "ZREMRANGEBYRANK": lambda now, a, b: _zremove(_slice(_or("zset"), int(a), int(b))),
    "ZPOPMIN": lambda now, n=1: Change("zset", _slice(_or("zset"), int(n), -1), _members(F.slice(_or("zset"), 1, int(n)), ["WITHSCORES"])),
    "ZPOPMAX": lambda now, n=1: Change("zset", _slice(_or("zset"), 0, -1 - int(n)), _members(F.slice(F.reverse(_or("zset")), 1, int(n)), ["WITHSCORES"])),
    "XADD": _xadd,
    "XDEL": lambda now, *i: Change("stream", F.filter(_or("stream"), lambda e: ~e["id"].isin(*i)), F.size(F.filter(_or("stream"), lambda e: e["id"].isin(*i)))),
    "XTRIM": lambda now, *o: _trim(o),
    "PFADD": lambda now, *m: Change("hll", F.array_sort(F.array_union(_or("set"), _strings(m))), (F.size(F.array_except(_strings(m), _or("set"))) > 0).cast("int")),
    "SETBIT": lambda now, at, bit: _setbit(int(at), int(bit)),
    "GEOADD": lambda now, *a: Change("geo", _hset([x for lon, lat, m in zip(a[::3], a[1::3], a[2::3]) for x in (m, f"{float(lon)} {float(lat)}")]).value, _hset([x for lon, lat, m in zip(a[::3], a[1::3], a[2::3]) for x in (m, "")]).reply),
    "PERSIST": lambda now: Change("", None, F.when(F.col("expire_at").isNotNull(), 1).otherwise(0), F.col("type").isNotNull(), {"expire_at": F.lit(None).cast("timestamp")}),
    "EXPIRE": lambda now, s, *o: _expire(F.timestamp_seconds(F.lit(now.timestamp() + float(s)))), "PEXPIRE": lambda now, ms, *o: _expire(F.timestamp_seconds(F.lit(now.timestamp() + float(ms) / 1000))),
    "EXPIREAT": lambda now, s, *o: _expire(F.timestamp_seconds(F.lit(float(s)))), "PEXPIREAT": lambda now, ms, *o: _expire(F.timestamp_seconds(F.lit(float(ms) / 1000))),
}


def _spop(n: Any) -> Change:
    drawn = _random(_or("set"), int(1 if n is None else n), random.getrandbits(62))
    return Change("set", F.array_except(_or("set"), drawn), F.get(drawn, F.lit(0)) if n is None else drawn)


def _hput(field: str, value: Column) -> Column:
    return F.map_concat(F.map_filter(_or("hash"), lambda k, v: k != field), F.create_map(F.lit(field), value))


def _getex(now: datetime.datetime, o: Sequence) -> Column:
    upper = [str(x).upper() for x in o]
    if "PERSIST" in upper:
        return F.lit(None).cast("timestamp")
    return F.col("expire_at") if not upper else _set(now, "", *o).extra["expire_at"]


def _setrange(at: int, value: str) -> Change:
    raw = value.encode().hex().upper()
    old = F.coalesce(F.hex(F.col("str")), F.lit(""))
    padded = F.rpad(old, F.greatest(F.length(old), F.lit(2 * at)), F.lit("0"))
    out = F.concat(F.substring(padded, 1, 2 * at), F.lit(raw), F.substring(padded, 2 * at + len(raw) + 1, 1 << 30))
    return Change("string", F.unhex(out), (F.length(out) / 2).cast("long"))


class KeyValue:
    """Commands on one table of keys in a session. ``now`` may be fixed so that expiry is repeatable."""

    def __init__(self, session: OverlaySession, table: str = "kv", now: Callable[[], datetime.datetime] | None = None):
        self.session, self.table = session, table
        self.now = now or (lambda: datetime.datetime.now(datetime.UTC))
        self.queue: list[tuple] | None = None
        self.watched: dict[str, int] = {}
        self.settings: dict[str, str] = {}
        self.channels: dict[tuple[str, str], None] = {}

    # -- rows -----------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """All keys that haven't expired."""
        return self.session.table(self.table).filter(F.col("expire_at").isNull() | (F.col("expire_at") > F.timestamp_seconds(F.lit(self.now().timestamp()))))

    def keys(self, pattern: str = "*") -> DataFrame:
        return self.rows().filter(F.col("key").rlike(glob(pattern))).select("key")

    def each(self, command: str, pattern: str, *args: Any) -> DataFrame:
        """(key, value) of a read command on every key that matches and has the command's type."""
        spec = READS[command.upper()]
        rows = self.rows().filter(F.col("key").rlike(glob(pattern)))
        if spec.kind:
            rows = rows.filter(F.col("type") == spec.kind)
        return rows.select("key", spec.value(*args).alias("value"))

    def change_each(self, command: str, pattern: str, *args: Any) -> int:
        """A write command on every key that matches and has the command's type; how many keys it changed."""
        change = WRITES[command.upper()](self.now(), *args)
        rows = self.rows().filter(F.col("key").rlike(glob(pattern)))
        if change.kind:
            rows = rows.filter(F.col("type") == change.kind)
        return self._store(rows, change)

    def _store(self, rows: DataFrame, change: Change) -> int:
        """Write the changed rows as one segment; empty values take their keys away."""
        s = self.session
        version = s.version
        s._start = version
        state = version.get(self.table)
        if change.when is not None:
            rows = rows.filter(change.when)
        column = COLUMN_OF.get(change.kind)
        new = {c: F.col(c) for c in SCHEMA.fieldNames()}
        if column is not None:
            # A key that is set anew has no other value left.
            # (A stream's consumer groups are in its hash column and stay.)
            new.update({c: F.lit(None).cast(SCHEMA[c].dataType) for c in VALUES if (change.kind, c) != ("stream", "hash")})
            new[column] = change.value
            new["type"] = F.lit(change.kind)
        new.update(change.extra or {})
        out = rows.select(F.col("key").alias("__k0"), *[new[c].cast(SCHEMA[c].dataType).alias(c) for c in SCHEMA.fieldNames()])
        if column == "str":
            gone = F.col("str").isNull()
        elif column is not None:
            gone = F.coalesce(F.size(column), F.lit(0)) <= 0
        else:
            gone = F.coalesce(F.col("expire_at") <= F.timestamp_seconds(F.lit(self.now().timestamp())), F.lit(False))
        after, _, n = s.writer.apply(state, out.withColumn(DEAD, gone))
        if n:
            s._save(version.put(after))
        return n

    def _row(self, key: str) -> DataFrame:
        """One row for a key, nulls where it is missing."""
        one = self.session.spark.range(1).select(F.lit(str(key)).alias("k"))
        found = self.rows().filter(F.col("key") == str(key))
        return one.join(found, F.col("k") == F.col("key"), "left").withColumn("key", F.col("k")).drop("k")

    # -- one command ------------------------------------------------------------------------------

    def execute(self, command: str, *args: Any) -> Any:
        """Run a command and return its reply."""
        name = command.upper()
        if name in REFUSED:
            raise NotSupported(f"{name} would reach beyond the overlay")
        if name in SCRIPTS:
            raise NotSupported(f"{name}: scripts can't be inspected")
        if self.queue is not None and name not in ("EXEC", "DISCARD", "MULTI", "WATCH"):
            self.queue.append((name, *args))
            return "QUEUED"
        if name in SESSION:
            return self._server(name, [str(a) for a in args])
        special = getattr(self, f"_do_{name.lower()}", None)
        if special is not None:
            return special(*args)
        if name in READS:
            return self._read(name, args[0], args[1:])
        if name in WRITES:
            return self._write(name, args[0], args[1:])
        raise NotSupported(f"unknown command {name}")

    def _server(self, name: str, args: list[str]) -> Any:
        """Replies of commands on the connection or server. There is one server, of one database, without replicas."""
        word = args[0].upper() if args else ""
        if name == "PING":
            return args[0] if args else "PONG"
        if name == "ECHO":
            return args[0]
        if name == "TIME":
            now = self.now()
            return [str(int(now.timestamp())), str(now.microsecond)]
        if name == "SELECT":
            if word != "0":
                raise OverlayError("there is one database, 0")
            return "OK"
        if name == "INFO":
            return f"# Server\r\nmode:standalone\r\n# Keyspace\r\ndb0:keys={self._do_dbsize()}\r\n"
        if name == "CONFIG":
            if word == "SET":
                self.settings[args[1].lower()] = args[2]
                return "OK"
            return {k: v for k, v in sorted(self.settings.items()) if re.match(glob(args[1].lower()), k)} if word == "GET" else "OK"
        if name == "CLIENT":
            if word == "SETNAME":
                self.settings[" name"] = args[1]
                return "OK"
            return {"GETNAME": self.settings.get(" name"), "ID": 1}.get(word, "OK")
        if name == "COMMAND":
            names = sorted(set(READS) | set(WRITES) | SESSION | {x[4:].upper() for x in dir(self) if x.startswith("_do_")})
            return len(names) if word == "COUNT" else names
        if name == "MEMORY":
            return self._do_dump_size(args[1]) if word == "USAGE" else "OK"
        if name in ("WAIT", "WAITAOF"):
            return 0 if name == "WAIT" else [0, 0]
        if name in ("SLOWLOG", "LATENCY", "MODULE", "PUBSUB", "CLUSTER"):
            return 0 if word in ("LEN", "NUMPAT", "RESET") and name != "CLUSTER" else "cluster_enabled:0\r\n" if word == "INFO" else []
        if name == "HELLO":
            return {"server": "palimpsest", "proto": 3 if word == "3" else 2, "mode": "standalone", "role": "master", "modules": []}
        if name == "RESET":
            self.queue, self.watched, self.channels = None, {}, {}
            return "RESET"
        if name == "UNWATCH":
            self.watched = {}
            return "OK"
        if name in ("SUBSCRIBE", "PSUBSCRIBE", "SSUBSCRIBE"):
            self.channels |= {(name, c): None for c in args}
            return [[name.lower(), c, i + 1] for i, c in enumerate(args)]
        if name in ("UNSUBSCRIBE", "PUNSUBSCRIBE", "SUNSUBSCRIBE"):
            kind = name.replace("UN", "", 1)
            gone = args or [c for k, c in self.channels if k == kind]
            for c in gone:
                self.channels.pop((kind, c), None)
            return [[name.lower(), c, len(self.channels)] for c in gone]
        return "OK"  # AUTH, QUIT

    def _do_dump_size(self, key: str) -> int | None:
        row = self.rows().filter(F.col("key") == key).select(F.octet_length(F.to_json(F.struct("*")))).first()
        return row[0] if row else None

    def read_each(self, pattern: str, **commands: Sequence) -> DataFrame:
        """(key, a column for each read command of one type) on every key that matches, in one job: name=(command, arguments ...)."""
        kinds = {READS[c[0].upper()].kind for c in commands.values()} - {None}
        rows = self.rows().filter(F.col("key").rlike(glob(pattern)))
        if kinds:
            rows = rows.filter(F.col("type").isin(*kinds))
        return rows.select("key", *[READS[c[0].upper()].value(*c[1:]).alias(n) for n, c in commands.items()])

    def _read(self, name: str, key: str, args: Sequence) -> Any:
        spec = READS[name]
        row = self.rows().filter(F.col("key") == str(key)).select("type", spec.value(*args).alias("v")).first()
        if row is None:
            return [None] * len(args) if name in ("HMGET", "ZMSCORE", "GEOPOS") else [0] * len(args) if name == "SMISMEMBER" else spec.missing(*args) if callable(spec.missing) else spec.missing
        if spec.kind and row["type"] != spec.kind:
            raise WrongType(f"{key} holds a {row['type']}, not a {spec.kind}")
        return row["v"]

    def _write(self, name: str, key: str, args: Sequence) -> Any:
        change = WRITES[name](self.now(), *args)
        row = self._row(key)
        whole = F.coalesce(_text(F.col("str")).rlike(r"^-?\d+$"), F.lit(True))
        now = row.select("type", change.reply.alias("reply"), (F.lit(True) if change.when is None else F.coalesce(change.when, F.lit(False))).alias("go"), whole.alias("whole")).first()
        if change.kind and now["type"] not in (None, change.kind) and name not in ("SET", "SETEX", "PSETEX"):
            raise WrongType(f"{key} holds a {now['type']}, not a {change.kind}")
        if name in ("INCR", "INCRBY", "DECR", "DECRBY") and not now["whole"]:
            raise WrongType("value is not an integer")
        if now["go"] and not (now["type"] is None and name in POPS):
            self._store(row, change)
        return now["reply"]

    # -- commands on several keys or on the keyspace ------------------------------------------------

    def _values(self, keys: Sequence[str], column: str) -> list[Any]:
        got = {r["key"]: r[column] for r in self.rows().filter(F.col("key").isin([str(k) for k in keys])).select("key", column).collect()}
        return [got.get(str(k)) for k in keys]

    def _do_mget(self, *keys: str) -> list[str | None]:
        return [None if v is None else bytes(v).decode(errors="replace") for v in self._values(keys, "str")]

    def _do_exists(self, *keys: str) -> int:
        return sum(t is not None for t in self._values(keys, "type"))

    def _do_keys(self, pattern: str = "*") -> list[str]:
        return [r[0] for r in self.keys(pattern).orderBy("key").toLocalIterator()]

    def _do_scan(self, cursor: Any = 0, *o: Any) -> tuple[str, list[str]]:
        """The cursor is the last key seen; a page holds the next keys in order."""
        n = int(_option(o, "COUNT", 10))
        rows = self.rows().filter(F.col("key").rlike(glob(_option(o, "MATCH", "*"))))
        kind = _option(o, "TYPE", None)
        if kind:
            rows = rows.filter(F.col("type") == kind)
        if str(cursor) != "0":
            rows = rows.filter(F.col("key") > str(cursor))
        page = [r[0] for r in rows.select("key").orderBy("key").limit(n).collect()]
        return (page[-1] if len(page) == n else "0"), page

    def _do_dbsize(self) -> int:
        return self.rows().count()

    def _do_randomkey(self) -> str | None:
        row = self.rows().select("key").orderBy(F.xxhash64(F.lit(random.getrandbits(62)), "key")).limit(1).first()
        return row[0] if row else None

    def _do_ttl(self, key: str, scale: int = 1) -> int:
        row = self.rows().filter(F.col("key") == str(key)).select(F.unix_micros("expire_at").alias("e")).first()
        if row is None:
            return -2
        return -1 if row["e"] is None else round((row["e"] / 1e6 - self.now().timestamp()) * scale)

    def _do_pttl(self, key: str) -> int:
        return self._do_ttl(key, 1000)

    def _do_expiretime(self, key: str, scale: int = 1) -> int:
        row = self.rows().filter(F.col("key") == str(key)).select(F.unix_micros("expire_at").alias("e")).first()
        return -2 if row is None else -1 if row["e"] is None else row["e"] * scale // 1_000_000

    def _do_pexpiretime(self, key: str) -> int:
        return self._do_expiretime(key, 1000)

    def _do_del(self, *keys: str) -> int:
        n = self._do_exists(*dict.fromkeys(keys))
        self._store(self.rows().filter(F.col("key").isin([str(k) for k in keys])), Change("string", F.lit(None).cast("binary"), F.lit(0)))
        return n

    _do_unlink = _do_del

    def _do_mset(self, *pairs: str) -> str:
        """All pairs as one segment."""
        last = {str(k): str(v) for k, v in zip(pairs[::2], pairs[1::2])}
        rows = self.session.spark.createDataFrame([(k, "string", bytearray(v.encode()), None, None, None, None, None, None) for k, v in last.items()], SCHEMA)
        self._store(rows, Change("string", F.col("str"), F.lit(0)))
        return "OK"

    def _do_msetnx(self, *pairs: str) -> int:
        if self._do_exists(*pairs[::2]):
            return 0
        self._do_mset(*pairs)
        return 1

    def _put(self, key: str, kind: str, value: Any) -> int:
        """Store a whole value; an empty one takes the key away."""
        data = {c: None for c in SCHEMA.fieldNames()} | {"key": str(key), "type": kind, COLUMN_OF[kind]: value}
        row = self.session.spark.createDataFrame([tuple(data[c] for c in SCHEMA.fieldNames())], SCHEMA)
        self._store(row, Change(kind, F.col(COLUMN_OF[kind]), F.lit(0), None, {"expire_at": F.lit(None).cast("timestamp")}))
        return len(value)

    def _held(self, keys: Sequence[str], kinds: Sequence[str], column: str) -> DataFrame:
        """One row with the value of each key, v0, v1 ..., empty where it is missing; in one job, in the JVM."""
        rows = self.rows().filter(F.col("key").isin([str(k) for k in keys]))
        wrong = F.max(F.when(~F.col("type").isin(*kinds), F.col("key")))
        empty = F.lit(b"") if column == "str" else F.array().cast(SCHEMA[column].dataType)
        one = rows.agg(F.map_from_entries(F.collect_list(F.struct("key", column))).alias("m"), wrong.alias("wrong"))
        return one.select(*[F.coalesce(F.col("m")[str(k)], empty).alias(f"v{i}") for i, k in enumerate(keys)], "wrong")

    def _reply(self, one: DataFrame, value: Column) -> Any:
        row = one.select(value.alias("v"), "wrong").first()
        if row["wrong"] is not None:
            raise WrongType(f"{row['wrong']} holds another type")
        return row["v"]

    def _keep(self, to: str, kind: str, one: DataFrame, value: Column, size: Callable[[Column], Column] = F.size) -> int:
        """Store a value made in the JVM under a key; how large it is."""
        n = self._reply(one, size(value))
        made = {c: F.lit(None).cast(SCHEMA[c].dataType) for c in SCHEMA.fieldNames()} | {"key": F.lit(str(to)), "type": F.lit(kind), COLUMN_OF[kind]: value.cast(SCHEMA[COLUMN_OF[kind]].dataType)}
        self._store(one.select(*[made[c].alias(c) for c in SCHEMA.fieldNames()]), Change(kind, F.col(COLUMN_OF[kind]), F.lit(0), None, {"expire_at": F.lit(None).cast("timestamp")}))
        return n

    def _algebra(self, keys: Sequence[str], step: Callable[[Column, Column], Column], kinds: Sequence[str] = ("set",)) -> tuple[DataFrame, Column]:
        return self._held(keys, kinds, "set"), F.array_sort(reduce(step, [F.col(f"v{i}") for i in range(len(keys))]))

    def _do_sunion(self, *keys: str) -> list[str]:
        return self._reply(*self._algebra(keys, F.array_union))

    def _do_sinter(self, *keys: str) -> list[str]:
        return self._reply(*self._algebra(keys, F.array_intersect))

    def _do_sdiff(self, *keys: str) -> list[str]:
        return self._reply(*self._algebra(keys, F.array_except))

    def _do_sunionstore(self, to: str, *keys: str) -> int:
        return self._keep(to, "set", *self._algebra(keys, F.array_union))

    def _do_sinterstore(self, to: str, *keys: str) -> int:
        return self._keep(to, "set", *self._algebra(keys, F.array_intersect))

    def _do_sdiffstore(self, to: str, *keys: str) -> int:
        return self._keep(to, "set", *self._algebra(keys, F.array_except))

    def _do_sintercard(self, n: int, *keys: str) -> int:
        one, found = self._algebra(keys[: int(n)], F.array_intersect)
        limit = int(_option(keys, "LIMIT", 0))
        return self._reply(one, F.least(F.size(found), F.lit(limit)) if limit else F.size(found))

    def _do_smove(self, source: str, to: str, member: str) -> int:
        if not self.execute("SREM", source, member):
            return 0
        self.execute("SADD", to, member)
        return 1

    def _combine(self, n: int, rest: Sequence, inter: bool) -> tuple[DataFrame, Column]:
        """(values, members with their scores folded) of ZUNION and ZINTER, in the JVM."""
        keys, o = rest[: int(n)], list(rest[int(n) :])
        upper = [str(x).upper() for x in o]
        weights = [float(x) for x in o[upper.index("WEIGHTS") + 1 :][: int(n)]] if "WEIGHTS" in upper else [1.0] * int(n)
        fold = {"SUM": lambda a, b: a + b, "MIN": F.least, "MAX": F.greatest}[str(_option(o, "AGGREGATE", "SUM")).upper()]
        weighted = lambda z, w: F.transform(z, lambda e: F.struct((e["score"] * w).alias("score"), e["member"].alias("member")))
        sets = [weighted(F.col(f"v{i}"), w) for i, w in enumerate(weights)]
        names = lambda z: F.transform(z, lambda e: e["member"])
        members = reduce(F.array_intersect if inter else F.array_union, [names(z) for z in sets])

        def score(m: Column) -> Column:
            found = [_score_in(z, m) for z in sets]
            return reduce(lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(fold(a, b)), found)

        made = F.transform(members, lambda m: F.struct(score(m).alias("score"), m.alias("member")))
        return self._held(keys, ("zset",), "zset"), F.array_sort(made)

    def _zdiff(self, n: int, keys: Sequence[str]) -> tuple[DataFrame, Column]:
        others = [F.transform(F.col(f"v{i}"), lambda e: e["member"]) for i in range(1, int(n))]
        left = F.filter(F.col("v0"), lambda e: ~F.array_contains(F.flatten(F.array(*others)), e["member"])) if others else F.col("v0")
        return self._held(keys[: int(n)], ("zset",), "zset"), left

    def _do_zunionstore(self, to: str, n: int, *rest: Any) -> int:
        return self._keep(to, "zset", *self._combine(n, rest, False))

    def _do_zinterstore(self, to: str, n: int, *rest: Any) -> int:
        return self._keep(to, "zset", *self._combine(n, rest, True))

    def _do_zunion(self, n: int, *rest: Any) -> list[str]:
        one, made = self._combine(n, rest, False)
        return self._reply(one, _members(made, rest))

    def _do_zinter(self, n: int, *rest: Any) -> list[str]:
        one, made = self._combine(n, rest, True)
        return self._reply(one, _members(made, rest))

    def _do_zdiff(self, n: int, *keys: str) -> list[str]:
        one, made = self._zdiff(n, keys)
        return self._reply(one, _members(made, keys))

    def _do_zdiffstore(self, to: str, n: int, *keys: str) -> int:
        return self._keep(to, "zset", *self._zdiff(n, keys))

    def _do_zrangestore(self, to: str, key: str, *a: Any) -> int:
        flat = self.execute("ZRANGE", key, *a, "WITHSCORES")
        return self._put(to, "zset", sorted((float(s), m) for m, s in zip(flat[::2], flat[1::2])))

    def _do_rpoplpush(self, source: str, to: str) -> str | None:
        return self._do_lmove(source, to, "RIGHT", "LEFT")

    def _do_lmove(self, source: str, to: str, a: str, b: str, *timeout: Any) -> str | None:
        value = self.execute("LPOP" if a.upper() == "LEFT" else "RPOP", source)
        if value is not None:
            self.execute("LPUSH" if b.upper() == "LEFT" else "RPUSH", to, value)
        return value

    _do_blmove = _do_lmove

    def _first(self, command: str, keys: Sequence[str], column: str, *args: Any) -> tuple[str, Any] | None:
        for k, v in zip(keys, self._values(keys, column)):
            if v:
                return k, self.execute(command, k, *args)
        return None

    def _do_blpop(self, *a: Any) -> Any:
        return self._first("LPOP", a[:-1], "list")

    def _do_brpop(self, *a: Any) -> Any:
        return self._first("RPOP", a[:-1], "list")

    def _do_bzpopmin(self, *a: Any) -> Any:
        return self._first("ZPOPMIN", a[:-1], "zset")

    def _do_bzpopmax(self, *a: Any) -> Any:
        return self._first("ZPOPMAX", a[:-1], "zset")

    def _do_lmpop(self, n: int, *a: Any) -> Any:
        keys, o = a[: int(n)], a[int(n) :]
        return self._first("LPOP" if str(o[0]).upper() == "LEFT" else "RPOP", keys, "list", int(_option(o, "COUNT", 1)))

    def _do_zmpop(self, n: int, *a: Any) -> Any:
        keys, o = a[: int(n)], a[int(n) :]
        return self._first("ZPOPMIN" if str(o[0]).upper() == "MIN" else "ZPOPMAX", keys, "zset", int(_option(o, "COUNT", 1)))

    def _do_pfcount(self, *keys: str) -> int:
        one, found = self._algebra(keys, F.array_union, ("hll",))
        return self._reply(one, F.size(found))

    def _do_pfmerge(self, to: str, *keys: str) -> str:
        self._keep(to, "hll", *self._algebra([to, *keys], F.array_union, ("hll",)))
        return "OK"

    def _do_bitop(self, op: str, to: str, *keys: str) -> int:
        fold = {"AND": lambda a, b: a.bitwiseAND(b), "OR": lambda a, b: a.bitwiseOR(b), "XOR": lambda a, b: a.bitwiseXOR(b)}.get(op.upper())
        values = [F.hex(F.col(f"v{i}")) for i in range(len(keys))]
        n = F.greatest(*[F.length(v) for v in values], F.lit(0)) / 2
        byte = lambda v, i: F.conv(F.rpad(F.substring(v, (2 * i - 1).cast("int"), F.lit(2)), 2, "0"), 16, 10).cast("int")
        one_byte = (lambda i: F.lit(255).bitwiseXOR(byte(values[0], i))) if op.upper() == "NOT" else lambda i: reduce(fold, [byte(v, i) for v in values])
        made = F.when(n > 0, F.unhex(F.concat_ws("", F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.lpad(F.hex(one_byte(i)), 2, "0"))))).otherwise(F.lit(b""))
        return self._keep(to, "string", self._held(keys, ("string",), "str"), made, F.octet_length)

    def _do_bitfield(self, key: str, *a: Any) -> list[Any]:
        """GET, SET, INCRBY and OVERFLOW in turn, on the bits as one text: one job for the replies, one write."""
        row = self._row(key).withColumn("__bits", _bits())
        kind, wrap, replies, changed, i = "WRAP", None, [], False, 0
        while i < len(a):
            word = str(a[i]).upper()
            if word == "OVERFLOW":
                kind, i = str(a[i + 1]).upper(), i + 2
                continue
            signed, width, place = _field_at(a[i + 1], a[i + 2])
            name = f"__r{len(replies)}"
            old = _field(F.col("__bits"), a[i + 1], a[i + 2])
            if word == "GET":
                row, i = row.withColumn(name, old), i + 3
                replies.append(name)
                continue
            low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
            new = (_wide(F.lit(0)) if word == "SET" else _wide(old)) + Decimal(int(a[i + 3]))
            fits = (new >= Decimal(low)) & (new <= Decimal(high))
            if kind == "SAT":
                new = F.greatest(F.least(new, F.lit(Decimal(high))), F.lit(Decimal(low)))
            wrap = F.pmod(new, F.lit(Decimal(1 << width)))
            text = F.lpad(F.conv(_wide(wrap).cast("string"), 10, 2), width, "0")
            padded = F.rpad(F.col("__bits"), F.greatest(F.length("__bits"), F.lit(-(-(place + width) // 8) * 8)), F.lit("0"))
            put = F.concat(F.substring(padded, 1, place), text, F.substring(padded, place + width + 1, 1 << 30))
            value = F.when(wrap > Decimal(high), wrap - Decimal(1 << width)).otherwise(wrap)
            reply = old if word == "SET" else value.cast("long")
            if kind == "FAIL":
                put, reply = F.when(fits, put).otherwise(F.col("__bits")), F.when(fits, reply)
            row = row.withColumn("__put", put).withColumn(name, reply).withColumn("__bits", F.col("__put")).drop("__put")
            replies.append(name)
            changed, i = True, i + 4
        got = row.select("type", *replies).first()
        if got["type"] not in (None, "string"):
            raise WrongType(f"{key} holds a {got['type']}, not a string")
        if changed:
            digits = F.transform(F.sequence(F.lit(0), F.greatest(F.length("__bits") / 4 - 1, F.lit(0)).cast("int")), lambda j: F.conv(F.substring(F.col("__bits"), (4 * j + 1).cast("int"), F.lit(4)), 2, 16))
            self._store(row, Change("string", F.unhex(F.concat_ws("", digits)), F.lit(0)))
        return [got[r] for r in replies]

    def _do_lcs(self, a: str, b: str, *o: Any) -> Any:
        x, y = (v or "" for v in self._do_mget(a, b))
        table = [[""] * (len(y) + 1)]
        for c in x:
            row = [""]
            for j, d in enumerate(y):
                row.append(table[-1][j] + c if c == d else max(table[-1][j + 1], row[j], key=len))
            table.append(row)
        found = table[-1][-1]
        return len(found) if "LEN" in [str(z).upper() for z in o] else found

    def _do_xread(self, *a: Any) -> dict[str, list]:
        i = [str(x).upper() for x in a].index("STREAMS")
        rest = a[i + 1 :]
        keys, ids = rest[: len(rest) // 2], rest[len(rest) // 2 :]
        got = {k: self.execute("XRANGE", k, f"({i_}" if i_ not in ("0", "$") else "-", "+", *a[:i]) for k, i_ in zip(keys, ids) if i_ != "$"}
        return {k: v for k, v in got.items() if v}

    # -- consumer groups: in a stream's hash column, each group's JSON {last, pending: {id: [consumer, ms, times]}} ----

    def _groups(self, key: str) -> tuple[Any, dict[str, dict]]:
        row = self.rows().filter((F.col("key") == str(key)) & (F.col("type") == "stream")).first()
        return row, {g: json.loads(t) for g, t in ((row["hash"] or {}) if row else {}).items()}

    def _save_groups(self, key: str, groups: dict[str, dict], row: Any) -> None:
        data = (row.asDict() if row else dict.fromkeys(SCHEMA.fieldNames())) | {"key": str(key), "type": "stream", "hash": {g: json.dumps(v) for g, v in groups.items()}}
        data["stream"] = data["stream"] or []
        out = self.session.spark.createDataFrame([tuple(data[c] for c in SCHEMA.fieldNames())], SCHEMA)
        self._store(out, Change("", None, F.lit(0)))

    def _group(self, key: str, group: str) -> tuple[Any, dict[str, dict]]:
        row, groups = self._groups(key)
        if group not in groups:
            raise OverlayError(f"NOGROUP {group} of {key}")
        return row, groups

    def _ms(self) -> int:
        return int(self.now().timestamp() * 1000)

    def _do_xgroup(self, what: str, key: str, group: str, *a: Any) -> Any:
        what = what.upper()
        row, groups = self._groups(key)
        if what == "CREATE":
            if row is None and "MKSTREAM" not in [str(x).upper() for x in a]:
                raise OverlayError("the stream must exist")
            if group in groups:
                raise OverlayError("BUSYGROUP")
            last = (row["stream"][-1]["id"] if row and row["stream"] else "0-0") if a and a[0] == "$" else str(a[0] if a else "0-0")
            groups[group] = {"last": last, "pending": {}, "consumers": []}
        elif what == "DESTROY":
            if groups.pop(group, None) is None:
                return 0
        elif what == "SETID":
            groups[group]["last"] = str(a[0])
        elif what == "CREATECONSUMER":
            if a[0] in groups[group]["consumers"]:
                return 0
            groups[group]["consumers"].append(a[0])
        elif what == "DELCONSUMER":
            mine = [i for i, p in groups[group]["pending"].items() if p[0] == a[0]]
            groups[group]["pending"] = {i: p for i, p in groups[group]["pending"].items() if p[0] != a[0]}
            groups[group]["consumers"] = [c for c in groups[group]["consumers"] if c != a[0]]
            self._save_groups(key, groups, row)
            return len(mine)
        else:
            raise NotSupported(f"XGROUP {what}")
        self._save_groups(key, groups, row)
        return "OK" if what in ("CREATE", "SETID") else 1

    def _do_xreadgroup(self, *a: Any) -> dict[str, list]:
        upper = [str(x).upper() for x in a]
        group, consumer = a[upper.index("GROUP") + 1], a[upper.index("GROUP") + 2]
        rest = a[upper.index("STREAMS") + 1 :]
        count = _option(a, "COUNT", None)
        out = {}
        for key, after in zip(rest[: len(rest) // 2], rest[len(rest) // 2 :]):
            row, groups = self._group(key, group)
            g = groups[group]
            if after == ">":
                got = self.execute("XRANGE", key, f"({g['last']}", "+", *(("COUNT", count) if count else ()))
                if not got:
                    continue
                g["last"] = got[-1]["id"]
                if "NOACK" not in upper:
                    g["pending"] |= {e["id"]: [consumer, self._ms(), 1] for e in got}
                if consumer not in g["consumers"]:
                    g["consumers"].append(consumer)
                self._save_groups(key, groups, row)
            else:
                got = [e for e in row["stream"] or [] if g["pending"].get(e["id"], [None])[0] == consumer]
            out[key] = got
        return out

    def _do_xack(self, key: str, group: str, *ids: str) -> int:
        row, groups = self._groups(key)
        pending = groups.get(group, {}).get("pending", {})
        n = sum(pending.pop(i, None) is not None for i in ids)
        if n:
            self._save_groups(key, groups, row)
        return n

    def _do_xclaim(self, key: str, group: str, consumer: str, idle: Any, *ids: Any) -> list[Any]:
        row, groups = self._group(key, group)
        pending, now = groups[group]["pending"], self._ms()
        taken = [i for i in ids if i in pending and now - pending[i][1] >= int(idle)]
        for i in taken:
            pending[i] = [consumer, now, pending[i][2] + 1]
        if taken:
            self._save_groups(key, groups, row)
        return [e for e in row["stream"] or [] if e["id"] in taken]

    def _do_xautoclaim(self, key: str, group: str, consumer: str, idle: Any, start: str = "0-0", *o: Any) -> tuple[str, list[Any]]:
        _, groups = self._group(key, group)
        order = lambda i: tuple(int(x) for x in str(i).split("-"))
        now, n = self._ms(), int(_option(o, "COUNT", 100))
        old = sorted((i for i, p in groups[group]["pending"].items() if order(i) >= order(start) and now - p[1] >= int(idle)), key=order)
        return (old[n] if len(old) > n else "0-0"), self._do_xclaim(key, group, consumer, idle, *old[:n])

    def _do_xpending(self, key: str, group: str, *o: Any) -> Any:
        _, groups = self._group(key, group)
        order = lambda i: tuple(int(x) for x in f"{i}-0".split("-")[:2])
        pending = sorted(groups[group]["pending"].items(), key=lambda p: order(p[0]))
        if not o:
            per: dict[str, int] = {}
            for _, p in pending:
                per[p[0]] = per.get(p[0], 0) + 1
            return [len(pending), pending[0][0] if pending else None, pending[-1][0] if pending else None, per]
        rest, idle = list(o), 0
        if str(rest[0]).upper() == "IDLE":
            idle, rest = int(rest[1]), rest[2:]
        low, high, n, *who = [str(x) for x in rest]
        inside = lambda i: (low == "-" or order(i) >= order(low.lstrip("(")) and i != low[1:]) and (high == "+" or order(i) <= order(high if "-" in high else f"{high}-{2**62}"))
        found = [[i, p[0], self._ms() - p[1], p[2]] for i, p in pending if inside(i) and self._ms() - p[1] >= idle and (not who or p[0] == who[0])]
        return found[: int(n)]

    def _do_xinfo(self, what: str, key: str, *a: Any) -> Any:
        row, groups = self._groups(key)
        if what.upper() == "GROUPS":
            return [{"name": g, "consumers": len(v["consumers"]), "pending": len(v["pending"]), "last": v["last"]} for g, v in sorted(groups.items())]
        if what.upper() == "CONSUMERS":
            g = groups[a[0]]
            return [{"name": c, "pending": sum(p[0] == c for p in g["pending"].values())} for c in g["consumers"]]
        if row is None:
            raise OverlayError("no such key")
        return {"length": len(row["stream"] or []), "groups": len(groups), "last": row["stream"][-1]["id"] if row["stream"] else None}

    def _do_object(self, what: str, key: str) -> Any:
        row = self.rows().filter(F.col("key") == str(key)).first()
        if row is None:
            return None
        if what.upper() != "ENCODING":
            return 1 if what.upper() == "REFCOUNT" else 0
        value = row[COLUMN_OF[row["type"]]] or ()
        small = lambda items, n: len(value) <= n and all(len(str(x).encode()) <= 64 for x in items)
        if row["type"] == "string":
            text = bytes(value)
            return "int" if re.fullmatch(rb"-?\d{1,18}", text) else "embstr" if len(text) <= 44 else "raw"
        if row["type"] == "set" and all(re.fullmatch(r"-?\d{1,18}", x) for x in value) and len(value) <= 512:
            return "intset"
        if row["type"] in ("hash", "set"):
            return "listpack" if small([*value, *(value.values() if row["type"] == "hash" else ())], 128) else "hashtable"
        if row["type"] in ("zset", "geo"):
            return "listpack" if small([e["member"] if row["type"] == "zset" else e for e in value], 128) else "skiplist"
        return {"list": "quicklist", "stream": "stream", "hll": "raw"}[row["type"]]

    def _do_sort(self, key: str, *a: Any) -> Any:
        upper = [str(x).upper() for x in a]
        if "STORE" in upper:
            i = upper.index("STORE")
            return self._put(a[i + 1], "list", self._do_sort(key, *a[:i], *a[i + 2 :]))
        gets = [str(a[i + 1]) for i, x in enumerate(upper) if x == "GET"]
        by = str(a[upper.index("BY") + 1]) if "BY" in upper else None
        if not gets and by is None:
            return self._read("SORT", key, a)
        # Items with their weights and values: a join with the keys that the patterns name.
        row = self.rows().filter(F.col("key") == str(key))
        items = row.select(F.posexplode(F.coalesce(F.col("list"), F.col("set"), F.transform(F.col("zset"), lambda e: e["member"]))).alias("place", "item"))

        def looked_up(pattern: str, name: str) -> None:
            nonlocal items
            at, _, field = pattern.partition("->")
            if at == "#":
                items = items.withColumn(name, F.col("item"))
                return
            value = F.col("hash")[field] if field else _text(F.col("str"))
            other = self.rows().filter(F.col("type") == ("hash" if field else "string")).select(F.col("key").alias(f"{name}_k"), value.alias(name))
            before, _, after = at.partition("*")
            items = items.join(other, F.concat(F.lit(before), F.col("item"), F.lit(after)) == F.col(f"{name}_k"), "left").drop(f"{name}_k")

        order = []
        if by is not None and "*" in by:
            looked_up(by, "weight")
            order = [F.col("weight") if "ALPHA" in upper else F.coalesce(F.col("weight").try_cast("double"), F.lit(0.0))]
        elif by is None:
            order = [F.col("item") if "ALPHA" in upper else F.col("item").cast("double")]
        for i, g in enumerate(gets):
            looked_up(g, f"g{i}")
        last = F.col("item") if order else F.col("place")
        items = items.orderBy(*[(o.desc() if "DESC" in upper else o.asc()) for o in (*order, last)])
        if "LIMIT" in upper:
            i = upper.index("LIMIT")
            items = items.offset(int(a[i + 1])).limit(int(a[i + 2]))
        return [r[c] for r in items.collect() for c in ([f"g{i}" for i in range(len(gets))] or ["item"])]

    def _do_geosearchstore(self, to: str, key: str, *a: Any) -> int:
        members = self.execute("GEOSEARCH", key, *a)
        places = self.execute("GEOPOS", key, *members) if members else []
        return self._put(to, "geo", dict(zip(members, places)))

    def _do_rename(self, old: str, new: str) -> str:
        row = self.rows().filter(F.col("key") == str(old)).first()
        if row is None:
            raise OverlayError("no such key")
        self._copy(row, new)
        if old != new:
            self._do_del(old)
        return "OK"

    def _copy(self, row: Any, to: str) -> None:
        data = row.asDict() | {"key": str(to)}
        out = self.session.spark.createDataFrame([tuple(data[c] for c in SCHEMA.fieldNames())], SCHEMA)
        self._store(out, Change("", None, F.lit(0)))

    def _do_renamenx(self, old: str, new: str) -> int:
        if self._do_exists(new):
            return 0
        self._do_rename(old, new)
        return 1

    def _do_copy(self, a: str, b: str, *o: Any) -> int:
        row = self.rows().filter(F.col("key") == str(a)).first()
        if row is None or (self._do_exists(b) and "REPLACE" not in [str(x).upper() for x in o]):
            return 0
        self._copy(row, b)
        return 1

    def _do_restore(self, key: str, ttl: int, dump: str, *o: Any) -> str:
        import base64

        if self._do_exists(key) and "REPLACE" not in [str(x).upper() for x in o]:
            raise OverlayError("BUSYKEY")
        data = json.loads(dump)
        column = COLUMN_OF[data["type"]]
        value = data.get(column)
        if column == "str":
            value = bytearray(base64.b64decode(value))
        elif column == "zset":
            value = [(e["score"], e["member"]) for e in value]
        elif column == "stream":
            value = [(e["id"], e["fields"]) for e in value]
        self._put(key, data["type"], value)
        if int(ttl):
            self.execute("PEXPIRE", key, ttl)
        return "OK"

    def _do_flushall(self, *a: Any) -> str:
        s = self.session
        s._start = s.version
        s._save(s.writer.truncate(s.version, s.version.get(self.table)))
        return "OK"

    _do_flushdb = _do_flushall

    # -- transactions --------------------------------------------------------------------------------

    def _mark(self, key: str) -> int | None:
        row = self.rows().filter(F.col("key") == str(key)).select(F.xxhash64(F.to_json(F.struct("*")))).first()
        return row[0] if row else None

    def _do_watch(self, *keys: str) -> str:
        self.watched |= {k: self._mark(k) for k in keys}
        return "OK"

    def _do_multi(self) -> str:
        if self.queue is not None:
            raise SyntaxProblem("MULTI calls can't be nested")
        self.queue = []
        return "OK"

    def _do_discard(self) -> str:
        if self.queue is None:
            raise SyntaxProblem("DISCARD without MULTI")
        self.queue, self.watched = None, {}
        return "OK"

    def _do_exec(self) -> list[Any] | None:
        """Run the queue as one transaction; None if a watched key changed."""
        if self.queue is None:
            raise SyntaxProblem("EXEC without MULTI")
        queue, watched = self.queue, self.watched
        self.queue, self.watched = None, {}
        if any(self._mark(k) != m for k, m in watched.items()):
            return None
        own = not self.session.in_transaction
        if own:
            self.session.sql("BEGIN")
        out: list[Any] = []
        try:
            for name, *args in queue:
                try:
                    out.append(self.execute(name, *args))
                except OverlayError as e:
                    out.append(e)
        except Exception:
            if own:
                self.session.sql("ROLLBACK")
            raise
        if own:
            self.session.sql("COMMIT")
        return out


#: Commands that leave a missing key missing.
POPS = frozenset("HDEL LPOP RPOP LREM LTRIM SREM SPOP ZREM ZREMRANGEBYSCORE ZREMRANGEBYLEX ZREMRANGEBYRANK ZPOPMIN ZPOPMAX XDEL XTRIM GETDEL".split())


def strategy_of(command: str) -> str:
    """How a command is routed when its keys have local changes."""
    name = command.upper()
    if name in REFUSED:
        return "NOT_SUPPORTED"
    if name in ("MULTI", "EXEC", "DISCARD"):
        return "TRANSACTION"
    if name in ("FLUSHDB", "FLUSHALL"):
        return "OVERLAY_DDL"
    if name in ("LTRIM", "XTRIM"):
        return "TRUNCATE"
    if name in SESSION or name in ("WATCH",):
        return "BASE_DIRECT"
    if name in READS or name in ("MGET", "EXISTS", "KEYS", "SCAN", "DBSIZE", "RANDOMKEY", "TTL", "PTTL", "EXPIRETIME", "PEXPIRETIME", "SUNION", "SINTER", "SDIFF", "SINTERCARD", "ZUNION", "ZINTER", "ZDIFF", "PFCOUNT", "LCS", "XREAD", "XINFO", "XPENDING", "OBJECT"):
        return "MERGED_READ"
    if name in POPS or name in ("DEL", "UNLINK", "BLPOP", "BRPOP", "BZPOPMIN", "BZPOPMAX", "LMPOP", "ZMPOP"):
        return "OVERLAY_DELETE"
    if name in WRITES and name not in ("SET", "SETNX", "SETEX", "PSETEX") or name in ("RENAME", "RENAMENX", "SMOVE", "RPOPLPUSH", "LMOVE", "BLMOVE", "BITFIELD", "XREADGROUP", "XAUTOCLAIM"):
        return "HYDRATE_AND_WRITE"
    return "OVERLAY_WRITE" if name in WRITES or hasattr(KeyValue, f"_do_{name.lower()}") else "NOT_SUPPORTED"
