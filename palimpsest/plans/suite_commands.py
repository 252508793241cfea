"""Registered queries of single key-value commands: a script on a small dataset, each command with its reply.

The replies are those that the commands are documented to give; expiry is
counted from a fixed time.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession

from ..errors import OverlayError
from ..operators import kv
from ..session import Database
from .suite import ORACLES, QUERIES
from .suite_keyed import NOW

#: The base dataset: a key of each type.
BASE = (
    ("b:str", "string", bytearray(b"Hello World")), ("b:hash", "hash", {"f1": "v1", "f2": "v2"}), ("b:list", "list", ["a", "b", "c"]), ("b:set", "set", ["1", "2", "3"]),
    ("b:zset", "zset", [(1.0, "one"), (2.0, "two"), (3.0, "three")]), ("b:stream", "stream", [("1-0", {"n": "1"}), ("2-0", {"n": "2"}), ("10-0", {"n": "3"})]),
)


def small_store(spark: SparkSession) -> kv.KeyValue:
    names = kv.SCHEMA.fieldNames()
    rows = [tuple({"key": k, "type": t, kv.COLUMN_OF[t]: v}.get(n) for n in names) for k, t, v in BASE]
    db = Database(spark)
    # A few rows and many plans: to compile each plan would take longer than to run it.
    db.spark.conf.set("spark.sql.codegen.wholeStage", "false")
    db.spark.conf.set("spark.sql.codegen.factoryMode", "NO_CODEGEN")
    db.register("kv", frame=spark.createDataFrame(rows, kv.SCHEMA), pk=["key"])
    return kv.KeyValue(db.session(), now=lambda: NOW)


def said(reply: Any) -> str:
    """A reply as text: nil, numbers without a needless point, lists and maps in brackets."""
    if reply is None:
        return "nil"
    if isinstance(reply, Row):
        return said(reply.asDict())
    if isinstance(reply, bool | str):
        return str(reply)
    if isinstance(reply, bytes | bytearray):
        return bytes(reply).decode(errors="replace")
    if isinstance(reply, float):
        return str(int(reply)) if reply == int(reply) else repr(reply)
    if isinstance(reply, dict):
        return "{" + ", ".join(f"{k}: {said(v)}" for k, v in sorted(reply.items())) + "}"
    if isinstance(reply, list | tuple):
        return "[" + ", ".join(said(r) for r in reply) + "]"
    if isinstance(reply, OverlayError):
        return reply.sqlstate
    return str(reply)


def replies(store: kv.KeyValue, script: tuple) -> list[str]:
    """The reply of each command, or the state of its error."""
    out = []
    for command, _ in script:
        try:
            out.append(said(store.execute(*command.split(" ") if isinstance(command, str) else command)))
        except OverlayError as e:
            out.append(said(e))
    return out


#: Commands (by words, or as a tuple where an argument has blanks) and their replies.
SCRIPTS: dict[str, tuple] = {
    "kv_cmd_strings": (
        ("GET b:str", "Hello World"), ("GETRANGE b:str 0 4", "Hello"), ("GETRANGE b:str -5 -1", "World"), ("STRLEN b:str", "11"), ("SETRANGE b:str 6 Redis", "11"), ("GET b:str", "Hello Redis"), ("APPEND b:str !", "12"),
        ("SET n 10", "OK"), ("INCR n", "11"), ("INCRBY n 5", "16"), ("DECR n", "15"), ("DECRBY n 5", "10"), ("INCRBYFLOAT n 0.5", "10.5"), ("INCR n", "WRONGTYPE"), ("MSET a 1 b 2", "OK"), ("MGET a b none", "[1, 2, nil]"),
        ("MSETNX a 9 c 3", "0"), ("MSETNX c 3 d 4", "1"), ("GETSET a 7", "1"), ("GETEX a", "7"), ("GETDEL a", "7"), ("EXISTS a b c", "2"), ("SETNX b 9", "0"), ("SETNX e 5", "1"), ("SET h v NX", "OK"), ("SET h w NX", "nil"),
        ("SET h w XX GET", "v"), ("MSET k1 ohmytext k2 mynewtext", "OK"), ("LCS k1 k2", "mytext"), ("LCS k1 k2 LEN", "6"), ("GET b:list", "WRONGTYPE"), ("GET none", "nil"), ("STRLEN none", "0"),
    ),
    "kv_cmd_bits": (
        ("SET s foobar", "OK"), ("BITCOUNT s", "26"), ("BITCOUNT s 0 0", "4"), ("BITCOUNT s 1 1", "6"), ("BITCOUNT s 1 1 BYTE", "6"), ("BITCOUNT s 5 30 BIT", "17"), ("BITCOUNT s -2 -1", "7"), ("BITCOUNT none", "0"),
        ("BITPOS s 1", "1"), ("BITPOS s 0", "0"), ("BITPOS s 1 1", "9"), ("BITPOS s 0 2 -1 BIT", "3"), ("BITPOS none 0", "0"), ("BITPOS none 1", "-1"), ("SETBIT t 7 1", "0"), ("GETBIT t 7", "1"), ("GETBIT t 100", "0"), ("SETBIT t 7 0", "1"),
        ("BITFIELD f INCRBY i5 100 1 GET u4 0", "[1, 0]"), ("BITFIELD f SET u8 0 255 GET i8 0", "[0, -1]"), ("BITFIELD_RO f GET i8 0 GET u8 #0", "[-1, 255]"), ("BITFIELD f OVERFLOW SAT INCRBY u8 0 10", "[255]"),
        ("BITFIELD f OVERFLOW FAIL INCRBY u8 0 10", "[nil]"), ("BITFIELD f INCRBY u8 0 10", "[9]"), ("BITFIELD f SET i8 #1 -128 GET i8 #1 GET u8 8", "[0, -128, 128]"), ("STRLEN f", "14"), ("BITFIELD_RO none GET u8 0", "[0]"),
        ("MSET x abc y ab", "OK"), ("BITOP AND z x y", "3"), ("GETRANGE z 0 1", "ab"), ("BITOP OR z x y", "3"), ("GET z", "abc"), ("BITOP XOR z x x", "3"), ("BITCOUNT z", "0"), ("BITOP NOT z x", "3"), ("BITCOUNT z", "14"),
    ),
    "kv_cmd_hashes": (
        ("HGET b:hash f1", "v1"), ("HGET b:hash none", "nil"), ("HGETALL b:hash", "{f1: v1, f2: v2}"), ("HMGET b:hash f1 none", "[v1, nil]"), ("HKEYS b:hash", "[f1, f2]"), ("HVALS b:hash", "[v1, v2]"), ("HLEN b:hash", "2"),
        ("HEXISTS b:hash f1", "1"), ("HEXISTS b:hash zz", "0"), ("HSTRLEN b:hash f2", "2"), ("HSET b:hash f1 x f3 y", "1"), ("HSETNX b:hash f1 z", "0"), ("HSETNX b:hash f5 z", "1"), ("HMSET b:hash f4 1", "OK"), ("HINCRBY b:hash f4 5", "6"),
        ("HINCRBYFLOAT b:hash f4 0.5", "6.5"), ("HDEL b:hash f5 none", "1"), ("HGETALL b:hash", "{f1: x, f2: v2, f3: y, f4: 6.5}"), ("HSCAN b:hash 0 MATCH f[34]", "{f3: y, f4: 6.5}"), ("HSET one a 1", "1"), ("HRANDFIELD one 3", "[a]"),
        ("HRANDFIELD one -3 WITHVALUES", "[a, 1, a, 1, a, 1]"), ("OBJECT ENCODING one", "listpack"), ("HDEL one a", "1"), ("EXISTS one", "0"), ("HSET b:str a 1", "WRONGTYPE"), ("HLEN none", "0"), ("HMGET none a b", "[nil, nil]"),
    ),
    "kv_cmd_lists": (
        ("LRANGE b:list 0 -1", "[a, b, c]"), ("LINDEX b:list 1", "b"), ("LINDEX b:list -1", "c"), ("LINDEX b:list 9", "nil"), ("LLEN b:list", "3"), ("LPUSH b:list y z", "5"), ("RPUSH b:list c", "6"), ("LRANGE b:list 0 -1", "[z, y, a, b, c, c]"),
        ("LSET b:list 0 w", "OK"), ("LINSERT b:list BEFORE a x", "7"), ("LINSERT b:list AFTER c d", "8"), ("LINSERT b:list AFTER none d", "-1"), ("LRANGE b:list 0 -1", "[w, y, x, a, b, c, d, c]"), ("LREM b:list -1 c", "1"), ("LPOP b:list", "w"),
        ("RPOP b:list", "d"), ("LPOP b:list 2", "[y, x]"), ("LTRIM b:list 1 -1", "OK"), ("LRANGE b:list 0 -1", "[b, c]"), ("LPUSHX none v", "0"), ("RPUSHX b:list e", "3"), ("LPUSHX b:list a", "4"), ("RPOPLPUSH b:list other", "e"),
        ("LMOVE b:list other LEFT RIGHT", "a"), ("LRANGE other 0 -1", "[e, a]"), ("BLMOVE other b:list RIGHT LEFT 0", "a"), ("BLPOP none b:list 0", "[b:list, a]"), ("BRPOP b:list 0", "[b:list, c]"), ("RPUSH q a b c 1 2 3 c c", "8"),
        ("LPOS q c", "2"), ("LPOS q c RANK 2", "6"), ("LPOS q c RANK -1", "7"), ("LPOS q c COUNT 2", "[2, 6]"), ("LPOS q c COUNT 0", "[2, 6, 7]"), ("LPOS q c RANK -1 COUNT 2", "[7, 6]"), ("LPOS q c COUNT 0 MAXLEN 3", "[2]"), ("LPOS q zz", "nil"),
        ("LMPOP 2 none q LEFT COUNT 2", "[q, [a, b]]"), ("LLEN q", "6"), ("OBJECT ENCODING q", "quicklist"), ("LRANGE none 0 -1", "[]"), ("LPUSH b:set a", "WRONGTYPE"),
    ),
    "kv_cmd_sets": (
        ("SMEMBERS b:set", "[1, 2, 3]"), ("SISMEMBER b:set 2", "1"), ("SMISMEMBER b:set 2 9", "[1, 0]"), ("SCARD b:set", "3"), ("SADD b:set 3 4", "1"), ("SREM b:set 1 9", "1"), ("SMEMBERS b:set", "[2, 3, 4]"), ("OBJECT ENCODING b:set", "intset"),
        ("SADD t 4 5 6", "3"), ("SINTER b:set t", "[4]"), ("SUNION b:set t none", "[2, 3, 4, 5, 6]"), ("SDIFF b:set t", "[2, 3]"), ("SINTERCARD 2 b:set t", "1"), ("SINTERCARD 2 b:set b:set LIMIT 2", "2"), ("SINTER b:set none", "[]"),
        ("SINTERSTORE d b:set t", "1"), ("SMEMBERS d", "[4]"), ("SUNIONSTORE d b:set t", "5"), ("SCARD d", "5"), ("SDIFFSTORE d b:set t", "2"), ("SMEMBERS d", "[2, 3]"), ("SDIFFSTORE d t t", "0"), ("EXISTS d", "0"), ("SMOVE t b:set 5", "1"),
        ("SMOVE t b:set 99", "0"), ("SISMEMBER b:set 5", "1"), ("SSCAN b:set 0 MATCH [23]", "[2, 3]"), ("SADD one x", "1"), ("SRANDMEMBER one 4", "[x]"), ("SRANDMEMBER one -2", "[x, x]"), ("SPOP one", "x"), ("EXISTS one", "0"), ("SCARD none", "0"),
        ("SUNION b:set b:list", "WRONGTYPE"), ("SPOP b:set 0", "[]"),
    ),
    "kv_cmd_zsets": (
        ("ZRANGE b:zset 0 -1", "[one, two, three]"), ("ZRANGE b:zset 0 0 WITHSCORES", "[one, 1]"), ("ZRANGE b:zset 0 1 REV", "[three, two]"), ("ZRANGE b:zset (1 3 BYSCORE", "[two, three]"), ("ZRANGEBYSCORE b:zset -inf +inf LIMIT 1 1", "[two]"),
        ("ZREVRANGE b:zset 0 0", "[three]"), ("ZREVRANGEBYSCORE b:zset +inf (1 WITHSCORES", "[three, 3, two, 2]"), ("ZRANK b:zset two", "1"), ("ZREVRANK b:zset two", "1"), ("ZRANK b:zset none", "nil"), ("ZSCORE b:zset two", "2"),
        ("ZMSCORE b:zset one none", "[1, nil]"), ("ZCARD b:zset", "3"), ("ZCOUNT b:zset 2 +inf", "2"), ("ZADD b:zset 1.5 half 2 two", "1"), ("ZADD b:zset XX 9 none", "0"), ("ZADD b:zset GT 1 two", "0"), ("ZADD b:zset INCR 1 one", "2"),
        ("ZINCRBY b:zset 0.5 one", "2.5"), ("ZRANGE b:zset 0 -1 WITHSCORES", "[half, 1.5, two, 2, one, 2.5, three, 3]"), ("ZREM b:zset half none", "1"), ("ZPOPMIN b:zset", "[two, 2]"), ("ZPOPMAX b:zset 1", "[three, 3]"), ("ZCARD b:zset", "1"),
        ("ZADD l 0 a 0 b 0 c 0 d", "4"), ("ZRANGEBYLEX l [b (d", "[b, c]"), ("ZREVRANGEBYLEX l + (b", "[d, c]"), ("ZLEXCOUNT l - [c", "3"), ("ZREMRANGEBYLEX l [a [a", "1"), ("ZREMRANGEBYRANK l 0 0", "1"), ("ZREMRANGEBYSCORE l 0 0", "2"), ("EXISTS l", "0"),
        ("ZADD p 1 x 2 y", "2"), ("ZADD q 10 y 20 z", "2"), ("ZUNION 2 p q WITHSCORES", "[x, 1, y, 12, z, 20]"), ("ZINTER 2 p q WEIGHTS 2 1 WITHSCORES", "[y, 14]"), ("ZDIFF 2 p q", "[x]"), ("ZUNIONSTORE d 2 p q AGGREGATE MAX", "3"),
        ("ZRANGE d 0 -1 WITHSCORES", "[x, 1, y, 10, z, 20]"), ("ZINTERSTORE d 2 p q AGGREGATE MIN", "1"), ("ZSCORE d y", "2"), ("ZDIFFSTORE d 2 p q", "1"), ("ZRANGESTORE d q 0 0", "1"), ("ZRANGE d 0 -1", "[y]"), ("BZPOPMIN none p 0", "[p, [x, 1]]"),
        ("BZPOPMAX q 0", "[q, [z, 20]]"), ("ZMPOP 1 q MIN", "[q, [y, 10]]"), ("ZRANDMEMBER p 5", "[y]"), ("ZRANDMEMBER p -2 WITHSCORES", "[y, 2, y, 2]"), ("ZSCAN p 0 MATCH y*", "[y, 2]"), ("OBJECT ENCODING p", "listpack"), ("ZCARD none", "0"),
    ),
    "kv_cmd_streams": (
        ("XLEN b:stream", "3"), ("XRANGE b:stream - +", "[{fields: {n: 1}, id: 1-0}, {fields: {n: 2}, id: 2-0}, {fields: {n: 3}, id: 10-0}]"), ("XRANGE b:stream (1-0 + COUNT 1", "[{fields: {n: 2}, id: 2-0}]"),
        ("XREVRANGE b:stream + - COUNT 1", "[{fields: {n: 3}, id: 10-0}]"), ("XADD b:stream 11-1 n 4", "11-1"), ("XREAD COUNT 1 STREAMS b:stream 2-0", "{b:stream: [{fields: {n: 3}, id: 10-0}]}"), ("XGROUP CREATE b:stream g 0", "OK"),
        ("XGROUP CREATE b:stream g 0", "XX000"), ("XREADGROUP GROUP g alice COUNT 3 STREAMS b:stream >", "{b:stream: [{fields: {n: 1}, id: 1-0}, {fields: {n: 2}, id: 2-0}, {fields: {n: 3}, id: 10-0}]}"), ("XPENDING b:stream g", "[3, 1-0, 10-0, {alice: 3}]"),
        ("XPENDING b:stream g - + 2", "[[1-0, alice, 0, 1], [2-0, alice, 0, 1]]"), ("XPENDING b:stream g (2-0 + 10 alice", "[[10-0, alice, 0, 1]]"), ("XPENDING b:stream g IDLE 5 - + 10", "[]"), ("XACK b:stream g 1-0 99-0", "1"),
        ("XCLAIM b:stream g bob 0 2-0", "[{fields: {n: 2}, id: 2-0}]"), ("XAUTOCLAIM b:stream g bob 0 0-0 COUNT 1", "[10-0, [{fields: {n: 2}, id: 2-0}]]"), ("XINFO STREAM b:stream", "{groups: 1, last: 11-1, length: 4}"),
        ("XINFO GROUPS b:stream", "[{consumers: 1, last: 10-0, name: g, pending: 2}]"), ("XDEL b:stream 2-0", "1"), ("XTRIM b:stream MAXLEN 1", "2"), ("XLEN b:stream", "1"), ("XGROUP CREATECONSUMER b:stream g carol", "1"), ("XGROUP DELCONSUMER b:stream g alice", "1"),
        ("XGROUP SETID b:stream g 0", "OK"), ("XGROUP DESTROY b:stream g", "1"), ("XLEN none", "0"),
    ),
    "kv_cmd_geo": (
        ("GEOADD sicily 13.361389 38.115556 Palermo 15.087269 37.502669 Catania", "2"), ("GEODIST sicily Palermo Catania km", "166.2743"), ("GEODIST sicily Palermo none", "nil"), ("GEOHASH sicily Palermo", "[sqc8b49rnyt]"),
        ("GEOPOS sicily Catania none", "[15.087269 37.502669, nil]"), ("GEORADIUS sicily 15 37 200 km ASC", "[Catania, Palermo]"), ("GEORADIUS sicily 15 37 200 km COUNT 1 WITHDIST", "[[Catania, 56.4413]]"), ("GEORADIUS sicily 15 37 100 km", "[Catania]"),
        ("GEORADIUSBYMEMBER sicily Palermo 200 km DESC", "[Catania, Palermo]"), ("GEOSEARCH sicily FROMLONLAT 15 37 BYRADIUS 200 km ASC", "[Catania, Palermo]"), ("GEOSEARCH sicily FROMLONLAT 15 37 BYBOX 400 400 km DESC", "[Palermo, Catania]"),
        ("GEOSEARCH sicily FROMLONLAT 15 37 BYBOX 100 400 km", "[Catania]"), ("GEOSEARCH sicily FROMMEMBER Palermo BYRADIUS 1 m WITHCOORD", "[[Palermo, 13.361389, 38.115556]]"), ("GEOSEARCHSTORE near sicily FROMLONLAT 15 37 BYRADIUS 100 km", "1"),
        ("GEOPOS near Catania", "[15.087269 37.502669]"), ("TYPE sicily", "zset"), ("PFADD v a b c a", "1"), ("PFADD v a", "0"), ("PFCOUNT v", "3"), ("PFADD w c d", "1"), ("PFCOUNT v w", "4"), ("PFMERGE u v w", "OK"), ("PFCOUNT u", "4"), ("TYPE u", "string"),
    ),
    "kv_cmd_keys": (
        ("TYPE b:zset", "zset"), ("TYPE none", "none"), ("DBSIZE", "6"), ("KEYS b:s*", "[b:set, b:str, b:stream]"), ("SCAN 0 MATCH b:* COUNT 2", "[b:list, [b:hash, b:list]]"), ("SCAN b:list COUNT 10", "[0, [b:set, b:str, b:stream, b:zset]]"),
        ("SCAN 0 TYPE set", "[0, [b:set]]"), ("EXPIRE b:str 100", "1"), ("TTL b:str", "100"), ("PTTL b:str", "100000"), ("EXPIRETIME b:str", "1717200100"), ("PEXPIRETIME b:str", "1717200100000"), ("PERSIST b:str", "1"), ("TTL b:str", "-1"), ("TTL none", "-2"),
        ("PEXPIRE b:str 5000", "1"), ("TTL b:str", "5"), ("EXPIREAT b:str 1717200010", "1"), ("TTL b:str", "10"), ("PEXPIREAT b:str 1717200020000", "1"), ("TTL b:str", "20"), ("SETEX x 50 v", "OK"), ("TTL x", "50"), ("PSETEX x 5000 v", "OK"), ("PTTL x", "5000"),
        ("GETEX x PERSIST", "v"), ("TTL x", "-1"), ("RENAME x y", "OK"), ("RENAMENX y b:str", "0"), ("RENAMENX y z", "1"), ("COPY z w", "1"), ("COPY z w", "0"), ("COPY z w REPLACE", "1"), ("GET w", "v"), ("EXPIRE w -1", "1"), ("EXISTS w", "0"), ("UNLINK z none", "1"),
        ("DEL b:list b:set", "2"), ("RENAME none x", "XX000"), ("OBJECT REFCOUNT b:str", "1"), ("OBJECT ENCODING b:str", "embstr"), ("OBJECT ENCODING none", "nil"), ("RESTORE r 0 " + json.dumps({"type": "list", "list": ["a", "b"]}, separators=(",", ":")), "OK"),
        ("LRANGE r 0 -1", "[a, b]"), ("DUMP none", "nil"), ("FLUSHDB", "OK"), ("DBSIZE", "0"), ("RANDOMKEY", "nil"), ("SET only 1", "OK"), ("RANDOMKEY", "only"), ("FLUSHALL", "OK"), ("EXISTS only", "0"),
    ),
    "kv_cmd_sort": (
        ("RPUSH nums 3 1 2", "3"), ("SORT nums", "[1, 2, 3]"), ("SORT nums DESC LIMIT 0 2", "[3, 2]"), ("SADD words b c a", "3"), ("SORT words ALPHA", "[a, b, c]"), ("MSET w_1 30 w_2 20 w_3 10", "OK"), ("SORT nums BY w_*", "[3, 2, 1]"), ("SORT nums BY w_* GET #", "[3, 2, 1]"),
        ("HSET d_1 name x", "1"), ("SORT nums BY w_* GET # GET d_*->name", "[3, nil, 2, nil, 1, x]"), ("SORT nums BY nosort", "[3, 1, 2]"), ("SORT nums STORE out", "3"), ("LRANGE out 0 -1", "[1, 2, 3]"), ("SORT none", "[]"), ("SORT nums BY w_* LIMIT 1 1", "[2]"),
    ),
    "kv_cmd_transactions": (
        ("MULTI", "OK"), ("SET a 1", "QUEUED"), ("INCR a", "QUEUED"), ("LPUSH a x", "QUEUED"), ("EXEC", "[OK, 2, WRONGTYPE]"), ("MULTI", "OK"), ("SET a 9", "QUEUED"), ("DISCARD", "OK"), ("GET a", "2"), ("WATCH a", "OK"), ("SET a 3", "OK"), ("MULTI", "OK"), ("SET a 4", "QUEUED"),
        ("EXEC", "nil"), ("GET a", "3"), ("WATCH a", "OK"), ("SET a 5", "OK"), ("UNWATCH", "OK"), ("MULTI", "OK"), ("INCR a", "QUEUED"), ("EXEC", "[6]"), ("EXEC", "42601"), ("MULTI", "OK"), ("MULTI", "42601"), ("DISCARD", "OK"),
    ),
    "kv_cmd_server": (
        ("PING", "PONG"), ("PING hi", "hi"), ("ECHO x", "x"), ("TIME", "[1717200000, 0]"), ("SELECT 0", "OK"), ("SELECT 3", "XX000"), ("CONFIG SET maxmemory 1", "OK"), ("CONFIG GET max*", "{maxmemory: 1}"), ("CLIENT SETNAME me", "OK"), ("CLIENT GETNAME", "me"), ("WAIT 1 0", "0"),
        ("WAITAOF 0 0 0", "[0, 0]"), ("SLOWLOG LEN", "0"), ("MODULE LIST", "[]"), ("PUBSUB CHANNELS", "[]"), ("SUBSCRIBE a b", "[[subscribe, a, 1], [subscribe, b, 2]]"), ("UNSUBSCRIBE a", "[[unsubscribe, a, 1]]"), ("PSUBSCRIBE x*", "[[psubscribe, x*, 1]]"),
        ("PUNSUBSCRIBE x*", "[[punsubscribe, x*, 1]]"), ("RESET", "RESET"), ("AUTH x", "OK"), ("QUIT", "OK"), ("MEMORY USAGE none", "nil"), ("LATENCY RESET", "0"), ("PUBLISH a x", "0A000"), ("SHUTDOWN", "0A000"), ("EVAL x 0", "0A000"), ("SWAPDB 0 1", "0A000"), ("MOVE a 1", "0A000"),
        ("DEBUG x", "0A000"), ("REPLICAOF h 1", "0A000"), ("SLAVEOF h 1", "0A000"), ("FAILOVER", "0A000"), ("BGSAVE", "0A000"), ("BGREWRITEAOF", "0A000"), ("SCRIPT LOAD x", "0A000"), ("FUNCTION LIST", "0A000"), ("FCALL f 0", "0A000"), ("NOSUCH", "0A000"),
    ),
}


def _script(name: str) -> None:
    script = SCRIPTS[name]
    QUERIES[name] = lambda spark, _: _table(spark, script)
    quoted = lambda s: "'" + (s if isinstance(s, str) else " ".join(s)).replace("'", "''") + "'"
    ORACLES[name] = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(c)}, {quoted(r)})" for i, (c, r) in enumerate(script)) + ") t(i, command, reply)"


def _table(spark: SparkSession, script: tuple) -> DataFrame:
    got = replies(small_store(spark), script)
    return spark.createDataFrame([(i, c if isinstance(c, str) else " ".join(c), r) for i, ((c, _), r) in enumerate(zip(script, got))], "i int, command string, reply string")


for _name in SCRIPTS:
    _script(_name)
