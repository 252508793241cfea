"""Rewrites of read dialects that Spark's parser doesn't take, or takes for something else."""

from __future__ import annotations

import json
import re
from fractions import Fraction
from typing import Any

from ..errors import NotSupported
from .text import Token, name_of, split_top, tokens


def _replace(sql: str, cuts: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, new in sorted(cuts):
        if a >= at:
            out += [sql[at:a], new]
            at = b
    return "".join(out) + sql[at:]


def _operand_start(ts: list[Token], i: int) -> int:
    """Index of the first token of the operand that ends at i."""
    if ts[i].text == ")":
        depth = ts[i].depth
        i -= 1
        while not (ts[i].text == "(" and ts[i].depth == depth):
            i -= 1
        if i and ts[i - 1].kind == "word":
            i -= 1
    while i >= 2 and ts[i - 1].text == ".":
        i -= 2
    return i


def _json_step(sql: str) -> str | None:
    """Rewrite the first JSON operator, or None if there is none left."""
    ts = tokens(sql)
    for i, t in enumerate(ts):
        if t.text not in ("->", "->>", "@>") or i == 0 or i + 1 >= len(ts):
            continue
        if t.text == "->" and (ts[i + 1].kind not in ("string", "number")):
            continue  # a lambda
        a = _operand_start(ts, i - 1)
        left, right = sql[ts[a].start : ts[i - 1].end], ts[i + 1]
        end = right.end
        if i + 3 < len(ts) and ts[i + 2].text == "::":
            end = ts[i + 3].end
        if t.text == "@>":
            if right.kind != "string":
                raise NotSupported("@> with anything but a JSON text at its right")
            new = _contains(left, json.loads(right.text[1:-1].replace("''", "'")))
        elif right.kind == "number":
            new, end = f"get_json_object({left}, '$[{right.text}]')", right.end
        else:
            new, end = _member(left, right.text[1:-1].replace("''", "'")), right.end
        return sql[: ts[a].start] + new + sql[end:]
    return None


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _member(left: str, key: str) -> str:
    """A member of a JSON object by its name, whatever characters it has; null if it is missing."""
    if re.fullmatch(r"[A-Za-z_]\w*", key):
        return f"get_json_object({left}, '$.{key}')"
    return f"element_at(from_json({left}, 'map<string,string>'), {_quoted(key)})"


def _contains(left: str, want: Any) -> str:
    """JSON containment: objects by their members, arrays by their elements, a scalar also in an array of them."""
    value = f"parse_json({left})"
    test = _within(value, want, 0)
    if not isinstance(want, dict | list):
        test = f"({test} OR {_within(value, [want], 0)})"
    return f"coalesce({test}, false)"


def _within(value: str, want: Any, depth: int) -> str:
    kind = f"schema_of_variant({value})"
    if isinstance(want, dict):
        members = "try_variant_get({0}, '$', 'map<string,variant>')".format(value)
        return "(" + " AND ".join([f"{kind} LIKE 'OBJECT%'", *[f"coalesce({_within(f'{members}[{_quoted(k)}]', v, depth)}, false)" for k, v in want.items()]]) + ")"
    if isinstance(want, list):
        items, x = f"try_variant_get({value}, '$', 'array<variant>')", f"x{depth}"
        return "(" + " AND ".join([f"{kind} LIKE 'ARRAY%'", *[f"exists({items}, {x} -> coalesce({_within(x, v, depth + 1)}, false))" for v in want]]) + ")"
    if want is None:
        return f"is_variant_null({value})"
    if isinstance(want, bool):
        return f"({kind} = 'BOOLEAN' AND try_variant_get({value}, '$', 'boolean') = {str(want).lower()})"
    if isinstance(want, str):
        return f"({kind} = 'STRING' AND try_variant_get({value}, '$', 'string') = {_quoted(want)})"
    return f"({kind} RLIKE '^(BIGINT|DOUBLE|FLOAT|DECIMAL)' AND try_variant_get({value}, '$', 'double') = CAST({want!r} AS DOUBLE))"


#: Function names of other dialects and what they are here; fixed values.
FUNCTIONS = {
    "JSONB_BUILD_OBJECT": "to_json_object", "JSON_BUILD_OBJECT": "to_json_object", "UUID_GENERATE_V4": "uuid", "GEN_RANDOM_UUID": "uuid", "NEWID": "uuid", "NOW": "now", "GETDATE": "now",
    "COUNT_BIG": "count", "STDEV": "stddev_samp", "STDEVP": "stddev_pop", "VAR": "var_samp", "VARP": "var_pop", "LEN": "length", "ISNULL": "coalesce", "IFNULL": "coalesce",
}


def rewrite(sql: str) -> str:
    """The statement in Spark's SQL."""
    while (step := _json_step(sql)) is not None:
        sql = step
    return _escape(_laterals(_top(_names(_slices(sql)))))


def _names(sql: str) -> str:
    """Quoted names, parameters and calls in Spark's form."""
    ts = tokens(sql)
    cuts: list[tuple[int, int, str]] = []
    for i, t in enumerate(ts):
        following = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind == "quoted" and t.text[0] in '"[':
            cuts.append((t.start, t.end, "`" + name_of(t).replace("`", "``") + "`"))
        elif t.kind == "param" and t.text[0] in "$@":
            cuts.append((t.start, t.end, f":p{t.text[1:]}" if t.text[1:].isdigit() else f":{t.text[1:]}"))
        elif t.text == "=" and following is not None and following.upper == "ANY" and i + 2 < len(ts) and ts[i + 2].text == "(":
            # x = ANY(array): Spark would take ANY for the boolean aggregate.
            a = _operand_start(ts, i - 1)
            j = i + 3
            while not (ts[j].text == ")" and ts[j].depth == ts[i + 2].depth):
                j += 1
            if ts[i + 3].upper != "SELECT":
                cuts.append((ts[a].start, ts[j].end, f"array_contains({_names(sql[ts[i + 3].start : ts[j - 1].end])}, {sql[ts[a].start : ts[i - 1].end]})"))
            else:
                cuts.append((t.start, following.end, "IN "))
        elif t.upper == "ARRAY" and following is not None and following.kind == "quoted" and following.text[0] == "[":
            cuts.append((t.start, following.end, f"array({name_of(following)})"))
        elif t.upper == "ARRAY" and following is not None and following.text == "[":
            j = i + 2
            inside = 1
            while j < len(ts) and inside:
                inside += {"[": 1, "]": -1}.get(ts[j].text, 0)
                j += 1
            cuts += [(t.start, following.end, "array("), (ts[j - 1].start, ts[j - 1].end, ")")]
        elif t.upper == "FOR" and following is not None and following.upper in ("UPDATE", "SHARE", "NO", "KEY") and t.depth == 0:
            cuts.append((t.start, ts[-1].end, ""))  # versions don't change, so there is nothing to lock
            break
        elif t.upper == "APPLY" and i and ts[i - 1].upper in ("CROSS", "OUTER"):
            outer = ts[i - 1].upper == "OUTER"
            cuts.append((ts[i - 1].start, t.end, "LEFT JOIN LATERAL" if outer else "CROSS JOIN LATERAL"))
        elif t.kind == "word" and following is not None and following.text == "(":
            cuts += _call(sql, ts, i)
    return _replace(sql, cuts)


def _arguments(sql: str, ts: list[Token], i: int) -> tuple[list[str], int]:
    """(argument texts, index of the closing parenthesis) of the call whose name is at i."""
    depth = ts[i + 1].depth
    j = i + 2
    args, begin = [], ts[i + 1].end
    while not (ts[j].text == ")" and ts[j].depth == depth):
        if ts[j].text == "," and ts[j].depth == depth + 1:
            args.append(sql[begin : ts[j].start].strip())
            begin = ts[j].end
        j += 1
    last = sql[begin : ts[j].start].strip()
    return args + ([last] if last else []), j


def _call(sql: str, ts: list[Token], i: int) -> list[tuple[int, int, str]]:
    name = ts[i].upper
    if name in ("JSONB_BUILD_OBJECT", "JSON_BUILD_OBJECT"):
        return [(ts[i].start, ts[i].end, "to_json(named_struct"), *_close(sql, ts, i)]
    if name == "EPOCH":
        args, j = _arguments(sql, ts, i)
        return [(ts[i].start, ts[j].end, f"(unix_micros(CAST({args[0]} AS TIMESTAMP)) / 1e6)")]
    if name == "TOTAL":
        args, j = _arguments(sql, ts, i)
        return [(ts[i].start, ts[j].end, f"coalesce(sum(CAST({args[0]} AS DOUBLE)), 0.0D)")]
    if name == "CHECKSUM_AGG":
        args, j = _arguments(sql, ts, i)
        return [(ts[i].start, ts[j].end, f"bit_xor(hash({args[0]}))")]
    if name in AGGREGATES:
        args, j = _arguments(sql, ts, i)
        text, end = _names(sql[ts[i + 1].end : ts[j].start].strip()), ts[j].end
        where = ""
        if j + 1 < len(ts) and ts[j + 1].upper == "WITHIN":
            return []  # Spark's own form
        if j + 2 < len(ts) and ts[j + 1].upper == "FILTER":
            k = j + 2
            while not (ts[k].text == ")" and ts[k].depth == ts[j + 2].depth):
                k += 1
            where, end = " " + _names(sql[ts[j + 1].start : ts[k].end]), ts[k].end
        new = _collected(name, text, where)
        return [] if new is None else [(ts[i].start, end, new)]
    if name in ("CONVERT", "TRY_CONVERT"):
        args, j = _arguments(sql, ts, i)
        args = [_names(a) for a in args]
        if len(args) == 1:  # CONVERT(x USING charset)
            return [(ts[i].start, ts[j].end, "CAST(" + re.split(r"(?i)\s+USING\s+", args[0])[0] + " AS STRING)")]
        kind, value = (args[0], args[1]) if _is_type(args[0]) else (args[1], args[0])
        return [(ts[i].start, ts[j].end, f"{'TRY_CAST' if name[0] == 'T' else 'CAST'}({value} AS {_spark_type(kind)})")]
    if name == "GENERATE_SERIES" and i and ts[i - 1].upper in ("FROM", "JOIN", ","):
        args, j = _arguments(sql, ts, i)
        return [(ts[i].start, ts[j].end, f"(SELECT explode(sequence({', '.join(args)})) AS generate_series)")]
    if name in FUNCTIONS:
        return [(ts[i].start, ts[i].end, FUNCTIONS[name])]
    return []


#: Aggregates that collect values, in the order that they ask for; fixed values.
AGGREGATES = frozenset("LIST ARRAY_AGG JSON_AGG JSONB_AGG JSON_ARRAYAGG JSON_GROUP_ARRAY STRING_AGG GROUP_CONCAT JSON_OBJECT_AGG JSONB_OBJECT_AGG JSON_OBJECTAGG JSON_GROUP_OBJECT".split())


def _collected(name: str, text: str, where: str) -> str | None:
    """A collecting aggregate with its ORDER BY and SEPARATOR. Without an order, values come sorted, so that the result is fixed;
    array_agg is left to Spark."""
    ts = tokens(text)
    order, separator, cut = "", None, len(text)
    for i, t in enumerate(ts):
        if t.depth == 0 and t.upper == "ORDER" and i + 1 < len(ts) and ts[i + 1].upper == "BY":
            order, cut = text[ts[i + 1].end :], min(cut, t.start)
        if t.depth == 0 and t.upper == "SEPARATOR":
            separator, cut = text[t.end :].strip(), min(cut, t.start)
            order = order[: order.upper().rfind("SEPARATOR")] if order else ""
    args = split_top(text[:cut])
    distinct = bool(re.match(r"DISTINCT\b", args[0], re.I))
    first = re.sub(r"^DISTINCT\s+", "", args[0], flags=re.I)
    if "OBJECT" in name:
        return f"to_json(map_from_entries(array_sort(collect_list(struct({first}, {args[1]})){where})))"
    if name == "ARRAY_AGG" and not order:
        return None
    collect = "collect_set" if distinct else "collect_list"
    if name in ("STRING_AGG", "GROUP_CONCAT"):
        separator = separator or (args[1] if len(args) > 1 else "','")
        first = f"CAST({first} AS STRING)"
    if order:
        keys = [re.match(r"(?is)(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?\s*$", k).groups() for k in split_top(order)]
        fields = ", ".join(f"'k{n}', {k}" for n, (k, _, _) in enumerate(keys))
        entries = f"{collect}(named_struct('x', {first}, {fields})){where}"
        compare = "0"
        for n, (_, way, nulls) in reversed(list(enumerate(keys))):
            down = (way or "").upper() == "DESC"
            last = nulls.upper() == "LAST" if nulls else not down
            less, more, null = ("1", "-1", "1" if last else "-1") if down else ("-1", "1", "1" if last else "-1")
            back = "-1" if null == "1" else "1"
            compare = f"CASE WHEN a.k{n} IS NULL AND b.k{n} IS NULL THEN {compare} WHEN a.k{n} IS NULL THEN {null} WHEN b.k{n} IS NULL THEN {back} WHEN a.k{n} < b.k{n} THEN {less} WHEN a.k{n} > b.k{n} THEN {more} ELSE {compare} END"
        inner = f"transform(array_sort({entries}, (a, b) -> {compare}), e -> e.x)"
    else:
        inner = f"array_sort({collect}({first}){where})"
    if separator is not None:
        # No value at all gives null, not an empty text.
        return f"nullif(array_join({inner}, {separator}), CASE WHEN size({inner}) = 0 THEN '' END)"
    inner = f"CASE WHEN size({inner}) > 0 THEN {inner} END"
    return inner if name in ("LIST", "ARRAY_AGG") else f"to_json({inner})"


def _is_type(text: str) -> bool:
    from ..operators.ddl import TYPES

    return text.partition("(")[0].strip().upper() in TYPES


def _spark_type(text: str) -> str:
    from ..operators.ddl import spark_type

    return spark_type("BIGINT" if text.upper() in ("SIGNED", "UNSIGNED") else text)


def _close(sql: str, ts: list[Token], i: int) -> list[tuple[int, int, str]]:
    _, j = _arguments(sql, ts, i)
    return [(ts[j].start, ts[j].end, "))")]


def _escape(sql: str) -> str:
    """Doubled quotes in strings as escapes without a quote, so that the text still splits into tokens; backslashes as themselves."""
    return re.sub(r"'(?:[^']|'')*'", lambda m: "'" + m.group()[1:-1].replace("\\", "\\\\").replace("''", "\\u0027") + "'", sql)


def _top(sql: str) -> str:
    """TOP n, with PERCENT and WITH TIES, of any SELECT in the statement, and OFFSET ... FETCH as LIMIT and OFFSET."""
    while (found := _one_top(sql)) is not None:
        sql = found
    m = re.search(r"\bOFFSET\s+(\d+)\s+ROWS?(?:\s+FETCH\s+(?:NEXT|FIRST)\s+(\d+)\s+ROWS?\s+ONLY)?\s*$", sql, re.I)
    if m:
        return sql[: m.start()] + (f"LIMIT {m.group(2)} " if m.group(2) else "") + f"OFFSET {m.group(1)}"
    sql = re.sub(r"\bLIMIT\s+(\d+)\s*,\s*(\d+)\s*$", r"LIMIT \2 OFFSET \1", sql, flags=re.I)
    return re.sub(r"\bFETCH\s+(?:NEXT|FIRST)\s+(\d+)\s+ROWS?\s+ONLY\s*$", r"LIMIT \1", sql, flags=re.I)


def _laterals(sql: str) -> str:
    """LIMIT and OFFSET of LATERAL queries as a rank. Spark loses the order of such a limit if a key of it isn't selected, and
    the limit of each row if the condition casts the inner column."""
    while (found := _one_lateral(sql)) is not None:
        sql = found
    return sql


def _one_lateral(sql: str) -> str | None:
    """The statement with its last limited LATERAL query rewritten; None if there is none."""
    ts = tokens(sql)
    for i in range(len(ts) - 3, -1, -1):
        if ts[i].upper != "LATERAL" or ts[i + 1].text != "(" or ts[i + 2].upper not in ("SELECT", "WITH"):
            continue
        depth = ts[i + 2].depth
        end = next(k for k in range(i + 2, len(ts)) if ts[k].depth < depth)
        at = {t.upper: k for k, t in enumerate(ts[i + 2 : end], i + 2) if t.depth == depth and t.upper in ("ORDER", "LIMIT", "OFFSET")}
        cuts = sorted([*at.values(), end])
        clause = {w: sql[ts[k].end : ts[cuts[cuts.index(k) + 1] - 1].end].strip() for w, k in at.items()}
        if not {"LIMIT", "OFFSET"} & set(at) or clause.get("LIMIT", "").upper() == "ALL":
            continue
        inner = _ranked(sql[ts[i + 2].start : ts[cuts[0] - 1].end], re.sub(r"(?i)^BY\s+", "", clause.get("ORDER", "")))
        first = clause.get("OFFSET", "0")
        tests = [f"__rank > {first}"] * ("OFFSET" in at) + ([f"__rank <= {first} + {clause['LIMIT']}" if "OFFSET" in at else f"__rank <= {clause['LIMIT']}"] if "LIMIT" in at else [])
        return sql[: ts[i + 2].start] + f"SELECT * EXCEPT (__rank) FROM ({inner}) WHERE {' AND '.join(tests)}" + sql[ts[end - 1].end :]
    return None


def _ranked(body: str, order: str) -> str:
    """A query with each row's number in the given order as ``__rank``. Keys may be names or places of the select list."""
    ts = tokens(body)
    top = [t.upper for t in ts if t.depth == 0]
    start = next((t for t in ts if t.depth == 0 and t.upper == "FROM"), None)
    if start is None or ts[0].upper == "WITH" or ts[1].upper == "DISTINCT" or {"UNION", "INTERSECT", "EXCEPT", "MINUS"} & set(top):
        return f"SELECT *, row_number() OVER (ORDER BY {order or 'NULL'}) AS __rank FROM ({body})"
    shown = [x.strip() for x in split_top(body[ts[0].end : start.start])]
    named = {}
    for x in shown:
        last = tokens(x)[-1]
        if (m := re.match(r"(?is)(.*\S)\s+AS\s+(\S+)$", x)) is not None and last.depth == 0:
            named[m.group(2).strip("`").lower()] = m.group(1)
    keys = []
    for k in split_top(order) if order else ["NULL"]:
        expression, way = re.match(r"(?is)\s*(.*?)((?:\s+(?:ASC|DESC))?(?:\s+NULLS\s+(?:FIRST|LAST))?)\s*$", k).groups()
        if expression.isdigit():
            expression = named.get(_alias(shown[int(expression) - 1]), shown[int(expression) - 1])
        keys.append(named.get(expression.strip("`").lower(), expression) + way)
    return f"{body[: start.start].rstrip()}, row_number() OVER (ORDER BY {', '.join(keys)}) AS __rank {body[start.start :]}"


def _alias(item: str) -> str | None:
    m = re.search(r"(?i)\sAS\s+(\S+)$", item)
    return m and m.group(1).strip("`").lower()


#: Aggregates that may not stand beside a slice of collected rows in one column; fixed values.
_WHOLE = frozenset("COUNT SUM AVG MEAN MIN MAX ANY_VALUE FIRST LAST BOOL_AND BOOL_OR EVERY SOME STDDEV STDDEV_SAMP STDDEV_POP VARIANCE VAR_SAMP VAR_POP MAX_BY MIN_BY COLLECT_LIST COLLECT_SET LISTAGG GROUPING GROUPING_ID".split()) | AGGREGATES


def _slices(sql: str) -> str:
    """slice(array_agg(x ORDER BY ...), 1, n) of a grouped SELECT by ranks, so that no task collects a whole group: rows are
    ranked in their group, the first n collected and joined with the group. Other forms, and lists that are wanted whole, stay."""
    ts = tokens(sql)
    if not ts or ts[0].upper != "SELECT" or ts[1].upper in ("DISTINCT", "TOP", "ALL") or not re.search(r"(?i)\bslice\s*\(\s*(?:array_agg|list)\s*\(", sql):
        return sql
    top = {}
    for k, t in enumerate(ts):
        if t.depth == 0 and t.kind == "word":
            top.setdefault(t.upper, k)
    if "FROM" not in top or not {"GROUP"} <= set(top) or {"UNION", "EXCEPT", "INTERSECT", "HAVING", "WINDOW", "LIMIT", "ORDER", "OFFSET", "FETCH", "QUALIFY", "FOR", "ROLLUP", "CUBE", "SETS"} & set(top) or "?" in {t.text for t in ts}:
        return sql
    part = lambda a, b: sql[ts[a].end : ts[b].start].strip()
    groups = split_top(sql[ts[top["GROUP"] + 1].end : ts[-1].end])
    if not all(re.fullmatch(r"\s*[A-Za-z_]\w*(\.[A-Za-z_]\w*)?\s*", g) and g.strip().upper() != "ALL" for g in groups):
        return sql
    groups = [g.strip() for g in groups]
    plain = {g.rpartition(".")[2].lower() for g in groups}
    source = part(top["FROM"], top.get("WHERE", top["GROUP"]))
    where = part(top["WHERE"], top["GROUP"]) if "WHERE" in top else ""
    keys = ", ".join(f"{g} AS __g{n}" for n, g in enumerate(groups))
    shown, inner, joins = [], [keys], []
    for n, item in enumerate(x.strip() for x in split_top(part(0, top["FROM"]))):
        name = re.search(r"(?is)\sAS\s+(\S+)$", item)
        m = re.search(r"(?i)\bslice\s*\(\s*(?:array_agg|list)\s*\(", item)
        if m is None:
            label = name.group(1) if name else item.rpartition(".")[2] if re.fullmatch(r"[A-Za-z_][\w.]*", item) else None
            if label is None:
                return sql
            inner.append(f"{item[: name.start()] if name else item} AS __c{n}")
            shown.append(f"__b.__c{n} AS {label}")
            continue
        its = tokens(item)
        i = next(k for k, t in enumerate(its) if t.start >= m.start())
        args, end = _arguments(item, its, i)
        rest = item[: its[i].start] + "__list" + item[its[end].end : name.start() if name else len(item)]
        words = [t for t in tokens(rest) if t.kind in ("word", "quoted") and t.text != "__list"]
        calls = {t.start for t, u in zip(tokens(rest), tokens(rest)[1:]) if u.text == "("}
        if len(args) != 3 or name is None or not all(a.isdigit() and int(a) for a in args[1:]) or any(t.start not in calls or t.upper in _WHOLE for t in words):
            return sql
        ats = tokens(args[0])
        close = _arguments(args[0], ats, 0)[1]
        listed, tail = args[0][ats[1].end : ats[close].start], args[0][ats[close].end :].strip()
        given = re.fullmatch(r"(?is)FILTER\s*\(\s*WHERE\b(.*)\)", tail)
        order = next((t for t in tokens(listed) if t.depth == 0 and t.upper == "ORDER"), None)
        if tail and given is None or order is None and ats[0].upper != "LIST" or re.match(r"(?i)\s*DISTINCT\b", listed) or len(split_top(listed[: order.start] if order else listed)) != 1:
            return sql
        test = given.group(1) if given else ""
        value = (listed[: order.start] if order else listed).strip()
        by = []
        for k in split_top(re.sub(r"(?is)^ORDER\s+BY\s", "", listed[order.start :])) if order else [value]:
            key, way, nulls = re.match(r"(?is)\s*(.*?)(?:\s+(ASC|DESC))?(?:\s+NULLS\s+(FIRST|LAST))?\s*$", k).groups()
            way = (way or "ASC").upper()
            by.append(f"{key} {way} NULLS {(nulls or ('FIRST' if way == 'DESC' else 'LAST')).upper()}")
        by = ", ".join(by)
        if order is None:  # list() has no nulls and sorts its values
            test = f"({test}) AND {value} IS NOT NULL" if test else f"{value} IS NOT NULL"
        tests = " AND ".join(f"({x})" for x in (where, test) if x)
        ranked = f"SELECT {keys}, {value} AS __x, row_number() OVER (PARTITION BY {', '.join(groups)} ORDER BY {by}) AS __r FROM {source}" + (f" WHERE {tests}" if tests else "")
        group = ", ".join(f"__g{k}" for k in range(len(groups)))
        lists = f"SELECT {group}, transform(array_sort(collect_list(named_struct('r', __r, 'x', __x))), e -> e.x) AS __list FROM ({ranked}) WHERE __r <= {int(args[1]) + int(args[2]) - 1} GROUP BY {group}"
        joins.append(f" LEFT JOIN ({lists}) __s{n} ON " + " AND ".join(f"__b.__g{k} <=> __s{n}.__g{k}" for k in range(len(groups))))
        shown.append(rest.replace("__list", f"slice(__s{n}.__list, {args[1]}, {args[2]})") + f" AS {name.group(1)}")
    if any(len(re.findall(r"(?i)\bslice\s*\(\s*(?:array_agg|list)\s*\(", x)) for x in shown) or not plain:
        return sql
    grouped = f"SELECT {', '.join(inner)} FROM {source}" + (f" WHERE {where}" if where else "") + f" GROUP BY {', '.join(groups)}"
    return f"SELECT {', '.join(shown)} FROM ({grouped}) __b" + "".join(joins)


def outer_percent(sql: str) -> tuple[str, Fraction] | None:
    """A statement whose own SELECT has TOP n PERCENT and an ORDER BY, without its TOP, and the share; None for all else,
    which ``rewrite`` takes."""
    ts = tokens(sql)
    top = [(i, t) for i, t in enumerate(ts) if t.depth == 0]
    words = [t.upper for _, t in top]
    at = next((i for (i, t), (_, before) in zip(top[1:], top) if t.upper == "TOP" and before.upper == "SELECT"), None)
    if at is None or "FROM" not in words or "ORDER" not in words or {"UNION", "EXCEPT", "INTERSECT"} & set(words):
        return None
    m = re.match(r"(?i)TOP\s*(?:(\d+(?:\.\d+)?)|\(\s*(\d+(?:\.\d+)?)\s*\))\s*PERCENT\b(?!\s+WITH\s+TIES\b)", sql[ts[at].start :])
    if m is None:
        return None
    return sql[: ts[at].start] + sql[ts[at].start + m.end() :].lstrip(), Fraction(m.group(1) or m.group(2)) / 100


def _one_top(sql: str) -> str | None:
    """The statement with its last TOP rewritten; None if there is none."""
    ts = tokens(sql)
    for i in range(len(ts) - 1, -1, -1):
        word = 2 if i and ts[i - 1].upper in ("DISTINCT", "ALL") else 1
        if ts[i].upper != "TOP" or i < word or ts[i - word].upper != "SELECT" or i + 1 == len(ts):
            continue
        depth, j = ts[i].depth, i + 2
        n = ts[i + 1].text
        if n == "(":
            while not (ts[j].text == ")" and ts[j].depth == depth):
                j += 1
            n, j = sql[ts[i + 1].end : ts[j].start], j + 1
        percent = j < len(ts) and ts[j].upper == "PERCENT"
        j += percent
        ties = ts[j].upper == "WITH" and ts[j + 1].upper == "TIES"
        j += 2 * ties
        # The SELECT goes on to the parenthesis or set operator that ends it.
        end = next((k for k in range(j, len(ts)) if ts[k].depth < depth or ts[k].depth == depth and ts[k].upper in ("UNION", "EXCEPT", "INTERSECT", ";")), len(ts))
        stop = ts[end - 1].end
        body = sql[ts[j].start : stop]
        if not percent and not ties:
            return sql[: ts[i].start] + body + f" LIMIT {n}" + sql[stop:]
        at = lambda a, b="": next((k for k in range(j, end) if ts[k].depth == depth and ts[k].upper == a and (not b or ts[k + 1].upper == b)), None)
        order = at("ORDER", "BY")
        if order is None or at("FROM") is None:
            raise NotSupported("TOP with PERCENT or WITH TIES needs FROM and ORDER BY")
        keys = sql[ts[order].start : stop]
        shown = sql[ts[j].start : ts[at("FROM")].start].rstrip()
        rank = f"{'rank' if ties else 'row_number'}() OVER ({keys}) AS __top" + (", count(*) OVER () AS __all" if percent else "")
        limit = f"ceil(__all * ({n}) / 100.0)" if percent else n
        inner = f"SELECT {shown}, {rank} {sql[ts[at('FROM')].start : ts[order].start]}"
        columns = "__top, __all" if percent else "__top"
        return sql[: ts[i - word].start] + f"SELECT {'DISTINCT ' if word == 2 and ts[i - 1].upper == 'DISTINCT' else ''}* EXCEPT ({columns}) FROM ({inner}) WHERE __top <= {limit}" + ("" if depth else " ORDER BY __top") + sql[stop:]
    return None
