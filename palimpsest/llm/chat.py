"""Chat formatting in budgeted windows.

A conversation is cut into windows of whole turns. Prefix sums of turn tokens
choose the longest run of new turns that fits the budget beside the system
turn, which every window repeats, and beside a limited history: the last turns
of the window before. A turn is new in exactly one window; only new assistant
texts are under the loss mask, repeated ones are masked out.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. Inside roles
and texts, ``<`` followed by any number of backslashes and ``|`` gets one more
backslash, so no control string can appear, and taking one off again gives the
original back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import parallelism, prepare

START, END = "<|im_start|>", "<|im_end|>"
#: Tokens in a window, tokens of repeated history in it at most, turns of history at most.
BUDGET, HISTORY_TOKENS, HISTORY_TURNS = 1024, 256, 4
#: Turn numbers that one group covers; longer conversations are several groups.
GROUP_TURNS = 1024

_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def escape_role(role: str) -> str:
    """A role ends at a line feed, so its own are written as \\n."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescape(role))


def rough_tokens(texts: list[str]) -> list[int]:
    """A token for every four bytes begun."""
    return [-(-len(t.encode()) // 4) for t in texts]


def windows(turns: list[tuple[str, str, int]], system: bool, context: int, *, budget: int, history_tokens: int, history_turns: int) -> Iterator[tuple[list[int], int]]:
    """Yield (turn indices, how many of them are repeated). ``turns`` are (role, text, tokens); the first
    ``context`` of them were new in an earlier group (a system turn first, if ``system``, then history)."""
    sums = np.concatenate([[0], np.cumsum([t[2] for t in turns])])
    head = [0] if system else []
    fixed = turns[0][2] if system else 0
    at = context
    while at < len(turns):
        # History: the longest run of turns that ends here within both bounds; not into the system turn.
        low = max(len(head), at - history_turns)
        first = max(low, int(np.searchsorted(sums[: at + 1], sums[at] - history_tokens, side="left")))
        first = min(first, at)
        repeated = [*(h for h in head if h < at), *range(first, at)]
        room = budget - sums[at] + sums[first] - (fixed if head and head[0] < at else 0)
        end = max(at + 1, int(np.searchsorted(sums, sums[at] + max(0, room), side="right")) - 1)
        if end == at + 1 and turns[at][2] > room:  # a turn that doesn't fit goes without history
            repeated = [h for h in head if h < at]
        yield [*repeated, *range(at, end)], len(repeated)
        at = end


def format_chats(
    turns: DataFrame, *, budget: int = BUDGET, history_tokens: int = HISTORY_TOKENS, history_turns: int = HISTORY_TURNS, group_turns: int = GROUP_TURNS, count: Callable[[list[str]], list[int]] = rough_tokens
) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: conv_id, part, window, formatted, n_repeated, loss (spans of code points).

    Null texts and roles are empty. Turns are ordered by turn, ties by role and
    text; null turns come first. A conversation whose first turn is by
    ``system`` repeats it in every window. A turn over the budget has a window
    of its own. Conversations longer than ``group_turns`` are dealt by part,
    each with copies of the system turn and of the turns before it, so no task
    holds an unbounded conversation; rows of a part are streamed in order.
    """
    spark = prepare(turns.sparkSession)
    clean = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    clean = clean.withColumn("part", F.coalesce(F.floor(F.col("turn") / group_turns), F.lit(-(1 << 40))).cast("long"))
    own = clean.select("conv_id", "part", F.lit(2).alias("kind"), "turn", "role", "text")
    # Of conversations in several parts only: who comes first, and what ends a part.
    parts = clean.groupBy("conv_id", "part").agg(F.min("turn").alias("low"), F.max("turn").alias("high"))
    many = parts.groupBy("conv_id").agg(F.count("*").alias("n"), F.min("part").alias("first")).filter("n > 1").drop("n")
    order = Window.partitionBy("conv_id").orderBy("part")
    split = parts.join(many.withColumnRenamed("conv_id", "c"), F.expr("conv_id <=> c")).drop("c")
    follow = split.withColumn("next", F.lead("part").over(order))
    named = follow.select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "next", "high", "first").filter("next is not null")
    tail = clean.join(named, F.expr("conv_id <=> c and part = p and turn > high - " + str(history_turns))).select("conv_id", F.col("next").alias("part"), F.lit(1).alias("kind"), "turn", "role", "text")
    firsts = split.filter("part = first").select(F.col("conv_id").alias("c"), F.col("part").alias("p"), "low")
    heads = clean.filter("role = 'system'").join(firsts, F.expr("conv_id <=> c and part = p and turn <=> low")).groupBy("c").agg(F.min(F.struct("turn", "role", "text")).alias("s"))
    rest = split.filter("part <> first").select("conv_id", "part")
    system = rest.join(heads, F.expr("conv_id <=> c")).select("conv_id", "part", F.lit(0).alias("kind"), "s.turn", "s.role", "s.text")
    rows = own.unionByName(tail).unionByName(system).repartition(parallelism(spark), "conv_id", "part").sortWithinPartitions("conv_id", "part", "kind", "turn", "role", "text")
    columns = ["conv_id", "part", "window", "formatted", "n_repeated", "loss"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str, int]] = []
        kinds: list[int] = []
        key = None

        def flush() -> list[tuple]:
            if not held:
                return []
            sizes = count([escape(t) for _, t, _ in held])
            all_turns = [(r, t, s + 4) for (r, t, _), s in zip(held, sizes)]
            context = sum(k < 2 for k in kinds)
            is_system = kinds[0] == 0 or (kinds[0] == 2 and held[0][0] == "system")
            out = []
            for n, (picked, repeated) in enumerate(windows(all_turns, is_system, context, budget=budget, history_tokens=history_tokens, history_turns=history_turns)):
                pieces, loss, size = [], [], 0
                for i, t in enumerate(picked):
                    role, text = escape_role(all_turns[t][0]), escape(all_turns[t][1])
                    before = f"{START}{role}\n"
                    pieces += [before, text, f"{END}\n"]
                    if i >= repeated and all_turns[t][0] == "assistant" and text:
                        loss.append({"from": size + len(before), "to": size + len(before) + len(text)})
                    size += len(before) + len(text) + len(END) + 1
                out.append((*key, n, "".join(pieces), repeated, loss))
            return out

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            kinds_ = [id_type, pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())]))]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds_)], names=columns)

        id_type = pa.int64()
        out: list[tuple] = []
        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for c, p, kind, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "part", "kind", "role", "text"))):
                if key is None or (c, p) != key:
                    out += flush()
                    held, kinds, key = [], [], (c, p)
                    if len(out) >= 256:
                        yield batch_of(out)
                        out = []
                held.append((role, text, 0))
                kinds.append(kind)
        out += flush()
        if out:
            yield batch_of(out)

    kind = turns.schema["conv_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"conv_id {kind}, part long, window int, formatted string, n_repeated int, loss array<struct<from:int,to:int>>")


def parse(formatted: str) -> list[tuple[str, str, int]]:
    """(role, text, place of the text) of each turn in a formatted window; inverse of the template."""
    out, at = [], 0
    while at < len(formatted):
        if not formatted.startswith(START, at):
            raise ValueError("a turn must begin with its mark")
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        out.append((unescape_role(formatted[at + len(START) : line]), unescape(formatted[line + 1 : end]), line + 1))
        at = end + len(END) + 1
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """Read windows back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest is sequential, so a conversation's windows are read in order in
    one task; they are streamed, one at a time.
    """
    spark = prepare(formatted.sparkSession)
    rows = formatted.repartition(parallelism(spark), "conv_id").sortWithinPartitions("conv_id", "part", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = formatted.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        missing = object()
        key, state, id_type = missing, None, pa.int64()
        out: list[tuple] = []

        def done() -> None:
            if key is not missing:
                out.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for c, text, repeated, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "n_repeated", "loss"))):
                if key is missing or c != key:
                    done()
                    key, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body, _ in parse(text)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode())
                for span in loss:
                    part = unescape(text[span["from"] : span["to"]])
                    state[2] += len(part)
                    state[3].update(part.encode())
                state[4] += len(text)
            if len(out) >= 1024:
                yield batch_of(out)
                out = []
        done()
        if out:
            yield batch_of(out)

    return rows.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
