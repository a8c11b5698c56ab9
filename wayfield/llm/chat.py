"""Conversations as training windows of a token budget, in a reversible template with a loss mask.

Template: ``<|turn|>role<|text|>text<|end|>`` for each turn. In roles and texts ``&``, ``<`` and ``[`` are written as
``&amp;``, ``&lt;`` and ``&#91;``, so no text can hold a control string of this template or of the usual others
(``</s>``, ``[INST]``), and unescaping gives the text back exactly.

Windows: prefix sums of the turns' tokens (template marks included) cut a conversation where they pass a multiple of
``own``; the cut is a turn boundary. A window is the leading system turn (kept in every window), then turns before the cut
as history, at most ``history`` tokens and what the budget leaves, then its own turns. Turns are never cut: a window goes
over its budget only by its last own turn, where that is longer than ``budget - own`` less the system turn. Loss is on the text of the window's own assistant turns, so every assistant text is a target
once; system and history, which repeat, are masked.

Turns are numbered in tasks dealt by ranges of (conversation, turn, role, beginning of the text), and prefix sums of a long
conversation are made in blocks of ``block`` of these numbers: sums inside blocks, then over blocks (a row each). So no task
holds a whole conversation, whatever its turn numbers are, and a window is only as long as its budget, or its longest turn.

Turns are ordered by number (null first), then role, then text; repeated rows are turns of their own. Null texts and roles
are empty; a null conversation id is one conversation. An empty table gives no window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from wayfield.llm.order import numbered as in_order
from wayfield.llm.store import written

# Fixed values of the template.
TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
ESCAPES = [("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;")]
MARKS = 3


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: str) -> str:
    for plain, safe in reversed(ESCAPES):
        text = text.replace(safe, plain)
    return text


def token_estimate(text: Column) -> Column:
    """A token for every run of letters, of digits, or single mark, and one more for every six letters."""
    return F.regexp_count(text, F.lit(r"\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}]"))


def numbered(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", tokens=token_estimate, block: int = 512) -> DataFrame:
    """conv, n (0, 1, ...), role, text, tokens, before (tokens of the turns before), system and lead (tokens of the leading system turn)."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    rows = rows.withColumns({"tokens": (tokens(F.col("text")) + MARKS).cast("long"), "head": F.substring("text", 1, 64)})
    rows = in_order(rows, "conv", ["turn", "role", "head"], "turns", ("text",)).drop("turn", "head").withColumn("block", F.floor(F.col("n") / block))
    sums = rows.groupBy("conv", "block").agg(F.sum("tokens").alias("t"))
    over = Window.partitionBy("conv").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv").alias("conv_b"), F.col("block").alias("block_b"), F.coalesce(F.sum("t").over(over), F.lit(0)).alias("t0"))
    inside = Window.partitionBy("conv", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("s", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).join(sums, F.expr("conv <=> conv_b and block = block_b"))
    return rows.select("conv", "n", "role", "text", "tokens", (F.col("t0") + F.col("s")).alias("before"))


def windows(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 512, own: int = 256, history: int = 128, tokens=token_estimate) -> DataFrame:
    """conv, window, formatted, tokens, loss (start and length in code points), turns (repeated, role start, text start and length)."""
    rows = written(numbered(turns, conv, turn, role, text, tokens), "numbered")
    step = own
    own = rows.withColumn("window", F.floor(F.col("before") / step)).withColumn("part", F.lit(2))
    lead = rows.filter("n = 0 and role = 'system'").select(F.col("conv").alias("conv_l"), F.struct("n", "role", "text", "tokens").alias("lead"))
    first = own.groupBy("conv", "window").agg(F.min("before").alias("start"), F.min("n").alias("n0"), F.sum("tokens").alias("used"))
    first = first.withColumnsRenamed({"conv": "conv_w", "window": "w"}).join(lead, F.expr("conv_w <=> conv_l"), "left")
    room = F.lit(budget) - F.col("used") - F.when(F.col("n0") > 0, F.coalesce("lead.tokens", F.lit(0))).otherwise(0)
    first = first.select("conv_w", "w", "start", "n0", "lead", F.greatest(F.lit(0), F.least(F.lit(history), room)).alias("room"))
    # history: turns that end within ``history`` tokens before the window's first turn; they lie in at most a few windows before
    back = -(-history // step)
    near = own.select("conv", "n", "role", "text", "tokens", "before", F.explode(F.sequence("window", F.col("window") + back + 1)).alias("w"))
    past = near.join(first, near["conv"].eqNullSafe(first["conv_w"]) & (near["w"] == first["w"]))
    past = past.filter("n < n0 and before >= start - room and not (n = 0 and role = 'system')").select("conv", first["w"].alias("window"), F.lit(1).alias("part"), "n", "role", "text", "tokens")
    kept = first.filter("n0 > 0 and lead is not null").select(F.col("conv_w").alias("conv"), F.col("w").alias("window"), F.lit(0).alias("part"), "lead.*")
    every = own.select("conv", "window", "part", "n", "role", "text", "tokens").unionByName(past).unionByName(kept)
    opened = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT))
    body = escape(F.col("text"))
    every = every.select("conv", "window", F.struct("part", "n", "role", "tokens", opened.alias("open"), body.alias("body"), (F.length(opened) + F.length(body) + len(END)).alias("size")).alias("t"))
    packed = every.groupBy("conv", "window").agg(F.sort_array(F.collect_list("t")).alias("t"))
    place = """transform(t, (x, i) -> named_struct('repeated', x.part < 2, 'role', x.role,
        'start', aggregate(slice(t, 1, i), 0L, (a, y) -> a + y.size) + length(x.open), 'length', cast(length(x.body) as long)))"""
    return packed.select(
        F.col("conv").alias(conv), "window",
        F.expr(f"array_join(transform(t, x -> concat(x.open, x.body, '{END}')), '')").alias("formatted"),
        F.expr("aggregate(t, 0L, (a, x) -> a + x.tokens)").alias("tokens"), F.expr(place).alias("turns"),
    ).withColumn("loss", F.expr("transform(filter(turns, x -> x.role = 'assistant' and not x.repeated), x -> named_struct('start', x.start, 'length', x.length))"))


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row per conversation, parsed from its windows in order: n_turns, digests of turns and of the text under the mask.

    Windows stream through in order of conversation and number; a task holds one window and two running digests.
    """
    import hashlib

    def parse(window: dict) -> tuple[list[tuple[str, str]], str]:
        text, new = window["formatted"], []
        parts = text.split(END)
        if parts.pop() != "" or len(parts) != len(window["repeated"]):
            raise ValueError("a window does not end with a turn")
        for part, repeated in zip(parts, window["repeated"], strict=True):
            opened, mark, body = part.partition(TEXT)
            if not (opened.startswith(TURN) and mark):
                raise ValueError("a turn without its marks")
            if not repeated:
                new.append((unescape(opened[len(TURN) :]), unescape(body)))
        return new, "".join(unescape(text[x["start"] : x["start"] + x["length"]]) for x in window["loss"])

    names = [conv, *(c.split()[0] for c in DIGEST.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, kind = None, None, None

        def done() -> pa.RecordBatch:
            turns, sha, chars, loss, size = state
            values = [key, turns, sha.hexdigest(), chars, loss.hexdigest(), size]
            return pa.RecordBatch.from_arrays([pa.array([values[0]], type=kind), *(pa.array([v]) for v in values[1:])], names=names)

        for batch in batches:
            kind = batch.schema.field(0).type
            for window in (x for i in range(0, batch.num_rows, 64) for x in batch.slice(i, 64).to_pylist()):
                if state is None or window[conv] != key:
                    if state is not None:
                        yield done()
                    key, state = window[conv], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                new, target = parse(window)
                for role, text in new:
                    state[1].update(f"{role}\n{text}\n".encode())
                state[3].update(target.encode())
                state[0], state[2], state[4] = state[0] + len(new), state[2] + len(target), state[4] + len(window["formatted"])
        if state is not None:
            yield done()

    rows = formatted.select(conv, "window", "formatted", F.expr("transform(turns, x -> x.repeated)").alias("repeated"), "loss")
    ordered = rows.repartition(conv).sortWithinPartitions(conv, "window")
    return ordered.mapInArrow(run, f"`{conv}` {formatted.schema[conv].dataType.simpleString()}, {DIGEST}")
