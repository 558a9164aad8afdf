"""Chat formatting: a finite-state machine over roles and text segments with loss flags, from a declarative template.

Formatting is row-local: a turn becomes a marker, its escaped text and a closing mark. Turn order is judged by composing
the machine's transition tables, run by run over range-partitioned turns, so a conversation of any length is split.

Defined results. Null text: empty. Null role: empty, which no state accepts. Null conv_id: a conversation of its own.
Null turn: first. Equal turns: by role, then text; repeated rows are repeated turns. Empty table: no rows.
"""

import hashlib

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TEMPLATE = {
    "open": "### ", "after": ": ", "close": " </turn>\n",
    "control": ["###", "</turn>"],
    "titles": {"system": "System", "user": "User", "assistant": "Assistant"},
    "other": "Role ",                       # title of any other role, followed by the escaped role
    "loss": ["assistant"],
    "start": ["system", "user"],
    "next": {"system": ["user"], "user": ["assistant"], "assistant": ["user"]},
    "end": ["assistant"],
}


def escaped(text, template=TEMPLATE):
    """A backslash before every backslash and before each control string."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for mark in template["control"]:
        text = F.replace(text, F.lit(mark), F.lit("\\" + mark))
    return text


def unescaped(text):
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _clean(turns):
    return turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def segments(turns: DataFrame, template=TEMPLATE) -> DataFrame:
    """One row per turn with its segments in order: conv_id, turn, role, text, segments array of (text, loss)."""
    rows = _clean(turns)
    title = F.concat(F.lit(template["other"]), F.replace(escaped(F.col("role"), template), F.lit(":"), F.lit("\\:")))
    for role, name in template["titles"].items():
        title = F.when(F.col("role") == role, F.lit(name)).otherwise(title)
    def part(text, loss):
        return F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)
    return rows.withColumn("segments", F.array(
        part(F.concat(F.lit(template["open"]), title, F.lit(template["after"])), no),
        part(escaped(F.col("text"), template), F.col("role").isin(template["loss"])),
        part(F.lit(template["close"]), no)))


def parsed(formatted, template=TEMPLATE):
    """Role and text read back from the formatted string of a turn."""
    open_, after, close = (F.lit(template[k]) for k in ("open", "after", "close"))
    # the title ends at the first mark that is not escaped; the text is what stands before the closing mark
    title = F.regexp_extract(formatted, r"(?s)^" + template["open"] + r"((?:\\.|[^\\:])*)" + template["after"], 1)
    rest = F.substring(formatted, F.char_length(open_) + F.char_length(title) + F.char_length(after) + 1,
                       F.char_length(formatted))
    text = unescaped(F.substring(rest, F.lit(1), F.char_length(rest) - F.char_length(close)))
    role = unescaped(F.substring(title, F.lit(len(template["other"]) + 1), F.char_length(title)))
    for name, shown in template["titles"].items():
        role = F.when(title == shown, F.lit(name)).otherwise(role)
    return role, text


def turn_order(turns: DataFrame, template=TEMPLATE) -> DataFrame:
    """conv_id, valid: whether the roles, in order, are a path of the template's machine that ends in an end state."""
    states = ["", *template["next"]]        # state 0: nothing read yet; -1: no way on
    step = {}
    for i, state in enumerate(states):
        for role in template["start"] if i == 0 else template["next"][state]:
            step[i, role] = states.index(role)

    def compose(batches):
        here, key, table = TaskContext.get().partitionId(), None, None
        for batch in batches:
            out = []
            for conv, absent, role in zip(batch["conv"], batch["absent"], batch["role"]):
                if key != (conv, absent):
                    if key is not None:
                        out.append((*key, here, table))
                    key, table = (conv, absent), list(range(len(states)))
                table = [step.get((s, role), -1) for s in table]
            if out:
                yield pd.DataFrame(out, columns=["conv", "absent", "run", "table"])
        if key is not None:
            yield pd.DataFrame([(*key, here, table)], columns=["conv", "absent", "run", "table"])

    rows = _clean(turns).select(F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"),
                                F.col("conv_id").isNull().alias("absent"), "turn", "role", "text")
    order = ["absent", "conv", F.asc_nulls_first("turn"), "role", "text"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv", "absent", "role").mapInPandas(
        compose, "conv long, absent boolean, run int, table array<int>")
    # at most one run of a conversation per partition
    ordered = F.sort_array(F.collect_list(F.struct("run", "table")))
    ends = [states.index(s) for s in template["end"]]
    return runs.groupBy("conv", "absent").agg(ordered.alias("runs")).select(
        F.when(~F.col("absent"), F.col("conv")).alias("conv_id"),
        F.aggregate("runs", F.lit(0), lambda s, r: F.when(s < 0, s).otherwise(F.get(r.table, s))).isin(ends).alias("valid"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, from its formatted turns: counts and digests of what is read back.

    A digest reads a conversation from start to end, so its rows are streamed in order through one task; nothing but
    the running state is held.
    """
    def stream(batches):
        state, key = None, None
        def row():
            n, a, chars, b, shown = state
            return (*key, n, a.hexdigest(), chars, b.hexdigest(), shown)
        for batch in batches:
            out = []
            for conv, absent, role, text, loss, shown in batch.itertuples(index=False, name=None):
                if key != (conv, absent):
                    if key is not None:
                        out.append(row())
                    key, state = (conv, absent), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[4] += shown
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None:
            yield pd.DataFrame([row()], columns=names)

    names = ["conv", "absent", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    whole = F.array_join(F.transform("segments", lambda s: s.text), "")
    role, text = parsed(F.col("whole"))
    under_loss = unescaped(F.array_join(F.transform(F.filter("segments", lambda s: s.loss), lambda s: s.text), ""))
    rows = formatted.select("conv_id", "turn", "segments", whole.alias("whole")).select(
        F.coalesce("conv_id", F.lit(0)).cast("long").alias("conv"), F.col("conv_id").isNull().alias("absent"), "turn",
        role.alias("role"), text.alias("text"), under_loss.alias("loss"), F.char_length("whole").alias("shown"))
    ordered = rows.repartition("conv", "absent").sortWithinPartitions(
        "absent", "conv", F.asc_nulls_first("turn"), "role", "text").drop("turn")
    out = ordered.mapInPandas(stream, "conv long, absent boolean, n_turns long, turns_sha256 string, loss_chars long, "
                                      "loss_sha256 string, formatted_chars long")
    return out.select(F.when(~F.col("absent"), F.col("conv")).alias("conv_id"), *names[2:])
