"""Conversation structure repair: the cheapest edits that give a conversation a legal order of roles.

Windows over a conversation's rows flag faults (blank, duplicate, truncated) and lay the rows in order; the sorted rows
of a conversation are folded by aggregate(), which carries four structs (cost, audit), one for each state of the automaton
of legal orders: nothing yet, after the system's row, after the user's, after the assistant's. Candidates for a state are
compared by native least() expressions on the structs: cheapest first, then the ASCII-least audit.

That the least of the structs may be kept at each row, though audits differ in length: two audits of one state and cost
over the same rows are never one the beginning of the other, as what is longer then has more insertions and costs more. So
what follows can't change their order. For the same reason the fold runs over blocks of BLOCK rows and carries inside of a
block only the rank of the audit before the block and the block's own part: a long conversation isn't copied at each row.

All of it is DataFrame and SQL functions, with one shuffle by conv_id. The audit and the digest are each one value over a
whole conversation, so its rows meet in one task by contract; nothing grows faster than a conversation's text.

Defined results: nulls in role and text are one space; rows of a null conv_id are one conversation; rows of one turn come
by role and text; repeated rows are rows (then duplicates); a conversation without rows left has zeros, an empty audit
and the digest of an empty text; other columns take no part; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows that are folded before audits are put together, and a cost that no conversation has.
BLOCK, NEVER = 256, 1 << 50
#: What counts as white space.
SPACE = " \t\n\x0b\x0c\r"
#: Edits as they are carried: I and J insert a user's and an assistant's row, R and S rerole to them. The report writes I and R.
CARRIED, WRITTEN = "IJRS", "IIRR"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, there: rows with faults by crc32 of ``conv_id:turn``; of a dropped one only its mark stays."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat_ws(":", blank("conv_id"), blank("turn")).cast("binary")), F.lit(20))
    role = F.when(fault == 4, "user").otherwise(blank("role"))
    text = F.when(fault == 1, "").when(fault == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    copies = F.when(fault == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault != 0).alias("there"), F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"))
    return out.drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """damaged rows in order (at) with their initial, first fault, and flags for counting."""
    conversation = Window.partitionBy("conv_id")
    in_order = conversation.orderBy(F.desc("there"), F.asc_nulls_first("turn"), "role", "text")
    last = F.substring(F.rtrim(F.col("text"), F.lit(SPACE)), -1, 1)
    rows = rows.withColumn("at", F.row_number().over(in_order)).withColumn("initial", F.substring("role", 1, 1))
    rows = rows.withColumn("before", F.lag("initial").over(in_order)).withColumn("turn_before", F.lag("turn").over(in_order))
    again = F.row_number().over(Window.partitionBy("conv_id", "there", "role", "text").orderBy("at")) > 1
    fault = F.when(last == "", "blank").when(again, "duplicate").when(~last.isin(".", "!", "?"), "truncated")
    illegal = F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")
    new_turn = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn") != F.col("turn_before")))
    return rows.withColumn("fault", fault).withColumn("illegal", illegal).withColumn("new_turn", new_turn)


STATES = ("none", "system", "user", "assistant")


def _after(s: Column, cost: int | Column, edit: str) -> Column:
    """A candidate: a state's struct with an edit more. All fields between cost and audit go along."""
    keep = [s["origin"].alias("origin")]
    return F.struct((s["cost"] + cost).alias("cost"), *keep, F.concat(s["audit"], F.lit(edit)).alias("audit"))


def _with_inserts(s: dict[str, Column]) -> dict[str, Column]:
    """The states after any rows that are inserted here."""
    return {
        "none": s["none"],
        "system": s["system"],
        "user": F.least(s["user"], *[_after(s[x], INSERT, "I") for x in ("none", "system", "assistant")]),
        "assistant": F.least(s["assistant"], _after(s["user"], INSERT, "J"), *[_after(s[x], 2 * INSERT, "IJ") for x in ("none", "system")]),
    }


def _row(state: Column, row: Column) -> Column:
    s = _with_inserts({x: state[x] for x in STATES})
    extra = F.when(row["fault"] == "truncated", TRUNCATED).otherwise(0)
    never = F.when(F.coalesce(row["fault"].isin("blank", "duplicate"), F.lit(False)), NEVER).otherwise(extra)
    keep = lambda initial: never + F.when(row["initial"] == initial, 0).otherwise(NEVER)
    deleted = {x: _after(s[x], DELETE, "D") for x in STATES}
    to_user = F.least(s["none"], s["system"], s["assistant"])
    return F.struct(
        deleted["none"].alias("none"),
        F.least(deleted["system"], _after(s["none"], keep("s"), "K")).alias("system"),
        F.least(deleted["user"], _after(to_user, keep("u"), "K"), _after(to_user, REROLE + never, "R")).alias("user"),
        F.least(deleted["assistant"], _after(s["user"], keep("a"), "K"), _after(s["user"], REROLE + never, "S")).alias("assistant"),
    )


def _block(state: Column, rows: Column) -> Column:
    """A block's rows, folded with the ranks of the audits before it instead of the audits."""
    known = F.array_sort(F.array(*[state[x]["audit"] for x in STATES]))
    zero = F.struct(*[F.struct(state[x]["cost"].alias("cost"), F.array_position(known, state[x]["audit"]).alias("origin"), F.lit("").alias("audit")).alias(x) for x in STATES])
    whole = lambda x: F.struct(x["cost"].alias("cost"), F.concat(F.element_at(known, x["origin"].cast("int")), x["audit"]).alias("audit"))
    return F.aggregate(rows, zero, _row, lambda out: F.struct(*[whole(out[x]).alias(x) for x in STATES]))


def cheapest(rows: Column) -> Column:
    """struct(cost, audit) of the cheapest edits of an array of sorted rows (initial, fault), the ASCII-least of them."""
    zero = F.struct(*[F.struct(F.lit(0 if x == "none" else NEVER).cast("bigint").alias("cost"), F.lit("").alias("audit")).alias(x) for x in STATES])
    starts = F.when(F.size(rows) > 0, F.sequence(F.lit(1), F.greatest(F.size(rows), F.lit(1)), F.lit(BLOCK))).otherwise(F.array().cast("array<int>"))
    blocks = F.transform(starts, lambda at: F.slice(rows, at, F.lit(BLOCK)))

    def end(state: Column) -> Column:
        s = {x: F.struct(state[x]["cost"].alias("cost"), F.lit(0).cast("bigint").alias("origin"), state[x]["audit"].alias("audit")) for x in STATES}
        best = F.least(s["none"], _with_inserts(s)["assistant"])
        return F.struct(best["cost"].alias("cost"), best["audit"].alias("audit"))

    return F.aggregate(blocks, zero, _block, end)


def repaired_text(rows: Column, audit: Column) -> Column:
    """The repaired conversation's rows, role:text, one a line."""

    def line(edit: Column, row: Column) -> Column:
        return F.when(edit == "I", "user:").when(edit == "J", "assistant:").when(edit == "K", F.concat(row["role"], F.lit(":"), row["text"])).when(edit == "R", F.concat(F.lit("user:"), row["text"])).when(edit == "S", F.concat(F.lit("assistant:"), row["text"]))

    # One token for each row: what is inserted before it, and its own edit.
    tokens = F.regexp_extract_all(audit, F.lit("[IJ]*[DKRS]"), F.lit(0))
    inserted = F.array(F.named_struct(F.lit("role"), F.lit(""), F.lit("text"), F.lit("")))
    pairs = F.zip_with(tokens, F.transform(rows, lambda r: F.struct(r["role"].alias("role"), r["text"].alias("text"))), lambda t, r: F.transform(F.split(t, ""), lambda e: line(e, r)))
    tail = F.transform(F.split(F.regexp_extract(audit, "[IJ]*$", 0), ""), lambda e: line(e, inserted[0]))
    return F.array_join(F.filter(F.concat(F.flatten(pairs), tail), lambda x: x.isNotNull()), "\n")


def repaired(rows: DataFrame) -> DataFrame:
    """Of rows as ``damaged`` gives them: conv_id, gaps, counts of faults, illegal, cost, audit and repaired (text)."""
    there = F.col("there")
    count = lambda condition, name: F.count(F.when(there & condition, 1)).alias(name)
    turn = F.when(there, F.col("turn"))
    row = F.when(there, F.struct("at", "initial", "fault", "role", "text"))
    of = flagged(rows).groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count(F.when(there & F.col("new_turn"), 1)), F.lit(0)).cast("bigint").alias("gaps"),
        *[count(F.col("fault") == x, x) for x in ("blank", "duplicate", "truncated")],
        count(F.col("illegal"), "illegal"),
        F.array_sort(F.collect_list(row)).alias("rows"),
    )
    of = of.withColumn("best", cheapest(F.transform("rows", lambda r: F.struct(r["initial"].alias("initial"), r["fault"].alias("fault")))))
    return of.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.translate("best.audit", CARRIED, WRITTEN).alias("audit"), repaired_text(F.col("rows"), F.col("best.audit")).alias("repaired"))
