"""Conversation structure repair: fault flags by windows, and a fold over sorted turns that keeps the cheapest repair.

Roles have to alternate, `(s?(ua)+)?` by their initials: nothing, or an opening system turn if any, then user and
assistant in turns. A fold reads a conversation's turns once and carries, for each of the four states (nothing so far,
after s, after u, after a), the cheapest (cost, audit) that ends there. Only the flags take part in it: texts join the
edits afterwards. Long conversations are folded in blocks of CHUNK turns, each from every state that can be entered with,
so that no audit is copied more often than there are blocks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Characters of blank texts.
SPACE = " \t\n\x0b\f\r"
#: Costs of the edits; TRUNCATED comes on top for a turn that stays although its text breaks off.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: A cost that no repair reaches.
UNREACHED = 1 << 50
CHUNK = 512


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value) with value computed once: expressions within lambdas are otherwise computed at each use."""
    return F.transform(F.array(value), then)[0]


def _way(cost: Column, audit: Column, plan: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), plan.alias("plan"))


def _edit(way: Column, cost: int | Column, letter: str | Column, code: str | Column | None = None) -> Column:
    """A way with one more edit: its letter in the audit, and in the plan its letter with the role (U, A inserted, u, a reroled)."""
    of = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _way(way["cost"] + of(cost), F.concat(way["audit"], of(letter)), F.concat(way["plan"], of(letter if code is None else code)))


def _unit(state: Column) -> Column:
    """Four ways without edits of which only the given state's is possible."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: _way(F.when(j == state, F.lit(0)).otherwise(F.lit(UNREACHED)), F.lit(""), F.lit("")))


def _inserted(ways: Column) -> Column:
    """The ways after any useful inserts: at most two turns, as more lead back to where they began."""
    after_u = F.least(ways[2], _edit(F.least(ways[0], ways[1], ways[3]), INSERT, "I", "U"))
    return let(after_u, lambda u: F.array(ways[0], ways[1], u, F.least(ways[3], _edit(u, INSERT, "I", "A"))))


def _step(ways: Column, turn: Column) -> Column:
    """The ways after one more turn: deleted, or kept or reroled where its role fits. Ties go to the least audit; equal
    costs at one turn never leave an audit that begins another, so the least prefix stays the least."""
    stays = F.when(turn["fault"] == "truncated", F.lit(TRUNCATED)).otherwise(F.lit(0))
    never = F.when(turn["fault"].isin("blank", "duplicate"), F.lit(UNREACHED)).otherwise(F.lit(0))

    def takes(way: Column, initial: str) -> Column:
        own = turn["initial"] == initial
        return _edit(way, F.when(own, F.lit(0)).otherwise(F.lit(REROLE)) + stays + never, F.when(own, F.lit("K")).otherwise(F.lit("R")), F.when(own, F.lit("K")).otherwise(F.lit(initial)))

    def after(w: Column) -> Column:
        gone = [_edit(w[j], DELETE, "D") for j in range(4)]
        opens = _edit(w[0], F.when(turn["initial"] == "s", F.lit(0)).otherwise(F.lit(UNREACHED)) + stays + never, "K")
        return F.array(gone[0], F.least(gone[1], opens), F.least(gone[2], takes(F.least(w[0], w[1], w[3]), "u")), F.least(gone[3], takes(w[2], "a")))

    return let(_inserted(ways), after)


def _block(ways: Column, turns: Column) -> Column:
    """The ways after a block of turns, which is folded on its own from each state that ways can be in."""
    joined = lambda a, b: _way(a["cost"] + b["cost"], F.concat(a["audit"], b["audit"]), F.concat(a["plan"], b["plan"]))
    onwards = lambda a, i: F.when(a["cost"] < UNREACHED, F.transform(F.aggregate(turns, _unit(i), _step), lambda b: joined(a, b)))
    each = F.filter(F.transform(ways, onwards), lambda x: x.isNotNull())
    return let(each, lambda e: F.transform(F.sequence(F.lit(0), F.lit(3)), lambda j: F.array_min(F.transform(e, lambda x: F.get(x, j)))))


def damage(turns: DataFrame) -> DataFrame:
    """turns(conv_id, turn, role, text) with faults put in by crc32(`conv_id:turn`) % 20, and whether a row is left
    (present): 0 drops it, 1 empties its text, 2 takes out `.`, `!` and `?`, 3 repeats it, 4 makes it the user's.

    A null role or text is one space, and so are a null conv_id and turn in the checksum. Other columns go.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), F.pmod(F.crc32(F.concat(spaced("conv_id"), F.lit(":"), spaced("turn")).cast("binary")), F.lit(20)).alias("c"))
    text = F.when(F.col("c") == 1, F.lit("")).when(F.col("c") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("c") == 0, F.array(F.lit(False))).when(F.col("c") == 3, F.array(F.lit(True), F.lit(True))).otherwise(F.array(F.lit(True)))
    return rows.select("conv_id", "turn", F.when(F.col("c") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("present"))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """One row per conv_id of turns(conv_id, turn, role, text) with the cheapest edits that make its roles alternate:
    conv_id, turns (long, how many it has), gaps, blank, duplicate, truncated, illegal, cost (long), audit (the edits'
    initials: Keep, Rerole, Delete, Insert) and repaired (its `role:text` lines).

    Turns are taken by turn, nulls first; rows of one turn by role, then text. A turn's first fault counts: blank, a
    duplicate (role and text seen earlier), truncated (its last character that isn't space is none of `.!?`). Blank turns and
    duplicates have to go; a truncated turn that stays costs TRUNCATED more. Edits of equal cost: the least audit. gaps are
    the turn numbers missing between the first and the last; illegal counts neighbours whose roles don't begin with s u,
    u a or a u. A null role or text is one space. Null conv_ids are one conversation. Where there is a column present, rows
    with false in it are no turns, but their conversation has a row all the same: zeros and empty texts if it has no other.
    Repeated rows are turns of their own (and duplicates). Other columns are ignored; an empty table gives no rows.

    One shuffle by conv_id carries all steps. A conversation is an array in one row, as its repaired text is one value
    (of at most 2 GB); blank turns and duplicates leave their texts behind before they get there.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    present = F.coalesce(F.col("present"), F.lit(True)) if "present" in turns.columns else F.lit(True)
    rows = turns.select("conv_id", "turn", spaced("role"), spaced("text"), present.alias("present")).repartition("conv_id")
    own = Window.partitionBy("conv_id", "present")
    ordered = own.orderBy(F.asc_nulls_first("turn"), "role", "text")
    initial = F.substring("role", 1, 1)
    rows = rows.withColumns({"at": F.row_number().over(ordered), "initial": initial, "before": F.lag(initial).over(ordered), "turn_before": F.lag("turn").over(ordered)})
    rows = rows.withColumn("nth", F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy("at")))
    told = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(told == "", F.lit("blank")).when(F.col("nth") > 1, F.lit("duplicate")).when(~F.substring(told, -1, 1).isin(".", "!", "?"), F.lit("truncated")).otherwise(F.lit(""))
    rows = rows.withColumn("fault", fault)
    gone = F.col("fault").isin("blank", "duplicate")
    turn = F.struct("at", "initial", "fault", F.when(~gone, F.col("role")).alias("role"), F.when(~gone, F.col("text")).alias("text"))
    count = lambda c: F.count(F.when(F.col("present") & c, F.lit(1)))
    wide = lambda c: c.cast("decimal(38,0)")
    number = F.when(F.col("present"), F.col("turn").cast("long"))
    distinct = F.col("turn").isNotNull() & (F.col("turn_before").isNull() | (F.col("turn_before") != F.col("turn")))
    out = rows.groupBy("conv_id").agg(
        count(F.lit(True)).alias("turns"),
        F.when(F.max(number).isNull(), F.lit(0)).otherwise(F.least(wide(F.max(number)) - wide(F.min(number)) + 1 - count(distinct), wide(F.lit((1 << 63) - 1)))).cast("long").alias("gaps"),
        *[count(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au")).alias("illegal"),
        F.sort_array(F.collect_list(F.when(F.col("present"), turn))).alias("list"),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.size("list") - 1, F.lit(0)), F.lit(CHUNK)), lambda k: F.slice("list", k + 1, F.lit(CHUNK)))
    ends = F.aggregate(blocks, _unit(F.lit(0)), _block)
    best = let(let(ends, _inserted), lambda w: F.least(w[0], w[3]))
    out = out.select("*", F.explode(F.array(best)).alias("best"))  # a generator: it is computed once
    codes = F.regexp_extract_all(F.col("best.plan"), F.lit("([UA]*[DKua])"), F.lit(1))
    inserts = lambda code: F.replace(F.replace(code, F.lit("U"), F.lit("user:\n")), F.lit("A"), F.lit("assistant:\n"))

    def lines(turn: Column, code: Column) -> Column:
        edit = F.substring(code, -1, 1)
        role = F.when(edit == "K", turn["role"]).when(edit == "u", F.lit("user")).when(edit == "a", F.lit("assistant"))
        return F.concat(inserts(F.regexp_extract(code, "^[UA]*", 0)), F.coalesce(F.concat(role, F.lit(":"), turn["text"], F.lit("\n")), F.lit("")))

    text = F.concat(F.array_join(F.zip_with("list", codes, lines), ""), inserts(F.regexp_extract(F.col("best.plan"), "[UA]*$", 0)))
    repaired = F.expr("substring(text, 1, length(text) - 1)")
    return out.withColumn("text", text).select("conv_id", "turns", "gaps", "blank", "duplicate", "truncated", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"), repaired.alias("repaired"))
