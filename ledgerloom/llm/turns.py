"""Conversation structure repair: window functions flag faults, a fold over each conversation's sorted turns finds the cheapest edits. Built-in functions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPACE = r" \t\n\x0B\f\r"
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: What no series of edits costs: the cost of a state that cannot be reached.
_FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    """What an edit costs; keeping a turn is free, and a truncated turn that is not deleted costs ``truncated`` more."""

    rerole: int = 3
    delete: int = 4
    insert: int = 3
    truncated: int = 3


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _plus(state: Column, cost: Column | int, letter: Column | str) -> Column:
    letter = F.lit(letter) if isinstance(letter, str) else letter
    return F.struct((state["cost"] + cost).alias("cost"), F.concat(state["audit"], letter).alias("audit"))


def _states(nothing: Column, system: Column, user: Column, assistant: Column) -> Column:
    """The cheapest edits so far whose output is empty, is one system turn, ends with a user's turn or with an assistant's."""
    return F.struct(nothing.alias("n"), system.alias("s"), user.alias("u"), assistant.alias("a"))


def _inserted(x: Column, costs: Costs) -> Column:
    """The states after turns may have been inserted."""
    user = F.least(x["u"], *[_plus(x[k], costs.insert, "I") for k in "nsa"])
    return _let(user, lambda u: _states(x["n"], x["s"], u, F.least(x["a"], _plus(u, costs.insert, "I"))))


def _edited(x: Column, turn: Column, costs: Costs) -> Column:
    """The states after ``turn`` was kept, given another role or deleted.

    Letters alone decide what edits cost, so that of two different ones of equal cost none begins the other: the least of a state stays the least whatever follows, and
    the least of states can be taken before a letter is added. ``least`` passes over nulls, which stand for edits that are not allowed.
    """
    stays = turn["fault"].isin(0, TRUNCATED)
    extra = F.when(turn["fault"] == TRUNCATED, costs.truncated).otherwise(0)

    def becomes(initial: str, source: Column) -> Column:
        same = turn["initial"] == initial
        return F.when(stays, _plus(source, extra + F.when(same, 0).otherwise(costs.rerole), F.when(same, "K").otherwise("R")))

    def gone(k: str) -> Column:
        return _plus(x[k], costs.delete, "D")

    first = F.when(stays & (turn["initial"] == "s"), _plus(x["n"], extra, "K"))
    user = becomes("u", F.least(x["n"], x["s"], x["a"]))
    return _states(gone("n"), F.least(gone("s"), first), F.least(gone("u"), user), F.least(gone("a"), becomes("a", x["u"])))


def cheapest(turns: Column, costs: Costs = Costs()) -> Column:
    """(cost, audit) of the cheapest edits of an array of turns (with ``initial`` and ``fault``) that give ``(s?(ua)+)?``; of equally cheap audits the least."""

    def state(cost: int) -> Column:
        return F.struct(F.lit(cost).cast("long").alias("cost"), F.lit("").alias("audit"))

    start = _states(state(0), state(_FAR), state(_FAR), state(_FAR))
    return F.aggregate(
        turns, start, lambda x, turn: _let(_inserted(x, costs), lambda y: _edited(y, turn, costs)), lambda x: _let(_inserted(x, costs), lambda y: F.least(y["n"], y["a"]))
    )


def replay(turns: Column, audit: Column) -> Column:
    """The turns (role and text) that the edits of ``audit`` leave: inserted ones have no text, and a place in the output decides between user and assistant."""

    def upto(j: Column, letter: str) -> Column:
        """How many other letters stand in the first ``j``."""
        return F.length(F.replace(F.substring(audit, F.lit(1), j), F.lit(letter), F.lit("")))

    lead = F.length(audit) - F.length(F.ltrim(audit, F.lit("D")))
    system = (F.substring(audit, lead + 1, F.lit(1)) == "K") & (F.get(turns, lead)["initial"] == "s")
    skipped = F.when(system, 1).otherwise(0)

    def line(j: Column) -> Column:
        letter, turn = F.substring(audit, j, F.lit(1)), F.get(turns, upto(j, "I") - 1)
        dealt = F.when((upto(j, "D") - skipped) % 2 == 1, "user").otherwise("assistant")
        return F.when(letter != "D", F.struct(F.when(letter == "K", turn["role"]).otherwise(dealt).alias("role"), F.when(letter == "I", "").otherwise(turn["text"]).alias("text")))

    places = F.when(F.length(audit) > 0, F.sequence(F.lit(1), F.length(audit))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(places, line), lambda x: x.isNotNull())


def repair(rows: DataFrame, costs: Costs = Costs(), id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", live: Column | None = None) -> DataFrame:
    """One row for each conversation: ``id_col``, gaps, blank, duplicate, truncated, illegal, cost, audit and ``repaired`` (array of role and text).

    Turns go by ``turn_col`` (nulls first; ties by role, then text). A null role or text is one space; a null id is an id. The first fault of a turn counts: blank (no word), duplicate (role and text of an
    earlier turn), truncated (not ended by . ! or ?). ``gaps`` are numbers missing between the least and the greatest turn, ``illegal`` counts neighbours whose roles' initials are
    not su, ua or au. Edits are K(eep), R(erole to user or assistant), D(elete, a must for blank and duplicate turns) and I(nsert). Rows that ``live`` turns down have no turn, but their conversation has a row.

    All is dealt out once, by id. A conversation is one array in the end, as its text is one: its turns have to fit a task, and its audit is copied for every turn.
    """
    rows = rows.select(
        F.col(id_col).alias("_c"), F.col(turn_col).cast("long").alias("_t"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"), F.coalesce(F.col(text_col), F.lit(" ")).alias("text"),
        (F.lit(True) if live is None else F.coalesce(live, F.lit(False))).alias("_l"),
    ).repartition("_c")
    seen = Window.partitionBy("_c", "_l", "role", "text").orderBy(F.asc_nulls_first("_t"))
    # Rows equal in all three are told apart by their number among equals, in both windows.
    order = Window.partitionBy("_c", "_l").orderBy(F.asc_nulls_first("_t"), "role", "text", "_s")
    rows = rows.withColumn("_s", F.row_number().over(seen))
    fault = F.when(~F.col("text").rlike(f"[^{SPACE}]"), BLANK).when(F.col("_s") > 1, DUPLICATE).when(~F.col("text").rlike(rf"[.!?][{SPACE}]*\z"), TRUNCATED).otherwise(0)
    rows = rows.withColumn("fault", fault).withColumn("initial", F.substring("role", 1, 1)).withColumn("_n", F.row_number().over(order)).withColumn("_before", F.lag("initial").over(order))
    illegal = F.col("_l") & (F.col("_n") > 1) & ~F.concat("_before", "initial").isin("su", "ua", "au")

    def count(what: Column) -> Column:
        return F.count(F.when(what, 1))

    turn = F.when(F.col("_l"), F.struct("_n", "_t", "initial", "fault", "role", "text"))
    faults = [count(F.col("_l") & (F.col("fault") == k)).alias(c) for k, c in ((BLANK, "blank"), (DUPLICATE, "duplicate"), (TRUNCATED, "truncated"))]
    out = rows.groupBy("_c").agg(F.sort_array(F.collect_list(turn)).alias("_turns"), *faults, count(illegal).alias("illegal"))
    numbers = F.array_distinct(F.filter(F.transform("_turns", lambda r: r["_t"].cast("decimal(20,0)")), lambda t: t.isNotNull()))
    out = out.withColumn("_numbers", numbers).withColumn("_best", cheapest(F.col("_turns"), costs)).withColumn("audit", F.col("_best.audit"))
    gaps = F.coalesce(F.array_max("_numbers") - F.array_min("_numbers") + 1 - F.size("_numbers"), F.lit(0))
    # The numbers of a conversation may lie further apart than a long tells.
    gaps = F.least(gaps, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")
    return out.select(F.col("_c").alias(id_col), gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("_best.cost").alias("cost"), "audit", replay(F.col("_turns"), F.col("audit")).alias("repaired"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``_live``, with faults by the CRC-32 of ``conv_id:turn`` (nulls are one space) modulo 20.

    0 drops the row (``_live`` is false, the row stays), 1 empties its text, 2 takes . ! and ? from it, 3 repeats it, 4 makes it a user's.
    """
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    k = F.crc32(key.cast("binary")) % 20
    text = F.coalesce(F.col("text"), F.lit(" "))
    rows = rows.select(
        "conv_id", "turn", F.when(k == 4, "user").otherwise(F.coalesce(F.col("role"), F.lit(" "))).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"), (k != 0).alias("_live"), F.when(k == 3, 2).otherwise(1).alias("_copies"),
    )
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_copies", "_copy")


def digest(repaired: DataFrame) -> DataFrame:
    """``repaired`` as the SHA-256 of its ``role:text`` lines."""
    lines = F.array_join(F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"])), "\n")
    return repaired.withColumn("repaired_sha256", F.sha2(lines, 256)).drop("repaired")
