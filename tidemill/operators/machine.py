"""The state machine of tasks over their events, however many events one task has.

An event asks for a state; it is granted where the table of legal steps allows it from the state that the task is in, else the
event is rejected and the state stays. What a run of events does to a task is thus a map from states to states, with the number
of rejections for each state to begin with, and maps of successive runs compose. So no task's events are sorted in one
window: events lie in ranges of (task, order), runs of 64 events give a map each, 64 maps give one, and so on up to
the task's whole map. Going down again, the state before each run gives the states before its parts, down to the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.cluster import forget, in_ranges, stored

# The states of a task and the steps between them. A final state may be told twice, and a task be started again.
START = "ready"
LEGAL = {
    "ready": ("searching", "stopped", "error"),
    "searching": ("searching", "downloading", "success", "stopped", "error"),
    "downloading": ("downloading", "success", "stopped", "error"),
    "success": ("success", "searching"),
    "stopped": ("stopped", "searching"),
    "error": ("error", "searching"),
}
#: Events of a range, and how many children a node has, as bits.
RANGE_ROWS, BITS = 200_000, 6


class Machine:
    """States by number, and maps of runs as Spark expressions."""

    def __init__(self, legal: dict[str, tuple[str, ...]] = LEGAL, start: str = START):
        self.states = sorted({*legal, *(t for to in legal.values() for t in to), start})
        self.legal, self.start = legal, self.states.index(start)

    def number(self, status: Column) -> Column:
        """The state's number; an unknown or null state is -1, which no step leads to."""
        found = F.try_element_at(F.create_map(*(F.lit(x) for i, s in enumerate(self.states) for x in (s, i))), status)
        return F.coalesce(found, F.lit(-1))

    def name(self, number: Column) -> Column:
        return F.array(*map(F.lit, self.states))[number]

    def step(self, state: Column, asked: Column) -> Column:
        """The state behind an event; equal to ``state`` where the step is not legal or stays."""
        return F.when(self.allowed(state, asked), asked).otherwise(state)

    def allowed(self, state: Column, asked: Column) -> Column:
        n = len(self.states)
        table = F.array(*(F.lit(t in self.legal.get(s, ())) for s in self.states for t in self.states))
        return (asked >= 0) & table[state * n + F.greatest(asked, F.lit(0))]

    def single(self, asked: Column) -> Column:
        """The map of one event: for each state the next one and whether the event is rejected."""
        return F.struct(
            F.array(*(self.step(F.lit(i), asked) for i in range(len(self.states)))).alias("to"),
            F.array(*(F.when(self.allowed(F.lit(i), asked), 0).otherwise(1).cast("long") for i in range(len(self.states)))).alias("bad"),
        )

    def composed(self, maps: Column) -> Column:
        """The map of successive maps."""
        n = len(self.states)
        nothing = F.struct(F.array(*map(F.lit, range(n))).alias("to"), F.array(*(F.lit(0).cast("long") for _ in range(n))).alias("bad"))
        return F.aggregate(maps, nothing, lambda a, m: F.struct(F.transform(a["to"], lambda s: m["to"][s]).alias("to"), F.zip_with(a["bad"], a["to"], lambda b, s: b + m["bad"][s]).alias("bad")))


class Runs:
    """The events of ``rows`` in runs, and the maps of all runs of runs."""

    def __init__(self, rows: DataFrame, by: str, order: list[str], status: str, machine: Machine, range_rows: int):
        self.by, self.machine = by, machine
        ranges, n = in_ranges(rows, [F.col(by), *map(F.col, order)], range_rows, "machine", "slice_")
        inside = ranges.withColumn("i_", F.row_number().over(Window.partitionBy(by, "slice_").orderBy(*order)) - 1)
        asked = stored(inside.withColumn("asked_", machine.number(F.col(status))), "machine-events")
        forget(ranges)
        # Places of events: the range, then the place inside, in as many digits as the largest range needs.
        longest = asked.agg(F.max("i_")).first()[0] or 0
        digits = max(1, -(-max(1, longest.bit_length()) // BITS))
        self.levels = digits + -(-max(0, (n - 1).bit_length()) // BITS)
        self.events = asked.withColumn("p_", F.shiftleft("slice_", digits * BITS) + F.col("i_"))
        # tree[k]: the children of each node of level k + 1, in order.
        self.tree, below = [], self.events.select(by, "p_", machine.single(F.col("asked_")).alias("m_"))
        self.stored = [asked]
        for _ in range(self.levels):
            nodes = below.groupBy(by, F.shiftright("p_", BITS).alias("node_")).agg(F.array_sort(F.collect_list(F.struct("p_", "m_"))).alias("c_"))  # 64 at most
            nodes = stored(nodes, "machine-level")
            self.stored.append(nodes)
            self.tree.append(nodes)
            below = nodes.select(by, F.col("node_").alias("p_"), machine.composed(F.col("c_.m_")).alias("m_"))
        self.top = below

    def before(self) -> DataFrame:
        """(by, p_, before_): the state's number before each event."""
        m = self.machine
        known = self.top.select(self.by, F.col("p_").alias("node_"), F.lit(m.start).alias("before_"))
        for nodes in reversed(self.tree):
            # The states before all children: one scan over at most 64 of them.
            states = F.aggregate("c_", F.array("before_"), lambda a, c: F.concat(a, F.array(c["m_"]["to"][F.element_at(a, -1)])))
            children = nodes.join(known, [self.by, "node_"]).select(self.by, F.explode(F.arrays_zip(F.col("c_.p_").alias("p_"), F.slice(states, 1, F.size("c_")).alias("before_"))).alias("c_"))
            known = children.select(self.by, F.col("c_.p_").alias("node_"), F.col("c_.before_").alias("before_"))
        return known.withColumnRenamed("node_", "p_")


def final_states(rows: DataFrame, by: str, order: list[str], status: str, legal: dict[str, tuple[str, ...]] = LEGAL, start: str = START, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(by, state, n_rejected): of each task the state after all its events and how many of them were rejected.

    Events go in the order of ``order``; rows that are equal in it go by the state that they ask for. A null or unknown state is rejected.
    """
    machine = Machine(legal, start)
    top = Runs(rows, by, _total(rows, order, status), status, machine, range_rows).top
    return top.select(by, machine.name(F.col("m_.to")[machine.start]).alias("state"), F.col("m_.bad")[machine.start].alias("n_rejected"))


def transitions(rows: DataFrame, by: str, order: list[str], status: str, legal: dict[str, tuple[str, ...]] = LEGAL, start: str = START, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All events with the state ``before`` and ``after`` them and whether they are ``rejected``."""
    machine = Machine(legal, start)
    runs = Runs(rows, by, _total(rows, order, status), status, machine, range_rows)
    both = runs.events.join(runs.before(), [by, "p_"])
    state, asked = F.col("before_"), F.col("asked_")
    return both.select(*rows.columns, machine.name(state).alias("before"), machine.name(machine.step(state, asked)).alias("after"), (~machine.allowed(state, asked)).alias("rejected"))


def _total(rows: DataFrame, order: list[str], status: str) -> list[str]:
    return [*order, *([status] if status not in order else [])]
