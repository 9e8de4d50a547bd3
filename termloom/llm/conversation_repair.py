"""Repair of conversation structure: the cheapest edits that make the roles of a conversation legal.

Legal is nothing at all, or an optional system turn and then pairs of user and
assistant. The grammar of roles is compiled to an LR automaton, and a conversation is
read by a generalised LR parser that repairs as it goes: before every turn, each live
stack may take an inserted turn, and the turn is then kept, given another role, or
deleted, each at its weight. Stacks share their lower parts, and stacks with equal tops
are merged into the cheaper one; of equal costs, the one whose edits come first in
ASCII. An automaton of few states has few sets of live stacks with few cost
differences, so each set and kind of turn is worked out once a task.

A conversation's turns are ordered by turn number, null first, then by role and text,
and read one by one, as the order of edits and the hash of the repaired text demand.
What is kept is a hash for each live stack and a reference for each turn, no texts.
Whether a turn repeats an earlier one is found before, by a shuffle of its own over
(conversation, role, text), so that a conversation of very many turns fills no memory.

Null role and text are one blank each. A conversation without id is one like others. A
role other than system, user and assistant can be changed or deleted, not kept. An empty
table has an empty result. Columns other than those named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.batches import text_slices

# Fixed values.
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
ROLES = {"s": "system", "u": "user", "a": "assistant"}
#: Roles that an edit may give a turn.
GIVEN = "ua"
LEGAL_NEIGHBOURS = {"su", "ua", "au"}
#: The grammar of role initials: C a conversation, P its pairs.
GRAMMAR = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "ua"), ("P", "Pua"))
END = "$"
KEEP, REROLE, DELETE, INSERT = "KRDI"
COSTS = {KEEP: 0, REROLE: 3, DELETE: 4, INSERT: 3}
TRUNCATED_COST = 3

REPORT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint,"
    " illegal bigint, cost bigint, audit string, roles string, repaired_sha256 string"
)
#: Conversations in one batch of the report.
REPORT_ROWS = 1000

#: A stack: its top state and the stack below, which other stacks may share.
Stack = tuple[int, "Stack | None"]


class Automaton:
    """LR states of a grammar whose terminals are lower-case letters."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR):
        self.rules = (("", grammar[0][0]), *grammar)
        self.states: list[frozenset[tuple[int, int]]] = [self._closure({(0, 0)})]
        self.steps: dict[tuple[int, str], int] = {}
        for number, state in enumerate(self.states):  # grows as it is read
            for symbol in sorted({self._next(item) for item in state} - {""}):
                moved = {(rule, at + 1) for rule, at in state if self._next((rule, at)) == symbol}
                target = self._closure(moved)
                if target not in self.states:
                    self.states.append(target)
                self.steps[number, symbol] = self.states.index(target)
        self.follow = self._follow()
        self.push = lru_cache(None)(self._push)

    def _next(self, item: tuple[int, int]) -> str:
        rule, at = item
        return self.rules[rule][1][at : at + 1]

    def _closure(self, items: set[tuple[int, int]]) -> frozenset[tuple[int, int]]:
        found = set(items)
        while True:
            wanted = {self._next(item) for item in found}
            more = {(i, 0) for i, (left, _) in enumerate(self.rules) if left and left in wanted}
            if more <= found:
                return frozenset(found)
            found |= more

    def _first(self, symbol: str, seen: frozenset[str] = frozenset()) -> set[str]:
        """Terminals that `symbol` may begin with. Only whole conversations may be empty."""
        if not symbol.isupper():
            return {symbol}
        rights = [r for left, r in self.rules if left == symbol and r and r[0] not in seen | {symbol}]
        return set().union(*(self._first(r[0], seen | {symbol}) for r in rights))

    def _follow(self) -> dict[str, set[str]]:
        follow = {left: set() for left, _ in self.rules}
        follow[self.rules[0][1]] = {END}
        for _ in self.rules:  # as often as a chain of rules can be long
            for left, right in self.rules:
                for symbol, after in zip(right, [*right[1:], ""]):
                    if symbol.isupper():
                        follow[symbol] |= self._first(after) if after else follow[left]
        return follow

    @property
    def start(self) -> Stack:
        return (0, None)

    def _push(self, stack: Stack, symbol: str) -> tuple[Stack, ...]:
        """The stacks after `symbol`, reduced as far as it asks for; at the end, those that accept."""
        found, waiting = [], [stack]
        while waiting:
            stack = waiting.pop()
            if symbol == END and (0, 1) in self.states[stack[0]]:
                found.append(stack)
            elif (stack[0], symbol) in self.steps:
                found.append((self.steps[stack[0], symbol], stack))
            for rule, at in sorted(self.states[stack[0]]):
                left, right = self.rules[rule]
                if rule and at == len(right) and symbol in self.follow[left]:
                    below = stack
                    for _ in right:
                        below = below[1]
                    waiting.append((self.steps[below[0], left], below))
        return tuple(found)


@dataclass(frozen=True)
class Move:
    """How a live stack came from one before: that one's place, the edits and their roles."""

    origin: int
    edits: str
    roles: str


#: Live stacks in the order of their edits, each with its cost above the cheapest.
Live = tuple[tuple[Stack, int], ...]


class Repairer:
    """Steps of the repairing parser, each worked out once."""

    def __init__(self, automaton: Automaton | None = None):
        self.automaton = automaton or Automaton()
        self.step = lru_cache(None)(self._step)
        self.finish = lru_cache(None)(self._finish)

    @property
    def start(self) -> Live:
        return ((self.automaton.start, 0),)

    def _inserted(self, stack: Stack) -> Iterator[tuple[Stack, str]]:
        """Stacks after inserting turns, with their roles. A top met before gains nothing."""
        waiting, tops = [(stack, "")], {stack[0]}
        while waiting:
            stack, roles = waiting.pop(0)
            yield stack, roles
            for role in GIVEN:
                for after in self.automaton.push(stack, role):
                    if after[0] not in tops:
                        tops.add(after[0])
                        waiting.append((after, roles + role))

    def _step(self, live: Live, initial: str, doomed: bool, truncated: bool) -> tuple[Live, int, tuple[Move, ...]]:
        """(live stacks, cost added to all, their moves) after a turn.

        A turn whose role has no `initial` of the grammar cannot be kept, a `doomed`
        one only be deleted.
        """
        best: dict[int, tuple] = {}

        def consider(stack: Stack, cost: int, origin: int, edits: str, roles: str) -> None:
            # Live stacks differ in their edits before this turn, and both took as many
            # turns, so none is a beginning of another: their order decides first.
            mine = (cost, origin, edits)
            if stack[0] not in best or mine < best[stack[0]][:3]:
                best[stack[0]] = (*mine, roles, stack)

        for origin, (before, paid) in enumerate(live):
            for stack, roles in self._inserted(before):
                edits = INSERT * len(roles)
                cost = paid + COSTS[INSERT] * len(roles)
                consider(stack, cost + COSTS[DELETE], origin, edits + DELETE, roles + "-")
                if doomed:
                    continue
                cost += TRUNCATED_COST * truncated
                for after in self.automaton.push(stack, initial) if initial in ROLES else ():
                    consider(after, cost + COSTS[KEEP], origin, edits + KEEP, roles + initial)
                for role in GIVEN:
                    for after in self.automaton.push(stack, role):
                        consider(after, cost + COSTS[REROLE], origin, edits + REROLE, roles + role)
        ordered = sorted(best.values(), key=lambda found: found[1:3])
        least = min(cost for cost, *_ in ordered)
        return (
            tuple((stack, cost - least) for cost, _, _, _, stack in ordered),
            least,
            tuple(Move(origin, edits, roles) for _, origin, edits, roles, _ in ordered),
        )

    def _finish(self, live: Live) -> tuple[int, Move]:
        """(cost added, move) of the cheapest way to end."""
        ends = [
            (cost + COSTS[INSERT] * len(roles), origin, INSERT * len(roles), roles)
            for origin, (before, cost) in enumerate(live)
            for stack, roles in self._inserted(before)
            if self.automaton.push(stack, END)
        ]
        cost, origin, edits, roles = min(ends)
        return cost, Move(origin, edits, roles)


@dataclass
class Conversation:
    """One conversation as far as it has been read."""

    repairer: Repairer
    conv_id: int | None
    live: Live = ()
    cost: int = 0
    moves: list[tuple[Move, ...]] = field(default_factory=list)
    hashes: list = field(default_factory=list)
    counts: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("blank", "duplicate", "truncated"), 0))
    illegal: int = 0
    turns: int = 0
    first_turn: int | None = None
    last_turn: int | None = None
    last_initial: str | None = None

    def __post_init__(self):
        self.live, self.hashes = self.repairer.start, [hashlib.sha256()]

    def read(self, turn: int | None, role: str, text: str, repeated: bool) -> None:
        initial = role[:1]
        if self.last_initial is not None and self.last_initial + initial not in LEGAL_NEIGHBOURS:
            self.illegal += 1
        self.last_initial = initial
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        end = text.rstrip(BLANKS)[-1:]
        fault = (
            "blank" if not end
            else "duplicate" if repeated
            else "truncated" if end not in SENTENCE_ENDS
            else None
        )
        if fault:
            self.counts[fault] += 1
        doomed = fault in ("blank", "duplicate")
        before = self.live
        self.live, cost, moves = self.repairer.step(before, initial, doomed, fault == "truncated")
        self.cost += cost
        self.moves.append(moves)
        said = f":{text}".encode()
        self.hashes = [self._hashed(before, move, role.encode(), said) for move in moves]

    def _hashed(self, before: Live, move: Move, own: bytes = b"", said: bytes = b""):
        """The hash of the turns repaired so far, after a move."""
        digest = self.hashes[move.origin].copy()
        begun = before[move.origin][0] != self.repairer.automaton.start
        for edit, role in zip(move.edits, move.roles):
            if edit != DELETE:
                name = own if edit == KEEP else ROLES[role].encode()
                digest.update((b"\n" if begun else b"") + name + (b":" if edit == INSERT else said))
                begun = True
        return digest

    def report(self) -> tuple:
        cost, last = self.repairer.finish(self.live)
        path, at = [last], last.origin
        for moves in reversed(self.moves):
            path.append(moves[at])
            at = moves[at].origin
        path.reverse()
        gaps = self.last_turn - self.first_turn + 1 - self.turns if self.turns else 0
        return (
            self.conv_id,
            gaps,
            *self.counts.values(),
            self.illegal,
            self.cost + cost,
            "".join(move.edits for move in path),
            "".join(move.roles for move in path),
            self._hashed(self.live, last).hexdigest(),
        )


def _ordered(turns: DataFrame, present: Column) -> DataFrame:
    return turns.select(
        F.col("conv_id").cast("bigint"),
        F.col("turn").cast("bigint"),
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
        present.alias("present"),
    )


#: Ascending, null first.
ORDER = ("turn", "role", "text")


def report(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """One row for each conversation of `turns` (conv_id, turn, role, text).

    `gaps`, `blank`, `duplicate`, `truncated`, `illegal` count faults; a turn has one of
    the middle three at most, the first that holds. `cost` and `audit` are the cheapest
    edits in order: K, R, D, I for keep, rerole, delete, insert. `roles` has the initial
    each edit leaves, `-` for none. `repaired_sha256` is of the repaired conversation as
    lines `role:text`. Rows that are not `present` only name their conversation.
    """
    names = [column.split()[0] for column in REPORT.split(", ")]
    kinds = [pa.int64()] * 7 + [pa.string()] * 3

    def read(batches):
        repairer = Repairer()
        done: list[tuple] = []
        conversation = None

        def batch_of() -> pa.RecordBatch:
            arrays = [pa.array(column, kind) for column, kind in zip(zip(*done), kinds)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            for part in text_slices(batch, "text"):
                rows = zip(*(part.column(name).to_pylist() for name in part.schema.names))
                for conv_id, turn, role, text, here, repeated in rows:
                    if conversation is None or conversation.conv_id != conv_id:
                        if conversation is not None:
                            done.append(conversation.report())
                        if len(done) >= REPORT_ROWS:
                            yield batch_of()
                        conversation = Conversation(repairer, conv_id)
                    if here:
                        conversation.read(turn, role, text, repeated)
        if conversation is not None:
            done.append(conversation.report())
        if done:
            yield batch_of()

    rows = _ordered(turns, F.lit(True) if present is None else present)
    same = Window.partitionBy("conv_id", "role", "text", "present").orderBy("turn")
    flagged = rows.withColumn("repeated", F.row_number().over(same) > 1)
    gathered = flagged.repartition("conv_id").sortWithinPartitions("conv_id", *ORDER)
    return gathered.mapInArrow(read, REPORT)


def repaired_turns(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, turn, role, text): the repaired turns of `turns`, by their report.

    `place` counts the edits of a conversation from 0, the deleting ones too, which
    leave no row. Inserted turns have no turn number and an empty text. Pass a written
    report: its edits meet the turns by (conversation, place among its turns).
    """
    letters = F.split("audit", "")
    edits = found.where("audit <> ''").select(
        F.col("conv_id").alias("of"), "roles", F.posexplode(letters).alias("place", "edit")
    )
    by_place = Window.partitionBy("of").orderBy("place")
    edits = edits.withColumn(
        "nth", F.when(F.col("edit") != INSERT, F.sum((F.col("edit") != INSERT).cast("int")).over(by_place))
    ).withColumn("initial", F.substr("roles", F.col("place") + 1, F.lit(1)))
    in_order = Window.partitionBy("conv_id").orderBy(*ORDER)
    numbered = _ordered(turns, F.lit(True)).withColumn("own", F.row_number().over(in_order))
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    met = edits.join(
        numbered, edits["of"].eqNullSafe(numbered["conv_id"]) & (F.col("nth") == F.col("own")), "left"
    )
    return met.where(F.col("edit") != DELETE).select(
        F.col("of").alias("conv_id"),
        "place",
        "edit",
        "turn",
        F.when(F.col("edit") == KEEP, F.col("role")).otherwise(names[F.col("initial")]).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
