"""Conversation structure repair: the cheapest edits that give every conversation the roles ``(s?(ua)+)?``.

**Faults.** Rows are taken by turn (nulls first), then role and text; nulls in role and text are one space. The first fault
of a row counts: ``blank`` (nothing but white space), ``duplicate`` (role and text seen earlier in the conversation),
``truncated`` (the last character before trailing white space is none of ``.!?``).

**Edits.** Keep costs 0, Rerole to user or assistant 2, Delete 3 (blank and duplicate rows have to go), Insert of an
empty text of user or assistant 2; a truncated row that stays adds 1. A kept row counts by the first letter of its role, a
row whose role is empty has none and cannot be kept. The audit is the initials of the cheapest edits in order, of equally
cheap ones the least in ASCII order.

**Persistent audits.** A dynamic program goes through the rows with four states: nothing yet, a system row, a user row
last, an assistant row last. Each holds its best audit as a node of a tree, so audits share their prefixes; a node knows
its depth, a rolling hash of its audit and its ancestors at distances of powers of two. Equally cheap audits are
compared by their longest common prefix, found by lifting both nodes while hashes differ; prefixes whose hashes agree are
then compared letter by letter up to the node they share. Two audits of one state with one cost are never a proper prefix of one another, since
the longer one has only inserts more, which cost; so the lesser one stays the lesser whatever follows.

**On Spark.** One shuffle by conversation, sorted within the partitions; each task reads its conversations as a stream. What all live audits
share is settled: its rows leave the task's memory, so a conversation of any length is held only as far as it is
undecided, beside its audit, one letter a row. States that can no longer win (dearer than another state plus the cost of getting the same end
from there) are given up, as otherwise deleting everything would stay undecided for ever. A conversation passes through
one task, since its digest is one sequential hash. Conversations without an id are one conversation. Repeated rows are
duplicates, rows of the same turn are no fault. An empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from casemill.llm.common import SPACES, quoted

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: State after a role that is allowed next, and the role that edits can put next.
FOLLOWS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}
LEGAL = {"su", "ua", "au"}
#: Rows and characters after which settled edits are looked for.
SETTLE_ROWS, SETTLE_CHARS = 256, 4_000_000
_BASE, _PRIME = 1_000_003, (1 << 61) - 1
_LONG = 2**63 - 1


class Audits:
    """Audits as nodes of a tree; node 0 is the empty one."""

    def __init__(self):
        self.up: list[list[int]] = [[]]  # ancestors 1, 2, 4, ... steps above
        self.letter, self.depth, self.hash = [""], [0], [0]

    def add(self, node: int, letter: str) -> int:
        ups, at, k = [node], node, 0
        while k < len(self.up[at]):
            at = self.up[at][k]
            ups.append(at)
            k += 1
        self.up.append(ups)
        self.letter.append(letter)
        self.depth.append(self.depth[node] + 1)
        self.hash.append((self.hash[node] * _BASE + ord(letter)) % _PRIME)
        return len(self.letter) - 1

    def lifted(self, node: int, steps: int) -> int:
        k = 0
        while steps:
            if steps & 1:
                node = self.up[node][k]
            steps >>= 1
            k += 1
        return node

    def _verified(self, x: int, y: int) -> tuple[int, int] | None:
        """The first nodes that differ on the ways to two nodes of the same depth; None if there are none."""
        found = None
        while x != y:
            if self.letter[x] != self.letter[y]:
                found = (x, y)
            x, y = self.up[x][0], self.up[y][0]
        return found

    def less(self, x: int, y: int) -> bool:
        """Whether the audit of ``x`` is before that of ``y``; a proper prefix comes first."""
        size = min(self.depth[x], self.depth[y])
        a, b = self.lifted(x, self.depth[x] - size), self.lifted(y, self.depth[y] - size)
        differ = None
        if self.hash[a] != self.hash[b]:
            k = len(self.up[a]) - 1
            while k >= 0:
                # The hash of the parents agrees in the end; longer steps end above the first difference.
                if k < len(self.up[a]) and self.hash[self.up[a][k]] != self.hash[self.up[b][k]]:
                    a, b = self.up[a][k], self.up[b][k]
                else:
                    k -= 1
            differ, a, b = (a, b), self.up[a][0], self.up[b][0]
        differ = self._verified(a, b) or differ
        if differ is None:
            return self.depth[x] < self.depth[y]
        return self.letter[differ[0]] < self.letter[differ[1]]

    def shared(self, nodes: list[int]) -> int:
        """The deepest node above or at all of the nodes."""
        first, *others = nodes
        for other in others:
            size = min(self.depth[first], self.depth[other])
            a, b = self.lifted(first, self.depth[first] - size), self.lifted(other, self.depth[other] - size)
            for k in range(len(self.up[a]) - 1, -1, -1):
                if k < len(self.up[a]) and self.up[a][k] != self.up[b][k]:
                    a, b = self.up[a][k], self.up[b][k]
            first = a if a == b else self.up[a][0]
        return first

    def spelled(self, node: int, above: int = 0) -> str:
        out = []
        while node != above:
            out.append(self.letter[node])
            node = self.up[node][0]
        return "".join(out[::-1])

    def rooted(self, root: int, nodes: list[int]) -> tuple[Audits, list[int]]:
        """The part of the tree between ``root`` and the nodes, as a tree of its own, and the nodes in it."""
        needed = set()
        for node in nodes:
            while node != root and node not in needed:
                needed.add(node)
                node = self.up[node][0]
        tree, new = Audits(), {root: 0}
        for node in sorted(needed):  # parents come before their children
            new[node] = tree.add(new[self.up[node][0]], self.letter[node])
        return tree, [new[n] for n in nodes]


class Repair:
    """The cheapest audit of rows that arrive one by one. ``put(edit, role, text)`` gets each settled row and insert; a
    deleted row has the role it had."""

    def __init__(self, put):
        self.put, self.tree = put, Audits()
        self.best = {START: (0, 0)}  # state: (cost, node)
        self.waiting, self.chars, self.at = [], 0, START
        self.audit: list[str] = []
        self._insert()

    def _offer(self, best: dict, state: int, cost: int, node: int, letter: str) -> None:
        old = best.get(state)
        if old is None or cost <= old[0]:
            new = self.tree.add(node, letter)
            if old is None or cost < old[0] or self.tree.less(new, old[1]):
                best[state] = (cost, new)

    def _insert(self) -> None:
        """Inserts from the cheapest state on: each costs, so a state is final when its turn comes."""
        done = set()
        while len(done) < len(self.best):
            state = min((s for s in self.best if s not in done), key=lambda s: (self.best[s][0], s))
            cost, node = self.best[state]
            done.add(state)
            if (after := NEXT[state][1]) not in done:
                self._offer(self.best, after, cost + INSERT_COST, node, INSERT)

    def row(self, role: str, text: str, deleted: bool, truncated: bool) -> None:
        new: dict[int, tuple[int, int]] = {}
        for state, (cost, node) in self.best.items():
            self._offer(new, state, cost + DELETE_COST, node, DELETE)
            if not deleted:
                cost += TRUNCATED_COST * truncated
                if (after := FOLLOWS.get((state, role[:1]))) is not None:
                    self._offer(new, after, cost, node, KEEP)
                self._offer(new, NEXT[state][1], cost + REROLE_COST, node, REROLE)
        self.best = new
        self._insert()
        # From an assistant row the same edits lead on, but for a system row that may have to go.
        ahead = min(self.best[ASSISTANT][0], self.best[USER][0] + INSERT_COST)
        for state, more in ((START, DELETE_COST), (SYSTEM, 0)):
            if state in self.best and self.best[state][0] > ahead + more:
                del self.best[state]
        self.waiting.append((role, text))
        self.chars += len(text)
        if len(self.waiting) % SETTLE_ROWS == 0 or self.chars > SETTLE_CHARS:
            self._settle([n for _, n in self.best.values()])

    def _settle(self, live: list[int]) -> None:
        root = self.tree.shared(live)
        edits = self.tree.spelled(root)
        taken = 0
        for edit in edits:
            role, text = ("", "") if edit == INSERT else self.waiting[taken]
            taken += edit != INSERT
            if edit == KEEP:
                self.at = FOLLOWS[self.at, role[:1]]
            elif edit != DELETE:
                role, self.at = NEXT[self.at]
            self.put(edit, role, text)
        self.waiting = self.waiting[taken:]
        self.chars = 0  # looked for again after as many characters more
        self.audit.append(edits)
        self.tree, nodes = self.tree.rooted(root, live)
        self.best = {s: (c, n) for (s, (c, _)), n in zip(self.best.items(), nodes, strict=True)}

    def end(self) -> tuple[int, str]:
        """Cost and audit of the whole conversation."""
        found = None
        for state in (START, ASSISTANT):
            if state in self.best:
                cost, node = self.best[state]
                if found is None or cost < found[0] or cost == found[0] and self.tree.less(node, found[1]):
                    found = (cost, node)
        self.best = {ASSISTANT: found}
        self._settle([found[1]])
        return found[0], "".join(self.audit)


class Conversation:
    """Faults and repair of one conversation, row by row."""

    def __init__(self, put):
        self.repair = Repair(put)
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.last = self.initial = None

    def row(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None:
            if self.low is None:
                self.low = turn
            self.turns += turn != self.last
            self.last = turn
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in LEGAL
        self.initial = role[:1]
        body = text.rstrip(SPACES)
        blank, cut = not body, body[-1:] not in (".", "!", "?")
        if blank:
            self.blank += 1
        elif seen:
            self.duplicate += 1
        else:
            self.truncated += cut
        self.repair.row(role, text, blank or seen, cut)

    def end(self) -> list:
        gaps = min(self.last - self.low + 1 - self.turns, _LONG) if self.turns else 0
        cost, audit = self.repair.end()
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit]


def in_order(rows: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """``conv, turn, role, text, seen, gone`` by conversation, within partitions in the order of the conversation."""
    space = F.lit(" ")
    plain = rows.select(
        quoted(conv).alias("conv"),
        quoted(turn).cast("long").alias("turn"),
        F.coalesce(quoted(role).cast("string"), space).alias("role"),
        F.coalesce(quoted(text).cast("string"), space).alias("text"),
        (F.coalesce(quoted(gone), F.lit(False)) if gone else F.lit(False)).alias("gone"),
    ).repartition("conv")
    alike = Window.partitionBy("conv", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first())
    marked = plain.withColumn("seen", F.row_number().over(alike) > 1)
    return marked.sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text", "seen")


def _streamed(rows: DataFrame, fields: str, begin, end) -> DataFrame:
    """``begin()`` gives a conversation for each key, ``end(key, conversation)`` its rows as soon as it is over; what a
    conversation puts out before goes along with its batch."""
    kind = rows.schema["conv"].dataType
    schema = T.StructType([T.StructField("conv", kind), *T._parse_datatype_string(fields).fields])
    arrow = to_arrow_schema(schema)

    def run(batches):
        made: list[tuple] = []
        key = now = None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv", "turn", "role", "text", "seen", "gone")]
            for conv, turn, role, text, seen, gone in zip(*columns):
                if now is None or conv != key:
                    if now is not None:
                        end(key, now, made)
                    key, now = conv, begin(conv, made)
                if not gone:
                    now.row(turn, role, text, seen)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)
                made.clear()
        if now is not None:
            end(key, now, made)
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), arrow.types)], schema=arrow)

    return rows.mapInArrow(run, schema)


AUDIT = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
    "repaired_sha256 string"
)


def audits(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", gone: str | None = None
) -> DataFrame:
    """A row per conversation: its faults, the cost and audit of its repair, and the SHA-256 of the repaired
    ``role:text``, joined by newlines.

    ``gone`` names a column that marks rows which only say that their conversation exists.
    """

    def begin(key, made):
        digest, first = sha256(), True

        def put(edit, role, text):
            nonlocal first
            if edit != DELETE:
                digest.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                first = False

        now = Conversation(put)
        now.digest = digest
        return now

    def end(key, now, made):
        found = now.end()
        made.append((key, *found, now.digest.hexdigest()))

    streamed = _streamed(in_order(rows, conv, turn, role, text, gone), AUDIT, begin, end)
    return streamed.withColumnRenamed("conv", conv)


def repaired(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The repaired conversations: ``place`` (from 0), role, text and the ``edit`` that left or made the row."""

    def begin(key, made):
        n = 0

        def put(edit, role, text):
            nonlocal n
            if edit != DELETE:
                made.append((key, n, role, text, edit))
                n += 1

        return Conversation(put)

    def end(key, now, made):
        now.end()

    streamed = _streamed(in_order(rows, conv, turn, role, text, None), "place bigint, role string, text string, edit string", begin, end)
    return streamed.withColumnRenamed("conv", conv)


def damaged(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults dealt by ``crc32(conv_id:turn) % 20``, nulls as one space: 0 drops a row
    (it stays, marked by ``gone``), 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes it the user's."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    draw = (F.crc32(name.cast("binary")) % 20).alias("draw")
    drawn = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), draw)
    return drawn.select(
        "conv_id",
        "turn",
        F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        (F.col("draw") == 0).alias("gone"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")
