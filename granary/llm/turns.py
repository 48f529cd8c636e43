"""Repair of conversations: the cheapest edits that make their turns alternate, by Dijkstra on the lattice of rows and grammar states.

The repaired role initials are `(s?(ua)+)?`. A node is (rows consumed, grammar state); edges are the edits of the next row and
insertions. The queue's key is (cost, audit), the audit being the edits' initials, and the search stops at the first accepting end
node it takes out. A conversation passes through its task in order, in segments of bounded size: within a segment the search runs
from all nodes at its beginning, and at its end every node that a row's edit reaches is settled, with a copy of the running SHA-256
for each. Such nodes' audits all end in a row's edit and hold equally many of them, so none is a prefix of another, and their rank
stands for them in the next segment's keys. What a task holds is one segment and the audit, which is a cell of the result anyway.
The hash of a conversation's text is sequential by its definition, so one conversation, however long, is one stream of one task.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A segment ends after so many rows or characters; results do not depend on it.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 4_000_000
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Grammar states: nothing yet, after s, after u, after a; where an initial leads, and the state of the one role that may follow.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ACCEPTING = (0, 3)
ROLE = {2: "user", 3: "assistant"}
LEGAL = {"su", "ua", "au"}
LAST = re.compile(r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\Z")

REPORT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after seeded damage by crc32("conv_id:turn") % 20: 0 drops a row, 1 empties its text, 2 takes its stops, 3 repeats it, 4 makes it the user's. Nulls count as one space; a null turn stays null for the order."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return out.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("kind", "copy")


def search(rows: list[tuple], entries: list[tuple[int, int]], last: bool) -> list[tuple[int, str, int, int]]:
    """(rank of the entry, audit from there, cost, state) of the nodes settled at the end of ``rows``, (initial, must go, truncated).

    ``entries`` are the costs and states at the beginning, by rank of their audits. If these are the last rows, the search stops at the
    first accepting end node.
    """
    queue = [(cost, rank, "", 0, state) for rank, (cost, state) in enumerate(entries)]
    heapq.heapify(queue)
    settled, found, n = set(), [], len(rows)
    while queue:
        cost, rank, audit, i, state = heapq.heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == n:
            if not last:
                found.append((rank, audit, cost, state))
                continue
            if state in ACCEPTING:
                return [(rank, audit, cost, state)]
        other = NEXT[state]
        heapq.heappush(queue, (cost + INSERT, rank, audit + "I", i, other))
        if i == n:
            continue
        initial, gone, truncated = rows[i]
        heapq.heappush(queue, (cost + DELETE, rank, audit + "D", i + 1, state))
        if gone:
            continue
        cost += TRUNCATED * truncated
        heapq.heappush(queue, (cost + REROLE, rank, audit + "R", i + 1, other))
        if (state, initial) in STEP:
            heapq.heappush(queue, (cost + KEEP, rank, audit + "K", i + 1, STEP[state, initial]))
    return found


def lines(rows: Iterator[tuple[str, str]], audit: str, state: int) -> Iterator[tuple[str, str, str, int]]:
    """(edit, role, text, state after it) of what an audit leaves of rows (role, text)."""
    rows = iter(rows)
    for edit in audit:
        role, text = next(rows) if edit != "I" else ("", "")
        if edit == "D":
            continue
        state = STEP[state, role[0]] if edit == "K" else NEXT[state]
        yield edit, role if edit == "K" else ROLE[state], text, state


class Conversation:
    """The rows of one conversation as they come by, in order."""

    def __init__(self, key):
        self.key, self.turns, self.span, self.before, self.last = key, 0, [None, None], None, None
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.rows, self.chars = [], 0
        #: cost, state, audit so far as (before, piece), running hash; by rank of the audits
        self.entries = [(0, 0, None, hashlib.sha256())]

    def add(self, turn, role: str, text: str, first: bool) -> None:
        if turn is not None and turn != self.before:
            self.turns, self.before = self.turns + 1, turn
            self.span = [turn if self.span[0] is None else self.span[0], turn]
        end = LAST.search(text)
        fault = "blank" if end is None else "duplicate" if not first else "truncated" if end[1] not in ".!?" else None
        if fault:
            self.counts[fault] += 1
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.counts["illegal"] += 1
        self.last = initial
        self.rows.append(((initial, fault in ("blank", "duplicate"), fault == "truncated"), (role, text)))
        self.chars += len(text)
        if len(self.rows) == SEGMENT_ROWS or self.chars >= SEGMENT_CHARS:
            self.settle(False)

    def settle(self, last: bool) -> None:
        found = search([r[0] for r in self.rows], [e[:2] for e in self.entries], last)
        entries = []
        for rank, audit, cost, end in sorted(found):
            _, state, before, digest = self.entries[rank]
            digest = digest.copy()
            for _, role, text, after in lines((r[1] for r in self.rows), audit, state):
                digest.update((("\n" if state else "") + role + ":" + text).encode())
                state = after
            entries.append((cost, end, (before, audit), digest))
        self.entries, self.rows, self.chars = entries, [], 0

    def report(self) -> dict:
        self.settle(True)
        cost, _, link, digest = self.entries[0]
        pieces = []
        while link is not None:
            link, piece = link
            pieces.append(piece)
        gaps = 0 if self.span[0] is None else self.span[1] - self.span[0] + 1 - self.turns
        return {"conv_id": self.key, "gaps": gaps, **self.counts, "cost": cost, "audit": "".join(reversed(pieces)), "repaired_sha256": digest.hexdigest()}


def _stream(rows: DataFrame, *more: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, kind, text by conversation and in order; kind 1 marks (role, digest) as new, 2 is a row.

    Whether a row repeats an earlier one is not kept in the tasks that read the stream: for each role and text the marker stands right before its first row.
    """
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("least"), F.bool_or(F.col("turn").isNull()).alias("none"))
    turn = F.when(F.col("none"), None).otherwise(F.col("least")).alias("turn")
    columns = ["conv_id", "turn", "role", "digest", "kind", "text"]
    out = rows.withColumn("kind", F.lit(2)).select(columns)
    for x in (first.select("*", turn, F.lit(1).alias("kind"), F.lit(None).cast("string").alias("text")).select(columns), *(m.select(columns) for m in more)):
        out = out.unionByName(x)
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", "kind")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, whether it is a new one, turn, role, digest, kind, text, whether its role and text are new) of a stream's rows."""
    before, begun, marked = None, False, None
    for batch in batches:
        for key, turn, role, digest, kind, text in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
            new = not begun or key != before
            if new:
                before, begun, marked = key, True, None
            first = marked == (role, digest)
            marked = (role, digest) if kind == 1 else None
            yield key, new, turn, role, digest, kind, text, first


def _kind(rows: DataFrame) -> str:
    return rows.schema["conv_id"].dataType.simpleString()


def _light(conv_id: DataFrame, kind: int, text=None) -> DataFrame:
    """Rows of a stream that come first in their conversations."""
    none = F.lit(None)
    return conv_id.select("conv_id", none.cast("long").alias("turn"), F.lit("").alias("role"), none.cast("binary").alias("digest"), F.lit(kind).alias("kind"), (none.cast("string") if text is None else text).alias("text"))


def repairs(rows: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """conv_id and the report (gaps, faults, illegal neighbours, cost, audit, hash of the repaired turns) of each conversation of ``rows`` (conv_id, turn, role, text).

    ``ids`` (conv_id) are reported too if they have no row: all zeros, an empty audit, the hash of nothing. A null conv_id is a conversation
    of its own. Rows are ordered by turn (nulls first), role and SHA-256 of the text; a null role or text is one space. A role without a first
    character has no initial and cannot be kept. A row repeats an earlier one if role and SHA-256 of the text agree. Other columns are ignored.
    An empty table gives an empty result.
    """
    kind = _kind(rows)
    stream = _stream(rows, *([_light(ids.select("conv_id").distinct(), 0)] if ids is not None else []))

    def run(batches):
        now, done, key_type = None, [], None

        def out():
            columns = {"conv_id": pa.array([r["conv_id"] for r in done], key_type)}
            columns |= {c.split()[0]: pa.array([r[c.split()[0]] for r in done], pa.string() if c.endswith("string") else pa.int64()) for c in REPORT.split(", ")}
            return pa.RecordBatch.from_pydict(columns)

        def typed():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                yield batch

        for key, new, turn, role, _, what, text, first in _walk(typed()):
            if new:
                if now is not None:
                    done.append(now.report())
                now = Conversation(key)
                if len(done) == 1000:
                    yield out()
                    done.clear()
            if what == 2:
                now.add(turn, role, text, first)
        if now is not None:
            done.append(now.report())
            yield out()

    return stream.mapInArrow(run, f"conv_id {kind}, {REPORT}")


def repaired(rows: DataFrame, reports: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, turn, role, text: the turns that the audits of ``reports`` leave of ``rows``; an inserted one has no turn.

    The audit comes before its conversation in the same order, so that the rows pass by one at a time.
    """
    kind = _kind(rows)
    stream = _stream(rows, _light(reports, 0, F.col("audit")))

    def run(batches):
        key, done, audit, at, state, place, key_type = None, [], "", 0, 0, 0, None

        def out():
            names = [("conv_id", key_type), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*done, strict=True), names, strict=True)], [n for n, _ in names])

        def put(edit, turn, role, text):
            nonlocal state, place, at
            at += 1
            if edit == "D":
                return
            state = STEP[state, role[0]] if edit == "K" else NEXT[state]
            done.append((key, place, edit, turn, role if edit == "K" else ROLE[state], text))
            place += 1

        def inserts():
            while at < len(audit) and audit[at] == "I":
                put("I", None, "", "")

        def typed():
            nonlocal key_type
            for batch in batches:
                key_type = batch.schema.field(0).type
                yield batch

        for key, new, turn, role, _, what, text, _ in _walk(typed()):  # noqa: B007
            if new:
                audit, at, state, place = "", 0, 0, 0
            if what == 0:
                audit = text
                inserts()
            elif what == 2 and at < len(audit):
                put(audit[at], turn, role, text)
                inserts()
            if len(done) >= 1000:
                yield out()
                done.clear()
        if done:
            yield out()

    return stream.mapInArrow(run, f"conv_id {kind}, place long, edit string, turn long, role string, text string")
