"""Conversation structure repair by depth-first branch and bound.

A repaired conversation reads ``(system? (user assistant)+)?``, told by the initials of its roles.  Rows are
taken in order; each is kept, given another role or deleted, and empty turns can be inserted anywhere.  The search keeps an
explicit stack of prefixes (row, place in the pattern, cost, audit).  A prefix goes if its cost plus the lower
bound of what remains exceeds the incumbent's cost, if it ties and its audit already sorts behind the incumbent's, or if the table
of its node (row and place) holds a better prefix.  An empty stack proves the incumbent the best one.

Two equally dear prefixes at one node differ in a letter before either ends (the same letters
cost the same, and further letters would be dearer inserts), so the smaller audit stays smaller however both go on.
An audit fixes the roles, as the pattern fixes what may follow, so the repaired text is unique.

Conversations are streamed: rows are shuffled by conversation, sorted on disk and read in order.  A long one is
searched ``SEGMENT`` rows at a time; between segments only the best prefix for each of the four places is kept, with its checksum so
far, and places more than ``SLACK`` dearer than the best one are dropped, as any ending they allow can be had from the
best one for less.  So a conversation of any length needs the memory of a segment and of its audits.  A checksum over one
conversation is one task's work by nature.

Costs: keep 0, other role 3, delete 4, insert 3; a truncated row that isn't deleted 3.  Blank rows and duplicates are deleted.

Defined cases: a NULL role or text is one space, so a row without text is blank; rows of one turn go by role, then text; turns that are NULL
come first; a NULL conversation id is a conversation; repeated rows are duplicates; an empty table gives no rows; very long texts
are compared and hashed whole; extra columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = 128
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
# Places in the pattern: nothing yet, after the system turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {"su", "ua", "au"}
TURN = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}  # where an inserted or rerolled turn leads
ROLE = {USER: "user", ASSISTANT: "assistant"}
# The dearest detour from one place to what another allows: a turn inserted and a system row deleted.
SLACK = INSERT + DELETE

Row = tuple[str, bool, bool]  # role initial, must be deleted, truncated
Prefix = tuple[int, int, str]  # cost, place the segment was entered at, audit since then


def suffix_bounds(rows: Sequence[Row], last: bool = True) -> list[list[int]]:
    """For every row and place, what that row and those behind it cost at least, by backward recursion.

    Audits aren't looked at, so of equally dear repairs the search has to find the first.
    """
    bound = [0, 2 * INSERT, INSERT, 0] if last else [0] * 4
    bounds = [bound]
    for initial, must, truncated in reversed(rows):
        after, bound = bound, [DELETE + b for b in bound]
        for place in range(4) if not must else ():
            stay = TRUNCATED * truncated
            bound[place] = min(bound[place], stay + REROLE + after[TURN[place]])
            if (place, initial) in NEXT:
                bound[place] = min(bound[place], stay + KEEP + after[NEXT[place, initial]])
        for place in (USER, ASSISTANT, USER, SYSTEM, START):  # turns inserted ahead of the row
            bound[place] = min(bound[place], INSERT + bound[TURN[place]])
        bounds.append(bound)
    return bounds[::-1]


def search(rows: Sequence[Row], entries: dict[int, tuple[int, str]], last: bool = True) -> dict[int, Prefix]:
    """The best way through a segment to each place it can end at; at its ``last`` one only to the best of the two final places.

    ``entries``: cost and audit so far for each place the segment can be entered at.
    """
    n, bound = len(rows), suffix_bounds(rows, last)

    def smaller(a: Prefix, b: Prefix) -> bool:
        if a[0] != b[0]:
            return a[0] < b[0]
        return a[2] < b[2] if a[1] == b[1] else entries[a[1]][1] + a[2] < entries[b[1]][1] + b[2]

    table: dict[tuple[int, int], Prefix] = {(0, place): (cost, place, "") for place, (cost, _) in entries.items()}
    ranked = sorted(table, key=lambda node: (table[node][0] + bound[0][node[1]], entries[node[1]][1]), reverse=True)
    stack = [(*node, table[node]) for node in ranked]
    finals = (START, ASSISTANT) if last else range(4)
    incumbent: Prefix | None = None
    while stack:
        i, place, prefix = stack.pop()
        if table[i, place] is not prefix:
            continue  # a better prefix has reached this node
        cost, entry, audit = prefix
        if i == n and place in finals and (incumbent is None or smaller(prefix, incumbent)):
            incumbent = prefix
        steps = [(i, TURN[place], cost + INSERT, "I")]
        if i < n:
            initial, must, truncated = rows[i]
            steps.append((i + 1, place, cost + DELETE, "D"))
            if not must:
                stay = cost + TRUNCATED * truncated
                steps.append((i + 1, TURN[place], stay + REROLE, "R"))
                if (place, initial) in NEXT:
                    steps.append((i + 1, NEXT[place, initial], stay + KEEP, "K"))
        # The most promising step is pushed last and tried first.
        steps.sort(key=lambda s: (s[2] + bound[s[0]][s[1]], s[3]), reverse=True)
        for j, there, new, letter in steps:
            reached = (new, entry, audit + letter)
            if incumbent is not None and _hopeless(reached, new + bound[j][there], incumbent, entries, last):
                continue
            if (j, there) not in table or smaller(reached, table[j, there]):
                table[j, there] = reached
                stack.append((j, there, reached))
    if last:
        place = next(p for p in finals if table.get((n, p)) is incumbent)
        return {place: incumbent}
    ends = {place: table[n, place] for place in range(4) if (n, place) in table}
    return {place: p for place, p in ends.items() if p[0] <= incumbent[0] + SLACK}


def _hopeless(reached: Prefix, least: int, incumbent: Prefix, entries: dict[int, tuple[int, str]], last: bool) -> bool:
    if not last:
        return least > incumbent[0] + SLACK
    if least != incumbent[0]:
        return least > incumbent[0]
    if reached[1] == incumbent[1]:
        return reached[2] > incumbent[2][: len(reached[2])]
    ours, theirs = entries[reached[1]][1] + reached[2], entries[incumbent[1]][1] + incumbent[2]
    return ours > theirs[: len(ours)]


def edited(rows: Sequence[tuple[str, str]], entry: int, audit: str, initials: Sequence[str]) -> Iterator[tuple[str, str]]:
    """The (role, text) turns an audit makes of rows."""
    place, i = entry, 0
    for letter in audit:
        if letter == "I":
            place = TURN[place]
            yield ROLE[place], ""
            continue
        role, text = rows[i]
        if letter == "K":
            place = NEXT[place, initials[i]]
            yield role, text
        elif letter == "R":
            place = TURN[place]
            yield ROLE[place], text
        i += 1


class _Conversation:
    """One conversation as its rows arrive."""

    def __init__(self, key, turns: bool):
        self.key, self.keep_turns = key, turns
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.least = self.most = None
        self.distinct = 0
        self.initial = None
        self.rows: list[Row] = []
        self.turns: list[tuple[str, str]] = []
        # For each place: cost, audit behind what all places share, checksum, turns made.
        self.state = {START: (0, "", hashlib.sha256(), None, [])}
        self.settled: list[str] = []

    def add(self, turn, role: str, text: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        if len(self.rows) == SEGMENT:
            self._advance(False)
        duplicate, truncated = duplicate and not blank, truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        if turn is not None:
            self.least = turn if self.least is None else self.least
            self.distinct += turn != self.most
            self.most = turn
        initial = role[:1]
        if self.initial is not None and self.initial + initial not in LEGAL:
            self.illegal += 1
        self.initial = initial
        self.rows.append((initial, blank or duplicate, truncated))
        self.turns.append((role, text))

    def _advance(self, last: bool) -> None:
        ends = search(self.rows, {place: s[:2] for place, s in self.state.items()}, last)
        initials = [r[0] for r in self.rows]
        state = {}
        for place, (cost, entry, audit) in ends.items():
            _, before, checksum, some, made = self.state[entry]
            checksum, made = checksum.copy(), list(made)
            for role, text in edited(self.turns, entry, audit, initials):
                checksum.update((b"\n" if some else b"") + f"{role}:{text}".encode())
                some = True
                if self.keep_turns:
                    made.append({"role": role, "text": text})
            state[place] = (cost, before + audit, checksum, some, made)
        # What every place's audit begins with needn't be compared again.
        audits = [s[1] for s in state.values()]
        low, high = min(audits), max(audits)
        shared = next((k for k, (a, b) in enumerate(zip(low, high)) if a != b), min(len(low), len(high)))
        self.settled.append(low[:shared])
        self.state = {place: (c, a[shared:], *rest) for place, (c, a, *rest) in state.items()}
        self.rows, self.turns = [], []

    def close(self) -> tuple:
        self._advance(True)
        (cost, audit, checksum, _, made), = self.state.values()
        gaps = self.most - self.least + 1 - self.distinct if self.most is not None else 0
        counts = (gaps, self.blank, self.duplicate, self.truncated, self.illegal)
        return (self.key, *counts, cost, "".join(self.settled) + audit, checksum.hexdigest(), *([made] if self.keep_turns else []))


def _faults(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    seen = Window.partitionBy("conv_id", "role", F.sha2("text", 256)).orderBy(*order)
    end = F.right(F.rtrim(F.col("text"), F.lit(SPACE)), F.lit(1))
    return rows.withColumns(
        {
            "blank": end == "",
            "duplicate": F.when(F.col("gone"), F.lit(False)).otherwise(F.sum((~F.col("gone")).cast("int")).over(seen.rowsBetween(Window.unboundedPreceding, 0)) > 1),
            "truncated": ~end.isin(".", "!", "?"),
        }
    )


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    gone: Column | None = None, with_turns: bool = False,
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256[, turns]), one row per conversation.

    Rows where ``gone`` is true count as missing, but their conversation is listed.  ``turns`` are the repaired (role, text).
    """
    space = F.lit(" ")
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(role, space).alias("role"),
        F.coalesce(text, space).alias("text"), F.coalesce(F.lit(False) if gone is None else gone, F.lit(False)).alias("gone"),
    ).repartition("conv_id")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = _faults(rows, order).sortWithinPartitions(F.col("conv_id"), *order)
    counts = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint"
    kind = conversations.schema[conv_id].dataType.simpleString()
    schema = f"conv_id {kind}, {counts}, audit string, repaired_sha256 string"
    schema += ", turns array<struct<role: string, text: string>>" if with_turns else ""
    names = [part.split()[0] for part in f"conv_id {kind}, {counts}, audit string, repaired_sha256 string".split(", ")] + ["turns"] * with_turns

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, kinds = None, None
        for batch in batches:
            done = []
            kinds = batch.schema.field("conv_id").type
            for key, at, who, body, lost, blank, duplicate, truncated in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or current.key != key:
                    if current is not None:
                        done.append(current.close())
                    current = _Conversation(key, with_turns)
                if not lost:
                    current.add(at, who, body, blank, duplicate, truncated)
            if done:
                yield _batch(done, names, kinds)
        if current is not None:
            yield _batch([current.close()], names, kinds)

    columns = ["conv_id", "turn", "role", "text", "gone", "blank", "duplicate", "truncated"]
    return ordered.select(*columns).mapInArrow(follow, schema)


def _batch(rows: list[tuple], names: list[str], key: pa.DataType) -> pa.RecordBatch:
    kinds = [key, *[pa.int64()] * 6, pa.string(), pa.string(), pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
