"""Operator 13: damaged conversations, their faults, and the cheapest repair.

A conversation after damage is a path of rows; repairing it is a walk over nodes (row, state), where the state says which role
is due. Costs to the end are found backwards. Of the arcs that lie on cheapest walks (several may leave a node: Delete,
Insert, Keep, Rerole), the walk whose letters are least is wanted. So nodes are ranked by the least letters that follow, of
length 1, then 2, 4, 8 and so on: the rank of twice the length comes from the pair of a node's own rank and that of the node its
pointer leads to, and pointers double. Each node takes its arc of least letter and rank; the letters of the walk are read at
all its places at once through the doubled pointers. Costs, ranks and pointers are arrays over many conversations at once.

Conversations meet by one shuffle and stream by in order of their turns. A row leaves about 20 bytes in memory (its class and the
digest that shows repetitions); texts beyond SPOOL bytes of a step wait in a temporary file of the task, which goes with it."""

from __future__ import annotations

import hashlib
import re
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import slices

#: Kinds of damage by crc32 modulo 20; costs of edits; rows that are repaired together; bytes of text in memory; digests in a hash.
DROP, EMPTY, STRIP, REPEAT, REROLE, DAMAGES = 0, 1, 2, 3, 4, 20
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
STEP_ROWS, SPOOL, HASHED = 50_000, 64_000_000, 1 << 18
#: States: nothing yet, after a system row, an assistant is due, a pair is complete.
START, SYSTEM, DUE, PAIR = range(4)
#: The state after a user or assistant row that is due, and which role that is.
NEXT, ROLE = np.array([DUE, DUE, PAIR, DUE]), ("user", "user", "assistant", "user")
#: Letters of edits in ASCII order; 0 ends a walk.
LETTERS = "\0DIKR"
_DELETE, _INSERT, _KEEP, _REROLE = range(1, 5)
_SPACE = " \t\n\x0b\f\r"
_OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after damage by crc32 of ``conv_id:turn``; nulls are read as one space. A dropped row stays with
    dropped = true, so that its conversation is not forgotten."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")])
    named = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.pmod(F.crc32(F.encode(named, "UTF-8")), F.lit(DAMAGES))
    rows = rows.withColumn("kind", kind)
    text = F.when(F.col("kind") == EMPTY, "").when(F.col("kind") == STRIP, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == REROLE, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == DROP).alias("dropped"), F.when(F.col("kind") == REPEAT, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


class Seen:
    """The digests seen so far: a hash of at most HASHED of them, older ones as one sorted array."""

    def __init__(self) -> None:
        self.new: set[bytes] = set()
        self.old = np.empty(0, "S16")

    def add(self, digest: bytes) -> bool:
        """Whether the digest was there before."""
        if digest in self.new:
            return True
        if len(self.old):
            at = int(np.searchsorted(self.old, np.array(digest, "S16")))
            if at < len(self.old) and self.old[at] == np.array(digest, "S16"):
                return True
        self.new.add(digest)
        if len(self.new) >= HASHED:
            self.old, self.new = np.sort(np.concatenate([self.old, np.array(list(self.new), "S16")])), set()
        return False


@dataclass
class Conversation:
    """What is known of a conversation's rows: one byte each, counts, and where its lines begin in the step's file."""

    conv_id: int | None
    codes: bytearray = field(default_factory=bytearray)
    seen: Seen = field(default_factory=Seen)
    first: int | None = None
    last: int | None = None
    turns: int = 0
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    before: str | None = None

    def add(self, turn: int | None, role: str, text: str) -> None:
        core = text.rstrip(_SPACE)
        again = bool(core) and self.seen.add(hashlib.md5(f"{role}\0{text}".encode(), usedforsecurity=False).digest())
        cut = bool(core) and not again and core[-1] not in ".!?"
        self.blank += not core
        self.duplicate += again
        self.truncated += cut
        if turn is not None:  # rows come in order of turns
            self.turns += turn != self.last
            self.first, self.last = turn if self.first is None else self.first, turn
        if self.before is not None:
            self.illegal += self.before + role[:1] not in ("su", "ua", "au")
        self.before = role[:1]
        # the role's letter in two bits, then whether it must go, then whether it is cut off
        self.codes.append({"s": 1, "u": 2, "a": 3}.get(role[:1], 0) | 4 * (not core or again) | 8 * cut)

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


def costs_to_end(codes: np.ndarray) -> np.ndarray:
    """Row i: the cheapest repair of the rows from i on, from each state; behind the last row, that of inserting what is due."""
    out = np.zeros((len(codes) + 1, 4), np.int64)
    d0, d1, d2, d3 = 0, 2 * INSERT_COST, INSERT_COST, 0
    out[-1] = d0, d1, d2, d3
    never = 1 << 60
    for i, code in zip(range(len(codes) - 1, -1, -1), codes[::-1].tolist()):  # noqa: B905
        letter, cut = code & 3, TRUNCATED_COST * (code >> 3)
        b0, b1, b2, b3 = d0 + DELETE_COST, d1 + DELETE_COST, d2 + DELETE_COST, d3 + DELETE_COST
        if not code & 4:
            to_user, to_assistant = d2 + cut + (0 if letter == 2 else REROLE_COST), d3 + cut + (0 if letter == 3 else REROLE_COST)
            b0, b1, b2, b3 = min(b0, to_user, d1 + cut if letter == 1 else never), min(b1, to_user), min(b2, to_assistant), min(b3, to_user)
        d2, d3 = min(b2, b3 + INSERT_COST), min(b3, b2 + INSERT_COST)
        d0, d1 = min(b0, d2 + INSERT_COST), min(b1, d2 + INSERT_COST)
        out[i] = d0, d1, d2, d3
    return out


def optimal_arcs(codes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Over the nodes (row, state) of all conversations, one after the other: for each letter the node to which its arc leads, and
    whether a cheapest walk takes it; then the cost to the end of each node, and the first node of each conversation."""
    cost = np.concatenate([costs_to_end(c) for c in codes])
    rows, first = len(cost), np.cumsum([0, *[len(c) + 1 for c in codes[:-1]]])
    code, real = np.zeros(rows, np.int64), np.ones(rows, bool)
    for c, at in zip(codes, first.tolist(), strict=True):
        code[at : at + len(c)], real[at + len(c)] = c, False
    state = np.arange(4)
    letter, gone, cut = code & 3, (code & 4) > 0, TRUNCATED_COST * (code >> 3)
    after = np.minimum(np.arange(rows) + 1, rows - 1)
    target, on = np.zeros((5, rows, 4), np.int64), np.zeros((5, rows, 4), bool)
    due = np.array([2, 2, 3, 2])
    kept = np.where(letter[:, None] == due, NEXT, np.where((letter == 1)[:, None] & (state == START), SYSTEM, -1))
    for kind, to, price, may in (
        (_DELETE, np.broadcast_to(state, (rows, 4)), np.full(rows, DELETE_COST), real[:, None]),
        (_INSERT, np.broadcast_to(NEXT, (rows, 4)), np.full(rows, INSERT_COST), np.ones((rows, 1), bool)),
        (_KEEP, np.maximum(kept, 0), cut, (real & ~gone)[:, None] & (kept >= 0)),
        (_REROLE, np.broadcast_to(NEXT, (rows, 4)), cut + REROLE_COST, (real & ~gone)[:, None]),
    ):
        row = np.arange(rows) if kind == _INSERT else after
        target[kind] = row[:, None] * 4 + to
        on[kind] = may & (cost.reshape(-1)[target[kind]] + price[:, None] == cost)
    return target.reshape(5, -1), on.reshape(5, -1), cost.reshape(-1), first * 4


def least_walks(target: np.ndarray, on: np.ndarray, first: np.ndarray) -> list[str]:
    """The letters of the ASCII-least walk from each first node; target and on: for each letter where its arc leads, and whether it may be taken."""
    n = target.shape[1]
    nodes, stop = np.arange(n), ~on.any(0)
    # length 1: the least letter and where it leads; a node where walks end leads to itself
    best = np.where(stop, 0, on.argmax(0))
    pointer = np.where(stop, nodes, target[best, nodes])
    rank, length, pointers, steps = best.copy(), (~stop).astype(np.int64), [pointer], 1
    while not (stop[pointer]).all():
        # twice the length: by the own rank, then by that of the node the pointer leads to
        pair = rank * (int(rank.max()) + 1) + rank[pointer]
        rank = np.unique(pair, return_inverse=True)[1]
        length = length + length[pointer]
        pointer = pointer[pointer]
        pointers.append(pointer)
        steps *= 2
    # among a node's arcs the one of least letter, then least rank, whose walk is the least of all
    order = np.where(on, np.arange(5)[:, None] * n + rank[target], 5 * n)
    letter = np.where(stop, 0, order.argmin(0))
    each = length[first]
    place = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
    at = np.repeat(first, each)
    for k, p in enumerate(pointers):
        at = np.where(place >> k & 1, p[at], at)
    text, ends = "".join(LETTERS[i] for i in letter[at]), np.cumsum(each).tolist()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


class _Step:
    """Conversations that are repaired together, and their lines."""

    def __init__(self) -> None:
        self.conversations: list[Conversation] = []
        self.lines = tempfile.SpooledTemporaryFile(max_size=SPOOL)
        self.rows = 0

    def add(self, role: str, text: str) -> None:
        for x in (role.encode(), text.encode()):
            self.lines.write(len(x).to_bytes(8, "little"))
            self.lines.write(x)
        self.rows += 1

    def _next(self) -> tuple[bytes, bytes]:
        return tuple(self.lines.read(int.from_bytes(self.lines.read(8), "little")) for _ in range(2))

    def _repaired(self, audit: str) -> str:
        """SHA-256 of the lines that the edits leave."""
        digest, state, begun = hashlib.sha256(), START, False
        for edit in audit:
            role, text = (b"", b"") if edit == "I" else self._next()
            if edit == "D":
                continue
            if edit != "K":
                role = ROLE[state].encode()
            state = SYSTEM if edit == "K" and role[:1] == b"s" else int(NEXT[state])
            for x in (b"\n" if begun else b"", role, b":", text):
                digest.update(x)
            begun = True
        return digest.hexdigest()

    def done(self) -> pa.RecordBatch:
        codes = [np.frombuffer(bytes(c.codes), np.uint8).astype(np.int64) for c in self.conversations]
        target, on, cost, first = optimal_arcs(codes)
        self.lines.seek(0)
        rows = [
            (c.conv_id, c.gaps, c.blank, c.duplicate, c.truncated, c.illegal, price, audit, self._repaired(audit))
            for c, price, audit in zip(self.conversations, cost[first].tolist(), least_walks(target, on, first), strict=True)
        ]
        self.lines.close()
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        names = [x.split()[0] for x in _OUT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def _repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step, now = _Step(), None
    for part in slices(batches):
        for conv_id, turn, role, text, dropped in zip(*[part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "dropped")], strict=True):
            if now is None or now.conv_id != conv_id:
                if step.rows >= STEP_ROWS:
                    yield step.done()
                    step = _Step()
                if now:
                    now.seen = Seen()
                now = Conversation(conv_id)
                step.conversations.append(now)
            if not dropped:
                now.add(turn, role, text)
                step.add(role, text)
    if now:
        yield step.done()


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation after damage.

    Rows stand in order of turn (null first; rows of one turn by role, then text, so copies are adjacent). Null conv_ids are one
    conversation; a null role or text is one space. gaps counts missing turns between the first and the last one. The edits are
    the cheapest that leave roles beginning with an optional s and then pairs u, a; their letters (D, I, K, R) are
    the ASCII-least. A conversation without rows after damage has zeros, an empty audit and the hash of nothing. Further columns
    are left out; an empty table gives no rows. A conversation is read by one task, as its hash runs over all its text in order."""
    rows = damaged(conversations).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    return rows.mapInArrow(_repair, _OUT)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
