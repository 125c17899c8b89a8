"""Conversation structure repair by aligning turns to the alternating grammar.

A repaired conversation is empty, or user and assistant in turn, ending with the
assistant, perhaps after one system turn. Its roles are thus one of the strings
"", "ua", "uaua", ..., "sua", "suaua", ... The turns are aligned to each of
these by Wagner and Fischer's table, kept to Ukkonen's band round the diagonals
that the cheapest audit so far (the incumbent) still allows. A length whose
bound exceeds the incumbent isn't aligned. Of the audits of least cost, which
are traced from the table letter by letter, the ASCII-least stays.

Edits: Keep a turn (free), Rerole it to user or assistant (3), Delete it (4;
blank and repeated turns must go), Insert an empty user or assistant turn (3).
A truncated turn that stays costs 3 more.

Conversations of any length: turns are range-partitioned by (conversation,
turn, role, text), so a long conversation lies in several partitions, and read
in that order in blocks of bounded size. A block whose conversation begins and
ends inside the partition and fits a block is repaired there. Any other block
is aligned to the segments of the grammar's strings between every two places
in the grammar (at the start, after system, user or assistant). No insertion
ends a block, so audits of one block never begin with one another, and the
least audit of a chain of blocks is the chain of least audits: the blocks of a
conversation are joined over these four places, from the last to the first.
What one task gathers of such a conversation is at most eleven short strings a
block, and the hash of its repaired text, which can only be taken in order, is
taken piece by piece.

Defined cases: turns are ordered by turn (NULL first), then role, then text; a
NULL role or text counts as one space; a NULL conversation id is one
conversation; a turn with an empty role can't be kept as it is. Rows that
agree in all four columns are the same turn again and count as duplicates. An
empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vintage.llm.common import written

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns of one block at most.
BLOCK = 64
#: Places in the grammar: nothing yet, after the system turn, after a user turn, after an assistant turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Insertions that end a conversation at each place.
_ENDING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
_SPACE = " \t\n\x0b\x0c\r"
_NEVER = 1 << 60

# ----------------------------------------------------------------- alignment


def _bound(by: int) -> int:
    """Least cost of targets longer than the turns by ``by``."""
    return INSERT * by if by >= 0 else -DELETE * by


def align(codes: str, target: str, cap: int, tail: bool = True) -> tuple[int, str] | None:
    """Cheapest edits of turns to a role string and the ASCII-least audit of that cost; None if dearer than ``cap``.

    ``codes``: a letter per turn, its role's initial (o: another), a capital if
    it's truncated, x if it must go. ``tail``: whether insertions may end the audit.
    """
    n, m = len(codes), len(target)
    lo, hi = 0, 0  # diagonals j - i inside the band
    while _bound(lo - 1) + _bound(m - n - lo + 1) <= cap:
        lo -= 1
    while _bound(hi + 1) + _bound(m - n - hi - 1) <= cap:
        hi += 1
    if _bound(m - n) > cap or not lo <= m - n <= hi:
        return None
    rows: list[dict[int, int]] = [{} for _ in range(n + 1)]  # cost from (turn i, target j) to the end
    for i in range(n, -1, -1):
        row, below = rows[i], rows[i + 1] if i < n else {}
        code = codes[i] if i < n else "x"
        stay = TRUNCATED if code.isupper() else 0
        letter = code.lower()
        for j in range(min(m, i + hi), max(0, i + lo) - 1, -1):
            best = 0 if i == n and j == m else _NEVER
            if i < n:
                best = below.get(j, _NEVER) + DELETE
            if j < m:
                role = target[j]
                if role != "s" and (tail or i < n):
                    best = min(best, row.get(j + 1, _NEVER) + INSERT)
                if letter == role:
                    best = min(best, below.get(j + 1, _NEVER) + stay)
                elif letter != "x" and role != "s":
                    best = min(best, below.get(j + 1, _NEVER) + stay + REROLE)
            if best <= cap:
                row[j] = best
    total = rows[0].get(0)
    if total is None:
        return None
    audit, i, j, left = [], 0, 0, total
    while i < n or j < m:  # letters in ASCII order: D I K R
        code = codes[i] if i < n else "x"
        stay = TRUNCATED if code.isupper() else 0
        if i < n and rows[i + 1].get(j) == left - DELETE:
            audit.append("D")
            i, left = i + 1, left - DELETE
        elif j < m and target[j] != "s" and (tail or i < n) and rows[i].get(j + 1) == left - INSERT:
            audit.append("I")
            j, left = j + 1, left - INSERT
        elif code.lower() == target[j]:
            audit.append("K")
            i, j, left = i + 1, j + 1, left - stay
        else:
            audit.append("R")
            i, j, left = i + 1, j + 1, left - stay - REROLE
    return total, "".join(audit)


def _best(codes: str, targets: Iterator[str], tail: bool) -> tuple[int, str] | None:
    """Least (cost, audit) over targets that come in order of their bounds."""
    best = None
    stay = len(codes) - codes.count("x")
    gone = DELETE * codes.count("x")
    for target in targets:
        if best and gone + _bound(len(target) - stay) > best[0]:
            break
        # without an incumbent: the price of deleting all and inserting all
        got = align(codes, target, best[0] if best else DELETE * len(codes) + INSERT * len(target), tail)
        if got and (best is None or got < best):
            best = got
    return best


def _targets(codes: str, head: str, first: str, odd: bool, least: int) -> Iterator[str]:
    """``head`` and alternating strings from ``first``, of odd or even length from ``least`` on, nearest lengths first."""
    other = "a" if first == "u" else "u"
    want = len(codes) - codes.count("x") - len(head)
    longest = 2 * len(codes) + 4
    lengths = [n for n in range(least, longest) if n % 2 == odd]
    for n in sorted(lengths, key=lambda n: _bound(n - want)):
        yield head + (first + other) * (n // 2) + first * (n % 2)


@lru_cache(maxsize=100_000)
def repair(codes: str) -> tuple[int, str]:
    """Least cost and audit of a whole conversation."""
    found = [_best(codes, iter([""]), True), _best(codes, _targets(codes, "", "u", False, 2), True)]
    if "s" in codes.lower():
        found.append(_best(codes, _targets(codes, "s", "u", False, 2), True))
    return min(f for f in found if f)


@lru_cache(maxsize=20_000)
def segments(codes: str) -> list[tuple[int, int, int, str]]:
    """(place before, place after, least cost, audit) of a block of turns; the audits end with a turn."""
    none = _best(codes, iter([""]), False)
    u_odd, u_even = (_best(codes, _targets(codes, "", "u", odd, 2 - odd), False) for odd in (True, False))
    a_odd, a_even = (_best(codes, _targets(codes, "", "a", odd, 2 - odd), False) for odd in (True, False))
    out = [(START, START, none), (START, USER, u_odd), (START, ASSISTANT, u_even), (SYSTEM, SYSTEM, none),
           (SYSTEM, USER, u_odd), (SYSTEM, ASSISTANT, u_even), (USER, USER, none), (USER, USER, a_even),
           (USER, ASSISTANT, a_odd), (ASSISTANT, ASSISTANT, none), (ASSISTANT, ASSISTANT, u_even), (ASSISTANT, USER, u_odd)]
    if "s" in codes.lower():
        out += [(START, SYSTEM, _best(codes, iter(["s"]), False)),
                (START, USER, _best(codes, _targets(codes, "s", "u", True, 1), False)),
                (START, ASSISTANT, _best(codes, _targets(codes, "s", "u", False, 2), False))]
    least: dict[tuple[int, int], tuple[int, str]] = {}
    for before, after, got in out:
        if got and ((before, after) not in least or got < least[before, after]):
            least[before, after] = got
    return [(before, after, *got) for (before, after), got in sorted(least.items())]


def chain(blocks: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[tuple[int, str]]]:
    """Least cost of a conversation in blocks, and per block the place before it and its audit."""
    cost = {place: INSERT * len(end) for place, end in _ENDING.items()}
    steps: list[dict[int, tuple[int, str, int]]] = []
    for options in reversed(blocks):
        step: dict[int, tuple[int, str, int]] = {}
        for before, after, c, audit in options:
            if after in cost:
                new = (c + cost[after], audit, after)
                if before not in step or new < step[before]:
                    step[before] = new
        steps.append(step)
        cost = {before: s[0] for before, s in step.items()}
    place, path = START, []
    for step in reversed(steps):
        _, audit, after = step[place]
        path.append((place, audit))
        place = after
    path[-1] = (path[-1][0], path[-1][1] + _ENDING[place])
    return cost[START], path


def repaired_lines(turns: list[tuple[str, str]], audit: str, place: int = START) -> list[str]:
    """``role:text`` of each turn of the repaired conversation."""
    out, i = [], 0
    for edit in audit:
        if edit == "D":
            i += 1
            continue
        role = "assistant" if place == USER else "user"
        if edit == "I":
            out.append(f"{role}:")
        else:
            own, text = turns[i]
            i += 1
            out.append(f"{own if edit == 'K' else role}:{text}")
            if edit == "K" and place == START and own[:1] == "s":
                place = SYSTEM
                continue
        place = ASSISTANT if role == "assistant" else USER
    return out


# ------------------------------------------------------------------- in Spark


def fault(text: str, seen: bool) -> str:
    """blank, duplicate, truncated or an empty string: the first fault of a turn."""
    end = text.rstrip(_SPACE)
    return "blank" if not end else "duplicate" if seen else "truncated" if end[-1] not in ".!?" else ""


def _code(role: str, what: str) -> str:
    if what in ("blank", "duplicate"):
        return "x"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
    return letter.upper() if what == "truncated" else letter


class _Run:
    """Turns of one conversation, as one partition gives them."""

    def __init__(self, conv, first: bool):
        self.conv, self.first, self.begun = conv, first, False
        self.start()

    def start(self) -> None:
        self.turns: list[tuple[str, str]] = []
        self.codes: list[str] = []
        self.faults: list[str] = []

    def add(self, role: str, text: str, seen: bool) -> None:
        what = fault(text, seen)
        self.turns.append((role, text))
        self.faults.append(what)
        self.codes.append(_code(role, what))

    def row(self, part: int, seq: int, whole: bool) -> dict:
        """A repaired conversation, or a block with its options."""
        initials = [r[:1] for r, _ in self.turns]
        out = {"c": self.conv, "part": part, "seq": seq, "whole": whole,
               **{k: self.faults.count(k) for k in ("blank", "duplicate", "truncated")},
               "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))}
        codes = "".join(self.codes)
        if whole:
            out["cost"], out["audit"] = repair(codes)
            out["repaired_sha256"] = hashlib.sha256("\n".join(repaired_lines(self.turns, out["audit"])).encode()).hexdigest()
        else:
            out |= {"first": initials[0], "last": initials[-1],
                    "turns": [{"role": r, "text": t} for r, t in self.turns],
                    "options": [dict(zip(("before", "after", "cost", "audit"), o)) for o in segments(codes)]}
        self.begun = True
        self.start()
        return out


def _kept(conv: str) -> str:
    return (f"c {conv}, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, "
            "cost long, audit string, repaired_sha256 string, first string, last string, "
            "turns array<struct<role string, text string>>, "
            "options array<struct<before int, after int, cost long, audit string>>")


def _schema(conv: pa.DataType) -> pa.Schema:
    n, s = pa.int64(), pa.string()
    option = pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", n), ("audit", s)])
    return pa.schema([("c", conv), ("part", pa.int32()), ("seq", pa.int32()), ("whole", pa.bool_()), ("blank", n),
                      ("duplicate", n), ("truncated", n), ("illegal", n), ("cost", n), ("audit", s), ("repaired_sha256", s),
                      ("first", s), ("last", s), ("turns", pa.list_(pa.struct([("role", s), ("text", s)]))),
                      ("options", pa.list_(option))])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired conversations and blocks of the others, from turns in order."""
    part, seq = TaskContext.get().partitionId(), count()
    run: _Run | None = None
    out: list[dict] = []
    schema = None
    for b in batches:
        schema = schema or _schema(b.schema.field("c").type)
        for c, r, t, m, later in zip(*(b[k].to_pylist() for k in ("c", "r", "x", "m", "later"))):
            if run is None or c != run.conv:
                if run is not None and run.turns:
                    out.append(run.row(part, next(seq), whole=not (run.first or run.begun)))
                run = _Run(c, first=run is None)
            for i in range(m):
                if len(run.turns) == BLOCK:
                    out.append(run.row(part, next(seq), whole=False))
                    if len(out) >= 1024:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out = []
                run.add(r, t, later or i > 0)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
    if run is not None:  # the last conversation may go on in the next partition
        yield pa.RecordBatch.from_pylist([run.row(part, next(seq), whole=False)], schema)


def _joined(t: pa.Table) -> pa.Table:
    """One row per conversation from its blocks."""
    rows = sorted(t.drop_columns(["c"]).to_pylist(), key=lambda r: (r["part"], r["seq"]))
    cost, path = chain([[(o["before"], o["after"], o["cost"], o["audit"]) for o in r["options"]] for r in rows])
    out = {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    out |= {"cost": cost, "audit": "".join(a for _, a in path),
            "steps": [{"part": r["part"], "seq": r["seq"], "place": p, "audit": a} for r, (p, a) in zip(rows, path)]}
    kind = _schema(pa.int64())
    step = pa.struct([("part", pa.int32()), ("seq", pa.int32()), ("place", pa.int32()), ("audit", pa.string())])
    names = ["blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    cols = [t["c"].slice(0, 1), *[pa.array([out[k]], kind.field(k).type) for k in names], pa.array([out["steps"]], pa.list_(step))]
    return pa.table(cols, names=["c", *names, "steps"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The repaired text of each block."""
    for b in batches:
        lines = ["\n".join(repaired_lines([(x["role"], x["text"]) for x in turns], audit, place))
                 for turns, audit, place in zip(*(b[k].to_pylist() for k in ("turns", "audit", "place")))]
        yield pa.RecordBatch.from_arrays([b["c"], b["part"], b["seq"], pa.array(lines, pa.string())], names=["c", "part", "seq", "piece"])


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the pieces of each conversation, which come in order; only its state is held."""
    conv, digest, begun, kind = None, None, False, None
    for b in batches:
        kind = b.schema.field("c").type
        for c, piece in zip(b["c"].to_pylist(), b["piece"].to_pylist()):
            if digest is None or c != conv:
                if digest is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["c", "repaired_sha256"])
                conv, digest, begun = c, hashlib.sha256(), False
            if piece:
                digest.update((("\n" if begun else "") + piece).encode())
                begun = True
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([conv], kind), pa.array([digest.hexdigest()])], names=["c", "repaired_sha256"])


def _spaced(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def _ordered(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, t, r, x, m (times the row occurs), later (role and text came earlier), once per distinct row."""
    g = turns.select(F.col(conv).alias("c"), F.col(turn).alias("t"), _spaced(role).alias("r"), _spaced(text).alias("x"))
    g = written(g.groupBy("c", "t", "r", "x").agg(F.count(F.lit(1)).alias("m")), "turns")
    key = F.struct(F.col("t").isNotNull(), F.col("t"))
    g = g.withColumn("h", F.unhex(F.sha2(F.col("x").cast("binary"), 256)))
    again = g.groupBy("c", "r", "h").agg(F.min(key).alias("k"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    same = F.col("g.c").eqNullSafe(F.col("a.c")) & (F.col("g.r") == F.col("a.r")) & (F.col("g.h") == F.col("a.h"))
    later = F.coalesce(key > F.col("a.k"), F.lit(False))
    return g.alias("g").join(again.alias("a"), same, "left").select("g.c", "g.t", "g.r", "g.x", "g.m", later.alias("later"))


def repairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = _ordered(turns, conv, turn, role, text)
    order = [F.col(c).asc_nulls_first() for c in ("c", "t", "r", "x")]
    kind = turns.schema[conv].dataType.simpleString()
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = written(rows.select("c", "r", "x", "m", "later").mapInArrow(_blocks, _kept(kind)), "turn-blocks")
    done = ["c", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    parts = blocks.filter(~F.col("whole"))
    joined = parts.select("c", "part", "seq", "blank", "duplicate", "truncated", "illegal", "first", "last", "options")
    joined = written(joined.groupBy("c").applyInArrow(_joined, (
        f"c {kind}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
        "steps array<struct<part int, seq int, place int, audit string>>")), "turn-chains")
    step = joined.select(F.explode("steps").alias("s")).select("s.*")
    pieces = parts.select("c", "part", "seq", "turns").join(step, ["part", "seq"])
    pieces = pieces.select("c", "part", "seq", "turns", "audit", "place").mapInArrow(_pieces, f"c {kind}, part int, seq int, piece string")
    hashes = pieces.repartition("c").sortWithinPartitions("c", "part", "seq").mapInArrow(_hashes, f"c {kind}, repaired_sha256 string")
    same = F.col("j.c").eqNullSafe(F.col("h.c"))
    chained = joined.alias("j").join(hashes.alias("h"), same).select(*[f"j.{c}" for c in done[:-1]], "h.repaired_sha256")
    turn_of = turns.select(F.col(conv).alias("k"), F.col(turn).alias("t")).distinct()
    gaps = turn_of.groupBy("k").agg(F.coalesce(F.max("t") - F.min("t") + 1 - F.count("t"), F.lit(0)).cast("long").alias("gaps"))
    out = blocks.filter("whole").select(*done).unionByName(chained)
    return out.join(gaps, F.col("c").eqNullSafe(F.col("k"))).select(F.col("c").alias(conv), "gaps", *done[1:])


def with_all_ids(found: DataFrame, turns: DataFrame, conv: str = "conv_id") -> DataFrame:
    """:func:`repairs` with a row of zeros for every id of ``turns`` that it doesn't have."""
    ids = turns.select(F.col(conv).alias("__id")).distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return ids.join(found, F.col("__id").eqNullSafe(F.col(conv)), "left").select(
        F.col("__id").alias(conv), *numbers, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Turns with the test's faults, by crc32 of ``conv:turn`` modulo 20.

    0: the turn is lost, 1: its text is emptied, 2: it loses its ``.!?``, 3: it
    comes twice, 4: its role is user. NULL counts as one space.
    """
    k = F.crc32(F.concat(_spaced(conv), F.lit(":"), _spaced(turn)).cast("binary")) % 20
    d = turns.select(F.col(conv), F.col(turn), _spaced(role).alias("r"), _spaced(text).alias("x"), k.alias("k")).filter("k <> 0")
    x = F.when(F.col("k") == 1, F.lit("")).when(F.col("k") == 2, F.regexp_replace("x", "[.!?]", "")).otherwise(F.col("x"))
    d = d.select(conv, turn, F.when(F.col("k") == 4, F.lit("user")).otherwise(F.col("r")).alias(role), x.alias(text),
                 F.explode(F.when(F.col("k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("__copy"))
    return d.drop("__copy")
