"""Repair of a conversation's structure: an optional system turn, then user and assistant in turn, to the end.

Per-row work (blank and truncated texts, role initials) and all moves of texts are Spark's. A conversation's turns are
then planned as codes of a few bytes, without texts: they are aligned to the alternating grammar string by the
Wagner-Fischer recurrence, from the end backwards, so one table has the cost of every feasible length in its first row
(and in the row after each system turn that could open the conversation). Only cells within Ukkonen's band are filled:
with m turns and r symbols left, what is still to pay is at least 2 (m - r) or 5 (r - m), which the incumbent (the cost of a
plain walk) must cover. The cheapest lengths are traced, each by its least letters, and of these audits the least wins.
A conversation whose band would take more than ``CELLS`` numbers is planned over the two phases of the grammar instead of
its lengths, in time and memory of its turns; the costs and audits are the same.

Edits: K keeps a turn, R gives it the role of its place (1), D deletes it (2; blank and repeated turns must go), I
inserts a turn without text (5); a truncated turn that stays adds 5.

Defined cases: null roles and texts are one space; turns are taken by number, null ones first, those of equal number by
role and text; a null id is a conversation of its own; a role without characters can't be kept; equal rows stay apart
(the second one is a duplicate); an empty table gives no rows; other columns are ignored. A conversation's codes, some 50
bytes a turn, are one array value, so it may have some thirty million turns; its texts are never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lacuna.llm.common import written

#: The costs of edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
FAR = 1 << 40
CELLS = 20_000_000
SOLID = r"[^\x20\x09-\x0D]"


def filled(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(" "))


def substitution(roles: np.ndarray, stay: np.ndarray, cut: np.ndarray, to: str) -> np.ndarray:
    """What it costs each turn to stand for a symbol."""
    return np.where(stay, np.where(roles == to, 0, REROLE) + TRUNCATED * cut, FAR)


def incumbent(roles: np.ndarray, stay: np.ndarray, cut: np.ndarray) -> int:
    """The cost of a plain walk: turns that may stay and aren't truncated stand for the next symbol, all others go."""
    best = FAR
    for strict in (True, False):  # turns with another role go as well, or are given the role
        cost, want, paid = 0, "su", 0
        for role, good in zip(roles.tolist(), (stay & ~cut).tolist(), strict=True):
            if not good or strict and role not in want:
                cost += DELETE
                continue
            if role == "s" and want == "su":
                want = "u"
                paid = 0
                continue
            paid = int(role != want[-1])
            cost += paid
            want = "a" if want[-1] == "u" else "u"
        if want == "a":
            cost += INSERT
        elif want == "u" and not any(r != "s" and g for r, g in zip(roles.tolist(), (stay & ~cut).tolist(), strict=True)):
            cost += 2 * INSERT  # a system turn alone
        best = min(best, cost)
    return min(best, DELETE * len(roles))


def aligned(roles: np.ndarray, stay: np.ndarray, cut: np.ndarray) -> tuple[int, str]:
    """The least cost and, of the audits with that cost, the least."""
    n = len(roles)
    most = incumbent(roles, stay, cut)
    below, above = most // DELETE, most // INSERT
    width = below + above + 2
    if (n + 1) * width > CELLS:
        return by_phase(roles, stay, cut)
    lengths = np.arange(width)
    by_symbol = np.stack([substitution(roles, stay, cut, "u"), substitution(roles, stay, cut, "a")])
    table, low = np.full((n + 1, width), FAR, np.int64), np.maximum(0, n - np.arange(n + 1) - below)
    table[n] = INSERT * lengths
    for i in range(n - 1, -1, -1):
        left = low[i] + lengths  # the symbols left in this row's cells
        shift = low[i] - low[i + 1]  # 0 or 1
        old = table[i + 1]
        own = DELETE + (np.append(old[1:], FAR) if shift else old)
        before = old if shift else np.append(FAR, old[:-1])  # one symbol less
        own = np.minimum(own, np.where(left > 0, by_symbol[left % 2, i] + before, FAR))
        table[i] = np.minimum(np.minimum.accumulate(own - INSERT * left) + INSERT * left, FAR)

    def at(i: int, r: int) -> int:
        k = r - low[i]
        return int(table[i, k]) if 0 <= k < width else FAR

    starts = [(0, "", r) for r in range(0, low[0] + width, 2)]
    spent = [at(0, r) for _, _, r in starts]
    for p in np.nonzero((roles == "s") & stay)[0].tolist():
        if DELETE * p > most:
            break
        for r in range(max(2, int(low[p + 1]) // 2 * 2), int(low[p + 1]) + width, 2):
            starts.append((p + 1, "D" * p + "K", r))
            spent.append(DELETE * p + TRUNCATED * int(cut[p]) + at(p + 1, r))
    least = min(spent)

    def traced(i: int, audit: str, r: int) -> str:
        letters = [audit]
        while i < n or r:
            now = at(i, r)
            if i < n and DELETE + at(i + 1, r) == now:
                letters.append("D")
                i += 1
            elif r and INSERT + at(i, r - 1) == now:
                letters.append("I")
                r -= 1
            else:
                letters.append("K" if roles[i] == "au"[r % 2 == 0] else "R")
                i, r = i + 1, r - 1
        return "".join(letters)

    return least, min(traced(*s) for s, cost in zip(starts, spent, strict=True) if cost == least)


def by_phase(roles: np.ndarray, stay: np.ndarray, cut: np.ndarray) -> tuple[int, str]:
    """As ``aligned``, over what comes next: the start (0), a user (1) or the end, an assistant (2), a user after the system turn (3)."""
    n = len(roles)
    user, assistant = substitution(roles, stay, cut, "u").tolist(), substitution(roles, stay, cut, "a").tolist()
    system = np.where((roles == "s") & stay, TRUNCATED * cut, FAR).tolist()
    cost = np.zeros((n + 1, 4), np.int64)
    cost[n] = (0, 0, INSERT, 2 * INSERT)
    for i in range(n - 1, -1, -1):
        start, u, a, first = cost[i + 1].tolist()
        u_own, a_own = min(DELETE + u, user[i] + a), min(DELETE + a, assistant[i] + u)
        u_now, a_now = min(u_own, INSERT + a_own), min(a_own, INSERT + u_own)
        cost[i] = (min(DELETE + start, INSERT + a_now, user[i] + a, system[i] + first), u_now, a_now, min(DELETE + first, INSERT + a_now, user[i] + a))
    i, phase, letters = 0, 0, []
    after = (2, 2, 1, 2)
    while i < n or cost[i, phase]:
        now = cost[i, phase]
        if i < n and DELETE + cost[i + 1, phase] == now:
            letters.append("D")
            i += 1
        elif INSERT + cost[i, after[phase]] == now:
            letters.append("I")
            phase = after[phase]
        else:
            if phase == 0 and system[i] + cost[i + 1, 3] == now:
                letters.append("K")
                phase = 3
            else:
                letters.append("K" if roles[i] == ("a" if phase == 2 else "u") else "R")
                phase = after[phase]
            i += 1
    return int(cost[0, 0]), "".join(letters)


def edits(audit: str, roles: np.ndarray) -> tuple[list[int], list[str | None]]:
    """Of each turn that the audit leaves: its place before (0 if inserted), and its role if it was given one."""
    places, given, i, want = [], [], 0, None
    for letter in audit:
        i += letter != "I"
        if letter == "D":
            continue
        if want is None and letter == "K" and roles[i - 1] == "s":
            want = "user"
            new = None
        else:
            new = None if letter == "K" else want or "user"
            want = "assistant" if want in (None, "user") else "user"
        places.append(0 if letter == "I" else i)
        given.append(new)
    return places, given


PLANNED = "key string, n_blank long, n_duplicate long, n_truncated long, n_illegal long, cost long, audit string, places array<int>, given array<string>"


def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation's codes."""
    for b in batches:
        out: list[list] = [[] for _ in range(9)]
        for key, turns in zip(b["key"].to_pylist(), b["turns"], strict=True):
            turns = turns.values
            code = np.array(turns.field("code").to_pylist(), "U2")
            roles, kind = code.astype("U1"), np.array([c[1] for c in code.tolist()], "U1")
            seen = turns.field("digest").dictionary_encode().indices.to_numpy()
            again = np.ones(len(seen), bool)
            again[np.unique(seen, return_index=True)[1]] = False
            blank = kind == "b"
            again &= ~blank
            cut = (kind == "t") & ~again
            cost, audit = aligned(roles, ~(blank | again), cut)
            pairs = np.char.add(roles[:-1], roles[1:])
            row = (key, blank.sum(), again.sum(), cut.sum(), (~np.isin(pairs, ("su", "ua", "au"))).sum(), cost, audit, *edits(audit, roles))
            for column, value in zip(out, row, strict=True):
                column.append(value)
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.list_(pa.int32()), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[c.split()[0] for c in PLANNED.split(", ")])


def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of each key's lines, which come in order: a line at a time."""
    key, state = None, None
    for b in batches:
        keys, sums = [], []
        for now, line in zip(b["key"].to_pylist(), b["line"].to_pylist(), strict=True):
            if now == key:
                state.update(b"\n")
            else:
                if state:
                    keys.append(key)
                    sums.append(state.hexdigest())
                key, state = now, hashlib.sha256()
            state.update(line.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], names=["key", "sha256"])
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "sha256"])


def numbered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """``key, conv, place, turn, role, text, code, digest``: the turns in order; a code is the role's initial and b (blank), t (truncated) or w (whole)."""
    role, text = F.col("role"), F.col("text")
    own = turns.select(F.to_json(F.struct(F.col(id_col).alias("id"))).alias("key"), F.col(id_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    first = F.substring("role", 1, 1)
    kind = F.when(~text.rlike(SOLID), "b").when(text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "w").otherwise("t")
    own = own.withColumn("code", F.concat(F.when(first.isin("s", "u", "a"), first).otherwise("-"), kind))
    own = own.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)))
    return own.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.asc_nulls_first("turn"), "role", "text")))


def plans(rows: DataFrame) -> DataFrame:
    """``key, conv, n_turns, gaps`` and what was planned, from numbered turns; texts are not read."""
    whole = rows.groupBy("key").agg(F.first("conv").alias("conv"), F.sort_array(F.collect_list(F.struct("place", "turn", "code", "digest"))).alias("turns"))
    numbers = F.array_distinct(F.filter(F.col("turns.turn"), lambda x: x.isNotNull()))
    gaps = F.when(F.size(numbers) > 0, F.array_max(numbers) - F.array_min(numbers) + 1 - F.size(numbers)).otherwise(0)
    one = whole.select("key", "conv", gaps.cast("long").alias("gaps"), F.size("turns").cast("long").alias("n_turns"), F.transform("turns", lambda x: F.struct(x["code"].alias("code"), x["digest"].alias("digest"))).alias("turns"))
    one = written(one, "codes")
    return one.drop("turns").join(one.select("key", "turns").mapInArrow(planned, PLANNED), "key")


def repair(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """``key, conv, n_turns, gaps, n_blank, n_duplicate, n_truncated, n_illegal, cost, audit``: one row for each conversation;
    and ``key, conv, place, was, role, text``: the repaired turns (was: the turn's place before, 0 if it was inserted)."""
    rows = written(numbered(turns, id_col, turn_col, role_col, text_col), "turns")
    plan = written(plans(rows), "plans")
    left = plan.select("key", "conv", F.posexplode(F.arrays_zip("places", "given")).alias("k", "e")).select("key", "conv", (F.col("k") + 1).alias("place"), F.col("e.places").alias("was"), F.col("e.given").alias("given"))
    texts = rows.select("key", F.col("place").alias("was"), F.col("role").alias("own"), "text")
    repaired = left.join(texts, ["key", "was"], "left").select("key", "conv", "place", "was", F.coalesce("given", "own").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return plan.drop("places", "given"), repaired


def repaired_hash(repaired: DataFrame) -> DataFrame:
    """``key, sha256``: of each conversation's ``role:text`` lines."""
    lines = repaired.select("key", "place", F.concat_ws(":", "role", "text").alias("line"))
    return lines.repartition("key").sortWithinPartitions("key", "place").select("key", "line").mapInArrow(hashed, "key string, sha256 string")
