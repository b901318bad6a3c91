"""Repair of conversation structure by cheapest edits.

A row is blank (no word), a duplicate (role and text seen earlier in its conversation), truncated (it does not end in ``.``,
``!`` or ``?``) or sound; the first fault counts. Keeping a row costs 0, giving it role user or assistant 1, deleting it 2
(a must for blank and duplicate rows), inserting an empty user or assistant row 5, and every truncated row that is not deleted 5
more. The rows that remain must read ``(s?(ua)+)?`` by the initials of their roles.

Edits form a lattice: a node is (rows consumed, last role kept). ``cheapest`` runs Dijkstra from both ends: nodes leave the
forward and the reverse heap by (cost, rows consumed, audit), until no path can cost as little as the best one that both sides
together have found. Then every cheapest path crosses from a node settled forward to one settled in reverse, and
the least concatenated audit of all these crossings is taken. At equal cost no audit to a node is a prefix of another, so
least parts make a least whole. For the same reason long conversations are cut into segments of ``SEGMENT`` rows, each
solved between all its end states and joined by (cost, audit).

Spark does the rest. Texts are digested in SQL; copies are found by a grouped count of digests, so a text that fills a third of
a table is summed before it is shuffled. One sorted shuffle of rows without texts gives every conversation's fault string, one
character a row, which its task turns into audit and counts. A second one streams texts behind their audit into SHA-256. No task holds
more of a conversation than its fault string and audit; a digest of all its texts has to pass through one task by its nature.

Only the four named columns are read. A null in any of them counts as one space (a null turn sorts first and takes no part in gaps);
a null conv_id is a conversation of its own. Rows of equal turn are ordered by role and text digest. Repeated rows are
duplicates of each other. An empty table gives an empty table.
"""

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from groundsieve.llm.common import SPACE, written

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
CUT_SHORT = 5  # a truncated row that stays
SEGMENT = 512
#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: A row's code: role initial (o: any other), in upper case where truncated; x: blank or duplicate, whatever its role.
Label = tuple[int, str]  # cost and audit


def _steps(code: str, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row."""
    out = [(*DELETE, state)]
    if code != "x":
        more = CUT_SHORT * code.isupper()
        if (to := _NEXT.get((state, code.lower()))) is not None:
            out.append((KEEP[0], KEEP[1] + more, to))
        for role in "ua":
            if role != code.lower() and (to := _NEXT.get((state, role))) is not None:
                out.append((REROLE[0], REROLE[1] + more, to))
    return out


_CODES = "suaoSUAOx"
_FORWARD = {c: [_steps(c, q) for q in range(4)] for c in _CODES}
_REVERSE = {c: [[(letter, cost, p) for p in range(4) for letter, cost, to in _FORWARD[c][p] if to == q] for q in range(4)] for c in _CODES}
_INSERTS = [[(*INSERT, to) for role in "ua" if (to := _NEXT.get((q, role))) is not None] for q in range(4)]
_UNINSERTS = [[(*INSERT, p) for p in range(4) for _, _, to in _INSERTS[p] if to == q] for q in range(4)]


def cheapest(codes: str, first: int, lasts: tuple[int, ...]) -> Label | None:
    """Least (cost, audit) from ``first`` before the rows to any of ``lasts`` after them; None where no edits lead there."""
    n = len(codes)
    ahead, behind = [(0, 0, "", first)], []
    for q in lasts:
        heappush(behind, (0, -n, "", q))
    done_f: dict[tuple[int, int], Label] = {}
    done_b: dict[tuple[int, int], Label] = {}
    best = None  # least cost of a whole path so far

    def meet(cost: int) -> None:
        nonlocal best
        best = cost if best is None else min(best, cost)

    while ahead and behind and (best is None or ahead[0][0] + behind[0][0] <= best):
        if ahead[0][0] <= behind[0][0]:
            cost, i, audit, q = heappop(ahead)
            if (i, q) in done_f:
                continue
            done_f[i, q] = cost, audit
            if (i, q) in done_b:
                meet(cost + done_b[i, q][0])
            for letter, c, to in _INSERTS[q]:
                if (i, to) not in done_f:
                    heappush(ahead, (cost + c, i, audit + letter, to))
                if (i, to) in done_b:
                    meet(cost + c + done_b[i, to][0])
            if i < n:
                for letter, c, to in _FORWARD[codes[i]][q]:
                    if (i + 1, to) not in done_f:
                        heappush(ahead, (cost + c, i + 1, audit + letter, to))
                    if (i + 1, to) in done_b:
                        meet(cost + c + done_b[i + 1, to][0])
        else:
            cost, back, audit, q = heappop(behind)
            i = -back
            if (i, q) in done_b:
                continue
            done_b[i, q] = cost, audit
            if (i, q) in done_f:
                meet(cost + done_f[i, q][0])
            for letter, c, p in _UNINSERTS[q]:
                if (i, p) not in done_b:
                    heappush(behind, (cost + c, -i, letter + audit, p))
                if (i, p) in done_f:
                    meet(cost + c + done_f[i, p][0])
            if i:
                for letter, c, p in _REVERSE[codes[i - 1]][q]:
                    if (i - 1, p) not in done_b:
                        heappush(behind, (cost + c, -(i - 1), letter + audit, p))
                    if (i - 1, p) in done_f:
                        meet(cost + c + done_f[i - 1, p][0])
    if best is None:
        return None
    audits = []
    for (i, q), (cost, audit) in done_f.items():
        if (i, q) in done_b and cost + done_b[i, q][0] == best:
            audits.append(audit + done_b[i, q][1])
        steps = [(i, s) for s in _INSERTS[q]] + ([(i + 1, s) for s in _FORWARD[codes[i]][q]] if i < n else [])
        for at, (letter, c, to) in steps:
            if (at, to) in done_b and cost + c + done_b[at, to][0] == best:
                audits.append(audit + letter + done_b[at, to][1])
    return best, min(audits)


@lru_cache(maxsize=100_000)
def _short(codes: str) -> Label:
    return cheapest(codes, START, (START, ASSISTANT))


def repaired(codes: str, segment: int = SEGMENT) -> Label:
    """Least (cost, audit) of a whole conversation's row codes."""
    if len(codes) <= segment:
        return _short(codes)
    reached: dict[int, Label] = {START: (0, "")}
    for at in range(0, len(codes), segment):
        part, last = codes[at : at + segment], at + segment >= len(codes)
        after: dict[int, Label] = {}
        for q, (cost, audit) in reached.items():
            for to in ((START, ASSISTANT) if last else range(4)):
                if (way := cheapest(part, q, (to,))) is not None:
                    label = cost + way[0], audit + way[1]
                    after[to] = min(after.get(to, label), label)
        reached = after
    return min(reached.values())


def damaged(rows: DataFrame) -> DataFrame:
    """A damaged copy of a conversation table: conv_id, turn, role, text and ``dropped``, which marks the rows taken out."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")), F.lit(20))
    base = rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), fault.alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return base.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _code(role: Column, text: Column) -> Column:
    """b: blank; else the role's initial (o: any other than s, u, a), in upper case where the text is cut short."""
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    whole = text.rlike(rf"[.!?][{SPACE}]*\z")
    return F.when(~text.rlike(f"[^{SPACE}]"), "b").when(whole, initial).otherwise(F.upper(initial))


_LEGAL = {"su", "ua", "au"}


def plans(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation; rows marked ``dropped`` only name theirs."""
    there = lambda c: F.when(~F.col("dropped"), c)
    slim = rows.select("conv_id", *[there(F.col(c)).alias(c) for c in ("turn", "role")], there(F.md5(F.col("text").cast("binary"))).alias("digest"),
                       there(_code(F.col("role"), F.col("text"))).alias("code"))
    same = slim.groupBy("conv_id", "turn", "role", "digest", "code").agg(F.count("*").alias("n")).repartition("conv_id")
    seen = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy("turn")) > 1
    told = same.withColumn("again", seen).select("conv_id", "turn", "role", "digest", "code", "n", "again").sortWithinPartitions("conv_id", "turn", "role", "digest")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, conv, codes, illegal, before, turns = [], None, None, 0, "", []

        def close() -> None:
            text = "".join(codes)
            cost, audit = repaired(text.replace("b", "x").replace("d", "x"))
            gaps = turns[1] - turns[0] + 1 - turns[2] if turns else 0
            done.append((conv, gaps, text.count("b"), text.count("d"), sum(map(text.count, "SUAO")), illegal, cost, audit))

        for b in batches:
            columns = [b[c].to_pylist() for c in ("conv_id", "turn", "role", "code", "n", "again")]
            for ident, turn, role, code, n, again in zip(*columns):
                if codes is None or ident != conv:
                    if codes is not None:
                        close()
                    conv, codes, illegal, before, turns = ident, [], 0, "", []
                if code is None:
                    continue
                codes.append(code * n if code == "b" else ("d" if again else code) + "d" * (n - 1))
                initial = role[:1]
                illegal += n - 1 + (bool(before) and before + initial not in _LEGAL)
                before = initial or "-"  # an empty role is a role
                if turn is not None:
                    turns = [turns[0], turn, turns[2] + (turn != turns[1])] if turns else [turn, turn, 1]
            yield _batch(done, _PLAN)
            done.clear()
        if codes is not None:
            close()
        yield _batch(done, _PLAN)

    return told.mapInArrow(fold, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


_PLAN = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


def edited(rows: DataFrame, planned: DataFrame) -> DataFrame:
    """The rows of every repaired conversation in order: conv_id, number (from 0), role, text. ``number`` -1 names a conversation
    and carries its audit as text."""
    texts = rows.where(~F.col("dropped")).select("conv_id", "turn", "role", "text", F.md5(F.col("text").cast("binary")).alias("digest"), F.lit(1).alias("kind"))
    audits = planned.select("conv_id", F.col("audit").alias("text"), F.lit(0).alias("kind"))
    both = texts.unionByName(audits, allowMissingColumns=True).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    schema = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, state, number = None, "", 0, START, 0

        def put(out: list, role: str, text: str) -> None:
            nonlocal state, number
            out.append((conv, number, role, text))
            state, number = _NEXT[state, role[:1]], number + 1

        def due() -> str:
            return "assistant" if state == USER else "user"

        def inserted(out: list) -> None:
            nonlocal at
            while at < len(audit) and audit[at] == INSERT[0]:
                put(out, due(), "")
                at += 1

        for b in batches:
            out: list[tuple] = []
            for ident, kind, role, text in zip(*[b[c].to_pylist() for c in ("conv_id", "kind", "role", "text")]):
                if kind == 0:
                    inserted(out)  # what is left of the conversation before
                    conv, audit, at, state, number = ident, text, 0, START, 0
                    out.append((conv, -1, None, audit))
                    continue
                inserted(out)
                letter, at = audit[at], at + 1
                if letter != DELETE[0]:
                    put(out, role if letter == KEEP[0] else due(), text)
            yield _batch(out, schema)
        out = []
        inserted(out)
        yield _batch(out, schema)

    return both.mapInArrow(edit, "conv_id long, number long, role string, text string")


def digests(edited_rows: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: of each conversation's ``role:text`` lines, joined by line feeds, as ``edited`` puts them out."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state = None, None
        for b in batches:
            out = []
            for ident, number, role, text in zip(*[b[c].to_pylist() for c in ("conv_id", "number", "role", "text")]):
                if number < 0:
                    if state is not None:
                        out.append((conv, state.hexdigest()))
                    conv, state = ident, hashlib.sha256()
                else:
                    state.update(f"{'' if number == 0 else chr(10)}{role}:{text}".encode())
            yield _batch(out, schema)
        yield _batch([] if state is None else [(conv, state.hexdigest())], schema)

    return edited_rows.mapInArrow(hashed, "conv_id long, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The written plans, and the repaired rows, of a table with conv_id, turn, role, text and ``dropped``."""
    planned = written(plans(rows))
    return planned, edited(rows, planned)
