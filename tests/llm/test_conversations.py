import hashlib
import random
import re
import zlib
from itertools import product

import pytest
from pyspark.sql import types as T

from groundsieve.llm import conversations

SCHEMA = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
FULL = re.compile(r"(s?(ua)+)?\Z")


def all_edits(codes):
    """Least (cost, audit) over every edit script with at most four inserts, by plain enumeration of states and audits."""
    best = None
    reach = {("", ""): 0}  # (roles kept, audit) -> cost

    def grow(now):
        out = dict(now)
        for _ in range(4):
            for (roles, audit), cost in list(out.items()):
                for role in "ua":
                    k = roles + role, audit + "I"
                    if re.match(r"s?(ua)*u?\Z", k[0]) and audit.count("I") < 4:
                        out[k] = min(out.get(k, 99), cost + 5)
        return out

    reach = grow(reach)
    for code in codes:
        after = {}
        for (roles, audit), cost in reach.items():
            ways = [(roles, "D", 2)]
            if code != "x":
                more = 5 * code.isupper()
                ways += [(roles + code.lower(), "K", more)] + [(roles + r, "R", 1 + more) for r in "ua"]
            for to, letter, c in ways:
                if re.match(r"s?(ua)*u?\Z", to):
                    k = to, audit + letter
                    after[k] = min(after.get(k, 99), cost + c)
        reach = grow(after)
    for (roles, audit), cost in reach.items():
        if FULL.match(roles):
            best = min(best or (99, ""), (cost, audit))
    return best


def test_cheapest_against_all_edits():
    for n in range(5):
        for codes in product("suaUAox", repeat=n):
            if n < 4 or hash(codes) % 20 == 0:
                assert conversations.repaired("".join(codes)) == all_edits("".join(codes)), codes


def plain(codes):
    """Forward dynamic programme over (cost, audit), a state at a time."""
    reached = {0: (0, "")}

    def inserts(now):
        for _ in range(3):
            for q, (cost, audit) in list(now.items()):
                for letter, c, to in conversations._INSERTS[q]:
                    now[to] = min(now.get(to, (10**9, "")), (cost + c, audit + letter))
        return now

    reached = inserts(reached)
    for code in codes:
        after = {}
        for q, (cost, audit) in reached.items():
            for letter, c, to in conversations._FORWARD[code][q]:
                after[to] = min(after.get(to, (10**9, "")), (cost + c, audit + letter))
        reached = inserts(after)
    return min(v for q, v in reached.items() if q in (0, 3))


@pytest.mark.parametrize("segment", [1, 2, 7, 512])
def test_segments_join_to_the_same_repair(segment):
    r = random.Random(segment)
    for n in [0, 1, 5, 30, 200]:
        for _ in range(5):
            codes = "".join(r.choice("suauauauaUAox") for _ in range(n))
            assert conversations.repaired(codes, segment) == plain(codes)


def expected(rows):
    """The whole contract, conversation by conversation, in plain Python."""
    out = {}
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, [])
        said = [" " if x is None else x for x in (conv, turn)]
        fault = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        by[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    for conv, found in by.items():
        found.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).hexdigest()))
        seen, codes, n = set(), "", {"b": 0, "d": 0, "t": 0}
        for _, role, text in found:
            word = re.findall("[^\x20\x09-\x0d]", text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not word:
                code, n["b"] = "x", n["b"] + 1
            elif (role, text) in seen:
                code, n["d"] = "x", n["d"] + 1
            elif word[-1] not in ".!?":
                code, n["t"] = initial.upper(), n["t"] + 1
            else:
                code = initial
            seen.add((role, text))
            codes += code
        cost, audit = plain(codes)
        turns = [t for t, _, _ in found if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(x[1][:1] + y[1][:1] not in ("su", "ua", "au") for x, y in zip(found, found[1:]))
        lines, state, at = [], "", 0
        for letter in audit:
            role, text = (None, "") if letter == "I" else found[at][1:]
            at += letter != "I"
            if letter == "D":
                continue
            role = role if letter == "K" else "assistant" if state == "u" else "user"
            lines.append(f"{role}:{text}")
            state = role[:1]
        out[conv] = (gaps, n["b"], n["d"], n["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def run(spark, rows, tmp_path):
    from groundsieve.llm.queries import op12_conversation_repair

    # extra columns whose names the operator uses itself
    wide = T.StructType([*SCHEMA, T.StructField("code", T.StringType()), T.StructField("fault", T.LongType()), T.StructField("digest", T.StringType())])
    spark.createDataFrame([(*r, "clash", 3, None) for r in rows], wide).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op12_conversation_repair(spark, str(tmp_path)).collect()}


def test_contract_on_given_rows(spark, small):
    from groundsieve.llm.queries import op12_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in op12_conversation_repair(spark, small).collect()}
    assert found == expected(rows)


def test_contract_on_odd_rows(spark, tmp_path):
    """Nulls in every column, ties, repeats, one long conversation, roles beyond the three, long texts."""
    r = random.Random(4)
    roles, texts = ["user", "assistant", "system", None, "", "tool", "unknown"], ["Yes.", "No", "", " \t", None, "Why?", "x" * 50_000 + ".", "été!", "a\nb."]
    rows = [(c, t, r.choice(roles), r.choice(texts)) for c in range(60) for t in range(r.randint(1, 9))]
    rows += [(None, None, "user", "Hi."), (None, 1, None, None), (7, None, "user", "Hi."), (7, None, "user", "Hi."), (8, 3, "user", "Hi."), (8, 3, "user", "Hi.")]
    rows += [(999, t, r.choice(["user", "assistant"]), f"{t}.") for t in range(1_500)]
    assert run(spark, rows, tmp_path) == expected(rows)


def test_conversation_without_rows(spark, tmp_path):
    dropped = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0][:3]
    found = run(spark, [(c, 0, "user", "Hi.") for c in dropped], tmp_path)
    assert found == {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in dropped}


def test_empty_table(spark, tmp_path):
    assert run(spark, [], tmp_path) == {}
