"""Conversation repair against trying all edits, and the query against a plain walk with whole strings."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

from ledgerscope.llm import conversations, queries

SCHEMA = "conv_id long, turn long, role string, text string, _id long, present2 string, audit string"


def faults(rows):
    """(initial, must go, unfinished, fault) of each (role, text)."""
    out, seen = [], set()
    for role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated", fault))
    return out


def applied(rows, kinds, edits):
    """(cost, repaired rows) of edits, None where they cannot be done."""
    at, cost, out = 0, 0, []
    for e in edits:
        due = "user" if not out or out[-1][0][:1] != "u" else "assistant"
        if e == "I":
            out.append((due, ""))
            cost += 3
            continue
        if at == len(rows):
            return None
        (role, text), (initial, must, cut, _) = rows[at], kinds[at]
        at += 1
        if e == "D":
            cost += 4
        elif must:
            return None
        else:
            out.append((role if e == "K" else due, text))
            cost += 3 * cut + 3 * (e == "R")
    if at < len(rows) or not re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "?" for r, _ in out)):
        return None
    return cost, out


def all_edits(rows, kinds):
    """Tries every string of edits with at most two inserts before each row and at the end."""
    options = ["D", *(i + e for i in ("", "I", "II") for e in "KR")]
    best = None
    for picks in itertools.product(*[options] * len(rows), ["", "I", "II"]):
        audit = "".join(picks)
        done = applied(rows, kinds, audit)
        if done and (best is None or (done[0], audit) < best[:2]):
            best = (done[0], audit, done[1])
    return best


def plain(rows, kinds):
    """The same with strings carried whole: for longer conversations."""
    states = {0: (0, "", [])}
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    due = {0: "user", 1: "user", 2: "assistant", 3: "user"}

    def inserted(states):
        for _ in range(2):
            for q, (c, a, o) in list(states.items()):
                to = step[q, due[q][0]]
                new = (c + 3, a + "I", [*o, (due[q], "")])
                states[to] = min(states.get(to, new), new, key=lambda s: s[:2])
        return states

    for (role, text), (initial, must, cut, _) in zip(rows, kinds):
        new = {}

        def put(q, c, a, o):
            if q not in new or (c, a) < new[q][:2]:
                new[q] = (c, a, o)

        for q, (c, a, o) in states.items():
            put(q, c + 4, a + "D", o)
        if not must:
            for q, (c, a, o) in inserted(dict(states)).items():
                if (q, initial) in step:
                    put(step[q, initial], c + 3 * cut, a + "K", [*o, (role, text)])
                put(step[q, due[q][0]], c + 3 + 3 * cut, a + "R", [*o, (due[q], text)])
        states = new
    return min(inserted(states)[q] for q in (0, 3) if q in inserted(states))


def damaged(rows):
    """rows: (conv_id, turn, role, text) -> conversations after damage, in order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        case = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        text = "" if case == 1 else re.sub("[.!?]", "", text) if case == 2 else text
        out[conv] += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {c: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, v in out.items()}


def expected(rows, solve):
    out = []
    for conv, full in damaged(rows).items():
        turns = [t for t, _, _ in full if t is not None]
        said = [(r, t) for _, r, t in full]
        kinds = faults(said)
        n = lambda f: sum(k[3] == f for k in kinds)
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(kinds))
        cost, audit, repaired = solve(said, kinds)
        text = "\n".join(f"{r}:{t}" for r, t in repaired)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, n("blank"), n("duplicate"), n("truncated"), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "s", "User"]
TEXTS = ["Hello.", "Hello", "ok!", "", " \n", None, "why? \t", "Hello. ", "x\x85", "\u2003", "Ü?"]


def made(rng, conv, n, few=False):
    pick = ROLES[:3] if few else ROLES
    return [(conv, rng.choice([None, i, i, i, i + 1, 3 * i]), rng.choice(pick), rng.choice(TEXTS if not few else TEXTS[:3]) ) for i in range(n)]


def test_plain_walk_is_least_of_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = [(rng.choice(ROLES) or " ", rng.choice(TEXTS) or " ") for _ in range(rng.randrange(5))]
        kinds = faults(rows)
        assert plain(rows, kinds)[:2] == all_edits(rows, kinds)[:2]


def stored(spark, rows, path):
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")


def test_query_rows_equal_the_contract(spark, tmp_path):
    rng = random.Random(2)
    rows = [r for c in range(400) for r in made(rng, c, rng.randrange(1, 12), c % 2 == 0)]
    rows += made(rng, None, 9) + rows[:50] + [(500, None, "user", "a."), (500, None, "user", "a."), (501, 10, None, None)]
    stored(spark, rows, tmp_path)
    got = sorted(map(tuple, queries.op12_conversation_repair(spark, str(tmp_path)).collect()), key=str)
    assert got == expected(rows, plain)


def test_conversation_longer_than_a_batch_and_than_memory(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(ROLES[:3]), rng.choice(["a.", "b", f"c{i}.", f"d{i}"])) for i in range(6_000)] + [(8, 1, "user", "a.")]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 500)
    try:
        df = conversations.damage(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        got = conversations.repair(df, present=df.present, spill=128).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(map(tuple, got), key=str) == expected(rows, plain)


def test_empty_table_and_other_ids(spark, tmp_path):
    stored(spark, [], tmp_path)
    assert queries.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    df = spark.createDataFrame([("x", 1, "user", "Hi."), ("x", 2, "assistant", "Ho."), (None, 1, "user", "Hi.")], "conv_id string, turn int, role string, text string")
    got = {r.conv_id: r for r in conversations.repair(df).collect()}
    assert got["x"].audit == "KK" and got["x"].cost == 0 and got[None].audit == "KI"
    assert got["x"].repaired_sha256 == hashlib.sha256(b"user:Hi.\nassistant:Ho.").hexdigest()
