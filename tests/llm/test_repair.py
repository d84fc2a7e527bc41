"""Repair of conversations against a plain recursion over whole conversations."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import numpy as np
import pytest

from encore.llm import repair
from encore.llm.queries import QUERIES

BLANK = " \t\n\x0b\x0c\r"
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    for conv_id, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        key = ":".join(" " if x is None else str(x) for x in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            yield from [(conv_id, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)


def cheapest(rows, faults):
    """(cost, audit) from the first row on."""
    following = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def best(i, last, inserted=0):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, ""))
        else:
            fault = faults[i]
            more = int(fault == "truncated")
            options.append(add(best(i + 1, last), 3, "D"))
            if fault not in ("blank", "duplicate"):
                initial = rows[i][0][:1]
                if initial and initial in following[last]:
                    options.append(add(best(i + 1, initial), more, "K"))
                for new in set(following[last]) & set("ua"):
                    options.append(add(best(i + 1, new), 2 + more, "R"))
        if inserted < 2:
            for new in set(following[last]) & set("ua"):
                options.append(add(best(i, new, inserted + 1), 2, "I"))
        return min((o for o in options if o), default=None)

    def add(found, cost, letter):
        return found and (found[0] + cost, letter + found[1])

    return best(0, "")


def brute(rows):
    out = []
    for conv_id in {r[0] for r in rows}:
        mine = sorted(damaged([r for r in rows if r[0] == conv_id]),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            shown = text.rstrip(BLANK)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen
                          else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        initials = [r[2][:1] for r in mine]
        cost, audit = cheapest(tuple(r[2:] for r in mine), tuple(faults))
        lines, last, i = [], "", 0
        for letter in audit:
            new = {"": "user", "s": "user", "u": "assistant", "a": "user"}[last]
            role, text = mine[i][2:] if i < len(mine) else (None, None)
            i += letter != "I"
            if letter != "D":
                lines.append(f"{role if letter == 'K' else new}:{'' if letter == 'I' else text}")
                last = lines[-1][0]
        out.append((conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                    *[faults.count(x) for x in ("blank", "duplicate", "truncated")],
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])),
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def collected(table):
    return sorted((tuple(r) for r in table.select(COLUMNS).collect()), key=repr)


def test_all_conversations(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    assert collected(QUERIES["op13_path_ranking"](spark, small)) == brute(rows)


def made(seed, conversations, rows):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "", " \t", "Why? ", "So it is!\n", "a ", " ", "x" * 40 + "."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", "u", None]
    return [(rng.randrange(conversations), rng.choice([None, i, i, i, i // 3]), rng.choice(roles),
             rng.choice([*texts, f"t{i}.", f"t{i}?", f"t{i}.", None])) for i in range(rows)]


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("block_rows", [1, 3, repair.BLOCK_ROWS])
def test_odd_rows_in_blocks(spark, block_rows):
    rows = made(5, 9, 260) + [(None, 1, "user", "A."), (None, 2, "assistant", "B."), (None, None, None, None),
                              (77, 5, "assistant", "Alone."), (78, None, "system", "S."), (79, 0, "user", "Q?" * 50_000)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", block string, place int").repartition(5)
    assert collected(repair.repaired_conversations(table, block_rows)) == brute(rows)


def test_dropped_and_empty(spark):
    gone = [(c, t, "user", "Hello.") for c in range(400) for t in (1,) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0][:3]
    table = spark.createDataFrame(gone, SCHEMA)
    got = collected(repair.repaired_conversations(table))
    assert len(gone) == 3 and sorted(got) == [(c, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c, *_ in sorted(gone)]
    assert repair.repaired_conversations(table.limit(0)).collect() == []


def test_least_paths_end_to_end():
    """One block of a long conversation, read through the pointers, against the recursion."""
    rng = random.Random(11)
    roles = [rng.choice(["system", "user", "assistant", "tool"]) for _ in range(150)]
    faults = [rng.choice([0, 0, 0, 1, 2, 3]) for _ in roles]
    (mine, code, removed, cut), = repair.by_size([faults], [roles])
    ends = np.array([repair.FINAL])
    (audit, state, _), = repair.least_paths(code, removed, cut, ends, np.array([0]), np.array([repair.START]))
    names = [["", "blank", "duplicate", "truncated"][f] for f in faults]
    assert audit + repair.ENDING[state] == cheapest(tuple((r, "") for r in roles), tuple(names))[1]
