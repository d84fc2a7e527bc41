"""Repair of conversations: the cheapest edits to `(s?(ua)+)?`, the least edit string of all cheapest ones.

A conversation's rows are in the order of turn, nulls first; rows of one turn are in the order of role and text. What is
wrong with a row: blank, a duplicate of an earlier row, or truncated. Rows are kept (K), get another role (R), are
deleted (D), and empty rows are inserted (I); a state machine over start, system, user and assistant says what may follow.

Conversations are cut into blocks of bounded rows and text, one table row each, so one conversation may hold any share of
the rows. A row's edits are a 4 x 4 matrix of costs between states, a block's matrix the least-cost product of those of
its rows. Joins that double their reach from round to round give every block the costs from its end to the end of the
conversation. Then each block knows the cost of each of its nodes (row, state) and which arcs are optimal, and ranks
its nodes: by the first letter of their audits, then, as each pointer doubles, by the first 2, 4, 8, ... letters. Among
optimal arcs the one with the least letter and the least rank of its end is taken; two arcs of a node never share a letter, so
the next block can't change that choice. A path is read through the doubled pointers. A block does this for every state it may be
entered in; joins with doubling reach compose the states and say which one it is. The edited rows of a conversation are
hashed in order, block after block, as a stream.

Costs: five shuffles of the rows, plus two rounds of joins of block facts for each doubling of the longest conversation's
blocks. A task holds a block at a time. The audit of a conversation is one cell, as the result asks.

Defined cases: a null role or text is one space, in the damage key a null conv_id or turn is one space too. A null conv_id
is a conversation of its own. An empty or unknown role can't be kept. Rows that agree in everything are duplicates. A
conversation without rows gives zeros, an empty audit and the hash of the empty string. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from encore.sources.stage import staged

#: Costs of the edits, and what an undeleted truncated row adds.
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: The order of the letters is that of ASCII.
LETTERS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
#: The state an inserted row or one with a new role leads to.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: What is still to insert at the end, as a cost and as letters.
FINAL = [0, 2 * INSERT, INSERT, 0]
ENDING = ["", "II", "I", ""]
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
FAR = 1 << 40
BLOCK_ROWS, BLOCK_CHARS = 4096, 1 << 22
SPACES = " \t\n\x0b\x0c\r"


def damaged(rows: DataFrame) -> DataFrame:
    """The rows after damage by crc32(`conv_id:turn`) % 20."""
    def text_of(name):
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))
    plain = rows.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), (F.crc32(
        F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20).alias("damage"))
    damage = F.col("damage")
    return plain.filter(damage != 0).select(
        "conv_id", "turn", F.when(damage == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(damage == 1, "").when(damage == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(damage == 3, 2).otherwise(1))).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, tie, fault); tie is the order of rows that agree in everything."""
    shown = F.rtrim(F.col("text"), F.lit(SPACES))
    named = F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = staged(rows.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("tie")).select(
        "*", F.unhex(F.sha2(named, 256)).alias("digest"),
        F.when(shown == "", BLANK).when(~F.substring(shown, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(0).alias("fault")),
        "messages")
    seen = rows.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(
        F.min(F.struct("turn", "tie")).alias("first"))
    both = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")))
    again = (F.col("fault") != BLANK) & (F.col("tie") != F.col("first.tie"))
    return both.select("conv_id", "turn", "role", "text", "tie", F.when(again, DUPLICATE).otherwise(F.col("fault")).alias("fault"))


# --- costs and least paths of blocks of one size -------------------------------------------------

def costs(code: np.ndarray, removed: np.ndarray, cut: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Least costs from each node to the ends; code [m, n], ends [m, k, 4], result [n + 1, m, k, 4].

    code: the state that a row's role leads to, START for other roles, -1 where there is no row; such places come first.
    """
    m, n = code.shape
    out = np.empty((n + 1, *ends.shape), dtype=np.int64)
    out[n] = ends
    for i in range(n - 1, -1, -1):
        d = out[i + 1]
        to = code[:, i, None]
        more = cut[:, i, None] * CUT
        stays = ~removed[:, i, None]
        to_user, to_other = more + d[..., USER], more + d[..., ASSISTANT]
        kept = np.where(stays & (to == USER), to_user, FAR)
        answer = np.where(stays & (to == ASSISTANT), to_other, FAR)
        system = np.where(stays & (to == SYSTEM), more + d[..., SYSTEM], kept)
        user, other = np.where(stays, REROLE + to_user, FAR), np.where(stays, REROLE + to_other, FAR)
        gone = DELETE + d
        at_start = np.minimum(np.minimum(gone[..., START], system), user)
        at_system = np.minimum(np.minimum(gone[..., SYSTEM], kept), user)
        at_user = np.minimum(np.minimum(gone[..., USER], answer), other)
        at_other = np.minimum(np.minimum(gone[..., ASSISTANT], kept), user)
        here = np.empty_like(d)
        here[..., USER] = np.minimum(at_user, INSERT + at_other)
        here[..., ASSISTANT] = np.minimum(at_other, INSERT + at_user)
        here[..., START] = np.minimum(at_start, INSERT + here[..., USER])
        here[..., SYSTEM] = np.minimum(at_system, INSERT + here[..., USER])
        out[i] = np.where((to < 0)[..., None], d, here)
    return out


def least_paths(code: np.ndarray, removed: np.ndarray, cut: np.ndarray, ends: np.ndarray, block: np.ndarray,
                entry: np.ndarray) -> list[tuple[str, int, np.ndarray]]:
    """For each (block, entry state): the least audit through the block, the state it leaves in, the states on its way."""
    m, n = code.shape
    d = costs(code, removed, cut, ends[:, None, :])[:, :, 0, :].transpose(1, 0, 2)
    size = m * (n + 1) * 4
    node = np.arange(size).reshape(m, n + 1, 4)
    state = np.arange(4)
    here, after = d[:, :-1], d[:, 1:]
    to, stays, more = code[:, :, None], ~removed[:, :, None], cut[:, :, None] * CUT
    kept = np.where((state == START) & (to == SYSTEM), SYSTEM, NEXT)
    keeps = stays & (to == kept)
    value = np.stack([
        DELETE + after, INSERT + here[..., NEXT],
        np.where(keeps, more + np.take_along_axis(after, np.broadcast_to(kept, after.shape), 2), FAR),
        np.where(stays, REROLE + more + after[..., NEXT], FAR)], axis=-1)
    target = np.stack([
        node[:, 1:], node[:, :-1][..., NEXT],
        np.take_along_axis(node[:, 1:], np.broadcast_to(kept, after.shape), 2), node[:, 1:][..., NEXT]], axis=-1)
    optimal = np.zeros((m, n + 1, 4, 4), dtype=bool)
    optimal[:, :-1] = (value == here[..., None]) & (to >= 0)[..., None]
    ends_at = np.broadcast_to(node[..., None], (m, n + 1, 4, 4)).copy()
    ends_at[:, :-1] = np.where(optimal[:, :-1], target, ends_at[:, :-1])
    optimal, ends_at = optimal.reshape(size, 4), ends_at.reshape(size, 4)

    # ranks by one letter, 0 being the end of the block; then by twice as many letters as before, until every path ends
    rank = np.where(optimal.any(axis=1), optimal.argmax(axis=1) + 1, 0)
    key = np.where(optimal, np.arange(4) * (size + 1) + rank[ends_at], np.iinfo(np.int64).max)
    arc = key.argmin(axis=1)
    letter = np.where(rank > 0, arc, -1)
    pointers = [ends_at[np.arange(size), arc]]
    start = node[block, (code >= 0).argmax(axis=1)[block], entry]
    while (letter[pointers[-1][start]] >= 0).any():
        rank = np.unique(rank * (size + 1) + rank[pointers[-1]], return_inverse=True)[1]
        pointers.append(pointers[-1][pointers[-1]])
    paths = start[:, None]
    for pointer in pointers:
        paths = np.concatenate((paths, pointer[paths]), axis=1)
    taken = letter[paths]
    length = (taken >= 0).sum(axis=1)
    out = []
    for k, steps in enumerate(length.tolist()):
        audit = "".join(map(LETTERS.__getitem__, taken[k, :steps].tolist()))
        out.append((audit, int(paths[k, steps] % 4), paths[k, 1:steps + 1] % 4))
    return out


def by_size(faults: list[list[int]], roles: list[list[str]]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]]:
    """(which blocks, code, removed, cut) of blocks of about one size, filled up at the front."""
    known = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
    classes: dict[int, list[int]] = {}
    for k, rows in enumerate(faults):
        classes.setdefault(max(len(rows) - 1, 0).bit_length(), []).append(k)
    for power, mine in classes.items():
        n = 1 << power
        code = np.full((len(mine), n), -1, dtype=np.int64)
        fault = np.zeros((len(mine), n), dtype=np.int64)
        for r, k in enumerate(mine):
            code[r, n - len(faults[k]):] = [known.get(x[:1], START) for x in roles[k]]
            fault[r, n - len(faults[k]):] = faults[k]
        yield mine, code, (fault == BLANK) | (fault == DUPLICATE), fault == TRUNCATED


# --- blocks --------------------------------------------------------------------------------------

def blocks(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row for each block of a conversation's rows; `block` is in the order of conversations and their rows."""
    order = ["conv_id", "turn", "role", "text", "tie"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = dict(rows.dtypes)
    facts = (f"conv_id {kinds['conv_id']}, block long, first_turn {kinds['turn']}, last_turn {kinds['turn']}, turns long, "
             "blank long, duplicate long, truncated long, illegal long, first_initial string, last_initial string, "
             "matrix array<long>, roles array<string>, texts array<string>, faults array<int>")
    names = [f.split()[0] for f in facts.split(", ")]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ready, conv, held, chars = [], None, [], 0
        id_kind = turn_kind = None

        def written(ready: list[tuple]) -> pa.RecordBatch:
            nonlocal number
            faults = [[r[3] for r in rows] for _, rows in ready]
            roles = [[r[1] for r in rows] for _, rows in ready]
            matrices = [None] * len(ready)
            for mine, code, removed, cut in by_size(faults, roles):
                ends = np.where(np.eye(4, dtype=bool), 0, FAR)
                d = costs(code, removed, cut, np.broadcast_to(ends, (len(mine), 4, 4)))[0]
                for r, k in enumerate(mine):
                    matrices[k] = np.minimum(d[r].T, FAR).ravel().tolist()
            out = []
            for k, (conv_id, rows) in enumerate(ready):
                turns = [r[0] for r in rows if r[0] is not None]
                initials = [r[1][:1] for r in rows]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                count = [faults[k].count(x) for x in (BLANK, DUPLICATE, TRUNCATED)]
                out.append((conv_id, number + k, turns[0] if turns else None, turns[-1] if turns else None,
                            len(set(turns)), *count, illegal, initials[0], initials[-1], matrices[k], roles[k],
                            [r[2] for r in rows], faults[k]))
            number += len(ready)
            kinds = [id_kind, pa.int64(), turn_kind, turn_kind, *[pa.int64()] * 5, pa.string(), pa.string(),
                     pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

        for batch in batches:
            id_kind, turn_kind = batch.schema.field("conv_id").type, batch.schema.field("turn").type
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault"))):
                if held and (row[0] != conv or len(held) >= block_rows or chars >= BLOCK_CHARS):
                    ready.append((conv, held))
                    held, chars = [], 0
                conv = row[0]
                held.append(row[1:])
                chars += len(row[3])
            if ready:
                yield written(ready)
                ready = []
        if held:
            yield written([(conv, held)])

    return placed.select(*order, "fault").mapInArrow(of, facts)


def _product(a: Column, b: Column) -> Column:
    """The least-cost product of two matrices of 16 values."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: F.least(F.lit(FAR), F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)),
        lambda j: F.get(a, F.floor(k / 4).cast("int") * 4 + j) + F.get(b, j * 4 + k % 4)))))


def _joined(table: DataFrame, other: DataFrame, step: int) -> DataFrame:
    """`table` with the columns of `other` that lie `step` blocks further in the same conversation."""
    other = other.withColumnRenamed("conv_id", "c").withColumn("i", F.col("place") - step).drop("place")
    return table.join(other, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("i")), "left").drop("c", "i")


def _doubled(table: DataFrame, most: int, back: bool, combine) -> DataFrame:
    """Combine `value` over all following (back: preceding) blocks, reaching 1, 2, 4, ... blocks further."""
    reach = 1
    while reach < most:
        other = table.select("conv_id", "place", F.col("value").alias("far"))
        both = _joined(table, other, -reach if back else reach)
        table = staged(both.withColumn("value", F.when(F.col("far").isNull(), F.col("value")).otherwise(
            combine(F.col("value"), F.col("far")))).drop("far"), "doubled")
        reach *= 2
    return table


def _to_end(matrix: Column) -> Column:
    """Costs from each state to the end, after the rows of `matrix`."""
    return F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.array_min(F.transform(
        F.sequence(F.lit(0), F.lit(3)), lambda e: F.get(matrix, s * 4 + e) + F.get(F.array(*map(F.lit, FINAL)), e))))


def _edited(blocks: DataFrame, places: DataFrame) -> DataFrame:
    """(conv_id, place, entry, leaves, audit, edited) of every block and state it may be entered in."""
    kind = dict(blocks.dtypes)["conv_id"]
    table = blocks.select("block", "roles", "texts", "faults").join(places, "block").select(
        "conv_id", "place", "last", "ends", "roles", "texts", "faults")
    names = ["conv_id", "place", "entry", "leaves", "audit", "edited"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out = []
            for mine, code, removed, cut in by_size(data["faults"], data["roles"]):
                ends = np.array([data["ends"][k] for k in mine], dtype=np.int64)
                asked = [(r, e) for r, k in enumerate(mine) for e in (range(4) if data["place"][k] else (START,))]
                block, entry = (np.array(x) for x in zip(*asked))
                found = least_paths(code, removed, cut, ends, block, entry)
                for (r, e), (audit, leaves, states) in zip(asked, found):
                    k = mine[r]
                    roles, texts, at, lines = data["roles"][k], data["texts"][k], 0, []
                    for letter, state in zip(audit, states.tolist()):
                        if letter == "I":
                            lines.append(f"{ROLES[state]}:")
                            continue
                        if letter == "K":
                            lines.append(f"{roles[at]}:{texts[at]}")
                        elif letter == "R":
                            lines.append(f"{ROLES[state]}:{texts[at]}")
                        at += 1
                    if data["last"][k]:
                        audit += ENDING[leaves]
                        lines += [f"{x}:" for x in ("user", "assistant")[2 - len(ENDING[leaves]):]]
                    out.append((data["conv_id"][k], data["place"][k], e, leaves, audit, "\n".join(lines)))
            if out:
                kinds = [batch.schema.field("conv_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names)

    return table.mapInArrow(of, f"conv_id {kind}, place int, entry int, leaves int, audit string, edited string")


def _hashed(pieces: DataFrame) -> DataFrame:
    """(conv_id, audit, repaired_sha256), the pieces of a conversation one after the other."""
    kind = dict(pieces.dtypes)["conv_id"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, digest, empty, id_kind = None, None, None, True, None

        def written(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (id_kind, pa.string(), pa.string()))],
                ["conv_id", "audit", "repaired_sha256"])

        for batch in batches:
            id_kind, done = batch.schema.field("conv_id").type, []
            for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "audit", "edited"))):
                if row[1] == 0:
                    if audit is not None:
                        done.append((conv, "".join(audit), digest.hexdigest()))
                    conv, audit, digest, empty = row[0], [], hashlib.sha256(), True
                audit.append(row[2])
                if row[3]:
                    digest.update(row[3].encode() if empty else b"\n" + row[3].encode())
                    empty = False
            if done:
                yield written(done)
        if audit is not None:
            yield written([(conv, "".join(audit), digest.hexdigest())])

    ordered = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return ordered.mapInArrow(of, f"conv_id {kind}, audit string, repaired_sha256 string")


def repaired(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """What is wrong with conversations (conv_id, turn, role, text) and what repairs them, and the repaired rows.

    First table: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256. Second: conv_id,
    place, audit, edited; the edited rows of each block as lines `role:text`.
    """
    held = staged(blocks(with_faults(rows), block_rows), "blocks")
    own = W.partitionBy("conv_id").orderBy("block")
    facts = staged(held.drop("roles", "texts", "faults").select(
        "*", (F.row_number().over(own) - 1).alias("place"), F.count("*").over(W.partitionBy("conv_id")).alias("blocks"),
        F.lag("last_turn").over(own).alias("turn_before"), F.lag("last_initial").over(own).alias("initial_before")), "block-facts")
    most = facts.agg(F.max("blocks")).first()[0] or 1
    several = facts.filter("blocks > 1")
    spread = several.select("conv_id", "place", F.col("matrix").alias("value"))
    spread = _doubled(spread, most, False, _product).select("conv_id", "place", _to_end(F.col("value")).alias("costs"))
    following = _joined(several.select("conv_id", "place", "block", "blocks"), spread, 1)
    final = F.array(*[F.lit(x).cast("long") for x in FINAL])
    places = facts.filter("blocks = 1").select("block", "conv_id", "place", F.lit(True).alias("last"), final.alias("ends"))
    places = places.union(following.select("block", "conv_id", "place", F.col("costs").isNull().alias("last"),
                                           F.coalesce("costs", final).alias("ends")))
    edited = staged(_edited(held, places), "edited")

    # which state each block is entered in: the states its predecessors lead to, from the start
    ways = several.select(F.col("conv_id").alias("c"), F.col("place").alias("p")).join(
        edited, F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("p") == F.col("place")))
    ways = ways.groupBy("conv_id", "place").agg(F.sort_array(F.collect_list(F.struct("entry", "leaves"))).alias("ways"))
    ways = ways.select("conv_id", "place", F.col("ways.leaves").alias("value"))
    ways = _doubled(ways, most, True, lambda own, before: F.transform(before, lambda s: F.get(own, s)))
    entries = ways.select(F.col("conv_id").alias("c"), (F.col("place") + 1).alias("p"), F.get("value", F.lit(0)).alias("e"))
    later = edited.filter("place > 0").join(entries, F.col("conv_id").eqNullSafe(F.col("c")) & (
        F.col("place") == F.col("p")) & (F.col("entry") == F.col("e")), "left_semi")
    pieces = staged(edited.filter("place = 0").union(later).select("conv_id", "place", "audit", "edited"), "pieces")

    begun = facts.filter("blocks = 1").select("conv_id", F.get(_to_end(F.col("matrix")), F.lit(0)).alias("cost")).union(
        spread.filter("place = 0").select("conv_id", F.get("costs", F.lit(0)).alias("cost")))
    summed = facts.groupBy("conv_id").agg(
        (F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns") + F.count_if(
            F.col("first_turn") == F.col("turn_before"))).alias("gaps"),
        F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
        (F.sum("illegal") + F.count_if(F.col("initial_before").isNotNull() & ~F.concat(
            "initial_before", "first_initial").isin("su", "ua", "au"))).alias("illegal"))
    out = summed
    for table in (begun, _hashed(pieces)):
        table = table.withColumnRenamed("conv_id", "c")
        out = out.join(table, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    return out, pieces


def repaired_conversations(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every original conv_id with what `repaired` says of its rows after damage."""
    found, _ = repaired(damaged(rows), block_rows)
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("c").alias("conv_id"), *[F.coalesce(F.col(n).cast("long"), F.lit(0).cast("long")).alias(n) for n in counts],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
