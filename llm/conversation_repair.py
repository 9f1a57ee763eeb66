"""Operator 11: conversations repaired by the cheapest edits, found by an auction.

A conversation after damage is a lattice: a node for each place between rows and
each state of the role grammar ``(s?(ua)+)?``, an arc for each edit with its cost
in whole numbers. The auction keeps a path from the origin and a price for each
node, never above the cost of any arc plus the price at its end. At the path's
last node it either extends the path along an arc that costs exactly the
difference of prices, or raises the node's price and contracts the path. When it
reaches the sink, every arc of every cheapest path is tight; among the tight
arcs that lead to the sink, the trace takes the least letter at each node.

Rows are dealt by a range sort on conversation and turn. A conversation that lies
whole inside a partition, and in one piece, is answered there. The others, long
ones or those at a partition's ends, go on as pieces of bounded size: auctions give
the costs from each state before a block of rows to each state behind it, those
fold back to prices at the ends of pieces, with which each piece is traced on its
own from every state, and the states then fold forward. So a conversation that
holds a third of all rows is spread over many tasks; only its audit and its hash,
which are one value each, run through one, streamed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from llm.common import scratch, settle

#: Rows of a lattice that one auction solves, rows and characters of a piece.
BLOCK = 32
PIECE = 1024
CHARACTERS = 1 << 22
NEVER = 1 << 40
DELETE, KEEP, REROLE, INSERT, TRUNCATED = 2, 0, 1, 5, 5

#: States: nothing yet, after a system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a new row of the two roles leads to.
_NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
_KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: What it costs to be done, by state, where a conversation ends.
_END = (0, NEVER, NEVER, 0)

_WHITE = " \t\n\v\f\r"
#: A row's first fault.
NONE, BLANK, DUPLICATE, CUT = range(4)


@lru_cache(1 << 14)
def lattice(codes: tuple[str, ...], ends: tuple[int, ...], last: bool) -> list[list[tuple[int, str, int]]]:
    """Arcs (cost, letter, node) of each node, letters ascending; node 4i + q is state q before row i, the sink comes after all.

    codes: of each row its role's initial (one of s, u, a, or ?) and its fault's number.
    ends: cost from each state behind the rows to the sink. last: rows may be
    inserted behind the rows as well; elsewhere the next lattice does that.
    """
    n = len(codes)
    arcs: list[list[tuple[int, str, int]]] = []
    for i in range(n + 1):
        for q in range(4):
            out = [(INSERT, "I", 4 * i + _NEXT[q])] if i < n or last else []
            if i < n:
                role, fault = codes[i][0], int(codes[i][1])
                out.insert(0, (DELETE, "D", 4 * (i + 1) + q))
                if fault not in (BLANK, DUPLICATE):
                    more = TRUNCATED if fault == CUT else 0
                    if (role, q) in _KEEPS:
                        out.append((KEEP + more, "K", 4 * (i + 1) + _KEEPS[role, q]))
                    out.append((REROLE + more, "R", 4 * (i + 1) + _NEXT[q]))
            elif ends[q] < NEVER:
                out.append((ends[q], "", 4 * (n + 1)))
            arcs.append(out)
    return [*arcs, []]


def auction(arcs: list[list[tuple[int, str, int]]], origins: list[int], bound: int) -> tuple[list[int], list[int]]:
    """Prices, and the distance of each origin to the last node (``NEVER`` if beyond ``bound``, which no finite distance is).

    Prices found for one origin serve the next. No cycle of the lattice is free, so a path never meets itself.
    """
    sink, price, far = len(arcs) - 1, [0] * len(arcs), []
    for origin in origins:
        path = [origin]
        while path[-1] != sink and price[origin] < NEVER:
            i = path[-1]
            best, to = NEVER, -1
            for cost, _, j in arcs[i]:
                if cost + price[j] < best:
                    best, to = cost + price[j], j
            if best > bound:
                best = NEVER
            if price[i] < best:
                price[i] = best
                if i != origin:
                    path.pop()
            elif best == NEVER:  # no way on from here
                path.pop()
            else:
                path.append(to)
        far.append(price[origin] if path and path[-1] == sink else NEVER)
    return price, far


def _bound(n: int, ends: tuple[int, ...]) -> int:
    """More than any cheapest way: all rows deleted, a truncated one kept, two rows inserted, and the dearest end."""
    return DELETE * n + TRUNCATED + 2 * INSERT + max(e for e in ends if e < NEVER)


@lru_cache(1 << 14)
def trace(codes: tuple[str, ...], ends: tuple[int, ...], last: bool, state: int) -> tuple[int, str, int]:
    """Cost, letters and last state of the cheapest way through the rows from ``state``, the least letters among equals. Cost ``NEVER`` where there is none."""
    arcs = lattice(codes, ends, last)
    price, (far,) = auction(arcs, [state], _bound(len(codes), ends))
    if far >= NEVER:
        return NEVER, "", state
    sink = len(arcs) - 1
    tight = [[(letter, j) for cost, letter, j in out if price[j] < NEVER and price[i] == cost + price[j]] for i, out in enumerate(arcs)]
    # a node's price can be too low if no cheapest way passes it, so a tight arc may lead nowhere
    leads = [False] * sink + [True]
    for i in range(sink - 1, -1, -1):
        # an arc leads to a later row, or to a state of the same one
        leads[i] = any(leads[j] for _, j in tight[i])
        for q in range(i + 1, 4 * (i // 4) + 4):
            leads[q] = leads[q] or any(leads[j] for _, j in tight[q])
    letters, at = [], state
    while True:
        letter, to = min((letter, j) for letter, j in tight[at] if leads[j])
        if to == sink:
            return far, "".join(letters), at % 4
        letters.append(letter)
        at = to


@lru_cache(1 << 14)
def costs(codes: tuple[str, ...]) -> tuple[tuple[int, ...], ...]:
    """Cost from each state before the rows (first index) to each state behind them."""
    out = [[NEVER] * 4 for _ in range(4)]
    for behind in range(4):
        ends = tuple(0 if q == behind else NEVER for q in range(4))
        _, far = auction(lattice(codes, ends, False), list(range(4)), _bound(len(codes), ends))
        for before in range(4):
            out[before][behind] = far[before]
    return tuple(map(tuple, out))


def _blocks(codes: list[str]) -> list[tuple[str, ...]]:
    return [tuple(codes[k : k + BLOCK]) for k in range(0, len(codes), BLOCK)]


def before(table: tuple[tuple[int, ...], ...], ends: tuple[int, ...]) -> tuple[int, ...]:
    """Prices of the states before some rows from those behind them."""
    return tuple(min(NEVER, *(c + e for c, e in zip(row, ends, strict=True))) for row in table)


def end_prices() -> tuple[int, ...]:
    """Cost to end a conversation behind its last row, by state."""
    return tuple(trace((), _END, True, q)[0] for q in range(4))


def table_of(codes: list[str]) -> tuple[tuple[int, ...], ...]:
    """``costs`` of many rows, folded from those of their blocks."""
    out = tuple(tuple(0 if p == q else NEVER for q in range(4)) for p in range(4))
    for block in _blocks(codes):
        step = costs(block)
        out = tuple(tuple(min(NEVER, *(row[m] + step[m][q] for m in range(4))) for q in range(4)) for row in out)
    return out


def way(codes: list[str], ends: tuple[int, ...], last: bool, state: int) -> tuple[int, str, int]:
    """``trace`` through many rows, block by block. With ``last``, ``ends`` isn't asked."""
    blocks = _blocks(codes) or [()]
    behind = [end_prices() if last else ends]
    for block in reversed(blocks[1:]):
        behind.append(before(costs(block), behind[-1]))
    behind.reverse()
    cost, letters = 0, []
    for k, block in enumerate(blocks):
        final = last and k == len(blocks) - 1
        far, more, state = trace(block, _END if final else behind[k], final, state)
        if far >= NEVER:
            return NEVER, "", state
        letters.append(more)
        cost = far if k == 0 else cost  # the first block's, as the prices behind it hold the rest
    return cost, "".join(letters), state


def faults_of(roles: list[str], texts: list[str]) -> list[int]:
    """The first fault of each row, duplicates looked for among these rows."""
    seen, out = set(), []
    for row in zip(roles, texts, strict=True):
        end = row[1].rstrip(_WHITE)[-1:]
        out.append(BLANK if not end else DUPLICATE if row in seen else CUT if end not in ".!?" else NONE)
        seen.add(row)
    return out


def codes_of(roles: list[str], faults: list[int]) -> list[str]:
    return [(r[:1] if r[:1] in ("s", "u", "a") else "?") + str(f) for r, f in zip(roles, faults, strict=True)]


def illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def repaired(roles: list[str], texts: list[str], letters: str, state: int) -> list[str]:
    """The repaired rows, ``role:text``, that the letters make of the rows from ``state``."""
    out, k = [], 0
    for x in letters:
        if x == "D":
            k += 1
            continue
        if x == "K":
            state = _KEEPS[roles[k][:1], state]
            role = roles[k]
        else:
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        out.append(f"{role}:{'' if x == 'I' else texts[k]}")
        k += x != "I"
    return out


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and ``gone`` after damage. Rows that are dropped stay, without text, so that no conversation is forgotten."""
    one_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one_space("role").alias("role"), one_space("text").alias("text"),
        (F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn"))) % 20).alias("h"),
    )
    rows = rows.select(
        "conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), (F.col("h") == 0).alias("gone"),
        F.when(F.col("h").isin(0, 1), "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
    return rows.drop("copy")


_DONE = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_PIECE = "part int, seq int, turns array<long>, roles array<string>, texts array<string>, faults array<int>"
_NAMES = [c.split()[0] for c in f"{_DONE}, {_PIECE}".split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2 + [pa.int32()] * 2 + [pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32())]


def _rows(columns: list[list], names: list[str], types: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)


def gaps_of(turns: list) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def answer(conv, turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The result's row for a whole conversation."""
    faults = faults_of(roles, texts)
    cost, letters, _ = way(codes_of(roles, faults), (), True, START) if roles else (0, "", START)
    text = "\n".join(repaired(roles, texts, letters, START))
    return conv, gaps_of(turns), *(faults.count(f) for f in (BLANK, DUPLICATE, CUT)), illegal([r[:1] for r in roles]), cost, letters, hashlib.sha256(text.encode()).hexdigest()


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Answers the conversations that lie whole inside the partition; the first, the last and long ones come out as pieces."""
    held: list[tuple] = []
    conv = part = None
    first, cut, seq, size = True, False, 0, 0
    out: list[tuple] = []

    def piece() -> tuple:
        nonlocal seq
        seq += 1
        turns, roles, texts = ([r[k] for r in held] for k in range(3))
        return (conv, *[None] * 8, part, seq, turns, roles, texts, faults_of(roles, texts))

    for batch in batches:
        for c, turn, role, gone, text, p in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if part is None:
                conv, part = c, p
            if c != conv:
                if first or cut:
                    out.append(piece())
                else:
                    out.append((*answer(conv, *([r[k] for r in held] for k in range(3))), *[None] * 6))
                first, cut, conv, held, size = False, False, c, [], 0
            if not gone:
                if len(held) >= PIECE or size >= CHARACTERS:
                    out.append(piece())
                    cut, held, size = True, [], 0
                held.append((turn, role, text))
                size += len(text)
        if out:
            yield _rows(list(map(list, zip(*out, strict=True))), _NAMES, _TYPES)
            out = []
    if part is not None:
        yield _rows([[x] for x in piece()], _NAMES, _TYPES)


_SUMMARY = "conv_id long, part int, seq int, costs array<long>, counts array<long>, turns array<long>, first string, last string"
_PRICED = "part int, seq int, ends array<long>, final boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece: its table of costs, counts of faults and of illegal neighbours, its turns' range and number, its roles' first and last initials."""
    names = [c.split()[0] for c in _SUMMARY.split(", ")]
    types = [pa.int64(), pa.int32(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.string(), pa.string()]
    for batch in batches:
        out = []
        for conv, part, seq, turns, roles, faults in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            known = sorted({t for t in turns if t is not None})
            initials = [r[:1] for r in roles]
            counts = [faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT), illegal(initials)]
            out.append((conv, part, seq, [c for row in table_of(codes_of(roles, faults)) for c in row], counts, [known[0], known[-1], len(known)] if known else [], initials[0] if roles else None, initials[-1] if roles else None))
        if out:
            yield _rows(list(map(list, zip(*out, strict=True))), names, types)


def _priced(pieces: pa.Table) -> pa.Table:
    """Of one conversation's pieces: the prices behind each, and on each the conversation's counts and cost."""
    rows = sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["seq"]))
    ends, prices = [], end_prices()
    for r in reversed(rows):
        ends.append(prices)
        prices = before(tuple(tuple(r["costs"][4 * k : 4 * k + 4]) for k in range(4)), prices)
    ends.reverse()
    counts = [sum(r["counts"][k] for r in rows) for k in range(4)]
    known = [r["turns"] for r in rows if r["turns"]]
    distinct = sum(t[2] for t in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:], strict=False))
    gaps = known[-1][1] - known[0][0] + 1 - distinct if known else 0
    some = [r for r in rows if r["first"] is not None]
    counts[3] += sum(illegal([a["last"], b["first"]]) for a, b in zip(some, some[1:], strict=False))
    n = len(rows)
    columns = [[r["part"] for r in rows], [r["seq"] for r in rows], ends, [k == n - 1 for k in range(n)], *[[x] * n for x in (gaps, *counts, prices[START])]]
    types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.bool_(), *[pa.int64()] * 6]
    return pa.Table.from_batches([_rows(columns, [c.split()[0] for c in _PRICED.split(", ")], types)])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each piece, from each state before it: the letters and the state behind it."""
    for batch in batches:
        out = []
        for part, seq, roles, faults, ends, final in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            ways = [way(codes_of(roles, faults), tuple(ends), final, q) for q in range(4)]
            out.append((part, seq, [w[1] for w in ways], [w[2] for w in ways]))
        if out:
            yield _rows(list(map(list, zip(*out, strict=True))), ["part", "seq", "letters", "states"], [pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32())])


def _entered(pieces: pa.Table) -> pa.Table:
    """The state in which the trace enters each piece of one conversation."""
    state, out = START, []
    for r in sorted(pieces.to_pylist(), key=lambda r: (r["part"], r["seq"])):
        out.append((r["part"], r["seq"], state))
        state = r["states"][state]
    return pa.Table.from_batches([_rows(list(map(list, zip(*out, strict=True))), ["part", "seq", "entry"], [pa.int32()] * 3)])


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the letters and hashes the repaired rows of the pieces, which come conversation by conversation in order."""
    names, types = _NAMES[:9], _TYPES[:9]
    conv = counts = digest = None
    letters: list[str] = []
    begun = False

    def row() -> pa.RecordBatch:
        return _rows([[x] for x in (conv, *counts, "".join(letters), digest.hexdigest())], names, types)

    for batch in batches:
        for c, *more, roles, texts, audit, entry in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if digest is None or c != conv:
                if digest is not None:
                    yield row()
                conv, counts, digest, letters, begun = c, more, hashlib.sha256(), [], False
            letters.append(audit)
            for x in repaired(roles, texts, audit, entry):
                digest.update((("\n" if begun else "") + x).encode())
                begun = True
    if digest is not None:
        yield row()


def _in_pieces(pieces: DataFrame) -> DataFrame:
    """The result's rows for the conversations of ``pieces``."""
    at = ["part", "seq"]
    # within a piece only the first of equal rows is still in question, so a text that fills a conversation comes once for each piece
    firsts = pieces.select("conv_id", *at, F.posexplode(F.arrays_zip("roles", "texts", "faults")).alias("i", "x")).where(F.col("x.faults").isin(NONE, CUT))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "x.roles", "x.texts").orderBy(*at)) > 1
    again = firsts.withColumn("earlier", earlier).where("earlier").groupBy(*at).agg(F.collect_list("i").alias("again"))
    faults = F.when(F.col("again").isNull(), F.col("faults")).otherwise(F.transform("faults", lambda f, i: F.when(F.array_contains("again", i), F.lit(DUPLICATE)).otherwise(f)))
    with scratch(pieces.sparkSession) as keep:
        pieces = keep(settle(pieces.join(again, at, "left").withColumn("faults", faults).drop("again")))
    summed = pieces.select("conv_id", *at, "turns", "roles", "faults").mapInArrow(_summed, _SUMMARY)
    with scratch(pieces.sparkSession) as keep:
        priced = keep(settle(summed.groupBy("conv_id").applyInArrow(_priced, _PRICED)))
    traced = pieces.join(priced, at).select(*at, "roles", "faults", "ends", "final").mapInArrow(_traced, "part int, seq int, letters array<string>, states array<int>")
    with scratch(pieces.sparkSession) as keep:
        traced = keep(settle(traced))
    entered = pieces.select("conv_id", *at).join(traced.select(*at, "states"), at).groupBy("conv_id").applyInArrow(_entered, "part int, seq int, entry int")
    audit = F.element_at("letters", F.col("entry") + 1)
    told = pieces.join(priced, at).join(traced, at).join(entered, at)
    told = told.repartition("conv_id").sortWithinPartitions("conv_id", *at).select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "roles", "texts", audit.alias("audit"), "entry")
    return told.mapInArrow(_assembled, _DONE)


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after ``damaged``.

    Rows are taken by turn (nulls first), rows of one turn by role and text. A
    null conv_id is a conversation, too; null roles and texts are one space.
    ``audit`` holds the cheapest edits' initials (Delete, Insert, Keep, Rerole), the
    ASCII-least among equally cheap ones. Without rows after damage: zeros, an
    empty audit, the hash of an empty string. Repeated rows are duplicates, very
    long texts and conversations are only more work, other columns are
    ignored, an empty table gives no rows.
    """
    spark = conversations.sparkSession
    # rows alike in everything can follow each other in any order, so many of them may be spread over partitions
    rows = damaged(conversations).withColumn("spread", F.monotonically_increasing_id())
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "spread"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn", "role", "gone", "text", F.spark_partition_id().alias("part"))
    with scratch(spark) as keep:
        walked = keep(settle(dealt.mapInArrow(_walk, f"{_DONE}, {_PIECE}")))
    done = [c.split()[0] for c in _DONE.split(", ")]
    pieces = walked.where("part is not null").select("conv_id", *[c.split()[0] for c in _PIECE.split(", ")])
    return walked.where("part is null").select(*done).unionByName(_in_pieces(pieces))
