"""Repair of conversation structure: cheapest edits to alternating turns.

A repaired conversation has the roles (system? (user assistant)+)?. Each row is
kept (K, costs 0), given the role user or assistant (R, 3) or deleted (D, 4;
blank rows and duplicates must be); empty user or assistant turns may be put in
anywhere (I, 3); a row left in that is truncated costs 3 more.

The edits of a conversation are the paths of a lattice: a node is a row boundary
and one of four states of the pattern (start, after system, after user, after
assistant). An auction finds the shortest one: each node has a price, a path
grows from the origin to the neighbour that is cheapest at its price, and where
the end of the path is priced below its best offer, the price rises to the offer
and the path gives its last arc back. Prices never exceed distances, and those
on the final path equal them, so every arc of every shortest path is tight
(price = cost + price beyond). Among tight arcs the one of least letter is
followed. Long conversations are auctioned from their end, BLOCK rows at a time:
the nodes of a boundary whose prices have converged are destinations for the
rows before it, so work grows with the number of rows.

Texts are moved once, into order; faults and edits travel as one character a
row and as row places. Only the edit string of a conversation, which is one cell
of the result, is made in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carrierlab.llm.tables import checkpointed

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"  # in ASCII order
BLOCK, PIECE, TASK_ROWS = 64, 4096, 1 << 14
INFINITE = 1 << 60

FINE, BLANK, DUPLICATE, CUT = range(4)
INITIALS, DROPPED = "sua", "x"

_AFTER_ROLE = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}


def _arcs(code: int) -> list[list[tuple[int, int, int, int]]]:
    """For each state the arcs out of a row of this code: (letter, cost, rows on, state)."""
    initial, fault = code % 4, code // 4
    more = TRUNCATED if fault == CUT else 0
    out = []
    for state in range(4):
        arcs = [(0, DELETE, 1, state), (1, INSERT, 0, _NEXT[state])]
        if fault not in (BLANK, DUPLICATE):
            if state in _AFTER_ROLE[initial]:
                arcs.append((2, KEEP + more, 1, _AFTER_ROLE[initial][state]))
            arcs.append((3, REROLE + more, 1, _NEXT[state]))
        out.append(arcs)
    return out


ARCS = [_arcs(code) for code in range(16)]
END_ARCS = [[(1, INSERT, 0, _NEXT[state])] for state in range(4)]
ACCEPTING = (START, ASSISTANT)


def auction(codes: bytes, block: int = BLOCK) -> list[list[int]]:
    """Prices of the nodes of each row boundary, converged for the first node."""
    n = len(codes)
    price = [[0, 0, 0, 0] for _ in range(n + 1)]
    exact = n + 1  # from this boundary on, nodes are destinations
    for low in range((n // block) * block, -1, -block):
        if exact <= n:  # no arc out of these rows ends below the least price behind them
            least = min(price[exact])
            price[low:exact] = [[least] * 4 for _ in range(low, exact)]
        for origin in ((START,) if low == 0 else range(4)):
            path = [(low, origin)]
            while True:
                i, state = path[-1]
                best, to = INFINITE, None
                if i == n and state in ACCEPTING:
                    best = 0  # the arc to the end
                for _, cost, step, after in (ARCS[codes[i]] if i < n else END_ARCS)[state]:
                    offer = cost + price[i + step][after]
                    if offer < best:
                        best, to = offer, (i + step, after)
                if price[i][state] < best:
                    price[i][state] = best
                    if len(path) > 1:
                        path.pop()  # contraction
                elif to is None or to[0] >= exact:
                    break
                else:
                    path.append(to)  # extension
        exact = low
    return price


def cheapest_edits(codes: bytes, block: int = BLOCK) -> tuple[int, str]:
    """(cost, letters) of the cheapest edits, of equally cheap ones the ASCII-least.

    ``codes`` has a byte for each row: 4 * fault + role (0 to 2 for system, user,
    assistant, 3 for any other).
    """
    n = len(codes)
    price = auction(codes, block)
    # Boundaries from which tight arcs lead to the end.
    open_ = bytearray(4 * (n + 1))
    for i in range(n, -1, -1):
        arcs = ARCS[codes[i]] if i < n else END_ARCS
        now = price[i]
        for state in range(4):
            if i == n:
                open_[4 * i + state] = state in ACCEPTING and now[state] == 0
            else:
                open_[4 * i + state] = any(
                    step and now[state] == cost + price[i + 1][after] and open_[4 * (i + 1) + after]
                    for _, cost, step, after in arcs[state])
        for _ in range(2):  # insertions lead to another node of the boundary, at most two in a row
            for state in range(4):
                after = _NEXT[state]
                if now[state] == INSERT + now[after] and open_[4 * i + after]:
                    open_[4 * i + state] = 1
    letters = []
    i, state = 0, START
    while i < n or state not in ACCEPTING or price[i][state] != 0:
        for letter, cost, step, after in (ARCS[codes[i]] if i < n else END_ARCS)[state]:
            if price[i][state] == cost + price[i + step][after] and open_[4 * (i + step) + after]:
                letters.append(LETTERS[letter])
                i, state = i + step, after
                break
        else:
            raise AssertionError("prices have not converged")
    return price[0][START], "".join(letters)


def damaged(rows: DataFrame) -> DataFrame:
    """Damage of conversation rows by crc32 of "conv_id:turn" modulo 20.

    0 drops a row (kept here with ``dropped`` set), 1 empties its text, 2 takes
    its ".", "!" and "?" out, 3 repeats it, 4 makes its role user. Nulls count as
    one space in the key, the role and the text.
    """
    space = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                            F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    return rows.select("conv_id", "turn", "role", "text").withColumn("kind", kind).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(role).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(
            text).alias("text"),
        (F.col("kind") == 0).alias("dropped"),
        F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _last_sign(text: Column) -> Column:
    return F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of conversation and turn (nulls first), role and text, with their ``place`` in that order."""
    order = ["conv_id", "turn", "role"]
    spread = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    return checkpointed(spread).withColumn("place", F.monotonically_increasing_id())


def solved(placed: DataFrame) -> DataFrame:
    """One row a conversation: counts of its faults, cost, audit and the pieces of places its rows lie in."""
    live = placed.where("NOT dropped")
    said = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.lit(":"),
                    F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    mark = _last_sign(F.col("text"))
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1))
    light = placed.select(
        "conv_id", "place", "dropped", F.when(~F.col("dropped"), F.col("turn")).alias("turn"), mark.alias("mark"),
        F.when((F.substring("role", 1, 1) == "") | (initial == 0), 3).otherwise(initial - 1).alias("initial"))
    # The first place of each (conversation, role, text); places are unique, so
    # no key of this join is frequent.
    first = live.groupBy(F.sha2(said, 256).alias("said")).agg(F.min("place").alias("place")).select(
        "place", F.lit(True).alias("fresh"))
    light = light.join(first, "place", "left")
    fault = (F.when(F.col("mark") == "", BLANK).when(F.col("fresh").isNull(), DUPLICATE)
             .when(~F.col("mark").isin(".", "!", "?"), CUT).otherwise(FINE))
    codes = light.select("conv_id", "place", "turn", F.when(F.col("dropped"), DROPPED).otherwise(
        F.substring(F.lit("0123456789abcdef"), fault * 4 + F.col("initial") + 1, F.lit(1))).alias("code"))
    # A piece has at most PIECE consecutive places, all of one partition.
    # As many tasks as rows need: their work is in the lattice, not in their bytes.
    tasks = 1 + placed.count() // TASK_ROWS
    pieces = codes.groupBy("conv_id", F.expr(f"place div {PIECE}").alias("piece")).agg(
        F.array_sort(F.collect_list(F.struct("place", "code"))).alias("rows"),
        F.coalesce(F.min("turn"), F.lit(0)).alias("low"), F.coalesce(F.max("turn"), F.lit(0)).alias("high"),
        F.size(F.collect_set("turn")).alias("turns"))
    pieces = pieces.select(
        "conv_id", "piece", F.col("rows")[0]["place"].alias("place"), "low", "high", "turns",
        F.array_join("rows.code", "").alias("codes"))

    def solve(pieces: list[dict]) -> dict:
        codes = bytes(int(c, 16) for p in pieces for c in p["codes"] if c != DROPPED)
        known = [p for p in pieces if p["turns"]]
        distinct = sum(p["turns"] for p in known) - sum(a["high"] == b["low"] for a, b in pairwise(known))
        gaps = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        array = np.frombuffer(codes, dtype=np.uint8)
        pair = array[:-1] % 4 * 4 + array[1:] % 4
        illegal = len(pair) - int(np.isin(pair, [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]).sum())
        faults = np.bincount(array // 4, minlength=4)
        cost, audit = cheapest_edits(codes)
        return {"gaps": gaps, "blank": int(faults[BLANK]), "duplicate": int(faults[DUPLICATE]),
                "truncated": int(faults[CUT]), "illegal": illegal, "cost": cost, "audit": audit,
                "places": [p["place"] for p in pieces], "codes": [p["codes"] for p in pieces]}

    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    kinds = {c: pa.int64() for c in counts} | {
        "audit": pa.string(), "places": pa.list_(pa.int64()), "codes": pa.list_(pa.string())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                done = [solve(pieces) for pieces in part.column("pieces").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), *(pa.array([d[c] for d in done], kind) for c, kind in kinds.items())],
                    names=["conv_id", *kinds])

    whole = pieces.repartition(tasks, "conv_id").groupBy("conv_id").agg(F.array_sort(F.collect_list(
        F.struct("piece", "place", "low", "high", "turns", "codes"))).alias("pieces"))
    return whole.mapInArrow(run, "conv_id long, " + ", ".join(f"{c} long" for c in counts) +
                            ", audit string, places array<long>, codes array<string>")


def edits(solution: DataFrame) -> DataFrame:
    """(conv_id, position, place, new_role): a row of the repaired conversation each.

    ``place`` is null for a turn put in, ``new_role`` for a row that is kept.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "position", "place", "new_role"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        out = [[], [], [], []]

        def batch_of():
            done = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)
            for c in out:
                c.clear()
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                conv, audit, places, codes = (batch.column(c)[k].as_py() for c in ("conv_id", "audit", "places", "codes"))
                rows = ((place + i, int(code, 16) % 4) for place, piece in zip(places, codes)
                        for i, code in enumerate(piece) if code != DROPPED)
                position, state = 0, START
                for letter in audit:
                    place, role = None, None
                    if letter != "I":
                        place, initial = next(rows)
                    if letter == "D":
                        continue
                    state = _AFTER_ROLE[initial][state] if letter == "K" else _NEXT[state]
                    if letter != "K":
                        role = "user" if state == USER else "assistant"
                    for c, value in zip(out, (conv, position, place, role)):
                        c.append(value)
                    position += 1
                    if len(out[0]) >= 1 << 15:
                        yield batch_of()
        yield batch_of()

    return solution.select("conv_id", "audit", "places", "codes").mapInArrow(
        run, "conv_id long, position long, place long, new_role string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired turns and a report, of rows (conv_id, turn, role, text, dropped).

    The first frame has conv_id, position (from 0), role and text of every
    repaired turn; the second one a row for each conversation: conv_id, gaps,
    blank, duplicate, truncated, illegal, cost, audit. Rows are ordered by turn
    (nulls first), those of one turn by role and text. A role counts by its
    first letter; another than s, u, a (empty, null) fits nowhere, so its row is
    given a role or deleted. A null conv_id is a conversation of its own. Rows
    with ``dropped`` only make their conversation known: without other rows it
    has zeros, an empty audit and no turns. Extra columns are ignored; an empty
    table gives empty results. Texts of any length are read where they lie.
    """
    placed = ordered(rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), "dropped"))
    solution = checkpointed(solved(placed))
    plan = edits(solution)
    kept = plan.where("place IS NOT NULL").join(placed.select("place", "role", "text"), "place").select(
        "conv_id", "position", F.coalesce("new_role", "role").alias("role"), "text")
    added = plan.where("place IS NULL").select("conv_id", "position", F.col("new_role").alias("role"),
                                               F.lit("").alias("text"))
    return kept.unionByName(added), solution.drop("places", "codes")


def report(conversations: DataFrame) -> DataFrame:
    """The report of :func:`repair` on damaged conversations, with ``repaired_sha256``: the digest of the
    repaired "role:text" lines. A conversation's turns pass one task in order, a batch at a time, as its digest needs."""
    turns, found = repair(damaged(conversations))
    turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "position")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = (), None
        ids, digests = [], []
        for batch in batches:
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if current != (conv,):
                    if running is not None:
                        ids.append(current[0])
                        digests.append(running.hexdigest())
                    current, running = (conv,), hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:".encode())
                running.update(text.encode())
            if len(ids) >= 1 << 14:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())],
                                                 names=["conv", "sha"])
                ids, digests = [], []
        if running is not None:
            ids.append(current[0])
            digests.append(running.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())],
                                         names=["conv", "sha"])

    hashed = turns.mapInArrow(digest, "conv long, sha string")
    return found.join(hashed, found["conv_id"].eqNullSafe(hashed["conv"]), "left").select(
        *found.columns, F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _plus(value: str, cost: str, letter: str) -> str:
    """SQL: a value (eight digits of cost, then letters) with one more edit."""
    return f"lpad(CAST(CAST({value}[1:8] AS BIGINT) + {cost} AS VARCHAR), 8, '0') || {value}[9:] || '{letter}'"


# The same report by a forward programme over whole edit strings.
ORACLE = rf"""
WITH RECURSIVE steps AS (
  SELECT list_transform(range(256), lambda t: list_reduce([t, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS tab
), src AS (
  SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '') AS ck, turn, coalesce(role, ' ') AS role,
    coalesce(text, ' ') AS txt,
    xor(list_reduce([4294967295] || list_transform(string_split(
      coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 20 AS kind
  FROM conversations, steps
), dam AS (
  SELECT ck, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(txt, '[.!?]', '', 'g') ELSE txt END AS txt,
    unnest(CASE WHEN kind = 3 THEN [0, 1] ELSE [0] END) AS again
  FROM src WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY ck ORDER BY turn NULLS FIRST, role, txt) AS k FROM dam
), signed AS (
  SELECT *, substr(role, 1, 1) AS ini, row_number() OVER (PARTITION BY ck, role, txt ORDER BY k) AS seen,
    regexp_extract(txt, '([^ 	-
])[ 	-
]*$', 1) AS mark FROM numbered
), f AS (
  SELECT *, CASE WHEN mark = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate'
      WHEN mark NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
    lag(ini) OVER (PARTITION BY ck ORDER BY k) AS before FROM signed
), stats AS (
  SELECT ck, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
    count(*) FILTER (WHERE fault = 'truncated') AS truncated,
    count(*) FILTER (WHERE k > 1 AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM f GROUP BY ck
), convs AS (
  SELECT DISTINCT conv_id, ck FROM src
), rec AS (
  SELECT ck, CAST(0 AS BIGINT) AS k, '00000000' AS v0, CAST(NULL AS VARCHAR) AS v1, '00000003I' AS v2, '00000006II' AS v3
  FROM convs
  UNION ALL
  SELECT ck, k, n0, n1, c2, least(n3, {_plus("c2", "3", "I")}) FROM (
    SELECT *, least(n2, {_plus("least(n0, n1, n3)", "3", "I")}) AS c2 FROM (
      SELECT ck, k, {_plus("v0", "4", "D")} AS n0,
        least({_plus("v1", "4", "D")}, CASE WHEN open AND ini = 's' THEN {_plus("v0", "more", "K")} END) AS n1,
        least({_plus("v2", "4", "D")}, CASE WHEN open THEN {_plus("m", "3 + more", "R")} END,
          CASE WHEN open AND ini = 'u' THEN {_plus("m", "more", "K")} END) AS n2,
        least({_plus("v3", "4", "D")}, CASE WHEN open THEN {_plus("v2", "3 + more", "R")} END,
          CASE WHEN open AND ini = 'a' THEN {_plus("v2", "more", "K")} END) AS n3
      FROM (SELECT f.ck, f.k, v0, v1, v2, v3, least(v0, v1, v3) AS m, ini,
              fault NOT IN ('blank', 'duplicate') AS open, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more
            FROM rec JOIN f ON f.ck = rec.ck AND f.k = rec.k + 1)))
), best AS (
  SELECT rec.ck, CAST(least(v0, v3)[1:8] AS BIGINT) AS cost, least(v0, v3)[9:] AS audit
  FROM rec LEFT JOIN stats USING (ck) WHERE rec.k = coalesce(n, 0)
), letters AS (
  SELECT ck, i, audit[i] AS letter, length(replace(audit[1:i], 'I', '')) AS k
  FROM (SELECT ck, audit, unnest(generate_series(1, length(audit))) AS i FROM best)
), made AS (
  SELECT letters.ck, i, letter, role, txt, coalesce(sum(CASE WHEN letter <> 'D' AND NOT (letter = 'K' AND ini = 's') THEN 1 ELSE 0 END)
    OVER (PARTITION BY letters.ck ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e
  FROM letters LEFT JOIN f ON f.ck = letters.ck AND f.k = letters.k AND letter <> 'I'
), repaired AS (
  SELECT ck, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN e % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(txt, ''), chr(10) ORDER BY i)) AS sha FROM made WHERE letter <> 'D' GROUP BY ck
)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank,
  coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  cost, audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM convs JOIN best USING (ck) LEFT JOIN stats USING (ck) LEFT JOIN repaired USING (ck)
"""
