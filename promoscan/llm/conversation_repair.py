"""The cheapest edits that make a conversation alternate, by iterative-deepening A*.

Rows are put in order by one sort over all conversations; the sort spreads a long one over many tasks,
and no window or group ever holds more than a segment of it. Every segment is searched depth first, in the
order of the edits' letters, under cost bounds that grow by one; a table keeps the states that failed and the
budget they failed with. The first path that is accepted is thus the cheapest and the least in
ASCII. Segments of a long conversation are searched from each state to each state, and a pass over its
segments chains them.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promoscan.llm.common import stored

# Costs of edits, characters that end a sentence, white space, and the roles that edits give.
DELETE, INSERT, REROLE, TRUNCATED = 3, 2, 2, 1
SENTENCE_END = "[.!?]"
WORD = r"[^\x20\x09-\x0D]"
ROLES = {"u": "user", "a": "assistant"}
#: States: nothing yet, after s, after u, after a; where a role leads, and which role an edit gives.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
WANTED = ("u", "u", "a", "u")
#: Inserts that complete a conversation in a state.
COMPLETE = ("", "ua", "a", "")
LEGAL = ("su", "ua", "au")
STATES = range(4)
#: Rows of a segment; a power of two.
SEGMENT = 128
ACCEPT, NEVER = -1, 1 << 40

Row = tuple[str, str]  # initial of the role (x: any other), fault: b, d, t or -


def _least_costs(rows: list[Row], goal: int) -> list[list[int]]:
    """For the rows from each place on and each state, what they cost at least.

    Forced deletes and truncated rows have their cost. Of neighbours that stay, wrong pairs of roles have to be mended;
    an edit costs two or more and touches two pairs at most, which follow each other, so that a
    run of v wrong pairs takes v / 2 edits, rounded up, of its own.
    """
    if goal in (0, 1):
        # no step leads back here: everything goes, but for one s on the way to state 1
        n = len(rows)
        spared = [any(row[0] == "s" and row[1] not in "bd" for row in rows[i:]) for i in range(n + 1)]
        first = [DELETE * (n - i) if goal == 0 else DELETE * (n - i - 1) if spared[i] else NEVER for i in range(n + 1)]
        return [[first[i], DELETE * (n - i) if goal == 1 else NEVER, NEVER, NEVER] for i in range(n + 1)]
    roles = "-sua"  # of the last row, by state
    ends = [(goal == ACCEPT and not COMPLETE[s]) or s == goal for s in STATES]
    # forced costs, the next row that stays, wrong pairs that follow it at once, and the cost of later runs
    forced, following, run, later = 0, "", 0, 0
    out = []
    for initial, fault in [("", ""), *reversed(rows)]:
        if fault and fault in "bd":
            forced += DELETE
        elif initial:
            wrong = not ends[roles.find(initial)] if not following else initial + following not in LEGAL
            if initial == "x":
                wrong = True
            run, later = (run + 1, later) if wrong else (0, later + 2 * ((run + 1) // 2))
            forced += TRUNCATED if fault == "t" else 0
            following = initial
        at = []
        for state in STATES:
            good = ends[state] if not following else (state, following) in STEPS
            at.append(forced + (2 * ((run + 1) // 2) if good else 2 * ((run + 2) // 2)) + later)
        out.append(at)
    return out[::-1]


def cheapest(rows: list[Row], start: int, goal: int) -> tuple[int, str] | None:
    """(cost, edits) from state ``start`` over ``rows`` to state ``goal``, or to the end of a conversation (``ACCEPT``).

    Only the end of a conversation takes inserts after its last row, so that the edits of a segment
    are never the beginning of others. None if the state can't be reached.
    """
    n = len(rows)
    gone = [fault in "bd" for _, fault in rows]
    least = _least_costs(rows, goal)
    failed: dict[tuple[int, int], int] = {}

    def search(i: int, state: int, budget: int) -> str | None:
        if least[i][state] > budget or failed.get((i, state), -1) >= budget:
            return None
        found = tried(i, state, budget)
        if found is None:
            failed[i, state] = budget
        return found

    def tried(i: int, state: int, budget: int) -> str | None:
        if i == n:
            if goal != ACCEPT:
                return "" if state == goal else None
            rest = COMPLETE[state]
            return "I" * len(rest) if INSERT * len(rest) <= budget else None
        if budget >= DELETE and (rest := search(i + 1, state, budget - DELETE)) is not None:
            return "D" + rest
        following = STEPS[state, WANTED[state]]
        if budget >= INSERT and (rest := search(i, following, budget - INSERT)) is not None:
            return "I" + rest
        if gone[i]:
            return None
        initial, fault = rows[i]
        extra = TRUNCATED if fault == "t" else 0
        kept = STEPS.get((state, initial))
        if kept is not None and budget >= extra and (rest := search(i + 1, kept, budget - extra)) is not None:
            return "K" + rest
        if budget >= REROLE + extra and (rest := search(i + 1, following, budget - REROLE - extra)) is not None:
            return "R" + rest
        return None

    # deleting or completing all rows reaches a state within this, if any path does
    for bound in range(least[0][start], (DELETE + INSERT) * n + INSERT * 4 + 1):
        found = search(0, start, bound)
        if found is not None:
            return bound, found
    return None


def _rows(codes: str) -> list[Row]:
    return list(zip(codes[::2], codes[1::2], strict=True))


_PATHS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))


def _searched(batches):
    """Adds the cheapest paths of each segment: from the first state or all, to the end or all states."""
    for batch in batches:
        out = []
        for codes, first, last in zip(*(batch.column(c).to_pylist() for c in ("codes", "is_first", "is_last")), strict=True):
            rows, paths = _rows(codes), []
            for start in [0] if first else STATES:
                for end in [ACCEPT] if last else STATES:
                    found = cheapest(rows, start, end)
                    if found:
                        paths.append({"start": start, "end": end, "cost": found[0], "edits": found[1]})
            out.append(paths)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _PATHS)], names=[*batch.schema.names, "paths"])


class _Chain:
    """The segments of one conversation, in order, and the best way to each state so far."""

    def __init__(self):
        # state: (cost, rank among ways of equal cost to any state, edits of each segment)
        self.best: dict[int, tuple[int, int, tuple]] = {0: (0, 0, None)}
        self.blocks: list[tuple[int, str]] = []

    def add(self, block: int, codes: str, paths: list[dict]) -> None:
        self.blocks.append((block, codes))
        ways = {}
        for p in paths:
            if p["start"] in self.best:
                cost, rank, before = self.best[p["start"]]
                way = (cost + p["cost"], rank, p["edits"], (before, p["start"], p["edits"]))
                if p["end"] not in ways or way[:3] < ways[p["end"]][:3]:
                    ways[p["end"]] = way
        # no edits are the beginning of others, so that the order so far stays the order of the whole
        order = sorted({way[1:3] for way in ways.values()})
        self.best = {end: (cost, order.index((rank, edits)), way) for end, (cost, rank, edits, way) in ways.items()}

    def rows(self) -> Iterator[tuple[int, str, list[str], int]]:
        """(block, edits, what becomes of each row, wrong pairs) of each segment."""
        way, chosen = self.best[ACCEPT][2], []
        while way:
            way, start, edits = way
            chosen.append((start, edits))
        before = ""
        for (block, codes), (state, edits) in zip(self.blocks, reversed(chosen), strict=True):
            initials = before + codes[::2]
            illegal = sum(initials[i : i + 2] not in LEGAL for i in range(len(initials) - 1))
            before = initials[-1]
            yield block, edits, applied(_rows(codes), state, edits), illegal


def applied(rows: list[Row], state: int, edits: str) -> list[str]:
    """For each row: initials inserted before it, then D, K, or the capital initial of its new role; at the end inserts alone."""
    out, inserted, i = [], "", 0
    for edit in edits:
        if edit == "I":
            inserted += WANTED[state]
            state = STEPS[state, WANTED[state]]
            continue
        if edit == "K":
            state = STEPS[state, rows[i][0]]
        elif edit == "R":
            edit = WANTED[state].upper()
            state = STEPS[state, WANTED[state]]
        out.append(inserted + edit)
        inserted, i = "", i + 1
    return [*out, inserted] if inserted else out


def _chained(batches):
    """Rows (c, block, edits, made, illegal, cost) of segments sorted by conversation and block."""
    names = ["c", "block", "edits", "made", "illegal"]
    chain, current = None, None

    def flush(kind):
        rows = list(chain.rows())
        columns = [pa.array([current] * len(rows), kind), *(pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.list_(pa.string()), pa.int64()), strict=True))]
        return pa.RecordBatch.from_arrays(columns, names=names)

    kind = None
    for batch in batches:
        kind = batch.schema.field("c").type
        for row in batch.to_pylist():
            if chain is None or row["c"] != current:
                if chain:
                    yield flush(kind)
                chain, current = _Chain(), row["c"]
            chain.add(row["block"], row["codes"], row["paths"])
    if chain:
        yield flush(kind)


def ordered_rows(rows: DataFrame) -> DataFrame:
    """(c, turn, role, text, pos): ``pos`` numbers all rows by conversation, turn (nulls first), role and text.

    Equal rows are told apart by where they were read, so that the sort can spread any number of them.
    """
    numbered = rows.withColumn("_read", F.monotonically_increasing_id())
    order = [F.asc_nulls_first("c"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text"), F.asc("_read")]
    return stored(numbered.orderBy(*order).withColumn("pos", F.monotonically_increasing_id()).drop("_read"), "turns")


def faults(ordered: DataFrame) -> DataFrame:
    """(c, turn, pos, initial, fault) of :func:`ordered_rows`: the first fault of blank b, duplicate d and truncated t, or -."""
    initial = F.substring("role", 1, 1)
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "text"), 256)
    rows = ordered.select(
        "c", "turn", "pos", same.alias("same"), F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~F.col("text").rlike(rf"{SENTENCE_END}[\x20\x09-\x0D]*\z")).alias("cut"),
    )
    firsts = rows.groupBy(F.col("c").alias("c1"), F.col("same").alias("same1")).agg(F.min("pos").alias("first"))
    met = rows.join(firsts, F.col("c").eqNullSafe(F.col("c1")) & (F.col("same") == F.col("same1")))
    fault = F.when(F.col("blank"), "b").when(F.col("pos") > F.col("first"), "d").when(F.col("cut"), "t").otherwise("-")
    return met.select("c", "turn", "pos", "initial", fault.alias("fault"))


def segments(rows: DataFrame) -> DataFrame:
    """(c, block, codes, is_first, is_last): the rows of a conversation in blocks of ``SEGMENT`` places."""
    block = F.shiftright("pos", SEGMENT.bit_length() - 1)
    code = F.concat("initial", "fault")
    found = rows.groupBy("c", block.alias("block")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", code.alias("code")))), lambda x: x["code"]), "").alias("codes"))
    ends = rows.groupBy(F.col("c").alias("c1")).agg(F.min(block).alias("lo"), F.max(block).alias("hi"))
    met = found.join(ends, F.col("c").eqNullSafe(F.col("c1")))
    return met.select("c", "block", "codes", (F.col("block") == F.col("lo")).alias("is_first"), (F.col("block") == F.col("hi")).alias("is_last"))


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (c, turn, role, text); role and text are not null.

    Returns a row per conversation, (c, blank, duplicate, truncated, illegal, cost, audit, min_turn, max_turn, turns), and the
    repaired rows (c, pos, place, role, text), in order by pos and place. ``c`` and ``turn`` may be null; turns
    are ordered with nulls first, equal ones by role and text. ``audit`` has the first letters of the edits Delete,
    Insert, Keep and Rerole. An empty table gives empty ones.

    Bounds: a segment is searched in one task; chaining holds four ways through one conversation, each as
    long as its audit.
    """
    ordered = ordered_rows(rows)
    marked = stored(faults(ordered), "faults")
    kind = f"c {rows.schema['c'].dataType.simpleString()}, block long"
    paths = "paths array<struct<start: int, end: int, cost: long, edits: string>>"
    searched = segments(marked).mapInArrow(_searched, f"{kind}, codes string, is_first boolean, is_last boolean, {paths}")
    sorted_paths = searched.select("c", "block", "codes", "paths").repartition("c").sortWithinPartitions("c", "block")
    chained = stored(sorted_paths.mapInArrow(_chained, f"{kind}, edits string, made array<string>, illegal long"), "repairs")

    edits = F.col("edits")
    dear = F.lit(DELETE) * F.regexp_count(edits, F.lit("D")) + F.lit(INSERT) * F.regexp_count(edits, F.lit("I")) + F.lit(REROLE) * F.regexp_count(edits, F.lit("R"))
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "edits"))), lambda x: x["edits"]), "")
    whole = chained.groupBy("c").agg(F.sum("illegal").alias("illegal"), F.sum(dear).alias("edit_cost"), audit.alias("audit"))

    # the place of a row among its segment's: a segment is at most SEGMENT rows
    block = F.shiftright("pos", SEGMENT.bit_length() - 1)
    places = marked.groupBy("c", block.alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "fault"))).alias("rows"))
    met = places.join(chained.select(F.col("c").alias("c1"), F.col("block").alias("block1"), "made"), F.col("c").eqNullSafe(F.col("c1")) & (F.col("block") == F.col("block1")))
    # inserts after the last row are an element of their own
    tail = F.when(F.size("made") > F.size("rows"), F.element_at("made", -1)).otherwise("")
    each = met.select("c", F.size("rows").alias("n"), tail.alias("tail"), F.posexplode(F.arrays_zip("rows", F.slice("made", F.lit(1), F.size("rows")).alias("made"))).alias("i", "x"))
    plan = stored(each.select("c", F.col("x.rows.pos").alias("pos"), F.col("x.rows.fault").alias("fault"), F.col("x.made").alias("made"), F.when(F.col("i") == F.col("n") - 1, F.col("tail")).otherwise("").alias("tail")), "plan")

    def count(condition: str) -> Column:
        return F.count_if(F.expr(condition))

    sums = marked.groupBy("c").agg(
        count("fault = 'b'").alias("blank"), count("fault = 'd'").alias("duplicate"), count("fault = 't'").alias("truncated"),
        F.min("turn").alias("min_turn"), F.max("turn").alias("max_turn"),
    )
    turns = marked.filter(F.col("turn").isNotNull()).select("c", "turn").distinct().groupBy("c").agg(F.count("*").alias("turns"))
    kept_cut = plan.filter("fault = 't' and right(made, 1) <> 'D'").groupBy("c").agg(F.count("*").alias("cut"))
    result = _with(_with(_with(sums, whole), turns), kept_cut)
    result = result.select(
        "c", "blank", "duplicate", "truncated", "illegal", (F.col("edit_cost") + F.lit(TRUNCATED) * F.coalesce("cut", F.lit(0))).alias("cost"), "audit",
        "min_turn", "max_turn", F.coalesce("turns", F.lit(0)).cast("long").alias("turns"),
    )

    own = F.right("made", F.lit(1))

    def given(initials: Column) -> Column:
        """Rows of inserted roles, with empty texts."""
        made = F.transform(F.filter(F.split(initials, ""), lambda x: x != ""), lambda x: F.struct(F.when(x == "u", ROLES["u"]).otherwise(ROLES["a"]).alias("role"), F.lit("").alias("text")))
        return made

    role = F.when(own == "K", F.col("role")).when(own == "U", ROLES["u"]).otherwise(ROLES["a"])
    itself = F.when(own == "D", F.array().cast("array<struct<role: string, text: string>>")).otherwise(F.array(F.struct(role.alias("role"), F.col("text").alias("text"))))
    before = F.expr("left(made, length(made) - 1)")
    lines = F.concat(given(before), itself, given(F.col("tail")))
    repaired = ordered.join(plan.select("pos", "made", "tail"), "pos").select("c", "pos", F.posexplode(lines).alias("place", "line")).select("c", "pos", "place", "line.role", "line.text")
    return result, repaired


def _with(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left`` with what ``right`` has for the same conversation."""
    named = right.withColumnRenamed("c", "c1")
    return left.join(named, F.col("c").eqNullSafe(F.col("c1")), "left").drop("c1")


def _digests(batches):
    """(c, sha256 of ``role:text`` lines) of rows sorted by conversation; texts are not gathered."""
    import hashlib

    digest = current = kind = None
    done: list = []

    def out():
        return pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind), pa.array([d for _, d in done], pa.string())], names=["c", "sha"])

    for batch in batches:
        kind = batch.schema.field("c").type
        for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("c", "role", "text")), strict=True):
            if digest is None or c != current:
                if digest:
                    done.append((current, digest.hexdigest()))
                digest, current = hashlib.sha256(), c
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
        if len(done) > 10_000:
            yield out()
            done.clear()
    if digest:
        done.append((current, digest.hexdigest()))
        yield out()


def digests(repaired: DataFrame) -> DataFrame:
    """(c, sha) of each conversation of :func:`repair` that has rows; one task streams through a conversation, as its digest needs."""
    rows = repaired.repartition("c").sortWithinPartitions("c", "pos", "place").select("c", "role", "text")
    return rows.mapInArrow(_digests, f"c {repaired.schema['c'].dataType.simpleString()}, sha string")


def damaged(conversations: DataFrame) -> DataFrame:
    """(c, turn, role, text) of conversations (conv_id, turn, role, text), some rows changed by a hash of their place."""

    def shown(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    # nulls are one space, in the key of the damage as in role and text
    kind = F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(shown("text"), SENTENCE_END, "")).otherwise(shown("text"))
    copies = F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    rows = conversations.filter(kind != 0).select(F.col("conv_id").alias("c"), "turn", F.when(kind == 4, "user").otherwise(shown("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"))
    return rows.drop("copy")


def repaired_after_damage(conversations: DataFrame) -> DataFrame:
    """Damages and repairs (conv_id, turn, role, text); one row per ``conv_id``, null being one of them.

    (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256); conversations of which
    no row is left have zeros, an empty audit and the digest of nothing. Other columns are ignored.
    """
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    result, repaired = repair(damaged(conversations.select("conv_id", "turn", "role", "text")))
    found = _with(_with(ids, result), digests(repaired))
    wide = [F.col(x).cast("decimal(20,0)") for x in ("max_turn", "min_turn", "turns")]
    gaps = F.coalesce((wide[0] - wide[1] + 1 - wide[2]).cast("long"), F.lit(0).cast("long"))
    counts = [F.coalesce(F.col(x), F.lit(0)).cast("long").alias(x) for x in ("blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select(F.col("c").alias("conv_id"), gaps.alias("gaps"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
