"""Structure repair of conversations by generalised LR parsing of their roles.

The grammar says which role sequences are whole: an optional system message, then pairs of user and
assistant. An LR automaton is built from it, and the role sequence is parsed with a graph-structured
stack: a top is an LR state, its links lead to the nodes below, and nodes below are shared. Rows may be
kept, deleted, given another role or have empty messages put before them, each at its cost; all of this
happens in parallel, and equal tops with equal links are merged by the smaller (cost, audit).

Long conversations are split: rows are dealt by ranges of (conversation, turn), a run of rows of one
conversation is parsed from every stack it may start with, and the runs' results, a few small
numbers and strings, are put together from the last run to the first. Only the join that gives the
edits their texts and the count of equal rows shuffle whole conversations.

Results by case. A null conversation id is a conversation of its own, null turns come first, a null role
or text is one space. Rows of one turn stand by role, then by the SHA-256 of their text; equal rows stand
together and all but the first are duplicates. A conversation whose rows all go has an empty audit's
rest only, an empty table gives nothing. Texts of any length are read once for their faults and moved
once for the result; other columns are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from passagemill.session import cut_lineage

ROWS_PER_RUN = 1_024
KEEP, DELETE, REROLE, INSERT = "K", "D", "R", "I"
COSTS = {KEEP: 0, DELETE: 4, REROLE: 3, INSERT: 3}
TRUNCATED_COST = 3
#: Terminals are role initials; only these two can be given or put in.
GIVEN = {"u": "user", "a": "assistant"}
START = "dialogue"
GRAMMAR = (
    (START, ()),
    (START, ("pairs",)),
    (START, ("s", "pairs")),
    ("pairs", ("u", "a")),
    ("pairs", ("pairs", "u", "a")),
)
#: What may stand side by side.
LEGAL = ("su", "ua", "au")
FINE, TRUNCATED, GONE = 0, 1, 2


class Automaton:
    """LR(0) states of a grammar: where symbols lead, and the rules that are complete in a state."""

    def __init__(self, grammar, start: str):
        self.grammar, self.start = grammar, start
        names = {left for left, _ in grammar}
        first = self._closed({(i, 0) for i, (left, _) in enumerate(grammar) if left == start}, names)
        numbers, todo = {first: 0}, [first]
        self.goto: list[dict[str, int]] = []
        self.complete: list[list[tuple[str, int]]] = []
        while todo:
            items = todo.pop(0)
            moved: dict[str, set] = {}
            for rule, dot in items:
                right = grammar[rule][1]
                if dot < len(right):
                    moved.setdefault(right[dot], set()).add((rule, dot + 1))
            leads = {}
            for symbol in sorted(moved):
                target = self._closed(moved[symbol], names)
                if target not in numbers:
                    numbers[target] = len(numbers)
                    todo.append(target)
                leads[symbol] = numbers[target]
            self.goto.append(leads)
            done = sorted(rule for rule, dot in items if dot == len(grammar[rule][1]))
            self.complete.append([(grammar[rule][0], len(grammar[rule][1])) for rule in done])
        # A state that can only be reduced is left at once.
        self.stays = [any(s not in names for s in leads) for leads in self.goto]

    def _closed(self, items: set, names: set) -> frozenset:
        items, todo = set(items), list(items)
        while todo:
            rule, dot = todo.pop()
            right = self.grammar[rule][1]
            if dot < len(right) and right[dot] in names:
                for i, (left, _) in enumerate(self.grammar):
                    if left == right[dot] and (i, 0) not in items:
                        items.add((i, 0))
                        todo.append((i, 0))
        return frozenset(items)


LR = Automaton(GRAMMAR, START)
BOTTOM = (0, None)


def _link(tops: dict, node: tuple, weight: tuple) -> bool:
    """A top's link to the nodes below it; of two equal ones the smaller (cost, audit) stays."""
    links = tops.setdefault(node[0], {})
    old = links.get(node[1])
    if old is not None and old <= weight:
        return False
    links[node[1]] = weight
    return True


def _shift(node: tuple, symbol: str) -> list[tuple]:
    """Nodes that stand on top after a symbol and the reductions it completes."""
    todo, out = [(LR.goto[node[0]][symbol], node)], []
    while todo:
        top = todo.pop()
        # Rules of the start symbol wait for the end of the conversation.
        waits = any(left == LR.start for left, _ in LR.complete[top[0]])
        if LR.stays[top[0]] or waits:
            out.append(top)
        for left, length in LR.complete[top[0]]:
            if left != LR.start:
                below = top
                for _ in range(length):
                    below = below[1]
                todo.append((LR.goto[below[0]][left], below))
    return out


_shifted = lru_cache(maxsize=None)(lambda node, symbol: tuple(_shift(node, symbol)) if symbol in LR.goto[node[0]] else ())


def _nodes(tops: dict) -> list[tuple]:
    return [((state, below), weight) for state, links in tops.items() for below, weight in links.items()]


def _with_inserts(tops: dict) -> dict:
    """Tops that any number of inserted messages leads to as well, cheapest first."""
    out = {state: dict(links) for state, links in tops.items()}
    heap = [(weight, i, node) for i, (node, weight) in enumerate(_nodes(out))]
    heapq.heapify(heap)
    while heap:
        weight, order, node = heapq.heappop(heap)
        if out[node[0]][node[1]] != weight:
            continue
        more = (weight[0] + COSTS[INSERT], weight[1] + INSERT)
        for symbol in GIVEN:
            for top in _shifted(node, symbol):
                if _link(out, top, more):
                    heapq.heappush(heap, (more, order + len(heap) + 1, top))
    return out


def _row(tops: dict, initial: str, fault: int, copies: int) -> dict:
    """Tops after one row and its copies, which are duplicates and must go."""
    out: dict = {}
    for node, (cost, audit) in _nodes(_with_inserts(tops)):
        _link(out, node, (cost + COSTS[DELETE], audit + DELETE))
        if fault == GONE:
            continue
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        for top in _shifted(node, initial):
            _link(out, top, (cost + COSTS[KEEP] + extra, audit + KEEP))
        for symbol in GIVEN:
            for top in _shifted(node, symbol):
                _link(out, top, (cost + COSTS[REROLE] + extra, audit + REROLE))
    if copies > 1:
        # Deletions side by side come before any insertion of the same cost.
        rest = copies - 1
        out = {
            state: {below: (cost + rest * COSTS[DELETE], audit + DELETE * rest) for below, (cost, audit) in links.items()}
            for state, links in out.items()
        }
    return out


def _all_stacks() -> list[tuple]:
    """Every stack that role sequences lead to; left recursion keeps them few."""
    terminals = sorted({s for _, right in GRAMMAR for s in right} - {left for left, _ in GRAMMAR})
    found, todo = [BOTTOM], [BOTTOM]
    while todo:
        node = todo.pop(0)
        for symbol in terminals:
            for top in _shifted(node, symbol):
                if top not in found:
                    found.append(top)
                    todo.append(top)
    return found


STACKS = _all_stacks()
NUMBER = {node: i for i, node in enumerate(STACKS)}


def _closing(stack: int) -> tuple[int, str]:
    """The cheapest insertions that complete a conversation from a stack."""
    best = []
    for node, weight in _nodes(_with_inserts({STACKS[stack][0]: {STACKS[stack][1]: (0, "")}})):
        for left, length in LR.complete[node[0]]:
            below = node
            for _ in range(length):
                below = below[1]
            if left == LR.start and below == BOTTOM:
                best.append(weight)
    return min(best)


CLOSING = [_closing(i) for i in range(len(STACKS))]


def parse_run(rows: tuple, starts: tuple) -> list[tuple]:
    """``(start, end, cost, audit)`` of a run of ``(initial, fault, copies)`` from each stack it may start with."""
    return _parsed_short(rows, starts) if len(rows) <= 16 else _parsed(rows, starts)


def _parsed(rows: tuple, starts: tuple) -> list[tuple]:
    out = []
    for start in starts:
        tops = {STACKS[start][0]: {STACKS[start][1]: (0, "")}}
        for row in rows:
            tops = _row(tops, *row)
        out += [(start, NUMBER[node], cost, audit) for node, (cost, audit) in _nodes(tops)]
    return out


#: Most conversations are short and look alike.
_parsed_short = lru_cache(maxsize=1 << 14)(_parsed)


def roles_of(start: int, audit: str, initials: list[str]) -> tuple[list[str | None], int]:
    """The role that every edit of an audit gives (None: the row's own, or none) and the stack it ends with."""
    node, at, roles = STACKS[start], 0, []
    for edit in audit:
        if edit in (KEEP, DELETE):
            symbol = initials[at] if edit == KEEP else None
            roles.append(None)
        else:
            symbol = next(s for s in GIVEN if _shifted(node, s))
            roles.append(GIVEN[symbol])
        if symbol is not None:
            node = next(iter(_shifted(node, symbol)))
        at += edit != INSERT
    return roles, NUMBER[node]


# --- rows ------------------------------------------------------------------------

_SPACE = " \t\n\u000b\u000c\r"
_FEATURES = ["conv_id", "turn", "role", "digest"]


def faults(text: Column) -> Column:
    """2 blank, 1 truncated, 0 neither."""
    trimmed = F.btrim(text, F.lit(_SPACE))
    return F.when(trimmed == "", GONE).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)


def _prepared(conversations: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(" "))
    return conversations.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text")
    ).withColumn("digest", F.unhex(F.sha2("text", 256)))


def _features(rows: DataFrame) -> DataFrame:
    """One row per distinct row: its copies, and whether its role and text stood in the conversation before."""
    distinct = rows.groupBy(*_FEATURES).agg(
        F.count("*").alias("copies"), F.first(faults(F.col("text"))).alias("fault")
    )
    said = distinct.groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("turns"), F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first")
    ).filter("turns > 1").select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    again = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return distinct.join(said, again, "left").select(
        *_FEATURES,
        "copies",
        "fault",
        F.when(F.col("first").isNull(), False).otherwise(~F.col("turn").eqNullSafe(F.col("first.turn"))).alias("said_before"),
    )


_RUN = (
    "conv_id {id}, turn_set boolean, first_turn long, first_role string, first_digest binary, turns array<long>, roles array<string>, "
    "digests array<binary>, copies array<long>, starts array<int>, ends array<int>, costs array<long>, "
    "audits array<string>, blank long, duplicate long, truncated long, illegal long, n_turns long, min_turn long, max_turn long"
)


def _batch(rows: list[dict], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))


def _run(conv, rows: list, starts: tuple) -> dict:
    """What is known of a run of rows on its own."""
    signature, initials, illegal = [], [], 0
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, _, copies, fault, said in rows:
        gone = fault == GONE or said
        signature.append((role[:1], GONE if gone else fault, copies))
        if gone or fault == TRUNCATED:
            count["blank" if fault == GONE else "duplicate" if said else "truncated"] += 1
        count["blank" if fault == GONE else "duplicate"] += copies - 1
        illegal += (copies - 1) * (role[:1] * 2 not in LEGAL)
        illegal += bool(initials) and initials[-1] + role[:1] not in LEGAL
        initials.append(role[:1])
    parsed = parse_run(tuple(signature), starts)
    turns = [r[0] for r in rows]
    known = [t for t in turns if t is not None]
    return {
        "conv_id": conv, "turn_set": turns[0] is not None, "first_turn": turns[0], "first_role": rows[0][1], "first_digest": rows[0][2],
        "turns": turns, "roles": [r[1] for r in rows], "digests": [r[2] for r in rows], "copies": [r[3] for r in rows],
        "starts": [p[0] for p in parsed], "ends": [p[1] for p in parsed], "costs": [p[2] for p in parsed], "audits": [p[3] for p in parsed],
        **count, "illegal": illegal,
        "n_turns": len(set(known)), "min_turn": min(known, default=None), "max_turn": max(known, default=None),
    }


def _parsed_runs(features: DataFrame, rows_per_run: int) -> DataFrame:
    """Runs of at most ``rows_per_run`` rows of one conversation, parsed where range partitioning has put them."""
    first = [F.col("conv_id"), F.col("turn"), F.col("role"), F.col("digest")]
    ordered = features.repartitionByRange(*first).sortWithinPartitions(*first)
    schema = T.StructType.fromDDL(_RUN.format(id=features.schema["conv_id"].dataType.simpleString()))

    def parse(batches: Iterator) -> Iterator:
        everywhere = tuple(range(len(STACKS)))
        # The first conversation of a partition may have begun in the one before.
        conv, rows, starts, begun = None, [], everywhere, False
        for batch in batches:
            out = []
            for c, *row in zip(*(column.to_pylist() for column in batch.columns)):
                changed = begun and c != conv
                if rows and (changed or len(rows) >= rows_per_run):
                    out.append(_run(conv, rows, starts))
                    rows, starts = [], everywhere
                if changed:
                    starts = (0,)
                conv, begun = c, True
                rows.append(row)
            if out:
                yield _batch(out, schema)
        if rows:
            yield _batch([_run(conv, rows, starts)], schema)

    return ordered.mapInArrow(parse, schema)


_CHOSEN = (
    "conv_id {id}, number long, audit string, cost long, blank long, duplicate long, truncated long, illegal long, n_turns long, "
    "min_turn long, max_turn long, turns array<long>, roles array<string>, digests array<binary>, given array<string>"
)


def _chosen(conv, runs: list[dict]) -> list[dict]:
    """The edits of a conversation whose runs come last first; a run's cheapest way on is known when it comes."""
    rest, ways = [CLOSING[i] for i in range(len(STACKS))], []
    for run in runs:
        best: dict[int, tuple] = {}
        for start, end, cost, audit in zip(run["starts"], run["ends"], run["costs"], run["audits"]):
            # Audits of a run end with a row, so none is the beginning of another: the rest cannot change their order.
            way = (cost + rest[end][0], audit, end)
            if start not in best or way < best[start]:
                best[start] = way
        if not ways:
            best = {s: (cost, audit + CLOSING[end][1], end) for s, (cost, audit, end) in best.items()}
        ways.append(best)
        rest = [(best[s][0], "") if s in best else None for s in range(len(STACKS))]
    out, start, left, after = [], 0, ways[-1][0][0], None
    for i in range(len(runs) - 1, -1, -1):
        run, (_, audit, end) = runs[i], ways[i][start]
        total = ways[i - 1][end][0] if i else 0
        first, last = run["roles"][0][:1], run["roles"][-1][:1]
        here = {n: run[n] for n in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
        if after is not None:
            here["illegal"] += after[0] + first not in LEGAL
            here["n_turns"] -= after[1] is not None and after[1] == run["turns"][0]
        each = [(t, r, d) for t, r, d, n in zip(run["turns"], run["roles"], run["digests"], run["copies"]) for _ in range(n)]
        given, _ = roles_of(start, audit, [r[:1] for _, r, _ in each])
        known = [t for t, _, _ in each if t is not None]
        # One entry per edit; insertions stand for no row.
        rows = iter(each)
        edits = [(None, None, None) if edit == INSERT else next(rows) for edit in audit]
        out.append({
            "conv_id": conv, "number": len(runs) - 1 - i, "audit": audit, "cost": left - total, **here,
            "min_turn": min(known, default=None), "max_turn": max(known, default=None),
            "turns": [e[0] for e in edits], "roles": [e[1] for e in edits], "digests": [e[2] for e in edits], "given": given,
        })
        after, start, left = (last, each[-1][0]), end, total
    return out


def _edited_runs(parsed: DataFrame) -> DataFrame:
    schema = T.StructType.fromDDL(_CHOSEN.format(id=parsed.schema["conv_id"].dataType.simpleString()))
    backwards = [F.col(c).desc_nulls_last() for c in ("turn_set", "first_turn", "first_role", "first_digest")]
    ordered = parsed.repartition("conv_id").sortWithinPartitions("conv_id", *backwards)

    def choose(batches: Iterator) -> Iterator:
        conv, runs = None, []
        for batch in batches:
            out = []
            for run in batch.to_pylist():
                if runs and run["conv_id"] != conv:
                    out += _chosen(conv, runs)
                    runs = []
                conv = run["conv_id"]
                runs.append(run)
            if out:
                yield _batch(out, schema)
        if runs:
            yield _batch(_chosen(conv, runs), schema)

    return ordered.mapInArrow(choose, schema)


def repair(conversations: DataFrame, rows_per_run: int = ROWS_PER_RUN) -> tuple[DataFrame, DataFrame]:
    """``(edits, summary)`` of a table ``conv_id, turn, role, text``.

    Edits, in order ``run, at``: ``action`` (keep, delete, rerole, insert), the row's ``turn, role, text`` and
    ``new_role`` (null if deleted). Kept, reroled and inserted rows are the repaired conversation; inserted texts are
    empty. Summary, one row per conversation: ``gaps, blank, duplicate, truncated, illegal, cost, audit``.
    """
    rows = _prepared(conversations)
    parsed = _parsed_runs(_features(rows), rows_per_run)
    chosen = cut_lineage(_edited_runs(parsed))
    names = F.create_map(*[F.lit(x) for pair in ((KEEP, "keep"), (DELETE, "delete"), (REROLE, "rerole"), (INSERT, "insert")) for x in pair])
    letters = F.filter(F.split("audit", ""), lambda x: x != "")
    edits = chosen.select(
        "conv_id",
        F.col("number").alias("run"),
        F.posexplode(F.arrays_zip(letters.alias("edit"), F.col("turns"), F.col("roles"), F.col("digests"), F.col("given"))).alias("at", "e"),
    ).select(
        "conv_id", "run", "at", F.element_at(names, F.col("e.edit")).alias("action"), F.col("e.turns").alias("turn"),
        F.col("e.roles").alias("role"), F.col("e.digests").alias("digest"), F.col("e.given").alias("given"),
    )
    texts = rows.groupBy(*_FEATURES).agg(F.first("text").alias("text"))
    texts = texts.select(*[F.col(c).alias(f"_{c}") for c in _FEATURES], "text")
    same = F.col("digest") == F.col("_digest")
    for c in ("conv_id", "turn", "role"):
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    new_role = F.when(F.col("action") != "delete", F.coalesce("given", "role"))
    full = edits.join(texts, same, "left").select(
        "conv_id", "run", "at", "action", "turn", "role",
        F.when(F.col("action") == "insert", F.lit("")).otherwise(F.col("text")).alias("text"), new_role.alias("new_role"),
    )
    pieces = F.array_sort(F.collect_list(F.struct("number", "audit")))
    summary = chosen.groupBy("conv_id").agg(
        F.coalesce(F.max("max_turn") - F.min("min_turn") + 1 - F.sum("n_turns"), F.lit(0)).cast("bigint").alias("gaps"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")],
        F.array_join(F.transform(pieces, lambda p: p["audit"]), "").alias("audit"),
    )
    return full, summary


def repaired_digests(edits: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the repaired ``role:text`` lines.

    A hash over a conversation is one sequence, so its rows stream through one task in order; what is held is a batch.
    """
    import hashlib

    schema = T.StructType.fromDDL(f"conv_id {edits.schema['conv_id'].dataType.simpleString()}, repaired_sha256 string")
    lines = edits.filter("action <> 'delete'").select("conv_id", "run", "at", F.concat("new_role", F.lit(":"), "text").alias("line"))
    ordered = lines.repartition("conv_id").sortWithinPartitions("conv_id", "run", "at").select("conv_id", "line")

    def digest(batches: Iterator) -> Iterator:
        conv, state = None, None
        for batch in batches:
            done = []
            for c, line in zip(*(column.to_pylist() for column in batch.columns)):
                if state is None or c != conv:
                    if state is not None:
                        done.append({"conv_id": conv, "repaired_sha256": state.hexdigest()})
                    conv, state = c, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(line.encode())
            if done:
                yield _batch(done, schema)
        if state is not None:
            yield _batch([{"conv_id": conv, "repaired_sha256": state.hexdigest()}], schema)

    return ordered.mapInArrow(digest, schema)
