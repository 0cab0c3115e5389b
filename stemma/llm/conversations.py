"""Repair of the role order of conversations by cheapest edits, with an audit of every edit."""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stemma.plans.durable import written

CHUNK = 20_000         # messages whose edits are found together in one task, about
PART = 64 << 20        # bytes of messages written out by one task, about
WHITE = r"' \t\n\u000B\u000C\r'"
DELETE, REROLE, INSERT, UNMENDED = 2, 1, 5, 5       # costs; keeping costs nothing
START, SYSTEM, USER, ASSISTANT = range(4)           # what the repaired conversation ends with so far
ENDS = (START, ASSISTANT)                           # it is whole in these states
NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEEPS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
NAMES = {USER: "user", ASSISTANT: "assistant"}
_PRIME = 10**18 + 3


class Edits:
    """A sequence of edits as a linked node: the edits before it and one more piece.

    Sequences share their prefixes. `ups[k]` is the node 2^k pieces before, `hash` a rolling hash of
    the whole sequence.
    """

    __slots__ = ("piece", "depth", "hash", "ups")

    def __init__(self, parent: Edits | None = None, piece: str = ""):
        self.piece, self.ups = piece, []
        self.depth = parent.depth + 1 if parent else 0
        data = piece.encode()
        self.hash = 0 if parent is None else (
            parent.hash * pow(256, len(data), _PRIME) + int.from_bytes(data, "big")) % _PRIME
        while parent:
            self.ups.append(parent)
            k = len(self.ups) - 1
            parent = parent.ups[k] if k < len(parent.ups) else None

    def before(self, depth: int) -> Edits:
        node = self
        while node.depth > depth:
            node = node.ups[(node.depth - depth).bit_length() - 1]
        return node

    def pieces(self, after: Edits | None = None) -> str:
        """The letters, all or those past the node `after`."""
        out, node = [], self
        while node is not after and node.ups:
            out.append(node.piece)
            node = node.ups[0]
        return "".join(reversed(out))

    def __lt__(self, other: Edits) -> bool:
        """Order of the letters, by a search for the longest common prefix.

        Nodes of one step are made once for a parent and a piece, so sequences that are
        equal are one node. That verifies what the hashes say; where two different nodes have one hash,
        the letters themselves are compared.
        """
        if self is other:
            return False
        depth = min(self.depth, other.depth)
        a, b = self.before(depth), other.before(depth)
        if a is b:
            return self.depth < other.depth
        if a.hash != b.hash:
            for k in range(len(a.ups) - 1, -1, -1):
                if k < len(a.ups) and a.ups[k].hash != b.ups[k].hash:
                    a, b = a.ups[k], b.ups[k]
            if a.ups[0] is b.ups[0] and not (a.piece.startswith(b.piece) or b.piece.startswith(a.piece)):
                return a.piece < b.piece
            if a.ups[0] is b.ups[0]:
                return self.pieces(a.ups[0]) < other.pieces(b.ups[0])
        return self.pieces() < other.pieces()


class Paths:
    """The cheapest edits that lead to each state, the ASCII-least of them on ties."""

    def __init__(self, best: dict[int, tuple[int, Edits]]):
        self.best = best

    def step(self, moves):
        """Paths after one of `moves`: (state before, state after, cost, piece), the state before may be new."""
        made, best = {}, {}
        for old, new, cost, piece, fresh in moves:
            source = best if fresh else self.best
            if old not in source:
                continue
            total, edits = source[old]
            total += cost
            if new in best and best[new][0] < total:
                continue
            key = (id(edits), piece)
            node = made.get(key) or made.setdefault(key, Edits(edits, piece) if piece else edits)
            if new not in best or total < best[new][0] or node < best[new][1]:
                best[new] = (total, node)
        return Paths(best)


_STAY = [(s, s, 0, "", False) for s in NEXT]
_INSERTS = [(s, NEXT[s], INSERT, "I", True) for s in (START, SYSTEM, ASSISTANT, USER)]


def _moves(initial: str, fault: str) -> list:
    moves = [(s, s, DELETE, "D", False) for s in NEXT]
    if fault not in ("blank", "duplicate"):
        extra = UNMENDED if fault == "truncated" else 0
        moves += [(s, t, extra, "K", False) for s, t in KEEPS.get(initial, {}).items()]
        moves += [(s, t, REROLE + extra, "R", False) for s, t in NEXT.items()]
    return moves + _INSERTS


_MOVES: dict[tuple[str, str], list] = {}


def cheapest(initials: list[str], faults: list[str], entry: int = START) -> dict[int, tuple[int, Edits]]:
    """{state: (cost, edits)} of a run of messages after the state `entry`."""
    paths = Paths({entry: (0, Edits())}).step(_STAY + _INSERTS)
    for key in zip(initials, faults):
        moves = _MOVES.get(key)
        if moves is None:
            if len(_MOVES) > 10_000:
                _MOVES.clear()
            moves = _MOVES[key] = _moves(*key)
        paths = paths.step(moves)
    return paths.best


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


_RUN = pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("whole", pa.bool_()), ("entry", pa.int32()),
                  ("exit", pa.int32()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64()),
                  ("first", pa.string()), ("last", pa.string())])
_RUNS = ("conv_id long, nth long, whole boolean, entry int, exit int, cost long, audit string, illegal long, "
         "first string, last string")


def _runs(table):
    """Edits of the messages of each conversation in a chunk.

    The first and the last conversation may go on in other chunks: they have a row for
    each pair of states before and after.
    """
    table = table.sort_by("nth")
    conv, nth, initial, fault = (table.column(c).to_pylist() for c in ("conv_id", "nth", "initial", "fault"))
    cuts = [0, *(i for i in range(1, len(conv)) if conv[i] != conv[i - 1]), len(conv)]
    rows = []
    for lo, hi in zip(cuts, cuts[1:]):
        letters = initial[lo:hi]
        whole = lo > 0 and hi < len(conv)
        told = {"conv_id": conv[lo], "nth": nth[lo], "whole": whole, "illegal": _illegal(letters),
                "first": letters[0], "last": letters[-1]}
        for entry in (START,) if whole else NEXT:
            found = cheapest(letters, fault[lo:hi], entry)
            if whole:
                found = {START: min(found[s] for s in ENDS if s in found)}
            rows += [{**told, "entry": entry, "exit": s, "cost": cost, "audit": edits.pieces()}
                     for s, (cost, edits) in found.items()]
    return pa.Table.from_pylist(rows, schema=_RUN)


_PRUNED = "conv_id long, nth long, entry int, exit int, cost long, illegal long"


def _pruned(table):
    """Runs of a conversation that lie on a cheapest way through all of its chunks, from costs alone."""
    rows = table.sort_by([("nth", "ascending"), ("entry", "ascending"), ("exit", "ascending")]).to_pylist()
    cuts = [0, *(i for i in range(1, len(rows)) if rows[i]["nth"] != rows[i - 1]["nth"]), len(rows)]
    chunks = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    far = math.inf
    ahead = [{START: 0}]
    for chunk in chunks:
        reach: dict[int, float] = {}
        for r in chunk:
            cost = ahead[-1].get(r["entry"], far) + r["cost"]
            reach[r["exit"]] = min(reach.get(r["exit"], far), cost)
        ahead.append(reach)
    total = min(ahead[-1].get(s, far) for s in ENDS)
    back, out = {s: 0 for s in ENDS}, []
    for k in range(len(chunks) - 1, -1, -1):
        reach = {}
        for r in chunks[k]:
            cost = r["cost"] + back.get(r["exit"], far)
            reach[r["entry"]] = min(reach.get(r["entry"], far), cost)
            if ahead[k].get(r["entry"], far) + cost == total:
                out.append(r)
        back = reach
    illegal = sum(c[0]["illegal"] for c in chunks) + sum(
        _illegal([a[0]["last"], b[0]["first"]]) for a, b in zip(chunks, chunks[1:]))
    return pa.Table.from_pylist([{"conv_id": r["conv_id"], "nth": r["nth"], "entry": r["entry"], "exit": r["exit"],
                                  "cost": int(total), "illegal": illegal} for r in out],
                                schema=pa.schema([("conv_id", pa.int64()), ("nth", pa.int64()), ("entry", pa.int32()),
                                                  ("exit", pa.int32()), ("cost", pa.int64()), ("illegal", pa.int64())]))


_JOINED = pa.schema([("conv_id", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("illegal", pa.int64())])


def _joined(table):
    """The ASCII-least of the cheapest ways through all chunks of a conversation."""
    rows = table.sort_by([("nth", "ascending"), ("entry", "ascending"), ("exit", "ascending")]).to_pylist()
    paths, lo = Paths({START: (0, Edits())}), 0
    for hi in range(1, len(rows) + 1):
        if hi == len(rows) or rows[hi]["nth"] != rows[lo]["nth"]:
            # All that is left is on a cheapest way, so only the letters decide.
            paths = paths.step([(r["entry"], r["exit"], 0, r["audit"], False) for r in rows[lo:hi]])
            lo = hi
    audit = min(paths.best[s][1] for s in ENDS if s in paths.best).pieces()
    return pa.Table.from_pylist([{"conv_id": rows[0]["conv_id"], "cost": rows[0]["cost"], "audit": audit,
                                  "illegal": rows[0]["illegal"]}], schema=_JOINED)


def _messages(rows: DataFrame) -> DataFrame:
    """Messages with nulls as one space, the digest of the text, the role's initial and faults of the text."""
    cell = {c: f"coalesce({c}, ' ')" for c in ("role", "text")}
    return rows.selectExpr("cast(conv_id as long) as conv_id", "cast(turn as long) as turn",
                           f"{cell['role']} as role", f"{cell['text']} as text").selectExpr(
        "*", "md5(text) as digest", f"trim(both {WHITE} from text) as ink").selectExpr(
        "conv_id", "turn", "role", "text", "digest", "left(role, 1) as initial",
        "case when ink = '' then 'blank' when right(ink, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault")


ORDER = ("turn", "role", "digest")     # of messages; Spark puts nulls first


def audits(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each conversation of `rows` (conv_id, turn, role, text) with its faults and cheapest edits.

    Columns conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. Messages stand in the order of
    turn (null first), role and the text's digest; a null role or text is one space, rows without
    conv_id are one conversation. A message's first fault counts: blank (white space only), duplicate (role
    and text seen earlier in the conversation), truncated (the last other character is none of `.!?`). gaps are missing
    turns between the smallest and the largest, illegal neighbours whose role initials are not su, ua or au.

    Edits make the role initials `(s?(ua)+)?`: Keep (0), Rerole to user or assistant (1), Delete (2; a must for
    blank and duplicate), Insert an empty message of user or assistant (5). A truncated message that
    stays costs 5 more. audit holds the initials of the cheapest edits, the ASCII-least on ties; it
    settles the roles too. A role whose initial is none of s, u, a cannot be kept. Other columns are
    ignored; repeated rows are messages; an empty table has no conversation.

    Method: messages are sorted once, without their texts, into chunks of about `chunk`. In each, dynamic
    programming over four states keeps edit sequences as persistent linked nodes; ties are settled by a
    search for the longest common prefix with rolling hashes over binary-lifting ancestors.
    A conversation of many chunks has the cheapest edits between any two states from each; runs that no cheapest
    way uses are dropped by their costs before the letters meet. What meets in one task of a conversation
    is a byte a message, as in its audit.
    """
    compact = _messages(rows).select("conv_id", *ORDER, "initial", "fault")
    n = max(1, math.ceil(compact.count() / chunk))
    # The last key splits equal messages, however many there are.
    keys = ["conv_id", *ORDER, "_salt"]
    dealt = (compact.withColumn("_salt", F.xxhash64(F.monotonically_increasing_id()))
             .repartitionByRange(n, *keys).sortWithinPartitions(*keys).drop("_salt"))
    placed = written(dealt.withColumn("nth", F.monotonically_increasing_id())
                     .withColumn("chunk", F.spark_partition_id()), "messages")
    first = placed.groupBy("conv_id", "role", "digest").agg(F.min("nth").alias("nth")).select(
        "nth", F.lit(True).alias("_first"))
    marked = placed.join(first, "nth", "left").selectExpr(
        "conv_id", "turn", "nth", "chunk", "initial",
        "case when fault = 'blank' or _first then fault else 'duplicate' end as fault")
    marked = written(marked, "marked")
    counts = (marked.groupBy("conv_id", "turn").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
        .groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")]))
    runs = written(marked.groupBy("chunk").applyInArrow(_runs, _RUNS), "runs")
    edge = runs.filter("not whole")
    pruned = edge.drop("audit").groupBy("conv_id").applyInArrow(_pruned, _PRUNED)
    joined = pruned.join(edge.select("nth", "entry", "exit", "audit"), ["nth", "entry", "exit"]).groupBy(
        "conv_id").applyInArrow(_joined, "conv_id long, cost long, audit string, illegal long")
    found = runs.filter("whole").select(*_JOINED.names).unionByName(joined).withColumnRenamed("conv_id", "_conv")
    return counts.join(found, F.col("conv_id").eqNullSafe(F.col("_conv"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")


class _Walk:
    """Follows the audit of one conversation over its messages and gives the repaired ones."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, edit, role, text):
        if edit == "K":
            self.state = KEEPS[role[:1]][self.state]
        else:
            self.state = NEXT[self.state]
            role = NAMES[self.state]
        return edit, role, text

    def inserted(self):
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put("I", None, "")

    def message(self, role, text):
        yield from self.inserted()
        edit, self.at = self.audit[self.at], self.at + 1
        if edit != "D":
            yield self._put(edit, role, text)


def _walked(rows: DataFrame, told: DataFrame, begin, take, end, schema: str) -> DataFrame:
    """Streams the messages of each conversation, in order, past its audit.

    `begin(conv_id)` makes what is kept of a conversation, `take(kept, edit, role, text)` gives output rows for a
    repaired message, `end(kept)` for the end. A task holds one audit and one batch of messages.
    """
    messages = _messages(rows).select("conv_id", F.lit(1).alias("kind"), *ORDER, "text")
    heads = told.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"),
                        F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(math.ceil(size / PART), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = ["conv_id", "kind", *ORDER]
    ordered = messages.unionByName(heads).repartition(parts, "conv_id").sortWithinPartitions(*keys)
    out = pa.schema([(f.split()[0], {"long": pa.int64(), "string": pa.string()}[f.split()[1]])
                     for f in schema.split(", ")])

    def run(batches):
        walk = kept = None
        for batch in batches:
            rows = []
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    if walk:
                        rows += [r for m in walk.inserted() for r in take(kept, *m)]
                        rows += end(kept)
                    walk, kept = _Walk(text), begin(conv)
                else:
                    rows += [r for m in walk.message(role, text) for r in take(kept, *m)]
            yield pa.RecordBatch.from_pylist(rows, schema=out)
        if walk:
            rows = [r for m in walk.inserted() for r in take(kept, *m)]
            yield pa.RecordBatch.from_pylist(rows + end(kept), schema=out)

    return ordered.select("conv_id", "kind", "role", "text").mapInArrow(run, schema)


def repaired_messages(rows: DataFrame, told: DataFrame) -> DataFrame:
    """The messages that `told`, the result of `audits`, leaves: conv_id, nth (from 0), edit, role, text."""
    def begin(conv):
        return {"conv_id": conv, "nth": -1}

    def take(kept, edit, role, text):
        kept["nth"] += 1
        return [{**kept, "edit": edit, "role": role, "text": text}]

    return _walked(rows, told, begin, take, lambda kept: [], "conv_id long, nth long, edit string, role string, text string")


def repaired_digests(rows: DataFrame, told: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired `role:text`, joined by line feeds."""
    def begin(conv):
        return [conv, hashlib.sha256(), b""]

    def take(kept, edit, role, text):
        kept[1].update(kept[2] + f"{role}:{text}".encode())
        kept[2] = b"\n"
        return []

    def end(kept):
        return [{"conv_id": kept[0], "repaired_sha256": kept[1].hexdigest()}]

    return _walked(rows, told, begin, take, end, "conv_id long, repaired_sha256 string")


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, by crc32 of `conv_id:turn` modulo 20; nulls are one space.

    0 drops the message, 1 empties its text, 2 takes its `.!?` out, 3 repeats it, 4 sets the role user.
    """
    key = "concat(coalesce(cast(conv_id as string), ' '), ':', coalesce(cast(turn as string), ' '))"
    return rows.selectExpr(
        "conv_id", "turn", "coalesce(role, ' ') as role", "coalesce(text, ' ') as text",
        f"crc32(cast({key} as binary)) % 20 as _k").filter("_k != 0").selectExpr(
        "conv_id", "turn", "if(_k = 4, 'user', role) as role",
        "case _k when 1 then '' when 2 then translate(text, '.!?', '') else text end as text",
        "explode(if(_k = 3, array(0, 1), array(0))) as _copy").drop("_copy")


def repair(conversations: DataFrame, rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """A row for each conv_id of `conversations`, repaired from `rows`: the columns of `audits` and repaired_sha256.

    A conversation without rows has zeros, an empty audit and the digest of the empty string.
    """
    told = written(audits(rows, chunk), "audits")
    both = told.join(repaired_digests(rows, told).withColumnRenamed("conv_id", "_conv"),
                     F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv").withColumnRenamed("conv_id", "_conv")
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return ids.join(both, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
