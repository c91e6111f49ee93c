"""Conversation structure repair: the cheapest edits that make roles alternate, the least of them by prefix-doubling path ranking.

A repaired conversation reads `(s?(ua)+)?` by its roles' initials. A row may be kept (0), given the role user or assistant (2) or
deleted (3; blank and repeated rows must be); an empty row of either role may be inserted anywhere (2); a truncated row that isn't deleted adds 1.

The rows of a conversation and the four states of that language (nothing yet, after s, u, a) make a graph. A backward DP gives each node's cost to the
end; arcs that keep to it are optimal. Nodes are ranked by the first 1, 2, 4, ... letters of the least audit (D, I, K, R) that leaves them: a rank of
2^(k+1) letters is the pair of a node's rank of 2^k letters and that of the node 2^k letters on. The ranks choose among optimal arcs, and the
path is read through the doubled pointers.

Rows are ordered by one range sort (turn, nulls first, then a hash of role and text, so that equal rows adjoin), which splits a conversation of any size over tasks.
It's cut into blocks of `BLOCK` rows. Where there are several, each block's costs from state to state are a min-plus matrix, and one pass over a conversation's
matrices gives each block the costs at its end; every arc of a letter leads to one node, so paths of blocks meet where the next one starts. Only
flags of rows are grouped; texts are shuffled to be sorted and to be hashed. SHA-256 reads a conversation in order, so one task streams it, a batch at a time.

Null roles and texts are one space (so such rows are blank, or of no known role). A null conv_id is a conversation of its own. Repeated rows are
duplicates of the first. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, discard, settled, shipped

BLOCK = 4096
#: Path cells (blocks x letters) that one kernel step holds.
CELLS = 1 << 21

_REROLE, _DELETE, _INSERT, _TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 40
#: States: nothing yet, after s, after u, after a. What a u or a leads to, and what each initial (other, s, u, a) does.
_START, _S, _U, _A = range(4)
_NEXT = np.array([_U, _U, _A, _U])
_KEEP = np.array([[-1, _S, _U, -1], [-1, -1, _U, -1], [-1, -1, -1, _A], [-1, -1, _U, -1]])
_ROLE = {_U: "user", _A: "assistant"}
_FINAL = [0, _FAR, _FAR, 0]
_LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
#: A row's code is its initial plus four times its fault: 1 blank, 2 duplicate, 3 truncated.


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the planted damage; nulls of role and text are one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(one("conv_id"), F.lit(":"), one("turn"))) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(one("text"), "[.!?]", "")).otherwise(one("text"))
    times = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    out = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(one("role")).alias("role"), text.alias("text"), times.alias("times"))
    return out.where("times > 0").select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_")).drop("_")


def _ordered(rows: DataFrame) -> DataFrame:
    """conv, conv_id, turn, seq, role, text, digest, code: seq ascends within each conversation, and over the parts of the sort."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    bare = F.rtrim("text", F.lit(SPACE.decode()))
    fault = F.when(bare == "", 1).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    length = F.length("role").cast("string")
    keyed = rows.select(F.struct("conv_id").alias("conv"), "conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at"),
                        F.unhex(F.md5(F.concat_ws(":", length, "role", "text"))).alias("digest"), (code + 4 * fault).cast("int").alias("code"))
    by = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("digest"), F.col("at")]
    return keyed.repartitionByRange(*by).sortWithinPartitions(*by).drop("at").withColumn("seq", F.monotonically_increasing_id())


def _blocks(ordered: DataFrame) -> DataFrame:
    """conv, block, last, rows (idx, seq, code): codes with duplicates marked; a block starts with the row before it, if there is one."""
    part = F.shiftright("seq", 33)
    firsts = ordered.groupBy("conv", "digest").agg(F.min("seq").alias("first"))
    runs = ordered.groupBy("conv", part.alias("part")).agg(F.min("seq").alias("low"), F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("conv", "part", (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("low")).alias("shift"))
    flags = ordered.select("conv", "digest", "seq", "code", part.alias("part")).join(firsts, ["conv", "digest"]).join(offsets, ["conv", "part"])
    initial, fault = F.col("code") % 4, F.expr("code div 4")
    marked = initial + 4 * F.when(fault == 1, 1).when(F.col("seq") > F.col("first"), 2).otherwise(fault)
    row = flags.select("conv", F.struct((F.col("seq") + F.col("shift")).alias("idx"), "seq", marked.cast("int").alias("code")).alias("row"))
    own = row.withColumn("block", F.expr(f"row.idx div {BLOCK}"))
    closing = own.where(F.col("row.idx") % BLOCK == BLOCK - 1).withColumn("block", F.col("block") + 1)
    blocks = own.unionByName(closing).groupBy("conv", "block").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return blocks.withColumn("last", F.col("block") == F.max("block").over(Window.partitionBy("conv")))


class _Graph:
    """The edit graphs of some blocks at once: nodes (row, state), flat; the node after all is the sink."""

    def __init__(self, codes: list[np.ndarray], ends: np.ndarray, last: np.ndarray):
        """codes: a block's rows; ends: the costs at each block's end by state; last: whether no rows follow."""
        lengths = np.array([len(c) for c in codes])
        self.base = np.concatenate([[0], np.cumsum(lengths + 1)])  # the first layer of each block
        layers = int(self.base[-1])
        self.closed = np.zeros(layers, bool)  # layers without a row
        self.closed[self.base[1:] - 1] = True
        code = np.zeros(layers, np.int64)
        code[~self.closed] = np.concatenate(codes) if len(codes) else code
        initial, fault = code % 4, code // 4
        self.may_keep, extra = (fault != 1) & (fault != 2), np.where(fault == 3, _TRUNCATED, 0)
        self.keep = np.where(self.may_keep[:, None], _KEEP[:, initial].T, -1)  # state after keeping, or -1
        self.extra = extra
        self.cost = np.full((layers, 4), _FAR)
        self.ends, self.last, self.open_end = ends, last, np.zeros(layers, bool)
        self.open_end[self.base[1:][last] - 1] = True
        self.cost[self.base[1:] - 1] = np.where(last[:, None], self._inserted(ends), ends)
        tops = self.base[1:] - 1
        order = np.argsort(-lengths, kind="stable")
        tops, lengths = tops[order], lengths[order]
        for back in range(1, int(lengths.max(initial=0)) + 1):
            tops = tops[: np.searchsorted(-lengths, -back, "right")]
            at = tops - back
            self.cost[at] = self._inserted(self._by_row(at).min(0))

    @staticmethod
    def _inserted(base: np.ndarray) -> np.ndarray:
        out = base.copy()
        out[:, _U] = np.minimum(base[:, _U], _INSERT + base[:, _A])
        out[:, _A] = np.minimum(base[:, _A], _INSERT + base[:, _U])
        out[:, [_START, _S]] = np.minimum(base[:, [_START, _S]], _INSERT + out[:, [_U]])
        return out

    def _by_row(self, at: np.ndarray) -> np.ndarray:
        """Costs of deleting, keeping and re-roling the rows of layers."""
        after = self.cost[at + 1]
        kept = np.take_along_axis(after, np.maximum(self.keep[at], 0), 1) + self.extra[at, None]
        other = after[:, _NEXT] + (_REROLE + self.extra[at])[:, None]
        return np.stack([after + _DELETE, np.where(self.keep[at] >= 0, kept, _FAR), np.where(self.may_keep[at, None], other, _FAR)])

    def paths(self, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """letter, layer and state of each node on the least optimal path from each root (a flat node), a row a root; letter 0 is the end."""
        layers = len(self.cost)
        inner = np.flatnonzero(~self.closed)
        by_row = np.full((3, layers, 4), _FAR)
        if len(inner):
            by_row[:, inner] = self._by_row(inner)
        node, sink = np.arange(layers * 4).reshape(layers, 4), layers * 4
        insert = np.where((~self.closed | self.open_end)[:, None], self.cost[:, _NEXT] + _INSERT, _FAR)
        costs = np.stack([by_row[0], insert, by_row[1], by_row[2]])
        layer4 = node - np.arange(4)
        to = np.stack([node + 4, layer4 + _NEXT, layer4 + 4 + np.maximum(self.keep, 0), layer4 + 4 + _NEXT])
        ended = self.closed[:, None] & ~self.open_end[:, None] | self.open_end[:, None] & (np.array(_FINAL) == 0)
        optimal = (costs == self.cost) & (self.cost < _FAR) & ~ended
        to = np.where(optimal, to, sink).reshape(4, -1)
        letter = np.where(optimal, np.arange(1, 5)[:, None, None], 9).reshape(4, -1)
        first = letter.argmin(0)
        has = optimal.any(0).ravel()
        pick = lambda best: np.append(np.where(has, to[best, np.arange(sink)], sink), sink)
        rank, jump = np.append(np.where(has, first + 1, 0), 0), pick(first)
        while (jump != sink).any():
            rank = np.unique(rank * (sink + 2) + rank[jump], return_inverse=True)[1]
            jump = jump[jump]
        best = (letter * (sink + 2) + rank[to]).argmin(0)
        chosen, step = np.append(np.where(has, best + 1, 0), 0), pick(best)
        path = roots[:, None]
        while (step[path[:, 0]] != sink).any():
            path, step = np.concatenate([path, step[path]], 1), step[step]
        path = np.concatenate([path, np.full((len(roots), 1), sink)], 1)
        return chosen[path], path // 4, path % 4


def _chunks(codes: list[np.ndarray]) -> Iterator[np.ndarray]:
    """Numbers of blocks of like length, so that one step's paths fit CELLS."""
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    kept: list[int] = []
    for i in order:
        if kept and (len(kept) + 1) * (6 * len(codes[i]) + 8) > CELLS:
            yield np.array(kept)
            kept = []
        kept.append(i)
    if kept:
        yield np.array(kept)


def _codes(batch: pa.RecordBatch) -> tuple[list, list, list]:
    """Codes, seqs and the code before (or None) of each block."""
    codes, seqs, before = [], [], []
    for block, rows in zip(batch["block"].to_pylist(), batch["rows"], strict=True):
        rows = rows.values
        idx, code = rows.field("idx").to_numpy(), rows.field("code").to_numpy().astype(np.int64)
        ahead = int(len(idx) > 0 and idx[0] < block * BLOCK)
        codes.append(code[ahead:]), seqs.append(rows.field("seq").to_numpy()[ahead:]), before.append(code[0] if ahead else None)
    return codes, seqs, before


def _transfers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's costs from state to state, row by row."""
    for batch in batches:
        codes, _, _ = _codes(batch)
        last = batch["last"].to_numpy(zero_copy_only=False)
        out: list = [None] * len(codes)
        for some in _chunks(codes):
            many = np.repeat(some, 4)
            ends = np.where(np.eye(4, dtype=bool), 0, _FAR)[np.tile(np.arange(4), len(some))]
            graph = _Graph([codes[i] for i in many], ends, last[many])
            for j, i in enumerate(some):
                out[i] = graph.cost[graph.base[4 * j : 4 * j + 4]].T.ravel().tolist()
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "costs"])


def _streamed(step, start):
    """A mapInArrow function over rows sorted by conversation that hands `step` the state and each row's value; emits conv, block, state before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), start
        for batch in batches:
            out = []
            for conv, value in zip(batch["conv"].to_pylist(), batch["costs"].to_pylist(), strict=True):
                if conv != now:
                    now, state = conv, start
                out.append(state)
                state = step(state, value)
            yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(out)], ["conv", "block", "state"])

    return run


def _through(ends: list[int], costs: list[int]) -> list[int]:
    return [int(x) for x in np.minimum((np.array(costs).reshape(4, 4) + np.array(ends)).min(1), _FAR)]


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which a block's least path ends, for each state before it."""
    for batch in batches:
        codes, _, _ = _codes(batch)
        last, ends = batch["last"].to_numpy(zero_copy_only=False), np.array(batch["ends"].to_pylist(), np.int64).reshape(-1, 4)
        out: list = [None] * len(codes)
        for some in _chunks(codes):
            graph = _Graph([codes[i] for i in some], ends[some], last[some])
            letter, _, state = graph.paths((graph.base[:-1, None] * 4 + np.arange(4)).ravel())
            final = np.take_along_axis(state, (letter > 0).sum(1)[:, None], 1)[:, 0].reshape(-1, 4)
            for j, i in enumerate(some):
                out[i] = final[j].tolist()
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], pa.array(out, pa.list_(pa.int64()))], ["conv", "block", "costs"])


_FOUND = "conv {conv}, block long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, tail string, edits array<struct<seq:long,lead:string,act:string>>"


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's figures, its part of the audit and what becomes of its rows. A row's act is D, K or its new role; lead is what is put before it."""
    for batch in batches:
        codes, seqs, before = _codes(batch)
        last, ends = batch["last"].to_numpy(zero_copy_only=False), np.array(batch["ends"].to_pylist(), np.int64).reshape(-1, 4)
        entry = batch["entry"].to_numpy()
        out: list = [None] * len(codes)
        for some in _chunks(codes):
            graph = _Graph([codes[i] for i in some], ends[some], last[some])
            letters, layers, states = graph.paths(graph.base[:-1] * 4 + entry[some])
            for j, i in enumerate(some):
                n = int((letters[j] > 0).sum())
                left = 0 if last[i] else int(ends[i][states[j][n]])
                out[i] = _result(codes[i], seqs[i], before[i], letters[j][:n], layers[j][:n] - graph.base[j], states[j][:n], int(graph.cost[graph.base[j], entry[i]]) - left)
        names = ("blank", "duplicate", "truncated", "illegal", "cost", "audit", "tail", "edits")
        kinds = (*[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.struct([("seq", pa.int64()), ("lead", pa.string()), ("act", pa.string())])))
        yield pa.RecordBatch.from_arrays([batch["conv"], batch["block"], *(pa.array([x[k] for x in out], t) for k, t in enumerate(kinds))], ["conv", "block", *names])


def _result(code, seq, before, letters, layers, states, cost):
    initial, fault = code % 4, code // 4
    if before is not None:
        initial = np.append(before % 4, initial)
    pairs = initial[:-1] * 4 + initial[1:]
    illegal = int((~np.isin(pairs, (6, 11, 14))).sum())  # su, ua, au
    edits, lead = [], []
    for letter, layer, state in zip(letters.tolist(), layers.tolist(), states.tolist(), strict=True):
        role = _ROLE[int(_NEXT[state])]
        if letter == 2:
            lead.append(f"{role}:")
        else:
            edits.append((int(seq[layer]), "\n".join(lead) or None, {1: "D", 3: "K", 4: role}[letter]))
            lead = []
    return (*(int((fault == k).sum()) for k in (1, 2, 3)), illegal, cost, _LETTERS[letters].tobytes().decode(), "\n".join(lead) or None, [dict(zip(("seq", "lead", "act"), e, strict=True)) for e in edits])


def _edits(blocks: DataFrame) -> DataFrame:
    """What _decided finds, of all blocks: those of long conversations get their ends and entries from their neighbours first."""
    conv = blocks.schema["conv"].dataType.simpleString()
    final = F.array(*[F.lit(x).cast("long") for x in _FINAL])
    single = blocks.where("block = 0 AND last").withColumn("ends", final).withColumn("entry", F.lit(_START))
    many = blocks.where("NOT (block = 0 AND last)")
    sorted_by = lambda df, order: df.repartition("conv").sortWithinPartitions("conv", order)
    moved = f"conv {conv}, block long, costs array<long>"
    ends = sorted_by(many.mapInArrow(_transfers, moved), F.desc("block")).mapInArrow(_streamed(_through, list(_FINAL)), f"conv {conv}, block long, state array<long>")
    closed = settled(many.join(ends.withColumnRenamed("state", "ends"), ["conv", "block"]), "blocks-ends")
    entries = sorted_by(closed.mapInArrow(_exits, moved), F.asc("block")).mapInArrow(_streamed(lambda state, exits: exits[state], _START), f"conv {conv}, block long, state long")
    joined = closed.join(entries.select("conv", "block", F.col("state").cast("int").alias("entry")), ["conv", "block"])
    both = single.unionByName(joined.select(*single.columns))
    return both.mapInArrow(_decided, _FOUND.format(conv=conv))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each conversation's lines; rows come sorted by conversation and seq, what becomes of a row before the row."""
    now, sha, some, act, out = None, None, False, "D", []
    for batch in batches:
        for conv, line, what in zip(*(batch[c].to_pylist() for c in ("conv", "line", "act")), strict=True):
            if sha is None or conv != now:
                if sha is not None:
                    out.append((now, sha.hexdigest()))
                now, sha, some, act = conv, hashlib.sha256(), False, "D"
            if what is not None:
                act = what
            elif line is not None:
                line = None if act == "D" else line["role"] + ":" + line["text"] if act == "K" else act + ":" + line["text"]
            text = line["text"] if what is not None and line else line
            if text is not None:
                sha.update(b"\n" * some + text.encode())
                some = True
        yield _hashed(out, batch.schema.field("conv").type)
        kind, out = batch.schema.field("conv").type, []
    if sha is not None:
        yield _hashed([(now, sha.hexdigest())], kind)


def _hashed(rows, kind) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "repaired_sha256"])


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows in order, what is found of each block, and each conversation's hash; rows has conv_id, turn, role and text without null texts or roles."""
    ordered = settled(_ordered(rows), "turns")
    blocks = settled(_blocks(ordered), "blocks")
    found = settled(_edits(shipped(blocks)), "edits")
    discard(blocks)
    line = lambda role, text: F.struct(role.alias("role"), text.alias("text"))
    none = F.lit(None).cast("string")
    texts = ordered.select("conv", "seq", F.lit(1).alias("kind"), line(F.col("role"), F.col("text")).alias("line"), none.alias("act"))
    edits = found.select("conv", F.explode("edits").alias("e")).select("conv", "e.seq", F.lit(0).alias("kind"), F.when(F.col("e.lead").isNotNull(), line(none, F.col("e.lead"))).alias("line"), "e.act")
    tails = found.where("tail IS NOT NULL").select("conv", F.lit((1 << 63) - 1).alias("seq"), F.lit(0).alias("kind"), line(none, F.col("tail")).alias("line"), F.lit("D").alias("act"))
    conv = ordered.schema["conv"].dataType.simpleString()
    lines = texts.unionByName(edits).unionByName(tails).repartition("conv").sortWithinPartitions("conv", "seq", "kind")
    return ordered, found, lines.select("conv", "line", "act").mapInArrow(_digests, f"conv {conv}, repaired_sha256 string")


def report(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation after the planted damage."""
    ordered, found, digests = repair(damaged(conversations))
    turns = ordered.where(F.col("turn").isNotNull()).groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    figures = ("blank", "duplicate", "truncated", "illegal", "cost")
    audit = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "")
    whole = found.groupBy("conv").agg(*[F.sum(c).alias(c) for c in figures], audit.alias("audit"))
    every = conversations.select(F.struct("conv_id").alias("conv"), "conv_id").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(turns, "conv", "left").join(whole, "conv", "left").join(digests, "conv", "left").select(
        "conv_id", zero("gaps"), *[zero(c) for c in figures], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


#: The same rows in SQL: CRC-32 bit by bit, then the cheapest edits row by row from the end, each state with its cost and least audit.
ORACLE = r"""
WITH RECURSIVE bits AS (
  SELECT conv_id, turn, role, text, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: ascii(x)::BIGINT) AS b
  FROM conversations
), hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce(b, lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda v, z: xor(v >> 1, (v & 1) * 3988292384)), 4294967295::BIGINT), 4294967295) % 20 AS kind FROM bits
), damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, range(2) AS t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged
), marked AS (
  SELECT conv_id, turn, role, text, i, left(role, 1) AS x, CASE WHEN bare = '' THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE '' END AS fault
  FROM (SELECT *, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM placed)
), walk AS (
  SELECT conv_id, max(i) + 1 AS i, {'c': 0, 'a': ''} AS q0, {'c': 4, 'a': 'II'} AS qs, {'c': 2, 'a': 'I'} AS qu, {'c': 0, 'a': ''} AS qa FROM marked GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, list_sort([b0, {'c': cu.c + 2, 'a': 'I' || cu.a}])[1], list_sort([bs, {'c': cu.c + 2, 'a': 'I' || cu.a}])[1], cu, ca FROM (
    SELECT conv_id, i, b0, bs, list_sort([bu, {'c': ba.c + 2, 'a': 'I' || ba.a}])[1] AS cu, list_sort([ba, {'c': bu.c + 2, 'a': 'I' || bu.a}])[1] AS ca FROM (
      SELECT w.conv_id, m.i,
        list_sort([{'c': q0.c + 3, 'a': 'D' || q0.a}, {'c': CASE WHEN free AND x = 's' THEN qs.c + t WHEN free AND x = 'u' THEN qu.c + t ELSE 1000000 END,
          'a': 'K' || CASE x WHEN 's' THEN qs.a ELSE qu.a END}, {'c': CASE WHEN free THEN qu.c + 2 + t ELSE 1000000 END, 'a': 'R' || qu.a}])[1] AS b0,
        list_sort([{'c': qs.c + 3, 'a': 'D' || qs.a}, {'c': CASE WHEN free AND x = 'u' THEN qu.c + t ELSE 1000000 END, 'a': 'K' || qu.a},
          {'c': CASE WHEN free THEN qu.c + 2 + t ELSE 1000000 END, 'a': 'R' || qu.a}])[1] AS bs,
        list_sort([{'c': qu.c + 3, 'a': 'D' || qu.a}, {'c': CASE WHEN free AND x = 'a' THEN qa.c + t ELSE 1000000 END, 'a': 'K' || qa.a},
          {'c': CASE WHEN free THEN qa.c + 2 + t ELSE 1000000 END, 'a': 'R' || qa.a}])[1] AS bu,
        list_sort([{'c': qa.c + 3, 'a': 'D' || qa.a}, {'c': CASE WHEN free AND x = 'u' THEN qu.c + t ELSE 1000000 END, 'a': 'K' || qu.a},
          {'c': CASE WHEN free THEN qu.c + 2 + t ELSE 1000000 END, 'a': 'R' || qu.a}])[1] AS ba
      FROM walk w JOIN (SELECT *, fault NOT IN ('blank', 'duplicate') AS free, CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END AS t FROM marked) m
        ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.i = w.i - 1) x) y
), best AS (SELECT conv_id, q0.c AS cost, q0.a AS audit FROM walk WHERE i = 1
), letters AS (
  SELECT conv_id, j, letter, count(*) FILTER (WHERE letter <> 'I') OVER (PARTITION BY conv_id ORDER BY j) AS i, sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY j) AS k,
    sum(CASE WHEN letter <> 'D' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS whole
  FROM (SELECT conv_id, unnest(string_split(audit, '')) AS letter, unnest(range(len(audit))) AS j FROM best WHERE audit <> '')
), repaired AS (
  SELECT l.conv_id, string_agg(CASE WHEN letter = 'K' THEN m.role WHEN (k + whole) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE m.text END, chr(10) ORDER BY j) AS s
  FROM letters l LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM l.conv_id AND m.i = l.i WHERE letter <> 'D' GROUP BY l.conv_id
), pairs AS (SELECT conv_id, x || lead(x) OVER (PARTITION BY conv_id ORDER BY i) AS p FROM marked
), figures AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
    count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM marked GROUP BY conv_id
), wrong AS (SELECT conv_id, count(*) AS illegal FROM pairs WHERE p IS NOT NULL AND p NOT IN ('su', 'ua', 'au') GROUP BY conv_id)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(s, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN wrong w ON w.conv_id IS NOT DISTINCT FROM e.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM e.conv_id LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM e.conv_id
"""
