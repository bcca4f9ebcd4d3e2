"""Conversation repair: the cheapest edits that leave roles as ``(s?(ua)+)?``, by block tables (Four Russians).

Every row is one of nine symbols. The cheapest cost from each of the four automaton states to the end
of a conversation is a vector; less its minimum, only a few vectors ever occur. For every block of
``BLOCK`` symbols and every such vector a table holds the vector before the block and what to add. A
conversation is processed from its end, a lookup a block. Then each block is expanded backward from
the vector at its right border, and the walk through it takes the ASCII-least of the cheapest edits.

Conversations of more than ``GIANT`` rows or ``GIANT_CHARS`` characters are ranged over many tasks and
cut into segments of at most 65,536 rows. A segment's lookups give a table of their own (vector to
vector), so that segments compose; each is then traced for each of the four states it may begin in.
Only the checksum of a repaired giant, a value of all its text in order, streams through one task.

Defined results: rows of one turn come in order of role, then text; nulls are one space, in the key of
the damage too; a null conv_id is one conversation; a role whose first letter is none of s, u, a
cannot stay as it is; without rows the result is empty.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small, stored, table
from .decontaminate import slices

BLOCK = 4
GIANT, GIANT_CHARS = 20_000, 32_000_000
SEGMENT_BITS = 16
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1  # fixed values: costs of the edits
SPACE = " \t\n\x0b\f\r"
# Automaton: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
AFTER = {"s": (1, None, None, None), "u": (2, 2, None, 2), "a": (None, None, 3, None)}
FILL = ((2, "u"), (2, "u"), (3, "a"), (2, "u"))
ROLES = {"u": "user", "a": "assistant"}
MUST_DELETE, KINDS, SYMBOLS = 0, "sua", 9
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
FIELDS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EMPTY_HASH = hashlib.sha256(b"").hexdigest()


def symbol(initial: str, truncated: bool, must_delete: bool) -> int:
    return MUST_DELETE if must_delete else 1 + 2 * (KINDS.index(initial) if initial in AFTER else 3) + truncated


def _moves(sym: int, state: int) -> list[tuple[str, int, int, str]]:
    """(edit, cost, next state, what is written) of a row: k its own line, U or A with another role."""
    moves = [("D", DELETE, state, "")]
    if sym != MUST_DELETE:
        kind, late = divmod(sym - 1, 2)
        kept = AFTER[KINDS[kind]][state] if kind < 3 else None
        if kept is not None:
            moves.append(("K", KEEP + TRUNCATED * late, kept, "k"))
        into, role = FILL[state]
        moves.append(("R", REROLE + TRUNCATED * late, into, role.upper()))
    return moves


class BlockTables:
    """Normalised vectors, and for each: what a symbol or a block before it makes of it."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[tuple[int, ...]] = []
        number: dict[tuple[int, ...], int] = {}

        def named(vector: tuple[int, ...]) -> tuple[int, int]:
            least = min(vector)
            normal = tuple(x - least for x in vector)
            if normal not in number:
                number[normal] = len(self.vectors)
                self.vectors.append(normal)
            return number[normal], least

        self.end, _ = named(self._filled((0, 1 << 20, 1 << 20, 0)))
        steps: list[list[tuple[int, int]]] = []
        while len(steps) < len(self.vectors):  # vectors that are met are stepped from in their turn
            right = self.vectors[len(steps)]
            steps.append([named(self._before(sym, right)) for sym in range(SYMBOLS)])
        self.n = len(self.vectors)
        to = np.array([[s[0] for s in row] for row in steps], np.int64).T
        add = np.array([[s[1] for s in row] for row in steps], np.int64).T
        self.step_to, self.step_add = to, add
        self.block_to, self.block_add = to, add
        for _ in range(block - 1):  # one symbol more in front
            inner, gone = self.block_to, self.block_add
            self.block_to = np.concatenate([to[s][inner] for s in range(SYMBOLS)])
            self.block_add = np.concatenate([gone + add[s][inner] for s in range(SYMBOLS)])
        self.to, self.add = self.block_to.ravel().tolist(), self.block_add.ravel().tolist()
        self.one_to, self.one_add = to.ravel().tolist(), add.ravel().tolist()
        self.choice = [[[self._chosen(s, v, q) for q in range(4)] for v in range(self.n)] for s in range(SYMBOLS)]
        self.last = [self._finish(q) for q in range(4)]

    @staticmethod
    def _filled(vector) -> tuple[int, ...]:
        """The vector with insertions at its place allowed."""
        v = list(vector)
        for _ in range(3):
            v = [min(v[q], INSERT + v[FILL[q][0]]) for q in range(4)]
        return tuple(v)

    def _before(self, sym: int, right) -> tuple[int, ...]:
        return self._filled([min(cost + right[to] for _, cost, to, _ in _moves(sym, q)) for q in range(4)])

    def _chosen(self, sym: int, v: int, state: int) -> tuple[str, str, int]:
        """(edits, what is written, next state) of a row: at every step the ASCII-least of the cheapest."""
        right, edits, out = self.vectors[v], "", ""
        here = self._before(sym, right)
        while True:
            options = {e: (to, w) for e, cost, to, w in _moves(sym, state) if cost + right[to] == here[state]}
            into, role = FILL[state]
            if INSERT + here[into] == here[state] and "D" not in options:
                edits, out, state = edits + "I", out + role, into
                continue
            edit = min(options)
            to, written = options[edit]
            return edits + edit, out + written, to

    def _finish(self, state: int) -> tuple[str, str, int]:
        edits, out = "", ""
        while state in (1, 2):
            state, role = FILL[state]
            edits, out = edits + "I", out + role
        return edits, out, state

    def borders(self, syms: bytes, right: int) -> tuple[list[int], int]:
        """Vectors at the block borders from the right end to the left one, and what they add up to."""
        n, at, total, got = len(syms), right, 0, [right]
        width, stride = self.n, self.block
        for i in range(n - stride, -1, -stride):
            code = 0
            for s in syms[i : i + stride]:
                code = code * SYMBOLS + s
            k = code * width + at
            total += self.add[k]
            at = self.to[k]
            got.append(at)
        for s in reversed(syms[: n % stride]):
            k = s * width + at
            total += self.one_add[k]
            at = self.one_to[k]
        got.append(at)
        return got, total

    def trace(self, syms: bytes, right: int, state: int) -> tuple[list[str], list[str], int]:
        """(edits a row, writings a row, state after) of a stretch that begins in ``state``."""
        borders, _ = self.borders(syms, right)
        n, stride, width = len(syms), self.block, self.n
        edits: list[str] = []
        out: list[str] = []
        begin = 0
        for k in range(len(borders) - 2, -1, -1):  # blocks from the left; borders[k] is the right border
            end = n - k * stride
            at, inner = borders[k], []
            for s in reversed(syms[begin:end]):  # the block backward from its right border
                inner.append(at)
                at = self.one_to[s * width + at]
            for s, v in zip(syms[begin:end], reversed(inner)):
                e, w, state = self.choice[s][v][state]
                edits.append(e)
                out.append(w)
            begin = end
        return edits, out, state

    def mapped(self, syms: bytes) -> tuple[np.ndarray, np.ndarray]:
        """What a whole stretch makes of every vector: (vector before it, what to add)."""
        at, total, stride, n = np.arange(self.n), np.zeros(self.n, np.int64), self.block, len(syms)
        for i in range(n - stride, -1, -stride):
            code = 0
            for s in syms[i : i + stride]:
                code = code * SYMBOLS + s
            total += self.block_add[code][at]
            at = self.block_to[code][at]
        for s in reversed(syms[: n % stride]):
            total += self.step_add[s][at]
            at = self.step_to[s][at]
        return at, total


@functools.cache
def tables(block: int = BLOCK) -> BlockTables:
    return BlockTables(block)


def written(marks: str, role: str, text: str) -> Iterator[str]:
    """The lines that a row's writings stand for."""
    for m in marks:
        if m == "k":
            yield f"{role}:{text}"
        elif m in ROLES:
            yield f"{ROLES[m]}:"
        else:
            yield f"{ROLES[m.lower()]}:{text}"


def repaired(rows: list[tuple[int | None, str, str, str]]) -> tuple:
    """The result of one conversation of (turn, role, text, last character) in order; see ``FIELDS``."""
    t = tables()
    syms, seen, turns = bytearray(), set(), set()
    blank = duplicate = truncated = illegal = 0
    before = None
    for turn, role, text, last in rows:
        if turn is not None:
            turns.add(turn)
        initial = role[:1]
        illegal += before is not None and (before, initial) not in LEGAL
        before = initial
        again = (role, text) in seen
        seen.add((role, text))
        late = last not in (".", "!", "?")
        blank += not last
        duplicate += bool(last) and again
        truncated += bool(last) and not again and late
        syms.append(symbol(initial, late, not last or again))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    syms = bytes(syms)
    borders, total = t.borders(syms, t.end)
    edits, marks, state = t.trace(syms, t.end, 0)
    more, fill, _ = t.last[state]
    lines = [line for m, (_, role, text, _) in zip(marks, rows) for line in written(m, role, text)]
    lines += written(fill, "", "")
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return gaps, blank, duplicate, truncated, illegal, total + t.vectors[borders[-1]][0], "".join(edits) + more, digest


# --- the damage, and what a row says of itself ----------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after the damage; a dropped row has no text any more."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    turn = F.col("turn").cast("long").alias("turn")
    rows = conversations.select("conv_id", turn, text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), (F.col("kind") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def _last() -> Column:
    """The last character that is no white space, empty without any."""
    return F.substring(F.rtrim("text", F.lit(SPACE)), -1, 1)


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def repair(conversations: DataFrame, giant: int = GIANT, giant_chars: int = GIANT_CHARS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of damaged rows."""
    sizes = conversations.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))
    big = stored(sizes.filter((F.col("n") > giant) | (F.col("chars") > giant_chars)).select("conv_id"), "giants")
    rows, n = damaged(conversations), big.count()
    if not n:
        return _whole(rows)
    giants = small(big.withColumnRenamed("conv_id", "_giant"), n)
    same = _same("conv_id", "_giant")
    return _whole(rows.join(giants, same, "left_anti")).unionByName(_giants(rows.join(giants, same, "left_semi"), big))


def _order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]


def _whole(rows: DataFrame) -> DataFrame:
    """Conversations that fit a task, one after the other in sorted partitions."""
    kind = rows.schema["conv_id"].dataType
    rows = rows.withColumn("last", _last()).repartition("conv_id").sortWithinPartitions("conv_id", *_order())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, results, own, current, any_row = [], [], [], None, False
        kinds = [(n, pa.string() if t == "string" else pa.int64()) for n, t in (f.split(" ") for f in FIELDS.split(", "))]
        target = pa.schema([("conv_id", id_type), *kinds])

        def flush() -> pa.RecordBatch:
            values = [ids, *(zip(*results) if results else [[]] * len(kinds))]
            columns = [pa.array(v, field.type) for v, field in zip(values, target)]
            ids.clear()
            results.clear()
            return pa.RecordBatch.from_arrays(columns, schema=target)

        for batch in (part for whole in batches for part in slices(whole, "text")):
            columns = [column.to_pylist() for column in batch.columns]
            for conv, turn, role, text, dropped, last in zip(*columns):
                if any_row and conv != current:
                    ids.append(current)
                    results.append(repaired(own))
                    own = []
                current, any_row = conv, True
                if not dropped:
                    own.append((turn, role, text, last))
            if len(ids) >= 1000:
                yield flush()
        if any_row:
            ids.append(current)
            results.append(repaired(own))
        yield flush()

    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)
    return rows.select("conv_id", "turn", "role", "text", "dropped", "last").mapInArrow(lean(run), f"conv_id {kind.simpleString()}, {FIELDS}")


# --- giants ---------------------------------------------------------------------------------------------------------


def _giants(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The same for conversations of any size; groups are segments of bounded numbers of rows."""
    key = F.coalesce(F.concat(F.lit("id:"), F.col("conv_id").cast("string")), F.lit("null")).alias("key")
    kept = rows.filter(~F.col("dropped")).select(key, "turn", "role", "text", _last().alias("last"))
    kept = kept.repartitionByRange("key", *_order()).sortWithinPartitions("key", *_order()).withColumn("pos", F.monotonically_increasing_id())
    kept = stored(kept, "giant-rows")
    said = F.sha2(F.concat_ws("\n", "role", "text"), 256).alias("h"), F.length("role").alias("width")
    facts = kept.select("key", "turn", "pos", "last", "role", F.substring("role", 1, 1).alias("initial"), *said)
    again = facts.groupBy("key", "h", "width").agg(F.min("pos").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    facts = facts.join(again, ["key", "h", "width"], "left").withColumn("again", F.coalesce(F.col("pos") > F.col("first"), F.lit(False)))
    blank, late = F.col("last") == "", ~F.col("last").isin(".", "!", "?")
    number = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    sym = F.when(blank | F.col("again"), MUST_DELETE).otherwise(1 + 2 * number + late.cast("int"))
    seg = F.shiftright("pos", SEGMENT_BITS)
    faults = blank.alias("blank"), (~blank & F.col("again")).alias("duplicate"), (~blank & ~F.col("again") & late).alias("truncated")
    facts = stored(facts.select("key", "turn", "pos", seg.alias("seg"), "initial", sym.alias("sym"), *faults), "giant-facts")

    def map_segment(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        initials = part["initial"].tolist()
        wrong = sum(p not in LEGAL for p in zip(initials, initials[1:]))
        to, add = tables().mapped(bytes(part["sym"].astype("uint8")))
        one = (part["key"].iloc[0], part["seg"].iloc[0], to.tolist(), add.tolist(), wrong, initials[0], initials[-1])
        return pd.DataFrame([one], columns=["key", "seg", "to", "add", "illegal", "first", "last"])

    segments = facts.select("key", "seg", "pos", "initial", "sym").groupBy("key", "seg")
    kind = "key string, seg long, to array<long>, add array<long>, illegal long, first string, last string"
    segments = stored(segments.applyInPandas(map_segment, kind), "giant-segments")  # a row for 65,536 rows of a giant

    def chain(part: pd.DataFrame) -> pd.DataFrame:
        part, t = part.sort_values("seg", ascending=False), tables()
        at, total, rights = t.end, 0, []
        for to, add in zip(part["to"], part["add"]):
            rights.append(at)
            total += add[at]
            at = to[at]
        ends = list(zip(part["last"].tolist()[1:], part["first"].tolist()))  # from right to left
        wrong = int(part["illegal"].sum()) + sum(p not in LEGAL for p in ends)
        known = {"right": rights, "cost": int(total + t.vectors[at][0]), "illegal": wrong, "final": [k == 0 for k in range(len(part))]}
        return part[["key", "seg"]].assign(**known)

    kind = "key string, seg long, right int, cost long, illegal long, final boolean"
    rights = stored(segments.groupBy("key").applyInPandas(chain, kind), "giant-rights")

    def trace_segment(part: pd.DataFrame) -> pd.DataFrame:
        part, t, out = part.sort_values("pos"), tables(), []
        syms, final = bytes(part["sym"].astype("uint8")), bool(part["final"].iloc[0])
        for entry in range(4):
            edits, marks, state = t.trace(syms, int(part["right"].iloc[0]), entry)
            if final:
                more, fill, state = t.last[state]
                edits[-1] += more
                marks[-1] += fill
            out.append((part["key"].iloc[0], part["seg"].iloc[0], entry, state, "".join(edits), part["pos"].tolist(), marks))
        return pd.DataFrame(out, columns=["key", "seg", "entry", "exit", "audit", "pos", "marks"])

    traced = facts.select("key", "seg", "pos", "sym").join(rights.select("key", "seg", "right", "final"), ["key", "seg"])
    kind = "key string, seg long, entry int, exit int, audit string, pos array<long>, marks array<string>"
    traced = stored(traced.groupBy("key", "seg").applyInPandas(trace_segment, kind), "giant-traces")

    def walk(part: pd.DataFrame) -> pd.DataFrame:
        exits = {(s, e): x for s, e, x in zip(part["seg"], part["entry"], part["exit"])}
        state, out = 0, []
        for s in sorted(set(part["seg"])):
            out.append((part["key"].iloc[0], s, state))
            state = exits[s, state]
        return pd.DataFrame(out, columns=["key", "seg", "entry"])

    entries = traced.select("key", "seg", "entry", "exit").groupBy("key").applyInPandas(walk, "key string, seg long, entry int")
    chosen = stored(traced.join(entries, ["key", "seg", "entry"]), "giant-choices")
    pieces = F.array_sort(F.collect_list(F.struct("seg", "audit")))
    joined = F.array_join(F.transform(pieces, lambda p: p["audit"]), "")  # no longer than the result's own value
    audits = chosen.groupBy("key").agg(joined.alias("audit"))
    marks = chosen.select(F.explode(F.arrays_zip("pos", "marks")).alias("m")).select("m.pos", "m.marks").filter("marks <> ''")
    lines = kept.select("key", "pos", "role", "text").join(marks, "pos").repartition("key").sortWithinPartitions("key", "pos")
    hashes = lines.select("key", "role", "text", "marks").mapInArrow(lean(_stream_hashes), "key string, repaired_sha256 string")
    flags = ("blank", "duplicate", "truncated")
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps")
    counts = facts.groupBy("key").agg(gaps, *[F.count_if(f).alias(f) for f in flags])
    costs = rights.groupBy("key").agg(F.max("illegal").alias("illegal"), F.max("cost").alias("cost"))
    out = ids.select("conv_id", key)
    for one in (counts, costs, audits, hashes):
        out = out.join(one, "key", "left")
    out = out.na.fill(0, ["gaps", *flags, "illegal", "cost"]).na.fill({"audit": "", "repaired_sha256": EMPTY_HASH})
    return out.select("conv_id", "gaps", *flags, "illegal", "cost", "audit", "repaired_sha256")


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A checksum a key of rows that come in order; nothing but its state is held."""
    current, digest = None, None
    done = lambda: pa.RecordBatch.from_pydict({"key": [current], "repaired_sha256": [digest.hexdigest()]})
    for batch in (part for whole in batches for part in slices(whole, "text")):
        for key, role, text, marks in zip(*[batch.column(k).to_pylist() for k in range(4)]):
            if key != current:
                if digest:
                    yield done()
                current, digest, begun = key, hashlib.sha256(), False
            for line in written(marks, role, text):
                digest.update((b"\n" if begun else b"") + line.encode("utf-8", "surrogatepass"))
                begun = True
    if digest:
        yield done()


def op11_convo_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repair of every damaged conversation."""
    return repair(table(spark, sf_dir, "conversations"))
