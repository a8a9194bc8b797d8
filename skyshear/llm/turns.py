"""Conversation structure repair: a grammar of role and fault sequences, and one transfer matrix for each of its rules.

A conversation should read system? (user assistant)+ or nothing. What a row can
do in a cheapest repair depends only on its role's initial and its fault, so a
conversation is a word over nine symbols. Reading a symbol takes the repair from
one of four states (nothing yet, after system, after user, after assistant) to
another at a least cost: a matrix in which sums are minima and products are sums.
Each entry also carries its audit, the letters of the edits, as a rope: a pair of
ropes that is only written out where two of equal cost are compared. Two audits
of equal cost between the same states are never one the beginning of the other
(the longer would cost an insertion more), so the least of joined audits joins
least audits, and matrices of parts may be multiplied in any grouping.

Conversations are cut into segments by turn. Of all segments with one word, one
is evaluated. A task pairs the symbols of its words (Re-Pair: the most frequent
neighbours become a rule, again and again), multiplies one matrix for each rule
from those of its two parts, bottom-up, and reads off each word as the product
of what is left of it. Segments then multiply to conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, stored, table

#: Turns of a segment, as a power of two.
SEGMENT_BITS = 12
#: Symbols whose grammar a task makes at a time; rules of one grammar at most; occurrences that make a rule worth it.
SYMBOLS, RULES, WORTH = 1 << 20, 512, 4
#: A row's symbol: its role's initial (o for any other), in capitals if its text is cut off; x if it must go.
ALPHABET = "suaoSUAOx"
#: States of a repair: nothing yet, after system, after user, after assistant. A repair ends in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of the edits, and of a cut-off text that stays.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
SPACE = r"\x20\x09-\x0D"
#: White space of the contract, as the characters that a trim takes away.
BLANKS = " \t\n\x0b\f\r"

Rope = str | tuple
#: Least cost and its audit from each state to each state; None where there is no way.
Matrix = list[list[tuple[int, Rope] | None]]


def written(rope: Rope) -> str:
    """The letters of a rope, from left to right, without recursion."""
    out, todo = [], [rope]
    while todo:
        part = todo.pop()
        if isinstance(part, str):
            out.append(part)
        else:
            todo += (part[1], part[0])
    return "".join(out)


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    """The cheaper way; of equal ones, that with the least audit."""
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return a if a[1] is b[1] or written(a[1]) <= written(b[1]) else b


def joined(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return None
    return a[0] + b[0], (a[1], b[1]) if a[1] and b[1] else a[1] or b[1]


def product(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        new: list[tuple[int, Rope] | None] = [None] * 4
        for mid in range(4):
            if row[mid] is not None:
                for to in range(4):
                    if b[mid][to] is not None:
                        new[to] = better(new[to], joined(row[mid], b[mid][to]))
        out.append(new)
    return out


def _after(state: int, role: str) -> int | None:
    """The state that a user or an assistant row leads to."""
    if role == "a":
        return ASSISTANT if state == USER else None
    return None if state == USER else USER


def insertions() -> Matrix:
    """Any number of inserted rows."""
    out: Matrix = [[(0, "") if i == j else None for j in range(4)] for i in range(4)]
    for start in range(4):
        state, count = start, 0
        while count < 2:
            state, count = (ASSISTANT if state == USER else USER), count + 1
            out[start][state] = better(out[start][state], (INSERT * count, "I" * count))
    return out


def edits(symbol: str) -> Matrix:
    """What may become of one row: kept, given another role, or deleted."""
    out: Matrix = [[None] * 4 for _ in range(4)]
    role, extra = symbol.lower(), CUT_OFF if symbol.isupper() else 0
    for state in range(4):
        out[state][state] = (DELETE, "D")
        if role == "x":
            continue
        if role == "s" and state == START:
            out[state][SYSTEM] = better(out[state][SYSTEM], (extra, "K"))
        for to in "ua":
            end = _after(state, to)
            if end is not None:
                out[state][end] = better(out[state][end], (extra, "K") if role == to else (REROLE + extra, "R"))
    return out


#: The matrix of each symbol: the row's own edits, then insertions.
SYMBOL_MATRICES = [product(edits(s), insertions()) for s in ALPHABET]


def paired(words: list[str], rules: int = RULES, worth: int = WORTH) -> tuple[list[np.ndarray], list[tuple[int, int]]]:
    """Re-Pair: the words over symbols and rules, and the two parts of each rule; rule r is symbol len(ALPHABET) + r.

    Pairs never cross words. The most frequent pair becomes a rule (the least of
    equally frequent ones); runs of one symbol pair up from their left.
    """
    code = np.full(128, -1, np.int32)
    code[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
    text = code[np.frombuffer("\n".join(words).encode(), np.uint8)] if words else np.zeros(0, np.int32)
    made: list[tuple[int, int]] = []
    while len(made) < rules and len(text) > 1:
        size = len(ALPHABET) + len(made)
        left, right = text[:-1], text[1:]
        inside = (left >= 0) & (right >= 0)
        pairs = np.where(inside, left * size + right, size * size)
        count = np.bincount(pairs, minlength=size * size + 1)[:-1]
        best = int(count.argmax())
        if count[best] < worth:
            break
        at = np.flatnonzero(pairs == best)
        if best // size == best % size:
            run = np.cumsum(np.concatenate([[True], np.diff(at) > 1])) - 1
            first = at[np.concatenate([[True], np.diff(at) > 1])]
            at = at[(at - first[run]) % 2 == 0]
        made.append((best // size, best % size))
        text = text.copy()
        text[at] = size
        text = np.delete(text, at + 1)
    ends = np.flatnonzero(text < 0)
    return np.split(text, ends) if words else [], made


def evaluated(words: list[str], rules: int = RULES, worth: int = WORTH) -> Iterator[tuple[str, Matrix]]:
    """Each word with its matrix, by one grammar for all of them."""
    shorter, made = paired(words, rules, worth)
    matrices = list(SYMBOL_MATRICES)
    for a, b in made:
        matrices.append(product(matrices[a], matrices[b]))
    for word, symbols in zip(words, shorter, strict=True):
        parts = [matrices[s] for s in symbols if s >= 0]
        while len(parts) > 1:  # in a tree, so that ropes stay shallow
            parts = [product(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        yield word, parts[0] if parts else [[(0, "") if i == j else None for j in range(4)] for i in range(4)]


def rows_in_order(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest``, null roles and texts as one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    return turns.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text")).withColumn("digest", F.md5("text"))


def segments(turns: DataFrame) -> DataFrame:
    """A row for each segment: its word and what is counted in it."""
    text = F.rtrim("text", F.lit(BLANKS))
    marks = rows_in_order(turns).select("conv_id", "turn", "role", "digest", (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.right(text, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    # texts that come back at another turn: rare, and added up before they are shuffled
    again = marks.groupBy("conv_id", "role", "digest").agg(F.min("turn").alias("low"), F.max("turn").alias("high"), F.count("turn").alias("known"), F.count("*").alias("all"))
    again = again.filter((F.col("all") > 1) & ((F.col("high") > F.col("low")) | (F.col("known") > 0) & (F.col("known") < F.col("all"))))
    again = again.select(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d"), F.when(F.col("known") == F.col("all"), F.col("low")).alias("_first"))
    late = F.col("_d").isNotNull() & F.col("turn").isNotNull() & (F.col("_first").isNull() | (F.col("turn") > F.col("_first")))
    found = marks.join(again, marks["conv_id"].eqNullSafe(again["_c"]) & (marks["role"] == again["_r"]) & (marks["digest"] == again["_d"]), "left")
    dealt = found.select("conv_id", F.shiftright("turn", SEGMENT_BITS).alias("segment"), "turn", "role", "digest", "blank", "cut", late.alias("late"))
    dealt = dealt.repartition("conv_id", "segment").sortWithinPartitions("conv_id", "segment", "turn", "role", "digest")
    kind = dealt.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, segment long, word string, first string, last string, illegal long, blank long, duplicate long, truncated long, low long, high long, turns long"
    names = ["conv_id", "segment", "word", "first", "last", "illegal", "blank", "duplicate", "truncated", "low", "high", "turns"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, row, word, before = None, None, [], None
        done: list[dict] = []

        def close() -> None:
            if row is not None:
                done.append({**row, "word": "".join(word)})

        for batch in batches:
            if not batch.num_rows:
                continue
            conv_type = batch.schema.field("conv_id").type
            for conv, segment, turn, role, digest, blank, cut, is_late in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                initial = role[:1]
                if row is None or key != (conv, segment):
                    close()
                    key, word, before = (conv, segment), [], None
                    row = dict.fromkeys(names, 0) | {"conv_id": conv, "segment": segment, "first": initial, "low": None, "high": None}
                elif row["last"] + initial not in ("su", "ua", "au"):
                    row["illegal"] += 1
                row["last"] = initial
                if turn is not None and (before is None or turn != before[0]):
                    row["turns"] += 1
                    row["low"], row["high"] = turn if row["low"] is None else row["low"], turn
                if blank:
                    row["blank"] += 1
                elif is_late or before == (turn, role, digest):
                    row["duplicate"] += 1
                elif cut:
                    row["truncated"] += 1
                    word.append(initial.upper() if initial in ("s", "u", "a") else "O")
                else:
                    word.append(initial if initial in ("s", "u", "a") else "o")
                if blank or is_late or before == (turn, role, digest):
                    word.append("x")
                before = (turn, role, digest)
            if len(done) >= 4096:
                yield as_batch(done, conv_type)
                done = []
        close()
        if done:
            yield as_batch(done, conv_type)

    def as_batch(done: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, pa.int64(), *[pa.string()] * 3, *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(names, kinds, strict=True)], names)

    return dealt.mapInArrow(read, schema)


def matrices_of(words: DataFrame, *, symbols: int = SYMBOLS, rules: int = RULES, worth: int = WORTH) -> DataFrame:
    """``word, costs, audits``: the matrix of each distinct word, row by row; a cost of null where there is no way."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.append(word)
                size += len(word)
                if size >= symbols:
                    yield from out(held)
                    held, size = [], 0
        yield from out(held)

    def out(held: list[str]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        weight = 0
        for word, matrix in evaluated(held, rules, worth):
            flat = [cell for line in matrix for cell in line]
            rows.append((word, [None if c is None else c[0] for c in flat], [None if c is None else written(c[1]) for c in flat]))
            weight += 16 * len(word)
            if weight >= 1 << 24:
                yield batch_of(rows)
                rows, weight = [], 0
        if rows:
            yield batch_of(rows)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["word", "costs", "audits"])

    return words.select("word").distinct().mapInArrow(read, "word string, costs array<long>, audits array<string>")


def repairs(turns: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``: the cheapest repair of each conversation, as a letter for each edit.

    ``turns`` has conv_id, turn (a whole number), role and text; other columns
    are ignored. Rows are taken by turn, null turns first; rows of one turn by
    role and digest of the text. A null role or text is one space, a null conv_id
    a conversation of its own. Repeated rows are duplicates but for the first. An
    empty role fits no place. A conversation of any length is read in segments of
    4,096 turns, and only their matrices meet in one task. An empty table has no
    repairs.
    """
    cut = stored(segments(turns), "turn-segments")
    rows = cut.join(matrices_of(cut), "word").drop("word").repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    kind = cut.schema["conv_id"].dataType.simpleString()
    counted = ["illegal", "blank", "duplicate", "truncated", "turns"]
    fields = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        done: list[dict] = []
        first = insertions()[START]

        def close() -> None:
            if now is not None:
                cost, audit = better(now["ways"][START], now["ways"][ASSISTANT])
                gaps = 0 if now["low"] is None else now["high"] - now["low"] + 1 - now["turns"]
                done.append({**now, "gaps": gaps, "cost": cost, "audit": written(audit)})

        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now["conv_id"] != r["conv_id"]:
                    close()
                    now = {"conv_id": r["conv_id"], "last": None, "low": None, "high": None, "ways": first, **dict.fromkeys(counted, 0)}
                for c in counted:
                    now[c] += r[c]
                if now["last"] is not None and now["last"] + r["first"] not in ("su", "ua", "au"):
                    now["illegal"] += 1
                now["last"] = r["last"]
                if r["low"] is not None:
                    now["low"], now["high"] = r["low"] if now["low"] is None else now["low"], r["high"]
                cells = [None if c is None else (c, a) for c, a in zip(r["costs"], r["audits"], strict=True)]
                now["ways"] = product([now["ways"]], [cells[i : i + 4] for i in range(0, 16, 4)])[0]
            if len(done) >= 4096:
                yield as_batch(done, batch.schema.field("conv_id").type)
                done = []
        close()
        if done:
            yield as_batch(done, batch.schema.field("conv_id").type)

    def as_batch(done: list[dict], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = [conv_type, *[pa.int64()] * 6, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([d[n] for d in done], k) for n, k in zip(fields, kinds, strict=True)], fields)

    out = stored(rows.mapInArrow(read, f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "turn-repairs")
    discard(cut)
    return out


def _merged(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of each conversation in order, its audit before them."""
    rows = rows_in_order(turns).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", "digest")
    audits = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"))
    return rows.unionByName(audits).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest").select("conv_id", "kind", "role", "text")


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, str, str] | tuple[object, None, None]]:
    """(conv_id, role, text) of each row of the repaired conversations, after (conv_id, None, None) for each conversation; a row at a time is held."""
    audit, at, state, conv = "", 0, START, None

    def inserted() -> Iterator[tuple[object, str, str]]:
        nonlocal at, state
        while audit[at : at + 1] == "I":
            state = ASSISTANT if state == USER else USER
            at += 1
            yield conv, "user" if state == USER else "assistant", ""

    for batch in batches:
        for new_conv, kind, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 0:
                yield from inserted()
                conv, audit, at, state = new_conv, text, 0, START
                yield conv, None, None
                continue
            yield from inserted()
            edit = audit[at]
            at += 1
            if edit == "D":
                continue
            if edit == "K" and role[:1] == "s":
                state = SYSTEM
            else:
                state = ASSISTANT if state == USER else USER
            yield conv, role if edit == "K" else "user" if state == USER else "assistant", text
    yield from inserted()


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, at, role, text``: the rows of the repaired conversations, numbered from 0; ``plans`` are their ``repairs``."""
    kind = turns.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        conv_type, rows, at = head.schema.field("conv_id").type, [], 0
        for conv, role, text in _edited(chained(head, batches)):
            if role is None:
                at = 0
                continue
            rows.append((conv, at, role, text))
            at += 1
            if len(rows) >= 4096:
                yield batch_of(rows, conv_type)
                rows = []
        if rows:
            yield batch_of(rows, conv_type)

    def batch_of(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        kinds = (conv_type, pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "at", "role", "text"])

    return _merged(turns, plans).mapInArrow(read, f"conv_id {kind}, at long, role string, text string")


def chained(head: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield head
    yield from rest


def repaired_digests(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of role:text of the repaired rows, joined by newlines.

    A digest reads its message from start to end, so one task reads all of a
    conversation, however long; it holds one row at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        head = next(batches, None)
        if head is None:
            return
        conv_type = head.schema.field("conv_id").type
        rows: list[tuple] = []
        open_conv, message, any_row = None, None, False
        for conv, role, text in _edited(chained(head, batches)):
            if role is None:
                if message is not None:
                    rows.append((open_conv, message.hexdigest()))
                open_conv, message, any_row = conv, hashlib.sha256(), False
                if len(rows) >= 4096:
                    yield batch_of(rows, conv_type)
                    rows = []
                continue
            message.update(f"{chr(10) if any_row else ''}{role}:{text}".encode())
            any_row = True
        if message is not None:
            rows.append((open_conv, message.hexdigest()))
        if rows:
            yield batch_of(rows, conv_type)

    def batch_of(rows: list[tuple], conv_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (conv_type, pa.string()), strict=True)], ["conv_id", "repaired_sha256"])

    return _merged(turns, plans).mapInArrow(read, f"conv_id {kind}, repaired_sha256 string")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with one row in five damaged, as the digest of its conversation and turn says."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20).cast("int")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    rows = conversations.select("conv_id", "turn", space("role").alias("role"), space("text").alias("text"), lot.alias("lot")).filter("lot <> 0")
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("lot") == 3, 2).otherwise(1).alias("times"))
    return out.withColumn("_n", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_n")


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of faults, the cheapest repair and the digest of its result, for every conversation of the damaged table."""
    all_rows = table(spark, sf_dir, "conversations")
    turns = damaged(all_rows)
    plans = repairs(turns)
    texts = repaired_digests(turns, plans)
    ids = all_rows.select(F.col("conv_id").alias("id")).distinct()
    out = ids.join(plans, ids["id"].eqNullSafe(plans["conv_id"]), "left").drop("conv_id")
    out = out.join(texts, out["id"].eqNullSafe(texts["conv_id"]), "left").drop("conv_id")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return out.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
