"""Conversation structure repair: the cheapest edits that make a conversation's roles follow `(s?(ua)+)?`.

A DuckDB recursive query runs inside hash-partitioned batches of segments; each recursion advances one
turn of all segments of a batch and keeps the minimum cost and audit for each grammar state. Segments
of a conversation are joined pairwise, so that one of any length is shared out among tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Grammar: state and initial of a role to the next state. 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: States in which a conversation may end.
ACCEPTED = (0, 3)
#: Roles that may be inserted or given to a row, by initial.
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Turns of a segment at most, as a power of two.
SEGMENT_BITS = 8
SPACE, MARKS = r"\x20\x09-\x0D", ".!?"


def _moves() -> list[tuple[int, int, str | None, str, int, bool]]:
    """(state, next, initial or null, edits, cost, whether the row goes): one row's edits, with an insertion before it or none.

    Two insertions between rows are never cheapest: they lead from a state to itself, or from 0 or 1
    to 3, where to delete what came before costs less.
    """
    before = [(s, s, "", 0) for s in range(4)] + [(s, to, "I", INSERT) for (s, letter), to in NEXT.items() if letter in ROLES]
    out = []
    for start, s, edits, cost in before:
        out.append((start, s, None, edits + "D", cost + DELETE, True))
        for (at, letter), to in NEXT.items():
            if at == s:
                out.append((start, to, letter, edits + "K", cost + KEEP, False))
                if letter in ROLES:
                    out.append((start, to, None, edits + "R", cost + REROLE, False))
    return out


MOVES = ", ".join(f"({a}, {b}, {'null' if c is None else repr(c)}, {d!r}, {e}, {g})" for a, b, c, d, e, g in _moves())
RECURSION = f"""
    with recursive moves(state, target, letter, edits, cost, goes) as (values {MOVES}),
    best(unit, first, state, k, cost, audit) using key (unit, first, state) as (
        select unit, s.first, s.first, 0::bigint, 0::bigint, '' from (select distinct unit from turns), (values (0), (1), (2), (3)) s(first)
        union
        select unit, first, target, k, low.cost, low.audit from (
            select b.unit, b.first, m.target, t.k, min({{'cost': b.cost + m.cost + case when m.goes then 0 else t.late end, 'audit': b.audit || m.edits}}) as low
            from best b join turns t on t.unit = b.unit and t.k = b.k + 1
            join moves m on m.state = b.state and (m.letter is null or m.letter = t.letter) and (m.goes or not t.gone)
            group by b.unit, b.first, m.target, t.k
        )
    )
    select unit, first, state, cost, audit from best
"""


def key_of(conversation: Column) -> Column:
    """A conversation's key as text; null has one of its own."""
    return F.coalesce(F.concat(F.lit("="), conversation.cast("string")), F.lit(""))


def damaged(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows with faults by crc32(`conversation:turn`) modulo 20: 0 drops, 1 empties, 2 strips `.!?`, 3 repeats, 4 sets role user.

    Nulls, within that key too, are one space; conversations and turns themselves stay null.
    """
    spaced = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (conversation, turn, role, text)}
    fault = F.pmod(F.crc32(F.encode(F.concat(spaced[conversation], F.lit(":"), spaced[turn]), "UTF-8")), F.lit(20))
    rows = df.select(F.col(conversation).alias("conv"), F.col(turn).alias("turn"), spaced[role].alias("r"), spaced[text].alias("x"), fault.alias("fault")).where("fault <> 0")
    rows = rows.withColumn("x", F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("x", MARKS, "")).otherwise(F.col("x")))
    rows = rows.withColumn("r", F.when(F.col("fault") == 4, "user").otherwise(F.col("r")))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select(F.col("conv").alias(conversation), F.col("turn").alias(turn), F.col("r").alias(role), F.col("x").alias(text))


def _segment_costs(rows: DataFrame) -> DataFrame:
    """(conv, segment, first, state, cost, audit): the cheapest edits of each segment from each state to each, of (conv, segment, at, letter, gone, late)."""
    names = ["conv", "segment", "at", "letter", "gone", "late"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con, rest = None, None

        def solved(t: pa.Table) -> pa.RecordBatch:
            conv, segment = t.column("conv").combine_chunks(), t.column("segment").to_numpy()
            codes = conv.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            new = np.ones(len(t), bool)
            new[1:] = (codes[1:] != codes[:-1]) | (segment[1:] != segment[:-1])
            starts = np.flatnonzero(new)
            unit = np.cumsum(new) - 1
            con.register("turns", pa.table({"unit": unit, "k": np.arange(len(t)) - starts[unit] + 1, "letter": t.column("letter"), "gone": t.column("gone"), "late": t.column("late")}))
            got = con.sql(RECURSION).to_arrow_table()
            con.unregister("turns")
            at = pa.array(starts[got.column("unit").to_numpy()])
            return pa.RecordBatch.from_arrays([conv.take(at), pa.array(segment).take(at), *(got.column(c).combine_chunks().cast(k) for c, k in (("first", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())))], ["conv", "segment", "first", "state", "cost", "audit"])

        for b in batches:
            if not len(b):
                continue
            if con is None:
                con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
            table = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            conv, segment = table.column("conv"), table.column("segment").to_numpy()
            last = np.flatnonzero(segment == segment[-1])
            while len(last) and conv[int(last[0])].as_py() != conv[len(table) - 1].as_py():
                last = last[1:]
            if whole := int(last[0]):
                yield solved(table.slice(0, whole))
            rest = table.slice(whole)
        if rest is not None and len(rest):
            yield solved(rest)

    batched = rows.select(*names).repartition("conv", "segment").sortWithinPartitions("conv", "segment", "at")
    return batched.mapInArrow(run, "conv string, segment long, first int, state int, cost long, audit string")


def _whole_costs(segments: DataFrame) -> DataFrame:
    """(conv, cost, audit) of whole conversations. Neighbouring segments are joined state by state, which halves their number in each round."""
    low = F.min(F.struct("cost", "audit")).alias("low")
    own = segments.select("conv", "segment").distinct().withColumn("i", (F.row_number().over(Window.partitionBy("conv").orderBy("segment")) - 1).cast("long"))
    now = cut(segments.join(own, ["conv", "segment"]).drop("segment"))
    whole = now.groupBy("conv").agg(F.max("i").alias("last"))
    now = now.join(whole, "conv")
    done, now = now.where("last = 0"), cut(now.where("last > 0"))
    while not now.isEmpty():
        left, right = now.where("i % 2 = 0"), now.where("i % 2 = 1").select("conv", (F.col("i") - 1).alias("i"), F.col("first").alias("state"), F.col("state").alias("end"), F.col("cost").alias("more"), F.col("audit").alias("then"))
        joined = left.join(right, ["conv", "i", "state"]).select("conv", "i", "last", "first", F.col("end").alias("state"), (F.col("cost") + F.col("more")).alias("cost"), F.concat("audit", "then").alias("audit"))
        joined = joined.groupBy("conv", "i", "last", "first", "state").agg(low).select("conv", "i", "last", "first", "state", "low.*")
        both = joined.unionByName(left.where("i = last").select(*joined.columns)).withColumn("i", F.expr("i div 2")).withColumn("last", F.expr("last div 2"))
        both = cut(both)
        done, now = done.unionByName(both.where("last = 0").select(*done.columns)), both.where("last > 0")
    ends = {s: "" for s in ACCEPTED} | {s: "I" for (s, letter), to in NEXT.items() if to in ACCEPTED and letter in ROLES}
    tail = F.create_map(*[F.lit(v) for s, e in ends.items() for v in (s, e)])[F.col("state")]
    closed = done.where(F.col("first") == 0).withColumn("tail", tail).where("tail is not null")
    closed = closed.select("conv", (F.col("cost") + F.length("tail") * INSERT).alias("cost"), F.concat("audit", "tail").alias("audit"))
    return closed.groupBy("conv").agg(low).select("conv", "low.*")


def _repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv, illegal, repaired_sha256) by walking each conversation's rows along its audit, as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = digest = last = None
        place = state = illegal = 0
        between = ""

        def put(name: str, text: str) -> None:
            nonlocal state, between
            digest.update(f"{between}{name}:{text}".encode())
            between, state = "\n", NEXT[state, name[:1]]

        def inserted() -> None:
            nonlocal place
            while place < len(audit) and audit[place] == "I":
                put(next(ROLES[letter] for (s, letter) in NEXT if s == state and letter in ROLES), "")
                place += 1

        def closed() -> tuple:
            inserted()
            return conv, illegal, digest.hexdigest()

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string()), strict=True)], ["conv", "illegal", "repaired_sha256"])

        for b in batches:
            found = []
            for c, at, name, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if at < 0:  # a conversation's first row has its audit
                    if conv is not None:
                        found.append(closed())
                    conv, audit, digest, last, place, state, illegal, between = c, text, hashlib.sha256(), None, 0, 0, 0, ""
                    continue
                illegal += last is not None and last + name[:1] not in ("su", "ua", "au")
                last = name[:1]
                inserted()
                edit = audit[place]
                place += 1
                if edit == "K":
                    put(name, text)
                elif edit == "R":
                    put(next(ROLES[letter] for (s, letter) in NEXT if s == state and letter in ROLES), text)
            if found:
                yield batch_of(found)
        if conv is not None:
            yield batch_of([closed()])

    first = audits.select("conv", F.lit(-1).cast("long").alias("at"), F.lit("").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv", "at", "role", "text").unionByName(first)
    return both.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(run, "conv string, illegal long, repaired_sha256 string")


def repair(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", conversations: DataFrame | None = None) -> DataFrame:
    """(conversation, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation.

    Rows stand by turn, nulls first; those of one turn by role and by a digest of their text. A null
    role or text is one space. A row is blank (nothing but white space), else a duplicate (same role and text
    earlier), else truncated (does not end in one of `.!?`). The audit has an initial for each edit in
    order: Keep 0, Rerole 1, Delete 2 (blank and duplicate rows must go), Insert 5; a truncated row
    that stays adds 5. Of equally cheap audits the least in ASCII order is taken; it alone decides the
    repaired turns. `conversations` names those that get a row, df's own by default; one without rows has zeros, an
    empty audit and the digest of no text. A null conversation is one conversation. Other columns are ignored.

    A conversation's rows are shared out by ranges, duplicates are found by a minimum of their group,
    and segments are solved apart; only the digest reads a whole conversation in one task, as a stream.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(a) for c, a in ((role, "role"), (text, "text"))]
    rows = df.select(key_of(F.col(conversation)).alias("conv"), F.col(turn).alias("turn"), *spaced).withColumn("digest", F.md5("text"))
    order = ["conv", F.col("turn").asc_nulls_first(), "role", "digest"]
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    kinds = rows.select(
        "conv", "at", "turn", F.substring("role", 1, 1).alias("letter"), F.md5(F.concat("role", F.lit("\0"), "digest")).alias("said"),
        (~F.col("text").rlike(f"[^{SPACE}]")).alias("blank"), (~F.col("text").rlike(rf"[{MARKS}][{SPACE}]*\z")).alias("open"),
    )
    firsts = kinds.where("not blank").groupBy("conv", "said").agg(F.min("at").alias("at")).withColumn("new", F.lit(True))
    kinds = kinds.join(firsts, ["conv", "said", "at"], "left").withColumn("duplicate", F.expr("not blank and new is null"))
    kinds = kinds.withColumn("gone", F.expr("blank or duplicate")).withColumn("truncated", F.expr("open and not gone"))
    kinds = cut(kinds.select("conv", "at", F.shiftright("at", SEGMENT_BITS).alias("segment"), "turn", "letter", "blank", "duplicate", "truncated", "gone", (F.col("truncated").cast("long") * TRUNCATED).alias("late")))
    audits = cut(_whole_costs(_segment_costs(kinds)))
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in ("blank", "duplicate", "truncated")]
    turns = kinds.groupBy("conv", "turn").agg(*counts).groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    out = (conversations if conversations is not None else df).select(conversation).distinct().withColumn("conv", key_of(F.col(conversation)))
    for found in (turns, audits, _repaired(rows, audits)):
        out = out.join(found, "conv", "left")
    out = out.fillna(0, ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]).fillna({"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()})
    return out.select(conversation, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
