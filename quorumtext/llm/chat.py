"""Chat formatting of typed content parts.

A message is a sequence of parts: text, image, audio and document; a plain text is one text part. A visitor
walks the parts in order; neighbouring texts are joined and escaped, every other part becomes a
placeholder, and its reference and the number of tokens it will expand to are recorded. A turn is rendered for
itself, between marks:

    <|im_start|>ROLE\nTEXT<|im_end|>\n

Control strings inside texts are escaped by doubling the bar (`<|` becomes `<||`), which a reader
undoes exactly. The text of assistant turns, and nothing else, is under the loss mask.

Turns are rendered where they are. To read conversations back, rows are dealt by conversation and
sorted within partitions; a task streams over them and holds one turn at a time, so a conversation
of any length needs no more memory than its longest turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>"
#: Tokens that a part expands to where its own `tokens` entry does not say.
EXPANDED = {"image": 256, "audio": 128, "document": 512}
_TURN = re.compile(r"<\|im_start\|>((?:[^\n<]++|<(?!\|)|<\|\||<\|n>)*+)\n((?:[^<]++|<(?!\|)|<\|\||<\|(?:image|audio|document)_\d+\|>)*+)<\|im_end\|>\n")
#: In a rendered text only; one that a text holds itself is escaped.
_PLACEHOLDER = re.compile(r"(<\|(?:image|audio|document)_\d+\|>)")


def escape(text: str) -> str:
    """No escaped text holds `<|` followed by anything but a bar."""
    return text.replace("<|", "<||")


def unescape(text: str) -> str:
    return text.replace("<||", "<|")


class Flatten:
    """Visitor of content parts: collects rendered text, attachment references and expanded token counts.

    Texts are escaped where a run of them ends, so that no control string comes about where two meet.
    """

    def __init__(self) -> None:
        self.done: list[str] = []
        self.run: list[str] = []
        self.references: list[tuple[str, str, int]] = []

    def visit(self, part: object) -> None:
        kind = part.get("type", "text") if isinstance(part, dict) else "text"
        visitor = getattr(self, f"visit_{kind}", None) if isinstance(kind, str) else None
        (visitor or self.visit_unknown)(part)

    def visit_text(self, part: object) -> None:
        text = part.get("text") if isinstance(part, dict) else part
        self.run.append("" if text is None else str(text))

    def attach(self, part: dict) -> None:
        kind, count = part["type"], part.get("tokens")
        whole = isinstance(count, (int, float)) and not isinstance(count, bool) and 0 <= count < 1 << 31
        self.close()
        self.done.append(f"<|{kind}_{len(self.references)}|>")
        self.references.append((kind, str(part.get("ref") or ""), int(count) if whole else EXPANDED[kind]))

    visit_image = visit_audio = visit_document = attach

    def visit_unknown(self, part: object) -> None:
        """A part of no known type is kept as its JSON text."""
        self.run.append(json.dumps(part, ensure_ascii=False, sort_keys=True))

    def close(self) -> None:
        """End a run of texts."""
        self.done.append(escape("".join(self.run)))
        self.run.clear()

    def text(self) -> str:
        self.close()
        return "".join(self.done)


def render(role: str | None, text: str | None, parts: list | None = None) -> tuple[str, list[tuple[str, str, int]]]:
    """One turn between its marks, and its attachments. Null role or text count as empty; parts, if given, follow the text."""
    flat = Flatten()
    for part in [{"type": "text", "text": text}, *(parts or [])]:
        flat.visit(part)
    name = escape(role or "").replace("\n", "<|n>")
    return f"{BEGIN}{name}\n{flat.text()}{END}\n", flat.references


def read(formatted: str) -> tuple[str, str]:
    """Role and text of a rendered turn, placeholders as they stand."""
    role, parts = read_parts(formatted)
    return role, "".join(part for part, _ in parts)


def read_parts(formatted: str) -> tuple[str, list[tuple[str, bool]]]:
    """Role of a rendered turn and its runs of text and placeholders, in order, each with whether it is a placeholder."""
    found = _TURN.fullmatch(formatted)
    if not found:
        raise ValueError("not a rendered turn")
    runs = _PLACEHOLDER.split(found[2])
    return unescape(found[1].replace("<|n>", "\n")), [(r, True) if i % 2 else (unescape(r), False) for i, r in enumerate(runs) if r]


def loss_span(formatted: str) -> tuple[int, int]:
    """Bounds, in the rendered turn, of the text under the loss mask; empty unless the role is assistant."""
    head = f"{BEGIN}assistant\n"
    return (len(head), len(formatted) - len(END) - 1) if formatted.startswith(head) else (0, 0)


def format_turns(df: DataFrame, *, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", parts: str | None = None) -> DataFrame:
    """(conversation, turn, formatted, loss_start, loss_end, attachments, expanded_tokens) of every row.

    `parts`, if named, is a column of JSON arrays of content parts that follow the text; null or
    unreadable JSON counts as no parts, a part without a usable `tokens` has its type's count. Loss bounds are code points in `formatted`. Null texts and
    roles are empty. Repeated rows are repeated; an empty table gives an empty one.
    """
    columns = [df[conversation].alias("c"), df[turn].alias("t"), df[role].cast("string").alias("r"), df[text].cast("string").alias("x"), (df[parts].cast("string") if parts else F.lit(None).cast("string")).alias("p")]

    def parsed(p: str | None) -> list:
        try:
            got = json.loads(p) if p else []
        except ValueError:
            return []
        return got if isinstance(got, list) else [got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
        for b in batches:
            made = [render(r, x, parsed(p)) for r, x, p in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            spans = [loss_span(f) for f, _ in made]
            notes = [[{"type": k, "ref": ref, "tokens": n} for k, ref, n in refs] for _, refs in made]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f for f, _ in made], pa.string()), pa.array([s for s, _ in spans], pa.int64()), pa.array([e for _, e in spans], pa.int64()), pa.array(notes, kinds), pa.array([sum(n for _, _, n in refs) for _, refs in made], pa.int64())],
                ["c", "t", "formatted", "loss_start", "loss_end", "attachments", "expanded_tokens"],
            )

    kind = {c: df.schema[c].dataType.simpleString() for c in (conversation, turn)}
    out = df.select(*columns).mapInArrow(run, f"c {kind[conversation]}, t {kind[turn]}, formatted string, loss_start long, loss_end long, attachments array<struct<type:string,ref:string,tokens:long>>, expanded_tokens long")
    return out.withColumnRenamed("c", conversation).withColumnRenamed("t", turn)


def summarise(turns: DataFrame, *, conversation: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conversation, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, attachments, expanded_tokens), read back from format_turns().

    turns_sha256 is of role, newline, text, newline for each turn, in order; loss_sha256 of all text
    under the loss mask, unescaped, with nothing between; attachments counts the placeholders. Turns of one number stand in the order of
    their rendered text; a null turn stands first. A null conversation is one conversation.
    """
    sorted_turns = turns.select(conversation, turn, "formatted", "loss_start", "loss_end", "expanded_tokens").repartition(conversation).sortWithinPartitions(conversation, turn, "formatted")
    names = ["c", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "attachments", "expanded_tokens"]
    kind = turns.schema[conversation].dataType.simpleString()
    of = sorted_turns.select(F.col(conversation).alias("c"), "formatted", "loss_start", "loss_end", "expanded_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, state = None, None  # the conversation at hand; its counts and running digests
        kind_ = None

        def closed() -> list:
            n, all_, chars, loss, size, attached, expanded = state
            return [open_[0], n, all_.hexdigest(), chars, loss.hexdigest(), size, attached, expanded]

        def batch_of(rows: list[list]) -> pa.RecordBatch:
            types = [kind_, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for b in batches:
            done = []
            kind_ = b.column(0).type
            for c, formatted, start, end, tokens in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if open_ is None or open_[0] != c:
                    if open_ is not None:
                        done.append(closed())
                    open_, state = (c,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                name, parts = read_parts(formatted)
                text = "".join(part for part, _ in parts)
                under_loss = unescape(formatted[start:end])
                state[0] += 1
                state[1].update(f"{name}\n{text}\n".encode())
                state[2] += len(under_loss)
                state[3].update(under_loss.encode())
                state[4] += len(formatted)
                state[5] += sum(placeholder for _, placeholder in parts)
                state[6] += tokens
            if done:
                yield batch_of(done)
        if open_ is not None:
            yield batch_of([closed()])

    out = of.mapInArrow(run, f"c {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, attachments long, expanded_tokens long")
    return out.withColumnRenamed("c", conversation)
