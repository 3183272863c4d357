"""Chat formatting at token level.

Every turn becomes: a role marker, its text, a turn end.  Markers are reserved
token ids beyond the vocabulary, spliced between separately encoded segments, so
no text can produce one.  The same holds for the formatted text: the strings that
markers are written as are escaped where they occur in a text, reversibly.  The
loss mask is not guessed from the tokens: segment lengths are summed up to
offsets, and the assistants' segments are the masked ranges.

Turns are encoded where they lie; only encoded turns are then brought together by
conversation, and a conversation of any length streams through its task turn by
turn.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lupafiscal.llm.tables import map_arrow

# Roles with a marker of their own; any other is written between ROLE and ROLE_END.
ROLES = ["system", "user", "assistant", "tool"]
LOSS_ROLE = "assistant"
MARKERS = [*(f"### {r.capitalize()}: " for r in ROLES), "### Role: ", " </role> ", " </turn>\n"]
ROLE, ROLE_END, TURN_END = len(ROLES), len(ROLES) + 1, len(ROLES) + 2
CONTROL = [m.strip() for m in MARKERS]
_CONTROL = re.compile("|".join(map(re.escape, sorted(CONTROL, key=len, reverse=True))))
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)

TURNS = "conv_id long, turn long, role string, text string"
FORMATTED = (
    "conv_id long, position long, token_start long, char_start long, ids array<int>, "
    "loss_from int, loss_to int, n_chars long"
)


def escape(text: str) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


class Codec:
    """A byte-level vocabulary with reserved ids for the markers after its last id."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.reserved = self.tokenizer.get_vocab_size(with_added_tokens=True)

    def encode(self, texts: list[str]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([escape(t) for t in texts], add_special_tokens=False)
        return [x.ids for x in found]

    def decode(self, ids: list[int]) -> str:
        """The escaped text of ids that hold no marker."""
        return self.tokenizer.decode(ids, skip_special_tokens=False) if ids else ""

    def role_ids(self, role: str) -> list[int]:
        if role in ROLES:
            return [self.reserved + ROLES.index(role)]
        return [self.reserved + ROLE, *self.encode([role])[0], self.reserved + ROLE_END]

    def role_of(self, ids: list[int]) -> str:
        if ids[0] < self.reserved + ROLE:
            return ROLES[ids[0] - self.reserved]
        return unescape(self.decode(ids[1:-1]))

    def rendered(self, ids: list[int]) -> str:
        """The formatted text of any ids."""
        out, run = [], []
        for i in [*ids, self.reserved + TURN_END + 1]:
            if i < self.reserved:
                run.append(i)
                continue
            out.append(self.decode(run))
            run = []
            if i - self.reserved <= TURN_END:
                out.append(MARKERS[i - self.reserved])
        return "".join(out)


@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def encoded_turns(df: DataFrame, path: str) -> DataFrame:
    """Each row of (conv_id, turn, role, text) as one turn's ids and its masked range in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        roles: dict[str, list[int]] = {}
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                names = [x or "" for x in part.column("role").to_pylist()]
                bodies = code.encode([x or "" for x in part.column("text").to_pylist()])
                ids, starts, ends, chars = [], [], [], []
                for name, body in zip(names, bodies, strict=True):
                    head = roles.get(name) or code.role_ids(name)
                    if len(roles) < 1024:
                        roles[name] = head
                    one = [*head, *body, code.reserved + TURN_END]
                    masked = (len(head), len(head) + len(body)) if name == LOSS_ROLE else (0, 0)
                    ids.append(one)
                    starts.append(masked[0])
                    ends.append(masked[1])
                    chars.append(len(code.rendered(one)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), part.column("tie"), pa.array(ids, pa.list_(pa.int32())),
                     pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(chars, pa.int64())],
                    ["conv_id", "turn", "tie", "ids", "loss_from", "loss_to", "n_chars"],
                )

    rows = df.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"),
        F.col("text").cast("string"), F.xxhash64("role", "text").alias("tie"),
    )
    schema = "conv_id long, turn long, tie long, ids array<int>, loss_from int, loss_to int, n_chars long"
    return map_arrow(rows, run, schema)


def format_chat(
    df: DataFrame, path: str, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row per turn (``FORMATTED``), in the order of its conversation.

    ``token_start`` and ``char_start`` are the turn's offsets in its conversation,
    by prefix sums; ``loss_from`` and ``loss_to`` are its masked range, in tokens of
    the turn.  Turns go by their number (null first), repeated numbers by a hash of
    role and text; repeated rows are turns of their own.  A null role or text counts
    as empty, rows without conversation id form one conversation.  Other columns are
    left out.
    """
    turns = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")
    )
    ordered = encoded_turns(turns, path).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, position, tokens, chars = (), 0, 0, 0
        for batch in batches:
            offsets = []
            sizes = np.diff(batch.column("ids").offsets.to_numpy())
            for conv, size, n in zip(
                batch.column("conv_id").to_pylist(), sizes.tolist(), batch.column("n_chars").to_pylist(), strict=True
            ):
                if current != (conv,):
                    current, position, tokens, chars = (conv,), 0, 0, 0
                offsets.append((position, tokens, chars))
                position, tokens, chars = position + 1, tokens + size, chars + n
            columns = [pa.array(c, pa.int64()) for c in (zip(*offsets, strict=True) if offsets else [()] * 3)]
            own = [batch.column(c) for c in ("ids", "loss_from", "loss_to", "n_chars")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *columns, *own], [f.split()[0] for f in FORMATTED.split(", ")]
            )

    return map_arrow(ordered, run, FORMATTED)


DIGESTS = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def read_back(formatted: DataFrame, path: str) -> DataFrame:
    """Per conversation, from formatted turns alone: what was said, and what the loss covers (``DIGESTS``).

    Ids are decoded where they lie; the digests need a conversation's turns in
    their order, so its texts then stream through one task.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = codec(path)
        for batch in batches:
            said, loss = [], []
            for ids, a, b in zip(
                batch.column("ids").to_pylist(), batch.column("loss_from").to_pylist(),
                batch.column("loss_to").to_pylist(), strict=True,
            ):
                head = 1 if ids[0] < code.reserved + ROLE else ids.index(code.reserved + ROLE_END) + 1
                body = unescape(code.decode(ids[head:-1]))
                said.append(f"{code.role_of(ids[:head])}\n{body}\n")
                loss.append(unescape(code.decode(ids[a:b])) if b > a else "")
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("position"), pa.array(said, pa.string()),
                 pa.array(loss, pa.string()), batch.column("n_chars")],
                ["conv_id", "position", "said", "loss", "n_chars"],
            )

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: tuple = ()
        turns = chars = formatted_chars = 0
        said, loss = hashlib.sha256(), hashlib.sha256()

        def done() -> pa.RecordBatch:
            row = (*current, turns, said.hexdigest(), chars, loss.hexdigest(), formatted_chars)
            fields = [f.split() for f in DIGESTS.split(", ")]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], pa.int64() if kind == "long" else pa.string()) for v, (_, kind) in zip(row, fields, strict=True)],
                [name for name, _ in fields],
            )

        finished: list[pa.RecordBatch] = []
        for batch in batches:
            for conv, text, part, n in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "said", "loss", "n_chars")), strict=True
            ):
                if current != (conv,):
                    if current:
                        finished.append(done())
                    current, turns, chars, formatted_chars = (conv,), 0, 0, 0
                    said, loss = hashlib.sha256(), hashlib.sha256()
                said.update(text.encode())
                loss.update(part.encode())
                turns, chars, formatted_chars = turns + 1, chars + len(part), formatted_chars + n
            if finished:
                yield pa.Table.from_batches(finished).combine_chunks().to_batches()[0]
                finished = []
        if current:
            yield done()

    decoded = map_arrow(formatted, texts, "conv_id long, position long, said string, loss string, n_chars long")
    ordered = decoded.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return map_arrow(ordered, digests, DIGESTS)
