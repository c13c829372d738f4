"""Chat formatting by token-level assembly.

Each segment (role, text) is encoded on its own and joined by reserved ids beyond the vocabulary, so
no text can ever make a control id. Strings in a text or role that look like control strings are
escaped all the same, so that the formatted text is unambiguous too: after ``<`` and any number of
backslashes before ``|`` one more backslash is put in, and taken out again on reading. The loss mask
comes from prefix sums of the segments' lengths: it covers the tokens of assistant texts and nothing
else.

A turn is ``<|im_start|>`` role ``<|im_sep|>`` text ``<|im_end|>``.

Conversations are gathered by conv_id and streamed in the order of turn, so a conversation with any
number of turns is read turn by turn in bounded memory: what is held is one turn and running digests.

Nulls and edges: a null text or role is empty; a null turn comes first; turns with equal numbers are
ordered by role and text; rows with a null conv_id form one conversation; an empty table gives no
rows; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole

# The control strings, in the order of their ids.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
START, SEP, END = range(3)


@dataclass(frozen=True)
class ChatFormat:
    tokenizer: str
    learned_role: str = "assistant"


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


class Assembler:
    """Token ids and loss mask of turns, and both read back."""

    def __init__(self, how: ChatFormat):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.how, self.tokenizer = how, Tokenizer.from_file(how.tokenizer)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.base = self.tokenizer.get_vocab_size()
        self.role = lru_cache(1000)(self._role)

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(escape(text), add_special_tokens=False).ids

    def _role(self, role: str) -> list[int]:
        return self._encode(role)

    def assemble(self, turns: list[tuple[str, str]]) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask (1: learned) of (role, text) in a row."""
        segments: list[list[int]] = []
        learned: list[int] = []
        for role, text in turns:
            segments += [[self.base + START], self.role(role), [self.base + SEP], self._encode(text), [self.base + END]]
            learned += [0, 0, 0, int(role == self.how.learned_role), 0]
        sizes = np.fromiter(map(len, segments), "i8", len(segments))
        ends = np.cumsum(sizes)
        ids = np.fromiter((i for s in segments for i in s), "u4", int(ends[-1]) if len(ends) else 0)
        # +1 where a learned segment begins, -1 where it ends; the mask is the running sum
        steps = np.zeros(len(ids) + 1, "i8")
        on = np.asarray(learned, bool)
        np.add.at(steps, (ends - sizes)[on], 1)
        np.add.at(steps, ends[on], -1)
        return ids, np.cumsum(steps[:-1]).astype("i1")

    def _decode(self, ids: np.ndarray) -> str:
        return self.tokenizer.decode(ids.tolist(), skip_special_tokens=False)

    def text_of(self, ids: np.ndarray) -> str:
        """The formatted text."""
        out, control = [], np.flatnonzero(ids >= self.base)
        at = 0
        for k in [*control.tolist(), len(ids)]:
            if k > at:
                out.append(self._decode(ids[at:k]))
            if k < len(ids):
                out.append(CONTROLS[int(ids[k]) - self.base])
            at = k + 1
        return "".join(out)

    def read(self, ids: np.ndarray, mask: np.ndarray) -> Iterator[tuple[str, str, str]]:
        """(role, text, text under the mask) of each turn, from the output alone."""
        starts, seps, ends = (np.flatnonzero(ids == self.base + k) for k in (START, SEP, END))
        for a, s, e in zip(starts.tolist(), seps.tolist(), ends.tolist(), strict=True):
            own = ids[s + 1 : e]
            text = unescape(self._decode(own)) if e > s + 1 else ""
            under = mask[s + 1 : e].astype(bool)
            lost = text if under.all() and len(own) else unescape(self._decode(own[under])) if under.any() else ""
            yield (unescape(self._decode(ids[a + 1 : s])) if s > a + 1 else ""), text, lost


_assemblers: dict[ChatFormat, Assembler] = {}


def assembler(how: ChatFormat) -> Assembler:
    if how not in _assemblers:
        _assemblers[how] = Assembler(how)
    return _assemblers[how]


def in_order(turns: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order of turn."""
    turns = whole(turns, {"conv_id": "long", "turn": "long", "role": "string", "text": "string"})
    turns = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(turns: DataFrame, how: ChatFormat) -> DataFrame:
    """Per turn its ids, loss mask and formatted text; a conversation's output is that of its turns in a row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one = assembler(how)
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                made = [one.assemble([(r, t)]) for r, t in zip(part.column("role").to_pylist(), part.column("text").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id"), part.column("turn"), pa.array([i.astype("i4") for i, _ in made], pa.list_(pa.int32())), pa.array([m for _, m in made], pa.list_(pa.int8())), pa.array([one.text_of(i) for i, _ in made], pa.string())],
                    names=["conv_id", "turn", "ids", "mask", "formatted"],
                )

    return in_order(turns).mapInArrow(run, "conv_id long, turn long, ids array<int>, mask array<byte>, formatted string")


def digests(turns: DataFrame, how: ChatFormat) -> DataFrame:
    """Formats every conversation and reads it back from ids and mask: what came out, as digests."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        one, state, done = assembler(how), None, []

        def close() -> None:
            done.append((state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]))

        def flush():
            rows = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(rows, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                for conv, role, text in zip(*(part.column(c).to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                    if state is None or state[0] != conv:
                        if state is not None:
                            close()
                        state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    ids, mask = one.assemble([(role, text)])
                    for r, t, lost in one.read(ids, mask):
                        state[1] += 1
                        state[2].update(f"{r}\n{t}\n".encode())
                        state[3] += len(lost)
                        state[4].update(lost.encode())
                    state[5] += len(one.text_of(ids))
                if done:
                    yield flush()
        if state is not None:
            close()
            yield flush()

    return in_order(turns).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
