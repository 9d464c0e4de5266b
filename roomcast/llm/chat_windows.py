r"""Chat formatting into token-budgeted, turn-aligned training windows.

Template.  A turn is ``<|turn ROLE|>`` + text + ``<|end|>``; a turn repeated from an
earlier window is opened by ``<|again ROLE|>`` instead.  ``\`` in a text is written
``\\`` and ``<|`` is written ``<\|`` (in a role, every ``|`` is written ``\|``), so no text
can contain a control string and unescaping gives the text back exactly.

Windows.  A turn's tokens are those of its text and of the control strings around it.
Running sums of turn tokens are cut into spans: a window takes turns, in
order, while its own sum stays within the budget.  A conversation whose first turn
has the role ``system`` repeats that turn at the head of every later window; then
come the last turns before the cut, as many as fit into ``history_tokens``; then new
turns.  A turn that is larger than what is left of a whole window gets a window of
its own and is never cut.  ``loss`` lists the character spans of assistant texts that
are new in the window: repeated turns, other roles and control strings are masked.

Rows of a conversation are hash-partitioned by conv_id, sorted inside the partition
and streamed: memory holds one Arrow batch and the turns that may still be
repeated, however long the conversation is.

Edge cases: null text and null role count as empty, null turn numbers come first,
ties and repeated rows are ordered by role and text and all kept, a null conv_id is a
conversation of its own, an empty table gives no windows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomcast.llm.byte_bpe import codec
from roomcast.llm.frames import rows_out

ASSISTANT, SYSTEM = "assistant", "system"
WINDOWS = "conv_id long, window_no long, formatted string, loss array<struct<start:long,stop:long>>, n_tokens long"
_TURN = re.compile(r"<\|(turn|again) ((?:[^|\\]++|\\.)*+)\|>((?:[^<\\]++|\\.|<(?!\|))*+)<\|end\|>", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_role(role: str) -> str:
    """As ``escape``, and without a bare ``|``: a role must not run into the ``|>`` behind it."""
    return role.replace("\\", "\\\\").replace("|", "\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _opened(kind: str, role: str, text: str) -> str:
    return f"<|{kind} {escape_role(role)}|>{escape(text)}<|end|>"


class _Packer:
    """Windows of one conversation, turn by turn."""

    def __init__(self, budget: int, history: int) -> None:
        self.budget, self.history_budget = budget, history
        self.system: tuple[str, str, int] | None = None
        self.recent: deque[tuple[str, str, int]] = deque()
        self.recent_tokens = 0
        self.window_no = 0
        self.n_turns = 0
        self._clear()

    def _clear(self) -> None:
        self.parts: list[str] = []
        self.loss: list[dict[str, int]] = []
        self.at = self.tokens = 0
        self.new = False

    def _append(self, kind: str, turn: tuple[str, str, int]) -> None:
        piece = _opened(kind, turn[0], turn[1])
        if kind == "turn" and turn[0] == ASSISTANT:
            stop = self.at + len(piece) - len("<|end|>")
            self.loss.append({"start": stop - len(escape(turn[1])), "stop": stop})
        self.parts.append(piece)
        self.at += len(piece)
        self.tokens += turn[2]

    def _open_window(self) -> None:
        if self.system is not None:
            self._append("again", self.system)
        for turn in self.recent:
            self._append("again", turn)

    def flush(self) -> tuple | None:
        """The window that is being filled, if it has a new turn."""
        if not self.new:
            return None
        out = (self.window_no, "".join(self.parts), self.loss, self.tokens)
        self.window_no += 1
        self._clear()
        return out

    def add(self, role: str, text: str, tokens: int) -> tuple | None:
        """Takes a turn; gives back the window that it closes."""
        turn, closed = (role, text, tokens), None
        if self.new and self.tokens + tokens > self.budget:
            closed = self.flush()
        if not self.new and self.n_turns:
            self._open_window()
            while self.recent and self.tokens + tokens > self.budget:  # history gives way to the new turn
                self.recent_tokens -= self.recent.popleft()[2]
                self._clear()
                self._open_window()
        self._append("turn", turn)
        self.new = True
        if not self.n_turns and role == SYSTEM:
            self.system = turn
        else:
            self.recent.append(turn)
            self.recent_tokens += tokens
            while self.recent_tokens > self.history_budget:
                self.recent_tokens -= self.recent.popleft()[2]
        self.n_turns += 1
        return closed


def format_chats(
    df: DataFrame,
    tokenizer: str,
    pattern: str,
    budget: int = 512,
    history_tokens: int = 128,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """Windows of all conversations (columns ``WINDOWS``); tokens are byte-level BPE tokens."""
    rows = (
        df.select(
            F.col(conv_col).cast("long").alias("conv_id"),
            F.col(turn_col).cast("long").alias("turn"),
            F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
        )
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    out = pa.schema(
        [
            ("conv_id", pa.int64()),
            ("window_no", pa.int64()),
            ("formatted", pa.string()),
            ("loss", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
            ("n_tokens", pa.int64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(tokenizer, pattern)
        packer, conv, ready = None, None, []

        @lru_cache(maxsize=1024)
        def around(role: str) -> int:
            return len(own.encode(_opened("again", role, ""))) // 4

        def tokens(role: str, text: str) -> int:
            return len(own.encode(text)) // 4 + around(role)

        def done(window: tuple | None) -> None:
            if window is not None:
                ready.append((conv, *window))

        for batch in batches:
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text"))):
                if packer is None or c != conv:
                    if packer is not None:
                        done(packer.flush())
                    packer, conv = _Packer(budget, history_tokens), c
                done(packer.add(role, text, tokens(role, text)))
            if ready:
                yield rows_out(out, zip(*ready))
                ready.clear()
        if packer is not None:
            done(packer.flush())
        if ready:
            yield rows_out(out, zip(*ready))

    return rows.mapInArrow(run, WINDOWS)


def read_window(formatted: str) -> Iterator[tuple[bool, str, str, int, int]]:
    """(repeated, role, text, start, stop) of each turn; start and stop span the escaped text."""
    at = 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"not a turn at character {at}")
        at = m.end()
        yield m[1] == "again", unescape(m[2]), unescape(m[3]), m.start(3), m.end(3)
    if at != len(formatted):
        raise ValueError(f"not a turn at character {at}")


class _Reader:
    """Digests of one conversation, fed window by window."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, formatted: str, loss: list[dict[str, int]]) -> None:
        self.chars += len(formatted)
        for again, role, text, _, _ in read_window(formatted):
            if not again:
                self.n_turns += 1
                self.turns.update(f"{role}\n{text}\n".encode())
        for span in loss:
            text = unescape(formatted[span["start"] : span["stop"]])
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, from its windows alone: turns and masked text as digests, and sizes."""
    rows = (
        windows.select("conv_id", "window_no", "formatted", "loss")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "window_no")
    )
    names = ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
    text = ("turns_sha256", "loss_sha256")
    out = pa.schema([(n, pa.string() if n in text else pa.int64()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, conv, ready = None, None, []
        for batch in batches:
            for c, formatted, loss in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "formatted", "loss"))):
                if reader is None or c != conv:
                    if reader is not None:
                        ready.append((conv, *reader.row()))
                    reader, conv = _Reader(), c
                reader.add(formatted, loss)
            if ready:
                yield rows_out(out, zip(*ready))
                ready.clear()
        if reader is not None:
            yield rows_out(out, zip((conv, *reader.row())))

    return rows.mapInArrow(run, ", ".join(f"{n} {'string' if n in text else 'long'}" for n in names))

