r"""Repair of conversation structure by grammar-compressed dynamic programming.

Rows of a conversation, in turn order, become symbols: the initial of the role, whether
the text ends truncated, or "must go" (blank, or a repetition of an earlier row).  The
cheapest edits that make the roles read ``(s?(ua)+)?`` are found over an automaton of four
states (start, behind the system row, behind a user row, behind an assistant row).  A symbol is a
matrix from state to state: least cost, and of the edits with that cost the ones that come
first in ASCII order, as a rope of letters (Keep, Rerole, Delete, Insert).  Matrices multiply
in (min, +), ropes are concatenated, and ties are compared along the ropes, past the parts that both share.
This is sound for ties: letters tell the state they lead to, so of two equally dear ropes
between the same states neither is a beginning of the other.

Many conversations have the same sequence, and different ones share parts.  Each
different sequence is looked at once, in blocks of bounded size; Re-Pair replaces the block's
most frequent pair of neighbours by a new symbol until none occurs twice, and
every rule gets one matrix, the product of the matrices of its two symbols, when it is made.
All sequences of the block are then products of few matrices.

Scale: all this runs on narrow rows (ids, turn, role, 128-bit hash of the text, flags).  Equal
rows are counted before the shuffle.  Ordered rows are dealt by ranges of
(conversation, turn, ...), so a conversation with a third of all rows is spread over many tasks,
and cut into segments of ``SEGMENT`` symbols; matrices of segments are then multiplied along each
conversation.  Texts are shuffled once, to write or hash the repaired rows in order; a task
streams them and holds one Arrow batch and the edits of one conversation.  The digest of a
conversation is one SHA-256, which can't be split: a very long one is hashed by one task.

Edge cases: a null role or text is one space (so the text is blank); null turns come first; rows of
one turn are ordered by role, then by a hash of the text; null ids form one conversation; equal rows repeat
each other; a conversation all of whose rows are lost has zeros and an empty audit; an
empty table gives no rows; other columns are never looked at.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roomcast.llm.bagminhash import text_key
from roomcast.llm.frames import rows_out
from roomcast.session import materialize

#: Symbols in a segment, and symbols that one grammar is built over.
SEGMENT = 4096
BLOCK = 1 << 18
#: Costs of edits, characters between words, ends of whole sentences.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
BLANKS = " \t\n\x0b\f\r"
STOPS = (".", "!", "?")
USER, ASSISTANT = "user", "assistant"
#: Symbols: s, u, a, o (other role), upper case if the text is truncated; x must be deleted.
SYMBOLS = "suaoSUAOx"

START, AFTER_SYSTEM, AFTER_USER, AFTER_ASSISTANT = range(4)
#: State behind a row with this role initial; absent where the grammar forbids it.
NEXT = {
    (START, "s"): AFTER_SYSTEM,
    (START, "u"): AFTER_USER,
    (AFTER_SYSTEM, "u"): AFTER_USER,
    (AFTER_ASSISTANT, "u"): AFTER_USER,
    (AFTER_USER, "a"): AFTER_ASSISTANT,
}
LEGAL = ("su", "ua", "au")

# -- ropes and matrices ----------------------------------------------------------------------------

#: A rope is a string, or (length, rope, rope).
Rope = str | tuple
Entry = tuple[int, Rope] | None
Matrix = tuple[tuple[Entry, ...], ...]
SHORT = 32


def rope_len(r: Rope) -> int:
    return len(r) if isinstance(r, str) else r[0]


def join(a: Rope, b: Rope) -> Rope:
    n = rope_len(a) + rope_len(b)
    if n <= SHORT:
        return a + b  # parts of a short rope are short, hence strings
    if not a or not b:
        return a or b
    return n, a, b


def less(a: Rope, b: Rope) -> bool:
    """ASCII order of two ropes; parts that both share in the same place are not walked."""
    left, right = [a], [b]
    while left and right:
        x, y = left.pop(), right.pop()
        if x is y:
            continue
        if isinstance(x, tuple) and (isinstance(y, str) or x[0] >= y[0]):
            left += (x[2], x[1])
            right.append(y)
        elif isinstance(y, tuple):
            right += (y[2], y[1])
            left.append(x)
        else:
            n = min(len(x), len(y))
            if x[:n] != y[:n]:
                return x[:n] < y[:n]
            if len(x) > n:
                left.append(x[n:])
            if len(y) > n:
                right.append(y[n:])
    return not any(map(rope_len, left)) and any(map(rope_len, right))


def text_of(r: Rope) -> str:
    parts, todo = [], [r]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            todo += (x[2], x[1])
    return "".join(parts)


def better(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if less(b[1], a[1]) else a


def row_times(row: tuple[Entry, ...], m: Matrix) -> tuple[Entry, ...]:
    """(min, +) product of a row of entries and a matrix."""
    out: list[Entry] = [None] * 4
    for k, head in enumerate(row):
        if head is None:
            continue
        for j, tail in enumerate(m[k]):
            if tail is not None and (out[j] is None or head[0] + tail[0] <= out[j][0]):
                out[j] = better(out[j], (head[0] + tail[0], join(head[1], tail[1])))
    return tuple(out)


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(row_times(row, b) for row in a)


def _inserts() -> Matrix:
    """Any number of inserted rows, none included."""
    rows = []
    for i in range(4):
        row: list[Entry] = [None] * 4
        row[i], at = (0, ""), i
        for n in (1, 2):
            at = AFTER_ASSISTANT if at == AFTER_USER else AFTER_USER
            row[at] = better(row[at], (n * INSERT, "I" * n))
        rows.append(tuple(row))
    return tuple(rows)


def _edit(symbol: str) -> Matrix:
    """One row, edited in the cheapest way for each pair of states."""
    rows, role = [], symbol.lower()
    extra = TRUNCATED if symbol.isupper() else 0
    for i in range(4):
        row: list[Entry] = [None] * 4
        row[i] = (DELETE, "D")
        if role != "x":
            to = AFTER_ASSISTANT if i == AFTER_USER else AFTER_USER
            row[to] = better(row[to], (REROLE + extra, "R"))
            kept = NEXT.get((i, role))
            if kept is not None:
                row[kept] = better(row[kept], (extra, "K"))
        rows.append(tuple(row))
    return tuple(rows)


INSERTS = _inserts()
#: Inserts before the row, then the row.
BY_SYMBOL = {s: times(INSERTS, _edit(s)) for s in SYMBOLS}
ONE: Matrix = tuple(tuple((0, "") if i == j else None for j in range(4)) for i in range(4))


def cheapest(row: tuple[Entry, ...]) -> tuple[int, str]:
    """(cost, audit) from the entries reached from the start, with inserts at the end."""
    ends = row_times(row, INSERTS)
    cost, rope = better(ends[START], ends[AFTER_ASSISTANT])
    return cost, text_of(rope)


# -- Re-Pair ---------------------------------------------------------------------------------------


def matrices(sequences: list[str]) -> list[Matrix]:
    """The matrix of every sequence, by one grammar over all of them."""
    names = {s: k for k, s in enumerate(SYMBOLS)}
    rules: list[Matrix] = [BY_SYMBOL[s] for s in SYMBOLS]
    at: list[int] = []  # symbols of all sequences, each followed by a -1
    for s in sequences:
        at += [names[c] for c in s]
        at.append(-1)
    n = len(at)
    nxt, before = list(range(1, n + 1)), list(range(-1, n - 1))
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        if at[i] >= 0 and at[i + 1] >= 0:
            places[at[i], at[i + 1]].append(i)
    queue = [(-len(p), pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(queue)
    while queue:
        noted, pair = heapq.heappop(queue)
        a, b = pair
        valid, free = [], -1
        for i in sorted(set(places[pair])):
            # left to right, and not into the second half of the occurrence before (as in aaa)
            if at[i] == a and nxt[i] < n and at[nxt[i]] == b and i != free:
                valid.append(i)
                free = nxt[i]
        places[pair] = valid
        if len(valid) < 2:
            continue
        if queue and len(valid) < -queue[0][0]:
            if len(valid) < -noted:
                heapq.heappush(queue, (-len(valid), pair))
                continue
        new = len(rules)
        rules.append(times(rules[a], rules[b]))
        touched = set()
        for i in valid:
            j = nxt[i]
            if at[i] != a or j >= n or at[j] != b:
                continue
            after, left = nxt[j], before[i]
            at[i], at[j] = new, -2
            nxt[i] = after
            if after < n:
                before[after] = i
                if at[after] >= 0:
                    places[new, at[after]].append(i)
                    touched.add((new, at[after]))
            if left >= 0 and at[left] >= 0:
                places[at[left], new].append(left)
                touched.add((at[left], new))
        del places[pair]
        for p in touched:
            if len(places[p]) > 1:
                heapq.heappush(queue, (-len(places[p]), p))
    out, own, i = [], ONE, 0
    while i < n:
        if at[i] == -1:
            out.append(own)
            own = ONE
        else:
            own = rules[at[i]] if own is ONE else times(own, rules[at[i]])
        i = nxt[i]
    return out


_ENTRIES = pa.list_(pa.struct([("at", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def sequence_matrices(sequences: DataFrame) -> DataFrame:
    """(symbols, entries) for every different value of ``symbols``; an entry is (4 * from + to, cost, audit)."""
    out = pa.schema([("symbols", pa.string()), ("entries", _ENTRIES)])

    def solved(block: list[str]) -> pa.RecordBatch:
        entries = [
            [{"at": 4 * i + j, "cost": e[0], "audit": text_of(e[1])} for i, row in enumerate(m) for j, e in enumerate(row) if e]
            for m in matrices(block)
        ]
        return rows_out(out, [block, entries])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = [], 0
        for batch in batches:
            for s in batch.column(0).to_pylist():
                if block and held + len(s) > BLOCK:
                    yield solved(block)
                    block, held = [], 0
                block.append(s)
                held += len(s) + 1
        if block:
            yield solved(block)

    different = sequences.select("symbols").distinct()
    return different.mapInArrow(run, "symbols string, entries array<struct<at:int,cost:long,audit:string>>")


def _matrix(entries: Iterable[dict]) -> Matrix:
    m: list[list[Entry]] = [[None] * 4 for _ in range(4)]
    for e in entries:
        m[e["at"] // 4][e["at"] % 4] = (e["cost"], e["audit"])
    return tuple(map(tuple, m))


# -- rows ------------------------------------------------------------------------------------------

ORDER = ("conv_id", "turn", "role", "t1", "t2")
_SPACE = " "


def conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, turn, role, text) with nulls of role and text as one space."""
    return df.select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit(_SPACE)).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit(_SPACE)).alias("text"),
    )


def damage(chats: DataFrame) -> DataFrame:
    """Rows of ``conversations`` after the damage that their id and turn draw."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(_SPACE)) for c in ("conv_id", "turn")]
    drawn = chats.withColumn("harm", F.crc32(F.concat_ws(":", *named)) % 20).filter("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.translate("text", "".join(STOPS), "")).otherwise(F.col("text"))
    role = F.when(F.col("harm") == 4, USER).otherwise(F.col("role"))
    again = F.explode(F.array_repeat(F.lit(0), F.when(F.col("harm") == 3, 2).otherwise(1)))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("harm")).drop("harm")


def _flags(text: Column) -> tuple[Column, Column]:
    """(blank, truncated) of a text."""
    seen = F.rtrim(text, F.lit(BLANKS))
    return seen == "", ~F.substring(seen, -1, 1).isin(*STOPS)


def faults(chats: DataFrame) -> DataFrame:
    """Narrow rows in place of equal rows: key, n copies, blank, truncated, and whether the first copy repeats an earlier row."""
    blank, cut = _flags(F.col("text"))
    t1, t2 = text_key(F.col("text"))
    narrow = chats.select("conv_id", "turn", "role", t1.alias("t1"), t2.alias("t2"), blank.alias("blank"), cut.alias("cut"))
    rows = materialize(narrow.groupBy(*narrow.columns).agg(F.count(F.lit(1)).alias("n")))
    # texts that a conversation has at several turns: all but the first repeat it
    same = ("conv_id", "role", "t1", "t2")
    often = rows.groupBy(*same).agg(
        F.count(F.lit(1)).alias("turns"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unset")
    )
    often = often.filter("turns > 1").select(*(F.col(c).alias(f"o_{c}") for c in same), "least", "unset")
    on = F.lit(True)
    for c in same:
        on = on & F.col(c).eqNullSafe(F.col(f"o_{c}"))
    later = F.when(F.col("unset"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("least"))
    return rows.join(often, on, "left").select(*ORDER, "blank", "cut", "n", F.coalesce(later, F.lit(False)).alias("later"))


class _Run:
    """Symbols and counts of consecutive rows of one conversation."""

    def __init__(self) -> None:
        self.symbols: list[str] = []
        self.first = self.last = ""
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = None

    def add(self, turn: int | None, role: str, blank: bool, cut: bool, repeats: bool) -> None:
        initial = role[:1] or "-"
        if blank or repeats:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            symbol = "x"
        else:
            self.truncated += cut
            symbol = initial if initial in "sua" else "o"
            symbol = symbol.upper() if cut else symbol
        if self.symbols:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.symbols.append(symbol)
        self.last = initial
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low, self.high = (turn if self.low is None else self.low), turn

    def row(self) -> tuple:
        counts = (self.blank, self.duplicate, self.truncated, self.illegal, self.turns, self.low, self.high)
        return "".join(self.symbols), self.first, self.last, *counts


_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")
_SEGMENT = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("segment", pa.int64())]
    + [(c, pa.string()) for c in ("symbols", "first", "last")]
    + [(c, pa.int64()) for c in _COUNTS]
)


def segments(flagged: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """Symbol strings of all conversations in order (part, segment), with what their rows count."""
    order = [F.asc_nulls_first(c) for c in ORDER]
    rows = materialize(flagged).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, conv, ready = TaskContext.get().partitionId(), 0, None, None, []

        def close() -> None:
            nonlocal number
            ready.append((conv, part, number, *held.row()))
            number += 1

        for batch in batches:
            for own, turn, role, blank, cut, n, later in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "blank", "cut", "n", "later"))
            ):
                for copy in range(n):
                    if held is None or own != conv or len(held.symbols) >= longest:
                        if held is not None:
                            close()
                        held, conv = _Run(), own
                    held.add(turn, role, blank, cut, later or copy > 0)
                    if len(ready) >= 4096:
                        yield rows_out(_SEGMENT, zip(*ready))
                        ready.clear()
        if held is not None:
            close()
        if ready:
            yield rows_out(_SEGMENT, zip(*ready))

    schema = ", ".join(f"{f.name} {'string' if pa.types.is_string(f.type) else 'long'}" for f in _SEGMENT)
    return rows.mapInArrow(run, schema)


class _Fold:
    """Segments of one conversation, taken in order."""

    def __init__(self) -> None:
        self.row: tuple[Entry, ...] = ONE[START]
        self.last = ""
        self.counts = [0] * 4
        self.turns, self.low, self.high = 0, None, None

    def add(self, entries: list, first: str, last: str, counts: list, turns: int, low: int | None, high: int | None) -> None:
        self.row = row_times(self.row, _matrix(entries))
        self.counts = [a + b for a, b in zip(self.counts, counts)]
        if self.last:
            self.counts[3] += self.last + first not in LEGAL
        self.last = last
        if low is not None:
            self.turns += turns - (low == self.high)
            self.low, self.high = (low if self.low is None else self.low), high

    def result(self) -> tuple:
        cost, audit = cheapest(self.row)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.counts, cost, audit


AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def audits(chats: DataFrame, longest: int = SEGMENT) -> DataFrame:
    """One row (``AUDIT``) per conversation with rows: its faults, and the cheapest edits in row order."""
    cut = materialize(segments(faults(chats), longest))
    solved = sequence_matrices(cut)
    rows = cut.join(solved, "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "part", "segment")
    out = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in AUDIT.split(", ")])
    names = ("conv_id", "entries", "first", "last", *_COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, conv = None, None
        for batch in batches:
            ready = []
            for own, entries, first, last, b, d, t, i, turns, low, high in zip(*(batch.column(c).to_pylist() for c in names)):
                if fold is None or own != conv:
                    if fold is not None:
                        ready.append((conv, *fold.result()))
                    fold, conv = _Fold(), own
                fold.add(entries, first, last, [b, d, t, i], turns, low, high)
            if ready:
                yield rows_out(out, zip(*ready))
        if fold is not None:
            yield rows_out(out, zip((conv, *fold.result())))

    return rows.mapInArrow(run, AUDIT)


class _Editor:
    """Applies an audit to the rows of a conversation, taken in order."""

    def __init__(self, audit: str) -> None:
        self.audit, self.at, self.state = audit, 0, START

    def _step(self, role: str, text: str, edit: str) -> tuple[str, str, str]:
        self.state = NEXT[self.state, role[:1]]
        return role, text, edit

    def _expected(self) -> str:
        return ASSISTANT if self.state == AFTER_USER else USER

    def inserted(self) -> Iterator[tuple[str, str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._step(self._expected(), "", "I")

    def add(self, role: str, text: str) -> Iterator[tuple[str, str, str]]:
        yield from self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            yield self._step(role, text, edit)
        elif edit == "R":
            yield self._step(self._expected(), text, edit)


def _edited(chats: DataFrame, audited: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """Texts of all conversations in order, each conversation headed by its audit row (kind 0) and that, if any, by its own row (kind -1)."""
    t1, t2 = text_key(F.col("text"))
    counts = [f.split()[0] for f in AUDIT.split(", ")[1:-1]]
    empty = [F.lit(None).cast("long").alias(c) for c in counts]
    rows = chats.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text", t1.alias("t1"), t2.alias("t2"), *empty)
    blank = {"turn": "long", "role": "string", "text": "string", "t1": "long", "t2": "long"}

    def head(df: DataFrame, kind: int, text: Column, numbers: list) -> DataFrame:
        none = {c: F.lit(None).cast(t).alias(c) for c, t in blank.items()}
        return df.select("conv_id", F.lit(kind).alias("kind"), *(none | {"text": text.alias("text")}).values(), *numbers)

    rows = rows.unionByName(head(audited, 0, F.col("audit"), counts))
    if others is not None:
        rows = rows.unionByName(head(others, -1, F.lit(None).cast("string"), empty))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *(F.asc_nulls_first(c) for c in ORDER[1:]))


def repair(chats: DataFrame, audited: DataFrame) -> DataFrame:
    """Repaired rows: conv_id, position (from 0), role, text, edit (K, R or I)."""
    out = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        editor, conv, position = None, None, 0
        for batch in batches:
            ready = []

            def take(rows: Iterable[tuple]) -> None:
                nonlocal position
                for row in rows:
                    ready.append((conv, position, *row))
                    position += 1

            for own, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    if editor is not None:
                        take(editor.inserted())
                    editor, conv, position = _Editor(text), own, 0
                else:
                    take(editor.add(role, text))
            if ready:
                yield rows_out(out, zip(*ready))
        if editor is not None:
            ready = []
            rest = [(conv, position + k, *row) for k, row in enumerate(editor.inserted())]
            if rest:
                yield rows_out(out, zip(*rest))

    return _edited(chats, audited).mapInArrow(run, "conv_id long, position long, role string, text string, edit string")


def reports(all_ids: DataFrame, chats: DataFrame, audited: DataFrame) -> DataFrame:
    """Per conversation of ``all_ids`` (conv_id): the audit row and the digest of the repaired ``role:text`` lines."""
    counts = [f.split()[0] for f in AUDIT.split(", ")[1:-1]]
    schema = AUDIT + ", repaired_sha256 string"
    out = pa.schema([(f.split()[0], pa.string() if f.endswith("string") else pa.int64()) for f in schema.split(", ")])

    class Report:
        def __init__(self, conv: int | None) -> None:
            self.conv, self.counts, self.audit, self.editor = conv, [0] * len(counts), "", None
            self.digest, self.any = hashlib.sha256(), False

        def take(self, rows: Iterable[tuple]) -> None:
            for role, text, _ in rows:
                self.digest.update(f"{chr(10) * self.any}{role}:{text}".encode())
                self.any = True

        def done(self) -> tuple:
            if self.editor is not None:
                self.take(self.editor.inserted())
            return self.conv, *self.counts, self.audit, self.digest.hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = None
        for batch in batches:
            ready = []
            numbers = zip(*(batch.column(c).to_pylist() for c in counts))
            for own, kind, role, text, found in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text")), numbers):
                if kind == -1:
                    if report is not None:
                        ready.append(report.done())
                    report = Report(own)
                elif kind == 0:
                    report.counts, report.audit, report.editor = found, text, _Editor(text)
                else:
                    report.take(report.editor.add(role, text))
            if ready:
                yield rows_out(out, zip(*ready))
        if report is not None:
            yield rows_out(out, zip(report.done()))

    return _edited(chats, audited, all_ids.select("conv_id").distinct()).mapInArrow(run, schema)
