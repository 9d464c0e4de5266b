"""Conversation repair against a plain dynamic program and against all edit scripts."""

import hashlib
import itertools
import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from roomcast.llm import turn_repair as R
from roomcast.llm.queries import QUERIES
from tests.llm.helpers import SF, folder_with

GRAMMAR = re.compile(r"(s?(ua)+)?")
SEEN = re.compile(r"[^\x20\x09-\x0D]")


def _all_scripts(symbols):
    """(cost, audit) by trying every script: edits of the rows with up to two inserts in each gap."""
    best = None
    for edits in itertools.product("KRD", repeat=len(symbols)):
        for gaps in itertools.product(("", "I", "II"), repeat=len(symbols) + 1):
            audit = gaps[0] + "".join(e + g for e, g in zip(edits, gaps[1:]))
            rows = iter(symbols)
            roles, cost = "", 0
            for e in audit:
                if e == "I":
                    cost += 2
                    roles += "?"
                    continue
                s = next(rows)
                if e == "D":
                    cost += 3
                    continue
                if s == "x":
                    break
                cost += 2 * (e == "R") + s.isupper()
                roles += "?" if e == "R" else s.lower()
            else:
                fits = any(
                    all(r in ("?", w) for r, w in zip(roles, want)) and not (want[:1] == "s" and roles[:1] == "?")
                    for want in ("ua" * (len(roles) // 2), "s" + "ua" * (len(roles) // 2))
                    if len(want) == len(roles) and GRAMMAR.fullmatch(want)
                )
                if fits and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def _plain(symbols):
    """(cost, audit) row by row, strings in full."""
    states = {0: (0, "")}

    def offer(to, state, value):
        if state not in to or value < to[state]:
            to[state] = value

    def inserts(states):
        out = dict(states)
        for _ in range(2):
            for s, (c, a) in list(out.items()):
                offer(out, 3 if s == 2 else 2, (c + 2, a + "I"))
        return out

    for s in symbols:
        after = {}
        for state, (c, a) in inserts(states).items():
            offer(after, state, (c + 3, a + "D"))
            if s == "x":
                continue
            extra = int(s.isupper())
            offer(after, 3 if state == 2 else 2, (c + 2 + extra, a + "R"))
            if (state, s.lower()) in R.NEXT:
                offer(after, R.NEXT[state, s.lower()], (c + extra, a + "K"))
        states = after
    ends = inserts(states)
    return min(ends[s] for s in (0, 3) if s in ends)


@settings(max_examples=40, deadline=None)
@given(st.text("suaoSUAx", max_size=3))
def test_plain_program_equals_all_scripts(symbols):
    assert _plain(symbols) == _all_scripts(symbols)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(R.SYMBOLS, max_size=40) | st.text("ux", max_size=90) | st.text("ua", max_size=60), min_size=1, max_size=8))
def test_grammar_equals_plain_program(sequences):
    for s, m in zip(sequences, R.matrices(sequences)):
        assert R.cheapest(m[R.START]) == _plain(s)


@given(st.lists(st.text("ab", max_size=50), max_size=6), st.lists(st.text("ab", max_size=50), max_size=6))
def test_ropes(a, b):
    def rope(parts):
        r = ""
        for p in parts:
            r = R.join(r, p)
        return r

    x, y = rope(a), rope(b)
    assert R.text_of(x) == "".join(a) and R.less(x, y) == ("".join(a) < "".join(b))
    head = rope(a + b)
    assert R.less(R.join(head, x), R.join(head, y)) == ("".join(a) < "".join(b))


def _want(rows):
    """{conv: result row} of the whole query by definition; rows are (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv]
        role, text = (" " if v is None else v for v in (role, text))
        h = zlib.crc32(":".join(" " if v is None else str(v) for v in (conv, turn)).encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        by[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, symbols, n = set(), "", [0, 0, 0]
        for _, role, text in own:
            visible = SEEN.findall(text)
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not visible:
                n[0] += 1
                symbols += "x"
            elif (role, text) in seen:
                n[1] += 1
                symbols += "x"
            elif visible[-1] not in ".!?":
                n[2] += 1
                symbols += initial.upper()
            else:
                symbols += initial
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit = _plain(symbols)
        lines, state, left = [], 0, iter(own)
        for e in audit:
            expected = "assistant" if state == 2 else "user"
            if e == "I":
                lines.append(expected + ":")
            else:
                _, role, text = next(left)
                if e == "D":
                    continue
                lines.append(f"{role if e == 'K' else expected}:{text}")
                expected = role if e == "K" else expected
            state = R.NEXT[state, expected[:1]]
        out[conv] = (gaps, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def _check(spark, folder):
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    want = _want(rows)
    got = QUERIES["op12_turn_repair"](spark, folder).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in NAMES) == want[r["conv_id"]], r["conv_id"]
    return got


def test_query(spark):
    got = _check(spark, SF)
    assert sum(r["cost"] for r in got) > 50 and {e for r in got for e in r["audit"]} == set("KRDI")


def _awkward(spark):
    rng = np.random.default_rng(8)
    rows = [(None, None, None, None), (None, 1, "user", "a."), (None, None, "user", "a."), (1, 5, "", ""), (2, 0, "system", "x. \n\x0b")]
    rows += [(3, None, "user", "b"), (3, None, "user", "b"), (3, -4, "user", "b"), (3, 2**40, "assistant", "é!" * 20000)]
    roles = ["system", "user", "assistant", "tool", "User", "s"]
    for c in range(4, 60):
        for t in range(int(rng.integers(1, 14))):
            text = ["yes.", "no", " ", f"w{rng.integers(9)}?", "end. "][int(rng.integers(5))]
            rows.append((c, int(rng.integers(0, 12)) * 100 + t, roles[int(rng.integers(6))], text))
    # one conversation with most of the rows
    rows += [(99, i, ("user", "assistant", "user")[i % 3], f"turn {i % 700}" + "." * (i % 5 > 0)) for i in range(1500)]
    rows += [(100, i, "user", "again.") for i in range(300)]
    return spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, kind string")


def test_awkward_conversations(spark, tmp_path):
    _check(spark, folder_with(spark, tmp_path, conversations=_awkward(spark)))


def test_segments_do_not_matter(spark):
    chats = R.damage(R.conversations(_awkward(spark))).cache()
    whole = {r["conv_id"]: tuple(r) for r in R.audits(chats).collect()}
    cut = {r["conv_id"]: tuple(r) for r in R.audits(chats, longest=7).collect()}
    assert whole == cut
    audited = R.audits(chats).cache()
    rows = defaultdict(list)
    for r in R.repair(chats, audited).orderBy("conv_id", "position").collect():
        rows[r["conv_id"]].append((r["position"], f"{r['role']}:{r['text']}"))
    for r in R.reports(chats, chats, audited).collect():
        own = rows[r["conv_id"]]
        assert [p for p, _ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(x for _, x in own).encode()).hexdigest() == r["repaired_sha256"]
