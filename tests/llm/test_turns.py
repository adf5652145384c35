"""Repaired conversations against a plain recursion over every target, and against a row-by-row version."""

import hashlib
import random
import zlib
from functools import lru_cache

import pytest

pytest.importorskip("public_tokenizers")

from concord.llm import turns  # noqa: E402

BLANKS = " \t\n\x0b\x0c\r"


def brute(initials, faults):
    """Least (cost, audit) over every target and every edit."""
    n = len(initials)

    @lru_cache(None)
    def go(i, t, target):
        if i == n and t == len(target):
            return 0, ""
        found = []
        if i < n:
            c, a = go(i + 1, t, target)
            found.append((c + 4, "D" + a))
        if t < len(target) and target[t] != "s":
            c, a = go(i, t + 1, target)
            found.append((c + 3, "I" + a))
        if i < n and t < len(target) and faults[i] != "F":
            c, a = go(i + 1, t + 1, target)
            more = 3 * (faults[i] == "T")
            if initials[i] == target[t]:
                found.append((c + more, "K" + a))
            if target[t] != "s":
                found.append((c + more + 3, "R" + a))
        return min(found) if found else (10**9, "")

    return min(go(0, 0, "s" * (length % 2) + "ua" * (length // 2)) for length in [0, *range(2, 2 * n + 5)])


def test_align_is_the_cheapest_and_least():
    rng = random.Random(1)
    assert turns.align("", "") == (0, "")
    for _ in range(1500):
        n = rng.randint(1, 8)
        initials = "".join(rng.choice("suao" if rng.random() < 0.5 else "ua") for _ in range(n))
        faults = "".join(rng.choice("FT    ") for _ in range(n))
        assert turns.align(initials, faults) == brute(initials, faults)


def test_long_conversations_are_aligned():
    rng = random.Random(2)
    initials = "".join("ua"[i % 2] if rng.random() < 0.9 else rng.choice("uaso") for i in range(120))
    faults = "".join(rng.choice("FTT" + " " * 17) for _ in range(120))
    import sys

    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        cost, audit = turns.align(initials, faults)
        lengths = sum(e != "D" for e in audit)
        assert cost <= turns._walk_cost(initials, faults) and lengths % 2 == 0 or initials[audit.index("K")] == "s"
        n = len(initials)
        least = None
        for m in range(n // 2 - 20, n // 2 + 20):
            table = [3 * k for k in range(2 * m + 1)]
            for i in range(n - 1, -1, -1):
                row = []
                for r in range(2 * m + 1):
                    ways = [table[r] + 4] + ([row[r - 1] + 3] if r else [])
                    if r and faults[i] != "F":
                        ways.append(table[r - 1] + 3 * (faults[i] == "T") + 3 * (initials[i] != ("a" if r % 2 else "u")))
                    row.append(min(ways))
                table = row
            least = min(table[2 * m], least if least is not None else 10**9)
        assert cost <= least
    finally:
        sys.setrecursionlimit(limit)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
        out += [(conv, turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return out


def plain_audit(key, rows):
    rows = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
    seen, faults, count = set(), "", dict(blank=0, duplicate=0, truncated=0)
    for _, _, role, text in rows:
        ink = text.strip(BLANKS)
        fault = "blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else ""
        seen.add((role, text))
        faults += {"": " ", "truncated": "T"}.get(fault, "F")
        if fault:
            count[fault] += 1
    initials = "".join(r[2][:1] if r[2][:1] in ("s", "u", "a") else "o" for r in rows)
    cost, audit = brute(initials, faults)
    numbers = [r[1] for r in rows if r[1] is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    length = sum(e != "D" for e in audit)
    target, lines, rest, place = "s" * (length % 2) + "ua" * (length // 2), [], iter(rows), 0
    for e in audit:
        row = None if e == "I" else next(rest)
        if e != "D":
            role = row[2] if e == "K" else {"u": "user", "a": "assistant"}[target[place]]
            lines.append(f"{role}:{row[3] if row else ''}")
            place += 1
    return (key, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest()), lines


def _rows():
    rng = random.Random(3)
    rows = []
    for conv in range(120):
        for turn in range(rng.randint(1, 8)):
            text = rng.choice(["Well. ", "so", "Is it?\n", "", " \t", "Yes! it is.", "é ok…", None])
            rows.append((conv, turn + (turn > 3) * rng.randint(0, 3), rng.choice(["user", "assistant", "system", "tool", "", None]) if rng.random() < 0.3 else ("user", "assistant")[turn % 2], text))
    return rows + [(None, 1, "user", "no id."), (None, None, None, None), (500, None, "user", "a."), (500, None, "assistant", "b."), (501, 7, "user", "tie."), (501, 7, "assistant", "tie."),
                   (501, 7, "user", "tie.")]


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


def test_damaged_conversations(spark):
    rows = _rows()
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], COLUMNS + ", dropped int, digest string, pass string").repartition(4)
    got = {r.conv_id: tuple(r) for r in turns.audits(turns.damage(df)).collect()}
    damaged = plain_damage(rows)
    assert got == {k: plain_audit(k, damaged)[0] for k in {r[0] for r in rows}}
    lost = {r[0] for r in rows} - {r[0] for r in damaged}
    assert lost and all(got[k][1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for k in lost)


def test_repaired_turns(spark):
    rows = [(k, t, r, x) for k, t, r, x in ((c, t, "" if r is None else r, x or "") for c, t, r, x in _rows())]
    out = {}
    for r in turns.repaired(spark.createDataFrame(rows, COLUMNS)).collect():
        out.setdefault(r.conv_id, []).append((r.place, f"{r.role}:{r.text}"))
    want = {k: plain_audit(k, rows)[1] for k in {r[0] for r in rows}}
    assert {k: [x for _, x in sorted(v)] for k, v in out.items()} == {k: v for k, v in want.items() if v}


def test_empty_and_very_long(spark):
    assert turns.audits(turns.damage(spark.createDataFrame([], COLUMNS))).count() == 0
    assert turns.repaired(spark.createDataFrame([], COLUMNS)).count() == 0
    many = spark.range(3000).selectExpr("1 as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role", "concat(repeat('word ', 100), id, '.') as text")
    (r,) = turns.audits(many).collect()
    assert (r.cost, r.audit, r.gaps, r.illegal) == (0, "K" * 3000, 0, 0)
    (r,) = turns.audits(turns.damage(many)).collect()
    assert r.gaps > 0 and r.blank > 0 and r.duplicate > 0 and r.truncated > 0 and r.cost > 0
