"""Conversation repair against all edit sequences."""

import random
import re
import zlib
from hashlib import sha256

import pytest

from casemill.llm import queries, repair

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    """``(cost, audit, repaired)`` of ``(role, text)`` rows: every edit sequence with at most two inserts in a place."""
    seen, facts = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        facts.append((role, text, not body or (role, text) in seen, bool(body) and body[-1] not in ".!?"))
        seen.add((role, text))
    ways = [(0, "", ())]

    def inserted(ways):
        for _ in range(2):
            ways = ways + [(c + 2, a + "I", out + ((r, ""),)) for c, a, out in ways for r in ("user", "assistant")]
        return {w for w in ways if re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] for r, _ in w[2]))}

    ways = inserted(ways)
    for role, text, gone, cut in facts:
        new = set()
        for cost, audit, out in ways:
            new.add((cost + 3, audit + "D", out))
            if not gone:
                if role:
                    new.add((cost + cut, audit + "K", out + ((role, text),)))
                for other in ("user", "assistant"):
                    new.add((cost + 2 + cut, audit + "R", out + ((other, text),)))
        ways = inserted(list(new))
        least = min(w[0] for w in ways)
        ways = {w for w in ways if w[0] <= least + 6}
    ways = [w for w in ways if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in w[2]))]
    cost, audit, out = min(ways, key=lambda w: w[:2])
    return cost, audit, "\n".join(f"{r}:{t}" for r, t in out)


def repaired(rows):
    out, now = [], None
    now = repair.Conversation(lambda edit, role, text: out.append(f"{role}:{text}") if edit != "D" else None)
    seen = set()
    for role, text in rows:
        now.row(None, role, text, (role, text) in seen)
        seen.add((role, text))
    *_, cost, audit = now.end()
    return cost, audit, "\n".join(out)


def dealt(rng, n):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", "s", "Assistant"]
    texts = ["Yes.", "No!", "Why?", "cut", "  ", "", "x. ", "other.", "and so on", "1.", "2.", "3."]
    return [(rng.choice(roles), rng.choice(texts)) for _ in range(n)]


@pytest.mark.parametrize(("settle", "prime"), [(1, repair._PRIME), (2, 7), (256, repair._PRIME), (256, 2)])
def test_cheapest_and_least_edits(monkeypatch, settle, prime):
    """Also with settled prefixes after every row, and with hashes that nearly always collide."""
    monkeypatch.setattr(repair, "SETTLE_ROWS", settle)
    monkeypatch.setattr(repair, "_PRIME", prime)
    rng = random.Random(settle + prime)
    for n in range(60):
        rows = dealt(rng, n % 6)
        assert repaired(rows) == brute(rows), rows


def slow(rows):
    """The definition row by row, for conversations too long for ``brute``: whole audits as strings."""
    best = {0: (0, "")}

    def inserts(best):
        for _ in range(3):
            for s, (c, a) in list(best.items()):
                t = repair.NEXT[s][1]
                best[t] = min(best.get(t, (10**9, "")), (c + 2, a + "I"))
        return best

    best, seen = inserts(best), set()
    for role, text in rows:
        new = {}
        body = text.strip(SPACE)
        for s, (c, a) in best.items():
            moves = [(s, c + 3, "D")]
            if body and (role, text) not in seen:
                more = body[-1] not in ".!?"
                moves.append((repair.NEXT[s][1], c + 2 + more, "R"))
                if (s, role[:1]) in repair.FOLLOWS:
                    moves.append((repair.FOLLOWS[s, role[:1]], c + more, "K"))
            for t, cost, e in moves:
                new[t] = min(new.get(t, (10**9, "")), (cost, a + e))
        seen.add((role, text))
        best = inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def test_long_conversations_are_settled_on_the_way():
    rng = random.Random(5)
    rows = [(r, f"{t}{i}." if i % 7 else t) for i, (r, t) in enumerate(dealt(rng, 6000))]
    most = 0
    now = repair.Conversation(lambda *_: None)
    seen = set()
    for row in rows:
        now.row(None, *row, row in seen)
        seen.add(row)
        most = max(most, len(now.repair.waiting))
    assert tuple(now.end()[-2:]) == slow(rows)
    assert most < 3 * repair.SETTLE_ROWS


def expected(rows):
    """The contract, from ``(turn, role, text)`` of one conversation."""
    kept = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        draw = zlib.crc32(name.encode()) % 20
        if draw:
            text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
            kept += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    kept.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    if not kept:
        return (0, 0, 0, 0, 0, 0, "", sha256(b"").hexdigest())
    turns = [r[0] for r in kept if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    faults, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, set()
    for _, role, text in kept:
        body = text.strip(SPACE)
        if not body:
            faults["blank"] += 1
        elif (role, text) in seen:
            faults["duplicate"] += 1
        elif body[-1] not in ".!?":
            faults["truncated"] += 1
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
    cost, audit, said = brute([r[1:] for r in kept])
    return (gaps, *faults.values(), illegal, cost, audit, sha256(said.encode()).hexdigest())


ROWS = [
    *[(c, t, r, f"Text {c} {t}.") for c in range(30) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"][c % 3 :])],
    (40, None, "user", "Hi."), (40, 3, None, "x"), (40, 3, "assistant", None), (40, 9, "user", "Hi."),
    (None, 1, "user", "a."), (None, 2, "assistant", "b"), (None, None, None, None),
    (41, 1, "user", "same."), (41, 1, "user", "same."), (41, 1, "user", "same."),
    (42, -(2**63), "user", "low."), (42, 2**63 - 1, "assistant", "high."),
    (43, 0, "user", "long " * 50_000 + "."), (43, 1, "", "no role."), (44, 5, "tool", " \t\n"),
    (45, 1, "user", "ab. "), (45, 1, "user", "Ab."),
]


def test_query(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    extra = df.selectExpr("*", "1 AS conv", "2 AS seen", "'x' AS audit", "true AS gone", "3 AS draw", "4 AS copy")
    extra.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["conv_id"]: tuple(r)[1:] for r in queries.op12_repair(spark, str(tmp_path)).collect()}
    groups = {}
    for row in ROWS:
        groups.setdefault(row[0], []).append(row)
    wanted = {c: expected(rows) for c, rows in groups.items()}
    wanted[42] = (min(wanted[42][0], 2**63 - 1), *wanted[42][1:])
    assert found == wanted


def test_repaired_rows(spark):
    df = spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string")
    rows = repair.repaired(df).collect()
    said = {}
    for r in sorted(rows, key=lambda r: r["place"]):
        said.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    digests = {r["conv_id"]: r["repaired_sha256"] for r in repair.audits(df).collect()}
    assert set(digests) == {r[0] for r in ROWS}
    assert all(sha256("\n".join(said.get(c, [])).encode()).hexdigest() == d for c, d in digests.items())
    assert repair.audits(df.limit(0)).count() == 0 and repair.repaired(df.limit(0)).count() == 0
