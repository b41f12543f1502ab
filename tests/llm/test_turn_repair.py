"""Conversation repair against a plain search over whole audits, with chunks of four rows and of one."""

import hashlib
import re
import zlib

import numpy as np
import pytest

from schemaloom.llm import turn_repair

SCHEMA = "conv_id bigint, turn bigint, role string, text string, talk string, id int, edits string"
WORD = re.compile(r"[^\x20\x09-\x0D]")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        way = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * (0 if way == 0 else 2 if way == 3 else 1)
    return out


def ordered(rows):
    """By turn, nulls first, then role and the text's beginning (the tests have no longer ties)."""
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3][:64]))


def repaired(rows):
    """(summary, turns) of one conversation's (conv, turn, role, text) rows in order: cheapest, then least, whole audits."""
    seen, faults = set(), []
    for _, _, role, text in rows:
        marks = WORD.findall(text)
        faults.append("blank" if not marks else "duplicate" if (role, text) in seen else "truncated" if marks[-1] not in ".!?" else "")
        seen.add((role, text))
    # state -> (cost, audit, turns); 0 nothing, 1 after s, 2 after u, 3 after a
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    best = {0: (0, "", ())}

    def offer(into, state, cost, audit, turns):
        if state not in into or (cost, audit) < into[state][:2]:
            into[state] = (cost, audit, turns)

    def filled(best):
        for _ in range(4):
            for state, (cost, audit, turns) in list(best.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in step:
                        offer(best, step[state, role[0]], cost + 3, audit + "I", (*turns, (role, "")))
        return best

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        above, best = filled(best), {}
        for state, (cost, audit, turns) in above.items():
            offer(best, state, cost + 4, audit + "D", turns)
            if fault in ("", "truncated"):
                more = 3 if fault else 0
                if (state, role[:1]) in step:
                    offer(best, step[state, role[:1]], cost + more, audit + "K", (*turns, (role, text)))
                for new in ("user", "assistant"):
                    if (state, new[0]) in step:
                        offer(best, step[state, new[0]], cost + more + 3, audit + "R", (*turns, (new, text)))
    cost, audit, turns = min(v for s, v in filled(best).items() if s in (0, 3))
    numbers = [r[1] for r in rows if r[1] is not None]
    kinds = [r[2][:1] for r in rows]
    return (max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(kinds, kinds[1:], strict=False)), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()), turns


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)


def check(spark, rows, **settings):
    fixed = turn_repair.repair(frame(spark, rows), "conv_id", **settings)
    rows = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    talks = {c: ordered([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    want = {"" if c is None else f"={c}": repaired(talk) for c, talk in talks.items()}
    got = {r["talk"]: tuple(r[f] for f in FIELDS[:-1]) for r in fixed.summary().collect()}
    assert got == {c: w[0][:-1] for c, w in want.items()}
    turns = {}
    for r in sorted(fixed.turns().collect(), key=lambda r: r["place"]):
        turns.setdefault(r["talk"], []).append((r["role"], r["text"]))
    assert turns == {c: list(w[1]) for c, w in want.items() if w[1]}
    assert {r["talk"]: r["repaired_sha256"] for r in fixed.digests().collect()} == {c: w[0][-1] for c, w in want.items() if w[1]}


def random_rows(seed, talks, most, roles):
    rng, rows = np.random.default_rng(seed), []
    for c in range(talks):
        for t in range(int(rng.integers(1, most))):
            text = rng.choice(["Yes.", "no", "", " \n", "Why? ", "same!", f"t{t}.", f"t{t}"])
            rows.append((None if c == 0 else c, None if rng.random() < 0.05 else int(t + 5 * (rng.random() < 0.05)), str(rng.choice(roles)), str(text)))
    return rows


@pytest.mark.parametrize(("seed", "bits", "passes"), [(1, 9, 8), (2, 2, 8), (3, 0, 2), (4, 1, 0)])
def test_random_conversations(spark, seed, bits, passes):
    roles = ["system", "user", "user", "assistant", "assistant", "tool", ""]
    check(spark, random_rows(seed, 25, 40, roles), bits=bits, passes=passes)


@pytest.mark.parametrize("passes", [3, 50])
def test_vectors_that_never_converge(spark, passes):
    """Rows of unknown roles keep their parity; rows that must go change no vector: one by doubling, one by passes."""
    rows = [(1, t, "tool", f"t{t}.") for t in range(45)] + [(2, t, "user", "") for t in range(40)] + [(3, t, "tool", f"{t}") for t in range(30)]
    check(spark, rows, bits=1, passes=passes)


def test_one_long_conversation(spark):
    rows = [(7, t, ("user", "assistant", "tool")[t * t % 7 % 3], f"t{t}" + "." * (t % 5 > 0)) for t in range(3000)]
    check(spark, rows, bits=5)


def test_damage_and_audit(spark):
    rows = random_rows(5, 40, 9, ["system", "user", "assistant", None]) + [(50, None, None, None), (50, None, None, None), (51, 0, "user", None)]
    rows += [(c, 0, "system", "s.") for c in range(60, 120)]  # some of these lose all their rows
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in turn_repair.audit(frame(spark, rows)).collect()}
    left = damaged(rows)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {c: repaired(ordered([r for r in left if r[0] == c]))[0] if any(r[0] == c for r in left) else nothing for c in {r[0] for r in rows}}
    assert got == want and nothing in got.values()
    assert turn_repair.audit(frame(spark, [])).count() == 0


def test_cost_vectors_equal_a_plain_recursion():
    rng = np.random.default_rng(3)
    matrix = rng.integers(0, 16, (50, 12)).astype(np.uint8)
    table = turn_repair.backward(matrix, np.tile(turn_repair.END, (50, 1)))
    names = {0: "s.", 1: "u.", 2: "a.", 3: "x."}
    for codes, cost in zip(matrix, table[0, :, 0], strict=True):
        rows = []
        for i, code in enumerate(codes):
            kind, fault = names[code // 4][0], code % 4
            if fault == 3:  # a duplicate needs its like before it
                continue
            rows.append((1, i, {"s": "system", "u": "user", "a": "assistant", "x": "x"}[kind], ["t%d." % i, "t%d" % i, ""][fault]))
        plain = repaired(rows)[0][5] if rows else 0
        assert cost == plain + 4 * int((codes % 4 == 3).sum())
