"""Conversation repair against plain search over all edits, and hard rows."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest

from skyshear.llm import turns

SCHEMA = "conv_id long, turn long, role string, text string, segment int, word string, digest int, audit string, kind int"
LEGAL = re.compile(r"(s?(ua)+)?")


def brute_faults(rows):
    """rows: (role, text) in order; the fault of each."""
    seen, out = set(), []
    for role, text in rows:
        kept = [c for c in text if c not in " \t\n\x0b\f\r"]
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_repair(rows):
    """The cheapest (cost, audit, repaired rows) by going through every edit of every row, most two insertions in a gap."""
    faults = brute_faults(rows)
    best = None
    gaps = [(), ("user",), ("assistant",), ("user", "assistant"), ("assistant", "user")]
    for before in gaps:
        for choice in itertools.product(*[itertools.product(["K", "user", "assistant", "D"], gaps) for _ in rows]):
            cost, audit, out = 5 * len(before), "I" * len(before), [(r, "") for r in before]
            for (role, text), fault, (edit, after) in zip(rows, faults, choice, strict=True):
                if edit == "D":
                    cost, audit = cost + 2, audit + "D"
                elif fault in ("blank", "duplicate"):
                    break
                else:
                    cost += (edit != "K") + 5 * (fault == "truncated")
                    audit += "K" if edit == "K" else "R"
                    out.append((role if edit == "K" else edit, text))
                out += [(r, "") for r in after]
                cost, audit = cost + 5 * len(after), audit + "I" * len(after)
                if best and cost > best[0]:
                    break
            else:
                if LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, out)
    return best


def least_suffixes(rows):
    """The same by dynamic programming from the end, for longer conversations: (cost, audit)."""
    faults = brute_faults(rows)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    def closed(best):
        for _ in range(3):
            for state in step:
                for to in ("u", "a"):
                    if to in step[state] and best.get(to):
                        c, a = best[to]
                        best[state] = min(x for x in (best.get(state), (c + 5, "I" + a)) if x)
        return best

    best = closed({"": (0, ""), "a": (0, "")})
    for (role, _), fault in reversed(list(zip(rows, faults, strict=True))):
        new = {}
        for state in step:
            ways = [(best[state][0] + 2, "D" + best[state][1])] if best.get(state) else []
            if fault not in ("blank", "duplicate"):
                extra = 5 * (fault == "truncated")
                if best.get(step[state].get(role[:1])):
                    c, a = best[step[state][role[:1]]]
                    ways.append((c + extra, "K" + a))
                for to in ("u", "a"):
                    if best.get(step[state].get(to)):
                        c, a = best[step[state][to]]
                        ways.append((c + extra + 1, "R" + a))
            if ways:
                new[state] = min(ways)
        best = closed(new)
    return best[""]


def conversation(rng, n):
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "user"]
    texts = ["Hello there.", "What?", "cut off", " ", "", "Fine!", "One more.", "a. ", "b?\n", "no end\t"]
    return [(rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {rng.random()}.") for _ in range(n)]


def table_of():
    rng = random.Random(2)
    rows = []
    for conv in range(40):
        rows += [(conv, t * rng.choice([1, 1, 3]), *r) for t, r in enumerate(conversation(rng, rng.randint(1, 4)))]
    for conv in range(100, 104):  # over several segments
        rows += [(conv, t * 37, *r) for t, r in enumerate(conversation(rng, 500))]
    rows += [(200, t, "user" if t % 2 == 0 else "assistant", f"line {t}.") for t in range(9000)]
    rows += [(300, None, "user", "Q?"), (300, 5, "assistant", "A."), (300, None, None, None), (301, None, "user", "Q?"), (None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (302, 1, "", "x."), (303, 1, "tool", "é\U0001f600" * 9000 + ".")]
    rows += [(304, -(2**40), "user", "Q?"), (304, 2**40, "assistant", "A."), (305, 1, "user", "Q?"), (305, 1, "user", "Q?"), (305, 1, "assistant", "A."), (306, 7, "user", "same."), (306, None, "user", "same."), (306, 2**41, "user", "same.")]
    return rows


def ordered(rows):
    by = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        by.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.md5(text.encode()).hexdigest(), text))
    return {c: sorted(r) for c, r in by.items()}


@pytest.fixture(scope="module")
def convs(spark):
    rows = [(*r, 1, "w", 2, "K", 0) for r in table_of()]
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def plans(convs):
    return turns.repairs(convs)


def digest_of(rows):
    return hashlib.sha256("\n".join(f"{r}:{t}" for r, t in rows).encode()).hexdigest()


def test_counts_and_audits_equal_brute_force(convs, plans):
    got = {r["conv_id"]: r for r in plans.collect()}
    want = ordered(table_of())
    assert set(got) == set(want)
    for conv, rows in want.items():
        plain = [(r[2], r[4]) for r in rows]
        faults, known = brute_faults(plain), {r[1] for r in rows if r[0]}
        initials = [r[:1] for r, _ in plain]
        one = got[conv]
        assert [one[k] for k in ("blank", "duplicate", "truncated")] == [faults.count(k) for k in ("blank", "duplicate", "truncated")], conv
        assert one["illegal"] == sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), conv
        assert one["gaps"] == (max(known) - min(known) + 1 - len(known) if known else 0), conv
        assert (one["cost"], one["audit"]) == least_suffixes(plain), conv


def test_repaired_rows_equal_brute_force(convs, plans):
    rows, digests = {}, {r["conv_id"]: r["repaired_sha256"] for r in turns.repaired_digests(convs, plans).collect()}
    for r in turns.repaired_turns(convs, plans).collect():
        rows.setdefault(r["conv_id"], []).append((r["at"], r["role"], r["text"]))
    for conv, wanted in ordered(table_of()).items():
        plain = [(r[2], r[4]) for r in wanted]
        mine = [x[1:] for x in sorted(rows.get(conv, []))]
        assert LEGAL.fullmatch("".join(r[:1] or "?" for r, _ in mine)), conv
        assert digests[conv] == digest_of(mine), conv
        if len(plain) <= 4:
            assert (brute_repair(plain)[1:]) == (plans.filter(plans["conv_id"].eqNullSafe(conv)).first()["audit"], mine), conv


def test_grammar_gives_the_products(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("suaoSUAOx") for _ in range(rng.randint(1, 40))) for _ in range(150)] + ["ua" * 600, "u" * 77, "s"]
    for rules, worth in ((512, 4), (3, 1), (0, 4), (60, 2)):
        shorter, made = turns.paired(words, rules, worth)
        parts = [(s,) for s in turns.ALPHABET]
        for a, b in made:
            parts.append((*parts[a], *parts[b]))
        assert ["".join(x for s in seq if s >= 0 for x in parts[s]) for seq in shorter] == words
        for word, matrix in turns.evaluated(words, rules, worth):
            plain = turns.SYMBOL_MATRICES[turns.ALPHABET.index(word[0])]
            for c in word[1:]:
                plain = turns.product(plain, turns.SYMBOL_MATRICES[turns.ALPHABET.index(c)])
            as_text = lambda m: [[None if x is None else (x[0], turns.written(x[1])) for x in row] for row in m]
            assert as_text(matrix) == as_text(plain)
    assert sum(len(s) for s in turns.paired(["ua" * 600])[0]) < 40  # the grammar shortens what repeats


def test_query_equals_brute_force(spark, convs, monkeypatch):
    monkeypatch.setattr(turns, "table", lambda *_: convs)
    got = {r["conv_id"]: r for r in turns.op13_turns(spark, "").collect()}
    rows = []
    for conv, turn, role, text in table_of():
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        rows += [(conv, turn, "user" if lot == 4 else role, text)] * (0 if lot == 0 else 2 if lot == 3 else 1)
    want = ordered(rows)
    assert set(got) == {r[0] for r in table_of()} and any(c not in want for c in got)
    for conv, one in got.items():
        plain = [(r[2], r[4]) for r in want.get(conv, [])]
        assert (one["cost"], one["audit"]) == (least_suffixes(plain) if plain else (0, "")), conv
        if len(plain) <= 4:
            assert one["repaired_sha256"] == digest_of(brute_repair(plain)[2] if plain else []), conv
    assert got[200]["truncated"] > 100 and got[200]["duplicate"] > 100


def test_empty_table(convs):
    none = convs.filter("false")
    plans = turns.repairs(none)
    assert plans.count() == turns.repaired_turns(none, plans).count() == turns.repaired_digests(none, plans).count() == 0
