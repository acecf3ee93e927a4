import hashlib
import itertools
import random
import re
import zlib

import pytest

from lumiflow.llm import conversation_repair as cr

GOAL = re.compile(r"(s?(ua)+)?")


def search(rows):
    """(cost, audit, lines) of the cheapest edits of (initial, role, text, fault), by trying all edits with up to two inserts between rows."""
    best = None
    inserts = ["", "u", "a", "ua", "au"]

    def go(i, cost, audit, lines, roles):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        for ins in inserts:
            c, a = cost + 3 * len(ins), audit + "I" * len(ins)
            ls, rs = lines + [f"{cr.NAMES[x]}:" for x in ins], roles + ins
            if i == len(rows):
                if GOAL.fullmatch(rs):
                    best = min(best or (c, a, ls), (c, a, ls))
                continue
            initial, role, text, fault = rows[i]
            more = 3 if fault == 3 else 0
            go(i + 1, c + 4, a + "D", ls, rs)
            if fault in (0, 3):
                go(i + 1, c + more, a + "K", ls + [f"{role}:{text}"], rs + (initial or "?"))
                for x, name in cr.NAMES.items():
                    go(i + 1, c + more + 3, a + "R", ls + [f"{name}:{text}"], rs + x)

    go(0, 0, "", [], "")
    return best


def reference(rows):
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, hash) of (conv, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if h:
                text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
                own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in own:
            words = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 1 if not words else 2 if (role, text) in seen else 3 if words[-1] not in ".!?" else 0
            seen.add((role, text))
            marked.append((role[:1], role, text, fault))
        cost, audit, lines = search(marked)
        turns = {r[0] for r in own if r[0] is not None}
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(marked))
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(m[3] == k for m in marked) for k in (1, 2, 3)), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed=3, n=60):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(0, 6)):
            role = rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", None])
            text = rng.choice(["Well.", "Yes!", "no end", " \n", "", None, "Well. ", f"Text {rng.randint(0, 99)}?"])
            rows += [(conv, rng.choice([turn, turn, turn, None, turn + 3]), role, text)] * rng.choice([1, 1, 1, 2])
    return [*rows, (None, 0, "user", "Null conversation."), (None, None, "assistant", "Fine.")]


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def table(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("fault", "block", "part", "open", "dropped", "state", "audit")})


def results(df):
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def test_brute_force(spark):
    rows = conversations()
    assert results(cr.repaired_conversations(table(spark, rows))) == reference(rows)


@pytest.mark.parametrize("block", [1, 2, 512])
def test_blocks_give_the_same(spark, monkeypatch, block):
    """Every conversation by blocks, cut anywhere."""
    monkeypatch.setattr(cr, "BLOCK", block)
    rows = conversations(4, 40)
    d = table(spark, rows).select("conv_id", "turn", "role", "text")
    assert results(cr._open(cr.damaged(d), d.select("conv_id").distinct())) == reference(rows)


def test_joined_blocks_equal_one_agenda():
    rng = random.Random(1)
    for _ in range(200):
        codes = "".join(rng.choice("suaxdSUAX") for _ in range(rng.randint(0, 12)))
        k = rng.randint(1, 4)
        parts = [cr.spans(codes[i : i + k]) for i in range(0, len(codes), k)]
        assert cr.lightest(parts) == cr.repair(codes)


def test_ties_are_least_in_ascii():
    # a lone user row: an answer inserted (3) is cheaper than its deletion (4)
    assert cr.repair("u") == (3, "KI")
    # two users: an insert between them and one behind (6), or the second made an answer (3)
    assert cr.repair("uu") == (3, "KR")
    assert cr.repair("d") == (4, "D")
    assert cr.repair("") == (0, "")
    # after an answer alone, a question before it (3) beats its deletion
    assert cr.repair("a") == (3, "IK")


def test_one_long_conversation(spark):
    """A conversation over all ranges: as many rows as a window could not hold, derived by blocks."""
    rows = [(7, i, "user" if i % 2 == 0 else "assistant", f"Line {i}.") for i in range(4000)] + [(8, 0, "user", "Hello."), (8, 1, "assistant", "Yes.")]
    got = results(cr.repaired_conversations(table(spark, rows)))
    kept = [r for r in rows if r[0] == 7 and zlib.crc32(f"7:{r[1]}".encode()) % 20]
    assert got[7][0] == max(r[1] for r in kept) - min(r[1] for r in kept) + 1 - len(kept)
    codes, seen = [], set()
    for _, turn, role, text in kept:
        h = zlib.crc32(f"7:{turn}".encode()) % 20
        role, text = "user" if h == 4 else role, "" if h == 1 else text.replace(".", "") if h == 2 else text
        codes += [cr._code(role[0], 1 if h == 1 else 3 if h == 2 else 0)] + (["d"] if h == 3 else [])
        seen.add(text)
    assert got[7][5:7] == min(cr.agenda("".join(codes), cr.START, cr.GOALS, True).values())


def test_empty(spark):
    assert cr.repaired_conversations(table(spark, conversations()).limit(0)).count() == 0
