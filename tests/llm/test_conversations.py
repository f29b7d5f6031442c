import hashlib
import random
import re
import zlib
from itertools import product

import duckdb
import pytest

from millrace.llm import conversations
from millrace.llm.conversations import audits, damaged, digests, op13_conversations, replayed, signatures, solve
from millrace.llm.oracles import OP13
from millrace.llm.scratch import Scratch

SPACE = " \t\n\v\f\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        fault = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(conv, turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return out


def plain(rows):
    """Every conversation, by trying all edits with up to two insertions before each row and at the end."""
    found = {}
    for conv in {r[0] for r in rows}:
        held = sorted((r[1:] for r in damage([r for r in rows if r[0] == conv])), key=lambda r: (r[0] is not None, r[0] or 0, r[1], conversations_key(r)))
        seen, kinds = set(), []
        for _, role, text in held:
            kinds.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "fine" if text.rstrip(SPACE)[-1] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [r[0] for r in held if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
        best = None
        gap = [list(zip(x)) for n in range(3) for x in product(("user", "assistant"), repeat=n)]
        for edits in product("DKrR", repeat=len(held)):
            if any(k in ("blank", "duplicate") and e != "D" for k, e in zip(kinds, edits)):
                continue
            base = sum({"D": 3, "K": 0, "r": 2, "R": 2}[e] + (k == "truncated" and e != "D") for k, e in zip(kinds, edits))
            if best and base > best[0]:
                continue
            for ins in product(gap, repeat=len(held) + 1):
                cost = base + 2 * sum(map(len, ins))
                if best and cost > best[0]:
                    continue
                out, audit = [], ""
                for i in range(len(held) + 1):
                    out += [(x[0], "") for x in ins[i]]
                    audit += "I" * len(ins[i])
                    if i < len(held):
                        audit += edits[i].upper()
                        if edits[i] != "D":
                            out.append(({"K": held[i][1], "r": "user", "R": "assistant"}[edits[i]], held[i][2]))
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                    best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
        n = lambda k: kinds.count(k)
        found[conv] = (gaps, n("blank"), n("duplicate"), n("truncated"), illegal, best[0], best[1], hashlib.sha256(best[2].encode()).hexdigest())
    return found


def conversations_key(row):
    _, role, text = row
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


NAMES = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def found(spark, rows, extra=()):
    df = spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string" + ", audit int" * len(extra))
    d, scratch = damaged(df), Scratch(spark, "test")
    got = digests(d, scratch.save(audits(d, scratch), "audits"))
    return {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got.collect()}, d


def made(seed, n):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "half", "  ", "", None, "end. \n", "x.\t"]
    return [(r.choice([None, *range(n)]), r.choice([None, 0, 1, 2, 5]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None]), r.choice(texts)) for _ in range(2 * n)]


def test_like_trying_all_edits(spark):
    rows = [r for seed in range(3) for r in [(x[0] if x[0] is None else x[0] + 1000 * seed, *x[1:]) for x in made(seed, 40)]]
    small = {c for c in {r[0] for r in rows} if len(damage([r for r in rows if r[0] == c])) <= 3}
    rows = [r for r in rows if r[0] in small]
    got, _ = found(spark, rows, (7,))
    assert len(got) > 60 and got == plain(rows)


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_of_any_size_give_the_same(spark, block, monkeypatch):
    r = random.Random(block)
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool"]), r.choice(["A.", "B.", "C", "D?", ""])) for c in range(6) for t in range(40)]
    want, _ = found(spark, rows)
    coded = signatures(damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    monkeypatch.setattr(conversations, "BLOCK", block)
    pieces = [len(x.signature) for x in coded.select("signature").collect()]
    assert max(pieces) <= 256
    whole = {}
    for x in sorted(coded.collect(), key=lambda x: (x.conv_id, x.turn, x.role, x.same, x.piece)):
        whole[x.conv_id] = whole.get(x.conv_id, "") + x.signature
    for conv, signature in whole.items():
        ways = [(0, "")] + [None] * 3
        for i in range(0, len(signature), block):
            table = [solve(signature[i : i + block], s) for s in range(4)]
            ways = [min(((w[0] + table[s][end][0], w[1] + table[s][end][1]) for s, w in enumerate(ways) if w and table[s][end]), default=None) for end in range(4)]
        cost, audit = min((w[0] + 2 * len(conversations.TAIL[e]), w[1] + conversations.TAIL[e]) for e, w in enumerate(ways) if w)
        assert (cost, audit) == want[conv][5:7]


def test_long_and_repeated(spark):
    rows = [(1, 4, "user", "Same.")] * 900 + [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(1500)] + [(3, 0, "user", "x" * 200_000 + ".")]
    got, d = found(spark, rows)
    n = len(damage(rows[:900]))
    assert got[1][2] == n - 1 and got[1][6].count("D") == n - 1 and got[1][5] == 3 * (n - 1) + 2
    scratch = Scratch(spark, "test")
    out = replayed(d, scratch.save(audits(d, scratch), "audits")).orderBy("conv_id", "place").collect()
    for conv in (1, 2, 3):
        mine = [x for x in out if x.conv_id == conv]
        assert [x.place for x in mine] == list(range(len(mine)))
        assert hashlib.sha256("\n".join(f"{x.role}:{x.text}" for x in mine).encode()).hexdigest() == got[conv][7]
        assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in mine))


def test_conversations_of_many_blocks_are_folded(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["system", "user", "assistant", "tool"]), r.choice(["A.", "B.", "", f"{t}", f"{t}."])) for c in range(3) for t in range(700)]
    got, d = found(spark, rows)
    coded = {}
    for x in sorted(signatures(d).collect(), key=lambda x: (x.conv_id, x.turn, x.role, x.same, x.piece)):
        coded[x.conv_id] = coded.get(x.conv_id, "") + x.signature
    for conv, signature in coded.items():
        assert len(signature) > 512
        ways = {0: (0, "")}
        for row in signature:
            new = {}
            for state, (cost, audit) in ways.items():
                for end, way in enumerate(solve(row, state)):
                    if way:
                        new[end] = min(new.get(end, (10**9, "")), (cost + way[0], audit + way[1]))
            ways = new
        assert min((c + 2 * len(conversations.TAIL[e]), a + conversations.TAIL[e]) for e, (c, a) in ways.items()) == got[conv][5:7]
        assert sum(x in "0123" for x in signature) == got[conv][1] and sum(x in "4567" for x in signature) == got[conv][2]


def test_empty_table(spark):
    assert found(spark, [])[0] == {}


def test_like_sql(spark):
    c = duckdb.connect()
    c.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    cursor = c.execute(OP13)
    names = [x[0] for x in cursor.description]
    got = op13_conversations(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, got.select(names).collect())) == sorted(cursor.fetchall())
