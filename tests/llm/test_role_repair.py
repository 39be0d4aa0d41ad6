import hashlib
import random
import re
import zlib

import pytest

from factloom.llm import role_repair

SPACE = " \t\n\x0b\x0c\r"
#: states of (s?(ua)+)? by hand: nothing, s, u open, pair
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def cheapest(turns):
    """Every sequence of edits, followed as long as its roles can still become legal and it isn't dearer than the best."""
    best = [(4 * len(turns), "D" * len(turns), "")]

    def go(i, state, cost, audit, roles, inserts):
        if cost > best[0][0]:
            return
        if i == len(turns) and state in (0, 3):
            assert re.fullmatch("(s?(ua)+)?", roles)
            best[0] = min(best[0], (cost, audit, roles))
        if inserts < 2:
            for x in "ua":
                if (state, x) in MOVES:
                    go(i, MOVES[state, x], cost + 3, audit + "I", roles + x, inserts + 1)
        if i == len(turns):
            return
        initial, fault = turns[i]
        go(i + 1, state, cost + 4, audit + "D", roles, 0)
        if fault in (1, 2):
            return
        more = 3 if fault == 3 else 0
        if (state, initial) in MOVES:
            go(i + 1, MOVES[state, initial], cost + more, audit + "K", roles + initial, 0)
        for x in "ua":
            if x != initial and (state, x) in MOVES:
                go(i + 1, MOVES[state, x], cost + 3 + more, audit + "R", roles + x, 0)

    go(0, 0, 0, "", "", 0)
    return best[0][:2]


def forward(turns):
    """The same by one pass over the four states, for long conversations."""
    def spread(now):
        for _ in range(4):
            for state, (cost, audit) in list(now.items()):
                for x in "ua":
                    if (to := MOVES.get((state, x))) is not None:
                        now[to] = min(now.get(to, (10**9, "")), (cost + 3, audit + "I"))
        return now

    now = spread({0: (0, "")})
    for initial, fault in turns:
        out = {}
        for state, (cost, audit) in now.items():
            options = [(state, cost + 4, "D")]
            if fault not in (1, 2):
                more = 3 if fault == 3 else 0
                options += [(MOVES.get((state, x)), cost + more + 3 * (x != initial), "K" if x == initial else "R") for x in {initial, "u", "a"}]
            for to, c, letter in options:
                if to is not None:
                    out[to] = min(out.get(to, (10**9, "")), (c, audit + letter))
        now = spread(out)
    return min(now[s] for s in (0, 3) if s in now)


def plain(rows):
    """The whole contract for the rows of one conversation."""
    def text_of(v):
        return " " if v is None else v

    after = []
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, text_of(r[2]), hashlib.sha256(text_of(r[3]).encode()).hexdigest())):
        role, text = text_of(role), text_of(text)
        code = zlib.crc32(f"{text_of(conv)}:{text_of(turn)}".encode()) % 20
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        after += [(turn, role, text)] * {0: 0, 3: 2}.get(code, 1)
    seen, turns = set(), []
    for _, role, text in after:
        bare = text.strip(SPACE)
        fault = 1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0
        seen.add((role, text))
        turns.append((role[:1], fault))
    cost, audit = forward(turns)
    out, state, left = [], 0, iter(after)
    for letter in audit:
        if letter == "I":
            x = next(x for x in "ua" if (state, x) in MOVES)
            out.append(f"{role_repair.ROLES[x]}:")
        else:
            _, role, text = next(left)
            if letter == "D":
                continue
            x = role[:1] if letter == "K" else next(x for x in "ua" if x != role[:1] and (state, x) in MOVES)
            out.append(f"{role if letter == 'K' else role_repair.ROLES[x]}:{text}")
        state = MOVES[state, x]
    when = [t for t, _, _ in after if t is not None]
    faults = [f for _, f in turns]
    pairs = [a + b for (a, _), (b, _) in zip(turns, turns[1:], strict=False)]
    return (
        max(when) - min(when) + 1 - len(set(when)) if when else 0, faults.count(1), faults.count(2), faults.count(3), sum(p not in ("su", "ua", "au") for p in pairs),
        cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
    )


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def same(df):
    rows = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    want = {c: plain([r for r in rows if r[0] == c]) for c in {r[0] for r in rows}}
    got = role_repair.repair(df).collect()
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[c] for c in COLUMNS) == want[r.conv_id], r.conv_id
    return got


def test_cheapest_edits_of_every_short_conversation():
    rng = random.Random(5)
    for _ in range(1500):
        turns = [(rng.choice("uuaastx"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(7))]
        found = role_repair.best(role_repair.parse(turns, 0))
        assert found == cheapest(turns) == forward(turns), turns


def test_pieces_join_to_the_whole():
    rng = random.Random(6)
    for _ in range(200):
        turns = [(rng.choice("uuaas"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(3, 30))]
        cuts = sorted({0, len(turns), *(rng.randrange(len(turns)) for _ in range(3))})
        tops = {0: (0, "")}
        for a, b in zip(cuts, cuts[1:], strict=False):
            tops = role_repair.joined(tops, {v: role_repair.parse(turns[a:b], v) for v in range(len(role_repair.LR.vertices))})
        assert role_repair.best(tops) == forward(turns)


def test_stacks_share_vertices():
    lr = role_repair.LR
    assert len(set(lr.vertices)) == len(lr.vertices) < 20 and lr.accepts(0)
    assert lr.advance(0, "a") is None and lr.advance(0, "x") is None
    v = lr.advance(lr.advance(lr.advance(0, "s"), "u"), "a")
    assert lr.accepts(v) and lr.advance(v, "s") is None and not lr.accepts(lr.advance(v, "u"))


def test_given_table(spark, sf_dir):
    same(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


@pytest.fixture
def odd(spark):
    rng = random.Random(7)
    texts = ["One.", "One.", "two", "Is it?", "", " \n", None, "end ", " ", "a.\x85", "...", "long " * 20_000 + "."]
    rows = [(rng.choice([1, 2, 3, 4, 5, 10**15, None]), rng.choice([None, 0, 1, 2, 3, 5, 9]), rng.choice(["user", "assistant", "system", None, "", "tool", "User", "über"]), rng.choice(texts)) for _ in range(300)]
    rows += rows[:40] + [(100 + k, 0, "user", "Alone.") for k in range(60)]  # some lose their only row
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, copy int, fault string")


def test_odd_rows(odd):
    got = same(odd)
    empty = [r for r in got if r.audit == "" and r.repaired_sha256 == hashlib.sha256(b"").hexdigest()]
    assert empty and all(sum(r[c] for c in COLUMNS[:6]) == 0 for r in empty if r.conv_id >= 100)


def test_empty_table(odd):
    assert role_repair.repair(odd.filter("false")).collect() == []


def test_one_conversation_over_many_tasks(spark):
    """Most rows are one conversation, larger than a piece and than a partition."""
    rng = random.Random(8)
    rows = [(7, k, rng.choice(["user", "assistant", "user", "assistant", "system"]), f"Turn {rng.randrange(3000)}{rng.choice(['.', '', '!'])}") for k in range(2500)]
    rows += [(c, k, "ua"[k % 2].replace("u", "user").replace("a", "assistant"), f"{c} {k}.") for c in range(8, 60) for k in range(4)]
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        same(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(8))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
