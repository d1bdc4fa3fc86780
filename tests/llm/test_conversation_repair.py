"""Conversation repair: every edit script by brute force, blocks of few items, odd rows, and the SQL twin."""

import itertools
import random
import re

import pytest
from compare import compare, connect

from tidemark.llm import conversation_repair as cr
from tidemark.llm import queries

KIND = "conv_id long, turn long, role string, text string, conv string, at int"


def plain(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, lines) by a walk that keeps the best script of each state."""
    rows = sorted(((t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, r, x in rows:
        bare = x.rstrip(cr.BLANKS)
        faults.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    best = {"": (0, "", ())}  # initials so far, as far as they matter -> cost, audit, lines

    def allowed(state, c):
        return {"": "su", "s": "u", "u": "a", "a": "u"}[state].find(c) >= 0 if c else False

    def inserted(options):
        options = dict(options)
        for _ in range(3):
            for s, (c, a, lines) in list(options.items()):
                for name in ("user", "assistant"):
                    if allowed(s, name[0]):
                        options[name[0]] = min(options.get(name[0], (9**9,)), (c + 2, a + "I", (*lines, name + ":")))
        return options

    for (_, r, x), fault in zip(rows, faults):
        after = {}
        for s, (c, a, lines) in [(s, w) for s, w in every(best)]:
            ways = [("D", s, 3, ())]
            if fault not in ("blank", "duplicate"):
                ways += [("R", n[0], 2 + (fault == "truncated"), (f"{n}:{x}",)) for n in ("user", "assistant") if allowed(s, n[0])]
                if allowed(s, r[:1]):
                    ways.append(("K", r[:1], int(fault == "truncated"), (f"{r}:{x}",)))
            for edit, q, cost, line in ways:
                after[q] = min(after.get(q, (9**9,)), (c + cost, a + edit, lines + line))
        best = after
    end = min(w for s, w in every(best) if s in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, end[0], end[1], "\n".join(end[2])


def every(best):
    """All (state, script) reached by any number of inserts, not only the best of each state."""
    for s, (c, a, lines) in best.items():
        state, way = s, (c, a, lines)
        yield state, way
        for _ in range(4):
            name = {"": "user", "s": "user", "u": "assistant", "a": "user"}[state]
            state, way = name[0], (way[0] + 2, way[1] + "I", (*way[2], name + ":"))
            yield state, way


def some_rows(rng, n):
    texts = ["Hi.", "Yes!", "cut off", "", " \n", "What?", None, "ü.", "ends \t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "u2"]
    return [(rng.choice([i, i, i, None, i // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.6 else f"text {i}.") for i in range(n)]


def got(spark, convs, extra=()):
    rows = [(c, t, r, x, "clash", 1) for c, rs in convs.items() for t, r, x in rs]
    turns = spark.createDataFrame(rows, KIND).repartition(3)
    ids = spark.createDataFrame([(c,) for c in (*convs, *extra)], "conv_id long")
    return {r[0]: tuple(r)[1:] for r in cr.report(turns, ids).collect()}, turns


def digest(text):
    import hashlib

    return hashlib.sha256(text.encode()).hexdigest()


def same(found, convs):
    for c, rows in convs.items():
        want = plain(rows)
        assert found[c] == (*want[:7], digest(want[7])), (c, rows, found[c], want)


def test_against_brute_force(spark):
    rng = random.Random(4)
    convs = {i: some_rows(rng, rng.randrange(1, 12)) for i in range(300)} | {None: some_rows(rng, 5)}
    found, turns = got(spark, convs, extra=(999,))
    same(found, convs)
    assert found[999] == (0, 0, 0, 0, 0, 0, "", digest(""))
    whole = cr.repaired_turns(cr.repair(turns)).collect()
    for c in convs:
        lines = [r for r in sorted(whole, key=lambda r: (r.at, r.part)) if r.conv_id == c]
        assert "\n".join(f"{r.role}:{r.text}" for r in lines) == plain(convs[c])[7]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in lines))


def test_long_conversations_over_many_blocks(spark, monkeypatch):
    """Blocks of 8 rows and at most 3 pieces a task: the same repair by several levels of pieces."""
    monkeypatch.setattr(cr, "BLOCK_BITS", 3)
    monkeypatch.setattr(cr, "FAN", 3)
    rng = random.Random(9)
    convs = {1: some_rows(rng, 700), 2: some_rows(rng, 3), 3: some_rows(rng, 90)}
    convs[4] = [(None, "user", "same.")] * 400 + [(i, "user", "same.") for i in range(50)] + [(5, "assistant", "x" * 200_000)]
    same(got(spark, convs)[0], convs)


def test_crossings_equal_a_table_of_all_states():
    rng = random.Random(1)
    for n in (1, 2, 3, 17, 64):
        kinds = [rng.randrange(12) for _ in range(n)]
        transfers = [cr.TRANSFERS[k] for k in kinds]
        states = cr.crossings(transfers, 0, cr.last_state(transfers, 0))
        ways = [cr.STEPS[k][p][q] for k, p, q in zip(kinds, states, states[1:])]
        best = {0: (0, "")}
        for k in kinds:
            best = {q: min((best[p][0] + cr.STEPS[k][p][q][0], best[p][1] + cr.STEPS[k][p][q][1]) for p in best if cr.STEPS[k][p][q]) for q in range(4) if any(cr.STEPS[k][p][q] for p in best)}
        want = min((c + 2 * cr.CLOSING[q], a, q) for q, (c, a) in best.items())
        assert (sum(w[0] for w in ways) + 2 * cr.CLOSING[states[-1]], "".join(w[1] for w in ways), states[-1]) == want


def test_empty(spark):
    assert got(spark, {}, extra=(1,))[0] == {1: (0, 0, 0, 0, 0, 0, "", digest(""))}
    assert got(spark, {})[0] == {}


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_sql_twin(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    df = queries.QUERIES["op11_conversation_repair"](spark, sf_dir)
    assert compare(df.columns, [tuple(r) for r in df.collect()], connect(sf_dir), queries.SQL["op11_conversation_repair"]) == ""
