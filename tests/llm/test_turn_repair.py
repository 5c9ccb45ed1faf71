"""Turn repair against the search of all edits, and its defined cases."""

import functools
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from rankforge.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        out.append("b" if not said else "d" if (role, text) in seen else "t" if said[-1] not in ".!?" else "o")
        seen.add((role, text))
    return out


def plain(rows):
    """(cost, audit, repaired turns) by trying every edit at every place."""
    found = faults(rows)
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    @functools.cache
    def best(i, last, inserts):
        options = [(0, "", ())] if i == len(rows) and last in ("", "a") else []
        if inserts < 3:
            for r in set(follow[last]) - {"s"}:
                c, a, t = best(i, r, inserts + 1)
                options.append((c + 3, "I" + a, ((name[r], ""), *t)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, t = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, t))
            extra = 3 * (found[i] == "t")
            if found[i] not in "bd":
                if role[:1] and role[:1] in follow[last]:
                    c, a, t = best(i + 1, role[:1], 0)
                    options.append((c + extra, "K" + a, ((role, text), *t)))
                for r in set(follow[last]) - {"s"}:
                    c, a, t = best(i + 1, r, 0)
                    options.append((c + extra + 3, "R" + a, ((name[r], text), *t)))
        return min(options, key=lambda o: o[:2], default=(10**9, "", ()))

    return best(0, "", 0)


def expected(rows):
    """The report of one conversation of (turn, role, text) rows."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]))
    found = faults(rows)
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, audit, said = plain(tuple(rows))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in said).encode()).hexdigest()
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(found.count(f) for f in "bdt"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, digest), said


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    roles = ["user", "assistant", "user", "assistant", "system", "umpire", "tool", "", None]
    texts = ["Fine.", "Yes!", "cut off", "Why?\n", "", " \t", "x", None, "end. \x0b"]
    convs = {c: [(rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)) for _ in range(rng.randint(0, 9))] for c in range(400)}
    convs[-5] = [(i, "assistant", f"a{i}.") for i in range(8)]
    convs[None] = [(0, "system", "s."), (1, "user", "u."), (2, "assistant", "a.")]
    return {c: rows for c, rows in convs.items() if rows}


def _frame(spark, convs):
    rows = [(c, *r) for c, rs in convs.items() for r in rs]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def test_against_all_edits(spark, made):
    df = _frame(spark, made).withColumn("phase", F.lit("x")).repartition(6)
    got = {r[0]: tuple(r[1:]) for r in tr.report(df).collect()}
    assert got == {c: expected(rows)[0] for c, rows in made.items()}
    turns = {}
    for r in sorted(tr.repaired(df).collect(), key=lambda r: r["turn"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: list(said) for c, rows in made.items() if (said := expected(rows)[1])}


def test_giant_conversation_spills(spark):
    rng = random.Random(8)
    rows = [(i // 2, rng.choice(["user", "assistant"]), rng.choice(["yes.", f"t{i}.", f"cut {i}"])) for i in range(30_000)]
    df = _frame(spark, {1: rows, 2: rows[:3]})
    in_memory = sorted(map(tuple, tr.report(df).collect()))
    spilled = sorted(map(tuple, tr.report(df, held=1_000).collect()))
    assert in_memory == spilled and in_memory[0][6] > 0 and len(in_memory[0][7]) >= 30_000
    assert tr.repaired(df, held=1_000).count() == sum(len(r[7].replace("D", "")) for r in in_memory)


def test_trail_returns_its_bytes_in_reverse():
    trail = tr._Trail(held=7)
    for i in range(100):
        trail.push(i)
    assert [trail.pop() for _ in range(100)] == list(range(99, -1, -1))
    trail.close()


def test_damage_and_empty_tables(spark):
    rows = [(c, t, r, x) for c in range(40) for t in range(5) for r, x in [("user", "Is it? Yes.")]] + [(None, None, None, None), (None, 3, "a", "b.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("gone", F.lit("x")).withColumn("copy", F.lit(1))
    done = tr.damage(df).collect()
    import zlib

    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        kind = zlib.crc32(key.encode()) % 20
        own = [(r["role"], r["text"], r["gone"]) for r in done if (r["conv_id"], r["turn"]) == (c, t)]
        role, text = role or " ", text if text is not None else " "
        text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
        assert own == [("user" if kind == 4 else role, text, kind == 0)] * (2 if kind == 3 else 1)
    # every conversation is reported, also one that lost all its turns
    only = spark.createDataFrame([(c, 0, "user", "Hi.") for c in range(200)], SCHEMA)
    got = {r["conv_id"]: r for r in tr.report(tr.damage(only)).collect()}
    assert set(got) == set(range(200))
    lost = [c for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert lost and all(tuple(got[c])[1:] == (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in lost)
    none = only.filter("false")
    assert tr.report(none).count() == tr.repaired(none).count() == tr.report(tr.damage(none)).count() == 0
