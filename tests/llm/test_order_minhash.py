"""Order MinHash against a plain version, and its defined cases."""

import hashlib
import random

import regex
import xxhash
from pyspark.sql import functions as F

from rankforge.llm import order_minhash as om

SPACE = "[ \\t\\n\\x0b\\f\\r]"
SYMBOL = regex.compile(rf"{SPACE}*(?:[\p{{L}}\p{{N}}\p{{M}}]{{1,8}}|[^ \t\n\x0b\f\r])|{SPACE}+")


def _hash(values):
    seed = 42
    for v in values:
        data = v.encode() if isinstance(v, str) else v
        seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def _high(h):
    return (h & ((1 << 63) - 1)) >> 28


def plain_fingerprint(text, k=3, length=2, slots=128):
    symbols = SYMBOL.findall(text)
    if not symbols:
        return []
    kmers = [symbols[i : i + k] for i in range(max(len(symbols) - k, 0) + 1)]
    seen, numbered = {}, []
    for at, kmer in enumerate(kmers):
        h = _high(_hash(kmer))
        times = seen.get(h, 0)
        seen[h] = times + 1
        if times:
            h = _high(_hash([h.to_bytes(8, "little"), times.to_bytes(4, "little")]))
        numbered.append((h, at))
    made = []
    shift = 35 - (slots - 1).bit_length()
    for slot in range(slots):
        least = sorted(x for x in numbered if x[0] >> shift == slot)[:length]
        if least:
            words = [w for at in sorted(at for _, at in least) for w in kmers[at]]
            made.append(slot << 32 | _hash(words) & 0xFFFFFFFF)
    return made


def plain_likeness(a, b):
    either = {x >> 32 for x in a} | {x >> 32 for x in b}
    return len(set(a) & set(b)) / len(either) if either else 1.0


def _texts():
    rng = random.Random(3)
    words = ["la", "maison", "Straße", "the", "of", "naïveté", "x", "documentation", "ok.", "a,b"]
    made = ["", None, "one", "one two", "a" * 500, "the the " * 90, "漢字かな" * 40, " \n\t ", "x  y\n\nz!"]
    made += [" ".join(rng.choices(words, k=rng.randint(1, 400))) for _ in range(30)]
    return made + [made[-1], made[-2], made[12]]


def test_against_plain_version(spark):
    texts = _texts()
    rng = random.Random(5)
    ids = rng.sample(range(-50, 10_000), len(texts))
    df = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").repartition(5)
    got = {r["row"]["doc_id"]: r for r in om.fingerprints(df).collect()}
    assert len(got) == len(ids)
    order = sorted(zip(ids, [t or "" for t in texts]), reverse=True)
    for i, (doc, text) in enumerate(order):
        after = order[(i + 1) % len(order)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + after[:half]
        row = got[doc]
        own, other, follow = map(plain_fingerprint, (text, edit, after))
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edit.encode()).hexdigest()
        assert row["fingerprint"] == "".join(f"{s:010x}" for s in own)
        assert row["edited_fingerprint"] == "".join(f"{s:010x}" for s in other)
        assert abs(row["near_edited"] - plain_likeness(own, other)) < 1e-12
        assert abs(row["near_next"] - plain_likeness(own, follow)) < 1e-12


def test_order_of_equal_kmers_matters(spark):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(300)]
    blocks = [words[i : i + 10] for i in range(0, 300, 10)]
    rng.shuffle(blocks)
    df = spark.createDataFrame([(" ".join(words), " ".join(sum(blocks, [])), " ".join(words[:290]))], "a string, b string, c string")
    prints = df.select(*[om.fingerprint(F.col(c)).alias(c) for c in "abc"])
    moved, cut = prints.select(om.likeness(F.col("a"), F.col("b")), om.likeness(F.col("a"), F.col("c"))).first()
    assert moved < cut and cut > 0.75


def test_defined_cases(spark):
    empty = om.fingerprints(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0
    one = om.fingerprints(spark.createDataFrame([(7, "alone here")], "doc_id long, text string")).first()
    assert one["near_next"] == 1.0  # the only document follows itself
    # clashing columns, rows without an id, repeated rows
    rows = [(1, "a b c d", 5), (1, "a b c d", 5), (None, "a b c d", 6), (None, None, 7), (2, None, 8)]
    df = spark.createDataFrame(rows, "doc_id int, text string, stretch int")
    got = om.fingerprints(df, ["doc_id", "stretch"]).collect()
    assert sorted((r["row"]["doc_id"] or -1, r["row"]["stretch"]) for r in got) == [(-1, 6), (-1, 7), (1, 5), (1, 5), (2, 8)]
    assert len({r["fingerprint"] for r in got}) == 2
    none = om.fingerprints(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert len(none) == 1 and none[0]["near_next"] == 1.0


def test_stretches_join(spark):
    """Many stretches, skewed ids: every row meets the next id."""
    rng = random.Random(1)
    ids = sorted({*range(700), *(rng.randrange(10**12) for _ in range(300))}, reverse=True)
    df = spark.createDataFrame([(i, f"t{i} " * 4) for i in ids], "doc_id long, text string").repartition(7)
    got = {r["row"]["doc_id"]: r["edited_sha256"] for r in om.fingerprints(df).collect()}
    for i, follow in zip(ids, ids[1:] + ids[:1]):
        text, after = f"t{i} " * 4, f"t{follow} " * 4
        half = len(text) // 2
        assert got[i] == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
