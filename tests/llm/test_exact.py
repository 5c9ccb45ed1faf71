"""Operators against brute force, SQL or held-out accuracy on the smallest tables."""

import collections
import math
import random
import re
import sys
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))

from check_oracles import TABLES, compare
from rankforge.llm import ORACLE, QUERIES, html_text, language_model, near_dedup, pieces, pii, quality, sharding, words
from rankforge.llm.queries import MODEL_PATH


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, duck, sf, name):
    df, rel = QUERIES[name](spark, sf), duck.sql(ORACLE[name])
    assert compare(df.columns, [tuple(r) for r in df.collect()], rel.columns, rel.fetchall()) is None


def test_one_query_per_operator():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 14))


# words


def test_word_blocks_split_like_bytes():
    import pyarrow as pa

    r = random.Random(1)
    made = ["".join(r.choice("aBé \t\n.x\x0b\x0c\r\x1c") for _ in range(r.randint(0, 40))) for _ in range(500)] + [None, ""]
    seen = {}
    for block in words.blocks(pa.array(made), words.SPACE, 2000):
        hashes = block.hashes()
        for i in range(len(block)):
            span = range(block.first[i], block.first[i + 1])
            got = [block.word(j) for j in span]
            assert got == (made[block.first_row + i] or "").encode().lower().split()
            for j, word in zip(span, got):
                assert seen.setdefault(word, hashes[j]) == hashes[j]
    assert len(set(map(int, seen.values()))) == len(seen)


# 1: personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and pii.luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_follow_the_patterns(texts):
    r = random.Random(3)
    parts = ["a", "B", "1", "23", "456", "1234", "+", "-", " ", ".", "@", "(", ")", "x.y", "é", "0", "4111111111111111"]
    made = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(5000)] + list(texts.values())
    for text in made:
        assert [m[:3] for m in pii.base_matches(text) if m[3]] == plain_spans(text)


def test_model_keeps_base_spans_and_adds_secrets(spark, duck):
    folder = "/root/testdata/sf0.01"
    texts = dict(duck.sql(f"select doc_id, text from '{folder}/documents.parquet'").fetchall())
    got = QUERIES["op1_pii"](spark, folder).collect()
    added = 0
    for r in got:
        base = [f"{k}:{s}:{e}" for k, s, e in plain_spans(texts[r.doc_id])]
        spans = r.spans.split(",") if r.spans else []
        assert [s for s in spans if s in base] == base
        added += len(spans) - len(base)
    assert added > 0


# 2: near duplicates


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by_shingle = collections.defaultdict(set)
    for i in sorted(sets):
        for j in set().union(*(by_shingle[s] for s in sets[i])) if sets[i] else ():
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
        for s in sets[i]:
            by_shingle[s].add(i)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark, sf, texts):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op2_near_dedup"](spark, sf).collect()}
    assert got == brute_components(texts)


def test_family_of_near_copies_is_linked_exactly(spark):
    """A base text with many random edits: some pairs link, some only through others, some not."""
    r = random.Random(8)
    base = [f"w{i}" for i in range(80)]
    texts = {0: " ".join(base)}
    for i in range(1, 400):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts[i] = " ".join(w)
    for i in range(400, 600):  # a shared passage, but no copies
        texts[i] = " ".join(base[:40] + [f"y{r.randrange(10**6)}" for _ in range(40)])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_estimate_is_close_and_corrected():
    r = np.random.default_rng(4)
    for both, each in ((600, 100), (100, 300), (0, 500)):
        sets = r.integers(0, 2**64, both + 2 * each, dtype=np.uint64)
        a, b = np.sort(sets[: both + each]), np.sort(np.concatenate([sets[:both], sets[both + each :]]))
        x, y = (near_dedup.compress(*near_dedup.registers(s))[None] for s in (a, b))
        got = near_dedup.estimate(x, y, len(a), len(b))[0][0]
        assert abs(got - both / (both + 2 * each)) < 0.15
    assert 0 < near_dedup.chance(100, 100) < 1e-8


# 3: language model


def test_scores_match_a_plain_backoff_model(spark, sf, texts):
    got = {r.doc_id: r for r in QUERIES["op3_lm_score"](spark, sf).collect()}
    tok = {i: (t or "").encode().lower().split() + [None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tok}
    train = [tok[i] for i in tok if not held[i]]
    one = collections.Counter(w for t in train for w in t)
    n, v = sum(one.values()), len(one)
    two = collections.Counter(p for t in train for p in zip(t, t[1:]))
    three = collections.Counter(p for t in train for p in zip(t, t[1:], t[2:]))
    after, after2 = collections.defaultdict(list), collections.defaultdict(list)
    for (u, _), c in two.items():
        after[u].append(c)
    for (u, w, _), c in three.items():
        after2[u, w].append(c)

    def p1(w):
        return (one.get(w, 0) + 0.5) / (n + 0.5 * (v + 1))

    def shared(counts, count, lower):
        return (max(count - 0.5, 0) + 0.5 * len(counts) * lower) / sum(counts)

    def p2(u, w):
        return shared(after[u], two[u, w], p1(w)) if u in after else p1(w)

    def p3(u, v, w):
        return shared(after2[u, v], three[u, v, w], p2(v, w)) if (u, v) in after2 else p2(v, w)

    for p in list(after2)[:3]:
        assert sum(p3(*p, w) for w in one) + p3(*p, b"\0") == pytest.approx(1)
    for i, t in tok.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(w in one for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10(p1(w)) for w in t), abs=1e-6)
        steps = [p3(t[j - 2], t[j - 1], w) if j > 1 else p2(t[0], w) if j else p1(w) for j, w in enumerate(t)]
        assert r.score == pytest.approx(sum(map(math.log10, steps)), abs=1e-6)


def test_state_is_the_longest_known_history():
    """One traversal, stretch by stretch: after each token the longest suffix the model goes on from."""
    r = random.Random(6)
    texts = [" ".join(r.choices("abcdefgh", k=r.randint(0, 60))) for _ in range(30)]
    train = [r.random() < 0.4 for _ in texts]
    data, bounds = words.columns(__import__("pyarrow").array(texts))
    hashes, first = language_model._tokens(data, bounds - bounds[0])
    grams = dict(language_model._block_grams(hashes, first, 3))
    tok = [t.split() + [None] for t in texts]
    follow = collections.defaultdict(collections.Counter)
    for t, known in zip(tok, train):
        for n in (1, 2):
            for i in range(len(t) - n if known else 0):
                follow[tuple(t[i : i + n])][t[i + n]] += 1
    flat = [(t, i) for t in tok for i in range(len(t))]
    answers = {1: np.zeros((3, len(grams[1].at)))}
    seen = collections.Counter(w for t, known in zip(tok, train) if known for w in t)
    answers[1][0] = [seen[t[i]] for t, i in (flat[a] for a in grams[1].at)]
    for n in (2, 3):
        rows = [(follow[tuple(t[i : i + n - 1])], t[i + n - 1]) for t, i in (flat[a] for a in grams[n].at)]
        answers[n] = np.array([[c[w], sum(c.values()), len(c)] for c, w in rows]).T.reshape(3, -1)
    automaton = language_model.Automaton(grams, answers, len(hashes), sum(seen.values()) + 0.5 * (len(seen) + 1))
    for stretch in (3, 1000):
        _, states = automaton.read(grams[1].of, first, stretch)
        for at, (t, i) in enumerate(flat):
            if t[i] is None:
                continue
            if i and follow.get((t[i - 1], t[i])):
                assert states[at] == 1 + automaton.n_words + {p: g for p, g in zip(grams[2].places, grams[2].of)}[at - 1]
            elif follow.get((t[i],)):
                assert states[at] == 1 + grams[1].of[at]
            else:
                assert states[at] == 0


# 5: main text


def test_article_text_is_whole(duck):
    for page, html in duck.sql("select page_id, html from pages").fetchall():
        inner = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        inner = re.sub(r"<[^>]*>", " ", re.sub(r"</?(b|i|em|a|strong|span)\b[^>]*>", "", inner))
        assert html_text.main_text(html) == " ".join(html_text.entities.unescape(inner).split()), page


def test_boilerplate_goes_and_neighbours_decide():
    prose = "the cat of the house and the dog in the garden that it was with us for a long time and by the sea"
    page = (
        f"<body><div class='cookie-notice'><p>{prose}</p></div><div id='sidebar'><p>{prose}</p></div><ul><li><a href=x>Home</a></ul>"
        f"<h1>Title</h1><p>{prose}</p><p>Short.</p><p>{prose} &amp; more&nbsp;text</p><form>{prose}</form>"
        f"<div class=comments><p>{prose}</p></div><p>Late</p><footer>{prose}</footer><!-- {prose} --><script>'{prose}'</script>"
    )
    assert html_text.main_text(page) == f"Title {prose} Short. {prose} & more text"


# 6: sampled segmentations


def test_samples_follow_the_lattice_distribution():
    v = pieces.Vocabulary(MODEL_PATH)
    text, n = "there", 20_000
    lattice, found = pieces.sample_block([text] * n, np.arange(n), v, 2)

    def every(node, path, log_p):
        if node == len(text):
            yield tuple(path), log_p
        else:
            for a in range(lattice.arc_first[node], lattice.arc_first[node + 1]):
                yield from every(node + lattice.width[a], [*path, a], log_p + lattice.log_p[a])

    p = {path: math.exp(x) for path, x in every(0, [], 0.0)}
    assert sum(p.values()) == pytest.approx(1)
    first = collections.Counter(tuple(s[0][0].tolist()) for s in found)
    second = collections.Counter(tuple(s[1][0].tolist()) for s in found)
    for path, x in p.items():
        assert first[path] / n == pytest.approx(x, abs=0.02)
        assert second[path] / n == pytest.approx(sum(p[q] * x / (1 - p[q]) for q in p if q != path), abs=0.02)
    # weighted by inclusion, the samples estimate the whole distribution's mass
    assert np.mean([sum(math.exp(s[1] - s[3]) for s in rows) for rows in found]) == pytest.approx(1, abs=0.05)


def test_samples_are_distinct_and_decode(spark, sf):
    got = QUERIES["op6_sentencepiece"](spark, sf).collect()
    assert all(r.round_trip for r in got)
    assert len({(r.doc_id, r.ids_hash) for r in got}) == len(got)
    again = QUERIES["op6_sentencepiece"](spark.newSession(), sf).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


# 7: shards


def greedy_best(sizes, shards):
    low, high = max(-(-sum(sizes) // shards), max(sizes)), sum(sizes)
    while low < high:
        middle, n, at = (low + high) // 2, 1, 0
        for s in sizes:
            if at + s > middle:
                n, at = n + 1, 0
            at += s
        low, high = (low, middle) if n <= shards else (middle + 1, high)
    return low


def test_capacity_search_is_exact_under_refinement(spark, monkeypatch):
    r = random.Random(5)
    groups = sorted((r.randrange(-(2**63), 2**63), r.choice([1, 100, r.randint(1, 10**6)])) for _ in range(3000))
    monkeypatch.setattr(sharding, "FIRST_BITS", 4)
    borders = [b for b in sharding.minimax_borders(spark.createDataFrame(groups, "h long, bytes long")) if b is not None]
    load = collections.Counter()
    for h, size in groups:
        load[sum(h >= b for b in borders)] += size
    assert max(load) < 16 and max(load.values()) == greedy_best([s for _, s in groups], 16)


def test_shards_cover_all_rows(spark, sf, texts):
    got = QUERIES["op7_sharding"](spark, sf).collect()
    assert len(got) == len(texts)
    shard_of = collections.defaultdict(set)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        shard_of[raw].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())


# 9: quality


def test_quality_agrees_with_the_labels(spark, duck):
    folder = "/root/testdata/sf0.01"
    kept = {r.doc_id: r.kept for r in QUERIES["op9_quality"](spark, folder).collect()}
    labels = duck.sql(f"select doc_id, quality from '{folder}/labels.parquet'").fetchall()
    good, bad = [kept[i] for i, q in labels if q], [kept[i] for i, q in labels if not q]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_em_weighs_labellers_by_agreement():
    r = random.Random(2)
    rows = []
    for _ in range(5000):
        good = r.random() < 0.8
        rows.append([quality.ABSTAIN if good or r.random() < 0.5 else quality.BAD for _ in quality.LABELLERS])
    codes, counts = np.unique(quality._pattern(np.array(rows)), return_counts=True)
    model = quality.LabelModel(codes, counts)
    assert model.share == pytest.approx(0.8, abs=0.03)


def test_label_model_against_plain_em():
    """Pattern counts give what expectation and maximisation over single documents give."""
    r = random.Random(12)
    votes = [[r.choice((quality.ABSTAIN, quality.GOOD, quality.BAD)) if r.random() < 0.6 else quality.GOOD for _ in quality.LABELLERS] for _ in range(400)]
    codes, counts = np.unique(quality._pattern(np.array(votes)), return_counts=True)
    model = quality.LabelModel(codes, counts)
    p = [0.1 if quality.BAD in v else 0.9 for v in votes]
    for _ in range(100):
        share = (sum(p) + 1) / (len(p) + 2)
        of = []
        for q in (p, [1 - x for x in p]):
            of.append([[(sum(x for x, v in zip(q, votes) if v[j] == k) + 1) / (sum(q) + 3) for j in range(len(v))] for k, v in [(k, votes[0]) for k in range(3)]])
        for j in range(len(votes[0])):
            bad = sum(v[j] == quality.BAD for v in votes)
            good_rate = min(of[0][quality.BAD][j], (1 - quality.TRUST) * bad / (share * len(p)) + 1e-9)
            bad_rate = min(max((bad - good_rate * share * len(p)) / ((1 - share) * len(p)), 1e-9), 0.99)
            for side, rate in ((0, good_rate), (1, bad_rate)):
                rest = of[side][quality.ABSTAIN][j] + of[side][quality.GOOD][j]
                for k in (quality.ABSTAIN, quality.GOOD):
                    of[side][k][j] *= (1 - rate) / rest
                of[side][quality.BAD][j] = rate
        new = []
        for v in votes:
            odds = math.log(share / (1 - share)) + sum(math.log(of[0][k][j] / of[1][k][j]) for j, k in enumerate(v))
            new.append(1 / (1 + math.exp(-max(-30, min(30, odds)))))
        done = max(abs(a - b) for a, b in zip(new, p)) < 1e-9
        if done:
            break
        p = new
    got = model.posterior(quality._pattern(np.array(votes)))
    assert np.allclose(got, new, atol=1e-6)


def test_pieces_are_looked_up_only_where_one_begins(monkeypatch):
    v, asked = pieces.Vocabulary(MODEL_PATH), []
    find = pieces.Vocabulary.find
    monkeypatch.setattr(pieces.Vocabulary, "find", lambda self, hashes: (asked.append(hashes), find(self, hashes))[1])
    text = "the cat sat\u2581 on \U0001f600 a xylophonist's mat \u4f60\u597d"
    codes = pieces._codes(text)
    codes = np.where(codes == pieces.SPACE, pieces.LITERAL, np.where(codes == 32, pieces.SPACE, codes))
    lattice = pieces.Lattice(codes, np.array([0, len(codes)]), v)
    assert asked and all(v.begins[h >> np.uint64(43)].all() for h in asked)
    # the arcs are those of a plain search, long ones first, and byte arcs where no piece stands for a character
    names = {v.text[v.text_at[i] : v.text_at[i + 1]].tobytes().decode(): i for i in v.ids.tolist()}
    found, expected = {}, {}
    for word, (a, b) in zip(lattice.word, zip(lattice.begin[:-1], lattice.begin[1:])):
        plain = "".join(" " if c == pieces.SPACE else "\0" if c == pieces.LITERAL else chr(c) for c in codes[a:b])
        for i in range(len(plain)):
            node = lattice.first[word] + i
            arcs = np.arange(lattice.arc_first[node], lattice.arc_first[node + 1])
            found[a + i] = [(int(lattice.width[x]), int(lattice.piece[x]) < len(v.ids) and int(v.ids[lattice.piece[x]])) for x in arcs]
            held = [(n, names[plain[i : i + n]]) for n in range(len(plain) - i, 0, -1) if plain[i : i + n] in names]
            expected[a + i] = held if any(n == 1 for n, _ in held) else [*held, (1, False)]
    assert found == expected
