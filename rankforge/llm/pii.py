"""Personal data in texts: candidate spans, boosted trees, calibrated thresholds.

Rules give the base spans of four kinds (email, ip, card, phone); they always
stay. Generators of high recall propose further, overlapping spans: secrets
after a key word, grouped numbers, dotted numbers, spelled-out addresses, long
codes. Boosted trees score each candidate from its format and its context; the
score is calibrated on held-out rows, and a candidate is added when its
probability reaches the threshold and it overlaps nothing more probable.

The trees are trained here, on the candidates of about ``SAMPLE_DOCS``
documents chosen by a hash of their text; equal candidates in equal context
count once, and of more than ``SAMPLE_ROWS`` of them a share chosen by their
hash is taken. Secrets and codes are proposed whole, however long. No labels exist, so rules label the
candidates: a validated base span, a card or phone number written the usual way
or a keyed secret with digits and letters mixed is positive; what has the shape but fails its check, and plain numbers
and words, are negative. Everything but that fit covers all rows.

Offsets are code points, ends exclusive. Defined cases: null texts have no
spans; a table without positive or negative candidates adds none; repeated rows
are treated alike.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.llm import boosting
from rankforge.llm.rows import with_report
from rankforge.llm.store import Scratch

KINDS = ["email", "ip", "card", "phone", "secret"]
SAMPLE_DOCS = 20_000
SAMPLE_ROWS = 200_000
EXAMPLES = 4_000
THRESHOLD = 0.95
FIELDS = (
    "n_email long, n_ip long, n_card long, n_phone long, base string,"
    " spans array<struct<kind:string,start:long,end:long>>"
)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# the looks back keep a start inside a run of digits from being tried: it could
# match only where the run's own start did
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")

_SECRET = re.compile(
    r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|key|auth)\b)[ \t]{0,4}[=:][ \t]{0,4}[\"']?([A-Za-z0-9+/=_-]{6,}+)"
)
# numbers written the usual way: they stand out where the base patterns run two into one
_USUAL_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3}[ .-]?[0-9]{3,4}(?![0-9])")
_USUAL_CARD = re.compile(r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])")
# a phone number has 15 digits at most, so six groups are enough
_GROUPED = re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ .-][0-9]{2,6}){1,5}(?![0-9])")
_CODE = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{16,}+")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._-])[A-Za-z0-9._-]{2,}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{2,}+ ?(?:\(dot\)|\[dot\]|\.) ?[A-Za-z]{2,}+"
)
_WORDS_BEFORE = re.compile(r"(?i)(mail|tel|phone|call|fax|card|visa|account|ip|host|server|address|token|password|secret|key)")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = 2 * v - 9 if v > 4 else 2 * v
        total += v
    return total % 10 == 0


def _emails(text):
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            last = found.end()
        at = text.find("@", last if found else at + 1)


def _digits(text, start, end):
    return "".join(c for c in text[start:end] if "0" <= c <= "9")


def base_matches(text):
    """(kind, start, end, valid) of every base pattern match, per kind in order."""
    out = [("email", s, e, True) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        out.append(("ip", m.start(), m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)))
    for m in _CARD.finditer(text):
        digits = _digits(text, m.start(), m.end())
        if len(digits) > 5:
            out.append(("card", m.start(), m.end(), 13 <= len(digits) <= 19 and luhn(digits)))
    for m in _PHONE.finditer(text):
        out.append(("phone", m.start(), m.end(), 9 <= len(_digits(text, m.start(), m.end())) <= 15))
    return out


def candidates(text, base):
    """Overlapping (kind, start, end, weak label) proposals beyond the valid base spans.

    Base matches are among them, for training and for what overlaps them.
    """
    out = [(kind, s, e, int(ok)) for kind, s, e, ok in base]
    if "(at)" in text or "[at]" in text:
        out += [("email", m.start(), m.end(), None) for m in _SPELLED.finditer(text)]
    for m in _SECRET.finditer(text):
        v = m.group(1)
        mixed = any(c.isdigit() for c in v) and any(c.isalpha() for c in v)
        out.append(("secret", m.start(1), m.end(1), int(mixed and len(v) >= 12) if mixed or len(v) < 12 else None))
    if _DIGIT.search(text):
        out += [("card", m.start(), m.end(), int(luhn(_digits(text, *m.span())))) for m in _USUAL_CARD.finditer(text)]
        out += [("phone", m.start(), m.end(), 1) for m in _USUAL_PHONE.finditer(text)]
        out += [("secret", m.start(), m.end(), None) for m in _CODE.finditer(text)]
        out += [("phone", m.start(), m.end(), None) for m in _GROUPED.finditer(text)]
    return out


def _entropy(value):
    n = len(value)
    return -sum(k / n * math.log2(k / n) for k in (value.count(c) for c in set(value)))


#: Lengths and counts above this are alike to the trees, so a span of any length keeps its kind.
ALIKE = 48


def features(text, kind, start, end):
    """Format and context of a whole span."""
    value = text[start:end]
    before, after = text[max(0, start - 24) : start], text[end : end + 8]
    n = end - start
    digits = sum("0" <= c <= "9" for c in value)
    letters = sum(c.isalpha() for c in value)
    upper = sum(c.isupper() for c in value)
    groups = re.findall("[0-9]+", value)
    words_before = _WORDS_BEFORE.findall(before)
    alike = lambda k: float(min(k, ALIKE))
    return [
        KINDS.index(kind), alike(n), alike(digits), alike(letters), digits / n, letters / n,
        alike(value.count("@")), alike(value.count(".")), alike(value.count(" ") + value.count("-")),
        alike(value.count("(") + value.count(")")), float(value[0] == "+"), alike(len(groups)),
        alike(max((len(g) for g in groups), default=0)), alike(min((len(g) for g in groups), default=0)),
        max((int(g[:6]) for g in groups), default=0), float(13 <= digits <= 19 and luhn(_digits(value, 0, n))),
        min(_entropy(value), 4.5), upper / n, len(words_before),
        float(bool(words_before)) and float(before.rstrip().lower().endswith(words_before[-1].lower())),
        float(before.rstrip(" \"'")[-1:] in ("=", ":") and before != ""), float(before[-1:].isalnum()),
        float(after[:1].isalnum()), float(after[:1] in ".,;" and after != ""), float(before[-1:] in "\"'" and before != ""),
    ]


def examples(n: int, seed: int = 7):
    """(text, weak label of its secret or number) of made-up lines, so that a small table fits as a large one does.

    Keyed secrets of 12 to 2,000 characters against keyed words, numbers with
    and without a check digit.
    """
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choices(chars, k=k))
    low, high, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    for i in range(n):
        lead = " ".join(pick(low, rng.randint(1, 9)) for _ in range(rng.randint(0, 4))).capitalize()
        name = rng.choice(["token", "password", "key", "api_key", "secret", "auth", "pwd", "Key", "TOKEN", "passwd"])
        sign = rng.choice([": ", "=", " = ", ":"])
        end = rng.choice([" " + pick(low, 5), ".", "", ", " + pick(low, 4)])
        if i % 4 == 0:
            size = int(math.exp(rng.uniform(math.log(12), math.log(2000))))
            chars = rng.choice([low + high + digits, "abcdef" + digits, low + digits, low + high + digits + "+/_-"])
            # one letter and one digit at any place make it a mixture
            value = pick(chars, size - 2)
            for one in pick(low, 1), pick(digits, 1):
                at = rng.randint(0, len(value))
                value = value[:at] + one + value[at:]
            yield f"{lead} {name}{sign}{value}{end}", 1
        elif i % 4 == 1:
            value = pick(low, rng.randint(6, 18))
            yield f"{lead} {name}{sign}{rng.choice([value, value.capitalize(), value + '-' + pick(low, 4)])}{end}", 0
        elif i % 4 == 2:
            body = pick(digits, 15)
            check = next(d for d in digits if luhn(body + d))
            number = body + (check if i % 8 == 2 else rng.choice([d for d in digits if d != check]))
            grouped = " ".join(number[j : j + 4] for j in range(0, 16, 4))
            yield f"{lead} {rng.choice([number, grouped, grouped.replace(' ', '-')])}{end}", int(i % 8 == 2)
        else:
            parts = f"+{rng.randint(1, 99)}", pick(digits, 3), pick(digits, 3), pick(digits, 4)
            yield f"{lead} {rng.choice(['call', 'tel', 'phone', ''])} {rng.choice([' ', '-', '.']).join(parts)}{end}", 1


def _example_rows(n: int):
    x, y = [], []
    for text, label in examples(n):
        for kind, s, e, _ in candidates(text, base_matches(text)):
            if kind in ("secret", "card", "phone") and e - s >= 6:
                # of overlapping proposals only the whole value has the line's label
                x.append(features(text, kind, s, e))
                y.append(float(label and (kind != "card" or luhn(_digits(text, s, e)))))
    return np.array(x).reshape(len(y), len(features("x", KINDS[0], 0, 1))), np.array(y)


def _sample_batches(batches):
    for batch in batches:
        rows, labels, keys = [], [], []
        for text in batch.column(0).to_pylist():
            text = text or ""
            for kind, s, e, label in candidates(text, base_matches(text)):
                if label is not None:
                    rows.append(features(text, kind, s, e))
                    labels.append(label)
                    # all that the features and the label are made from
                    seen = "\0".join((kind, text[max(0, s - 24) : s], text[s:e], text[e : e + 8]))
                    keys.append(hashlib.blake2b(seen.encode("utf-8", "surrogatepass"), digest_size=8).digest())
        keys = np.frombuffer(b"".join(keys), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.int64()), pa.array(keys)], names=["x", "y", "h"]
        )


def _at_most(rows: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose hash falls into the first ``share`` of all hashes."""
    place = F.shiftrightunsigned(F.xxhash64(key), 1)
    return rows if share >= 1 else rows.filter(place < F.lit(int(share * (1 << 63))))


def sample(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(x, y, h): distinct labelled candidates of the sampled documents, about ``sample_rows`` by their hash at most."""
    some = _at_most(docs.select(F.col("text").cast("string").alias("text")), "text", sample_docs / max(1, docs.count()))
    found = some.mapInArrow(_sample_batches, "x array<double>, y long, h long").dropDuplicates(["h"])
    found = Scratch(docs.sparkSession, "pii").write(found, "candidates")
    return _at_most(found, "h", sample_rows / max(1, found.count()))


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_rows: int = SAMPLE_ROWS, made: int = EXAMPLES):
    """Trees and calibration from the weakly labelled candidates of a bounded sample and of ``made`` example lines."""
    rows = sample(docs, sample_docs, sample_rows).select("x", "y").toArrow()
    y = rows["y"].to_numpy().astype(float)
    x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    more_x, more_y = _example_rows(made)
    x, y = np.concatenate([x.reshape(len(y), more_x.shape[1]), more_x]), np.concatenate([y, more_y])
    order = np.lexsort((y, *x.T[::-1]))
    x, y = x[order], y[order]
    held = np.arange(len(y)) % 4 == 3
    if min(y[~held].sum(), (1 - y[~held]).sum(), y[held].sum(), (1 - y[held]).sum()) < 1:
        return None
    model = boosting.fit(x[~held], y[~held])
    model["sigmoid"] = boosting.calibrate(boosting.decision(model, x[held]), y[held])
    model["accuracy"] = float(((boosting.decision(model, x[held]) > 0) == (y[held] > 0)).mean())
    return model


def probability(model, x):
    a, b = model["sigmoid"]
    return boosting.sigmoid(a * boosting.decision(model, x) + b)


def _select(base, proposed, p, threshold):
    """Valid base spans, and proposals from the most probable that overlap nothing chosen."""
    chosen = [(kind, s, e) for kind, s, e, ok in base if ok]
    # spans that do not overlap, sorted: base spans of different kinds may, and count as one here
    taken = []
    for s, e in sorted((s, e) for _, s, e in chosen):
        if taken and s < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(e, taken[-1][1]))
        else:
            taken.append((s, e))
    for q, (kind, s, e, _) in sorted(zip(p, proposed), key=lambda v: (-v[0], v[1][1], v[1][2])):
        if q < threshold:
            break
        at = bisect.bisect_left(taken, (e,))
        if not at or taken[at - 1][1] <= s:
            chosen.append((kind, s, e))
            taken.insert(at, (s, e))
    return sorted(chosen, key=lambda v: (KINDS.index(v[0]), v[1]))


def _report(texts, model, threshold):
    bases, lists, rows = [], [], []
    for value in texts:
        text = value.as_py() or ""
        base = base_matches(text)
        good = {v[:3] for v in base if v[3]}
        more = [c for c in candidates(text, base) if c[:3] not in good]
        rows += [features(text, kind, s, e) for kind, s, e, _ in more]
        bases.append(base)
        lists.append(more)
    p = probability(model, np.array(rows)) if model and rows else np.zeros(len(rows))
    counts, joined, spans, at = {k: [] for k in KINDS}, [], [], 0
    for base, more in zip(bases, lists):
        # a base match that failed its check never comes back
        failed = {(kind, s, e) for kind, s, e, ok in base if not ok}
        q = [0.0 if (k, s, e) in failed else v for (k, s, e, _), v in zip(more, p[at : at + len(more)])]
        at += len(more)
        good = sorted(((k, s, e) for k, s, e, ok in base if ok), key=lambda v: (KINDS.index(v[0]), v[1]))
        for kind in KINDS:
            counts[kind].append(sum(v[0] == kind for v in good))
        joined.append(",".join(f"{k}:{s}:{e}" for k, s, e in good))
        spans.append([{"kind": k, "start": s, "end": e} for k, s, e in _select(base, more, q, threshold)])
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return [
        *[pa.array(counts[k], pa.int64()) for k in KINDS[:4]],
        pa.array(joined, pa.string()),
        pa.array(spans, pa.list_(kind)),
    ]


def find(docs: DataFrame, threshold: float = THRESHOLD, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(row, n_email, n_ip, n_card, n_phone, base, spans) for each row of ``docs`` (needs ``text``)."""
    model = train(docs, sample_docs)
    return with_report(docs, "text", lambda texts: _report(texts, model, threshold), FIELDS)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans as one."""
    found = find(docs, threshold)
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])))
    text = F.col("row.text")
    state = F.struct(F.lit(1).cast("long").alias("at"), F.lit("").alias("out"))

    def step(s, v):
        start, end = v["start"] + 1, v["end"] + 1
        before = F.concat(s["out"], F.substring(text, s["at"].cast("int"), (start - s["at"]).cast("int")))
        fresh = F.concat(before, F.lit("["), F.upper(v["kind"]), F.lit("]"))
        return F.struct(F.greatest(s["at"], end).alias("at"), F.when(start >= s["at"], fresh).otherwise(s["out"]).alias("out"))

    done = F.aggregate(ordered, state, step)
    cut = F.concat(done["out"], F.substring(text, done["at"].cast("int"), F.length(text)))
    new = F.when(F.size("spans") > 0, cut).otherwise(text)
    return found.withColumn("cut", new).select(
        *[F.col("cut").alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    )
