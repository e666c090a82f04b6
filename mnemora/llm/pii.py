"""Personal data by weak supervision (operator 1).

Every whole text is searched for candidate spans: the base matches (email, ip, card, phone), which
always stay, and wider ones (obfuscated addresses, numbers without a plus sign or run into other numbers, IPv6, cards that fail
the check digit, social security numbers, IBANs, names after a title). Four labelers vote yes, no or
nothing on each candidate:

* regex - the span is well formed for its kind (check digits, ranges, counts);
* gazetteer - known top-level domains, reserved networks, issuer prefixes, country codes, given titles;
* context - words just before the span that announce such data, or other numbers;
* border - the span is not a part of a longer token.

Expectation-maximisation (a two-class model with labelers independent given the class, for each kind)
estimates their reliabilities and the share of true spans from the counts of all vote patterns of
the corpus. The final span classifier is a logistic model over the votes, the span itself (its shape, length,
first characters) and its neighbours (two words before, one after), all hashed to ``SLOTS`` weights. It is trained on the
label model's soft labels of at most ``SAMPLE`` different candidates, those of the least hashes, and judges
every candidate of every text; wider candidates it gives at least ``THRESHOLD`` are added. Counts by pattern,
whose number the labelers fix, and the sample are all that reaches the driver.

Null texts are empty; repeated rows give repeated results; an empty table gives no rows and trains
nothing. The text is scanned once, with patterns that take linear time; the candidates are a written
table, so lost executors repeat only their own tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, text_of, written

KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "name")
BASE = KINDS[:4]
THRESHOLD = 0.9
#: Different candidates that the classifier is trained on at most, and its weights.
SAMPLE, SLOTS = 100_000, 1 << 14
BEFORE = 48

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

NATIONAL = re.compile(r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
HIDDEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT)[\])}] ?[A-Za-z0-9-]++(?:(?:\.| ?[\[({](?:dot|DOT)[\])}] ?)[A-Za-z0-9-]++)+")
NAMED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof)\. [A-Z][a-z]++(?: [A-Z][a-z]++)?(?![A-Za-z])")
LAST = re.compile(r"[A-Za-z0-9-]++(?=[^A-Za-z0-9-]*$)")
GROUPED = re.compile(r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[ .-][0-9]{2,4}){1,3}(?![0-9])")

#: Gazetteers.
TOP_DOMAINS = frozenset("com org net edu gov int mil io co info biz eu uk de fr es it nl ch at be se no fi dk pl pt ie us ca au nz jp cn in br mx ru".split())
ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "35", "30", "36", "38", "62", "50")
COUNTRIES = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "54", "55", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "351", "352", "353", "358", "420", "421", "971", "972")
ANNOUNCED = {
    "email": r"e-?mail|contact|write|reach|address|mailto|reply",
    "ip": r"\bip\b|address|host|server|login|from",
    "card": r"card|visa|master ?card|amex|credit|debit|payment",
    "phone": r"phone|\btel\b|call|mobile|fax|cell|contact|whatsapp|dial",
    "ssn": r"\bssn\b|social security|tax id",
    "iban": r"iban|account|bank|transfer",
    "name": r"dear|contact|from|by|attn|patient|signed",
}
OTHERWISE = r"version|isbn|order|ticket|\bsku\b|serial|section|model|part no|invoice|chapter|build|release"
ANNOUNCED_RE = {k: re.compile(v, re.I) for k, v in ANNOUNCED.items()}
OTHERWISE_RE = re.compile(OTHERWISE, re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches by start, then kind."""
    out = []
    at, done = text.find("@"), 0
    if at >= 0:
        back = text[::-1]  # the local part is read backwards from its @
        n = len(text)
        while at >= 0:
            # at most the characters since the last match
            run = LOCAL.match(back, n - at, n - done).end() - (n - at)
            m = DOMAIN.match(text, at + 1) if run else None
            if m:
                out.append((at - run, 0, m.end()))
                done = m.end()
                at = text.find("@", done)
            else:
                done = max(done, at + 1)
                at = text.find("@", at + 1)
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(digits_of(m[0])) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def wider_spans(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Candidates beside the base spans, overlapping neither them nor each other."""
    from bisect import bisect_left

    used = sorted((s, e) for s, _, e in taken)
    found = []
    if DIGIT.search(text):
        found += [(m.start(), 4, m.end()) for m in SSN.finditer(text)]
        if "+" in text:
            for m in GROUPED.finditer(text):
                i = bisect_left(used, (m.start() + 1, 0))
                m = GROUPED.match(text, m.start(), used[i][0] if i < len(used) else len(text))  # up to the next base span
                if m and 9 <= len(digits_of(m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
        found += [(m.start(), 3, m.end()) for m in NATIONAL.finditer(text)]
        found += [(m.start(), 5, m.end()) for m in IBAN.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(digits_of(m[0])) <= 19]
        if ":" in text:
            found += [(m.start(), 1, m.end()) for m in IPV6.finditer(text)]
    low = text.lower() if ("(" in text or "[" in text or "{" in text) else ""
    if "(at" in low or "[at" in low or "{at" in low:
        found += [(m.start(), 0, m.end()) for m in HIDDEN.finditer(text)]
    if ". " in text:
        found += [(m.start(), 6, m.end()) for m in NAMED.finditer(text)]
    if not found:
        return []
    out = []
    for s, k, e in sorted(found, key=lambda x: (x[0], x[1])):
        i = bisect_left(used, (s, e))
        if (i and used[i - 1][1] > s) or (i < len(used) and used[i][0] < e):
            continue
        used.insert(i, (s, e))
        out.append((s, k, e))
    return out


def votes(text: str, start: int, kind: int, end: int) -> str:
    """The labelers' votes (+, - or 0 each: regex, gazetteer, context, border) and the span's shape."""
    span, d = text[start:end], ""
    form = book = "0"
    if kind == 0:
        tail = LAST.search(span)[0].lower()
        form = "+" if ".." not in span and 2 <= len(tail) <= 24 and tail.isalpha() else "-"
        book = "+" if tail in TOP_DOMAINS else "-"
    elif kind == 1:
        if ":" in span:
            form, book = "+", "-" if span.lower().startswith(("fe80", "0:0", "2001:db8")) else "0"
        else:
            parts = span.split(".")
            form = "+" if all(p == "0" or not p.startswith("0") for p in parts) else "-"
            book = "-" if parts[0] in ("0", "10", "127", "255") or span.startswith(("192.168.", "169.254.")) else "+"
    elif kind == 2:
        d = digits_of(span)
        form = "+" if luhn(d) else "-"
        book = "+" if d.startswith(ISSUERS) and len(d) in (13, 14, 15, 16, 19) else "-"
    elif kind == 3:
        d = digits_of(span)
        form = "+" if span.startswith("+") else "0"
        book = ("+" if d.startswith(COUNTRIES) else "-") if span.startswith("+") else ("-" if d[0] in "01" else "0")
    elif kind == 4:
        a, b, c = span.split("-")
        form = "-" if a in ("000", "666") or a[0] == "9" or b == "00" or c == "0000" else "+"
    elif kind == 5:
        whole = span.replace(" ", "")
        form = "+" if 15 <= len(whole) <= 34 and int("".join(str(int(c, 36)) for c in whole[4:] + whole[:4])) % 97 == 1 else "-"
    else:
        form, book = "0", "+"
    before = text[max(0, start - BEFORE) : start]
    context = "+" if ANNOUNCED_RE[KINDS[kind]].search(before) else ("-" if OTHERWISE_RE.search(before) else "0")
    left, right = text[start - 1 : start], text[end : end + 1]
    border = "-" if (left.isalnum() or right.isalnum() or left == "_" or right == "_") else "+"
    shape = "s" if any(c in span for c in " -().") else "p"
    return f"{KINDS[kind]}:{form}{book}{context}{border}{shape}"


SHAPES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\dA-Z_]+"), "a"), (re.compile(r"[0-9]"), "9"), (re.compile(r"\s"), "_"), (re.compile(r"\|"), "I"))
NEAR = re.compile(r"\w+|[^\w\s]")


def clues(text: str, start: int, kind: int, end: int) -> str:
    """What the classifier reads of a span and its neighbours: shape, length, first two characters, two words before, one after."""
    shape = text[start : min(end, start + 200)]
    for pattern, to in SHAPES:
        shape = pattern.sub(to, shape)
    low = lambda x: x[:20].lower().replace("|", "I")
    before = [low(x) for x in NEAR.findall(text[max(0, start - BEFORE) : start])[-2:]]
    after = [low(x) for x in NEAR.findall(text[end : end + BEFORE])[:1]]
    return "|".join([f"s={shape[:40]}", f"n={min(40, end - start)}", f"f={low(text[start : start + 2])}", *(f"b{i}={x}" for i, x in enumerate(reversed(before))), *(f"a={x}" for x in after)])


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, found array<struct<start:long,kind:int,end:long,base:boolean,votes:string,clues:string>>"


def candidates(docs: DataFrame) -> DataFrame:
    """Per document: base counts and hash, and every candidate span with its votes, by start, then kind."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        item = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("base", pa.bool_()), ("votes", pa.string()), ("clues", pa.string())])
        for batch in batches:
            counts: list[list[int]] = [[] for _ in BASE]
            hashes, found = [], []
            for text in batch.column(1):
                t = text.as_py()
                base = base_spans(t)
                wide = wider_spans(t, base)
                for k, own in enumerate(counts):
                    own.append(sum(x[1] == k for x in base))
                hashes.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                both = sorted([(*x, True) for x in base] + [(*x, False) for x in wide])
                found.append([{"start": s, "kind": k, "end": e, "base": b, "votes": votes(t, s, k, e), "clues": clues(t, s, k, e)} for s, k, e, b in both])
            cols = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(hashes, pa.string()), pa.array(found, pa.list_(item))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "found"])

    return docs.select("doc_id", text_of(docs).alias("text")).mapInArrow(run, f"doc_id {id_type}, {SCHEMA}")


LABELERS = 4


def estimate(counts: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """Expectation-maximisation over pattern counts, for each kind: the probability of each pattern to be a true span.

    Reliabilities are smoothed with a prior of labelers that are right more often than not, so that a
    kind with few candidates, or with labelers that all agree, keeps its classes' meaning.
    """
    import numpy as np

    out: dict[str, float] = {}
    for kind in KINDS:
        own = sorted(p for p in counts if p.startswith(kind + ":"))
        if not own:
            continue
        n = np.array([counts[p] for p in own], float)
        v = np.array([["-0+".index(c) for c in p.split(":")[1][:LABELERS]] for p in own])
        prior = np.array([[6.0, 3.0, 1.0], [1.0, 3.0, 6.0]])  # of class no, yes: votes -, 0, +
        q = np.clip(0.5 + 0.15 * (v - 1).sum(axis=1), 0.05, 0.95)
        for _ in range(rounds):
            w = np.stack([n * (1 - q), n * q])
            share = (w.sum(axis=1) + 1) / (n.sum() + 2)
            rate = np.empty((LABELERS, 2, 3))
            for j in range(LABELERS):
                for c in range(2):
                    rate[j, c] = prior[c] + np.bincount(v[:, j], weights=w[c], minlength=3)
                    rate[j, c] /= rate[j, c].sum()
            log = np.log(share)[:, None] + sum(np.log(rate[j][:, v[:, j]]) for j in range(LABELERS))
            new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -60, 60)))
            moved, q = np.abs(new - q).max(), new
            if moved < 1e-9:
                break
        out |= dict(zip(own, q.tolist(), strict=True))
    return out


def _features(key: str) -> list[int]:
    """Slots of a candidate's features. key: its vote pattern, and its clues where there are any, joined by "|"."""
    import zlib

    pattern, *words = key.split("|")
    kind, v = pattern.split(":")
    names = ["", kind, f"{kind}{v[LABELERS]}", *(f"{kind}{j}{v[j]}" for j in range(LABELERS)), *(f"{j}{v[j]}" for j in range(LABELERS)), f"01{v[:2]}", f"02{v[0]}{v[2]}", f"12{v[1:3]}", *(f"{kind}{w}" for w in words), *(w for w in words if w[0] in "ab")]
    return [zlib.crc32(n.encode("utf-8", "surrogatepass")) % SLOTS for n in names]


class Classifier:
    """A logistic model over hashed features; its probability of a candidate by key."""

    def __init__(self, weights):
        self.weights = weights

    def __getitem__(self, key: str) -> float:
        import math

        return 1 / (1 + math.exp(-max(-40.0, min(40.0, float(self.weights[_features(key)].sum())))))


def train(counts: dict[str, int], soft: dict[str, float], ridge: float = 1.0, rounds: int = 400) -> Classifier:
    """The span classifier of candidates (keys with counts) and the soft labels of their vote patterns, by gradient steps of adaptive size."""
    import numpy as np

    weights, squares = np.zeros(SLOTS), np.full(SLOTS, 1e-6)
    keys = sorted(counts)
    if keys:
        slots = [_features(k) for k in keys]
        flat, row = np.concatenate(slots), np.repeat(np.arange(len(keys)), [len(x) for x in slots])
        n, y = np.array([counts[k] for k in keys], float), np.array([soft[k.split("|")[0]] for k in keys])
        for _ in range(rounds):
            z = np.bincount(row, weights[flat], len(keys))
            miss = n * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
            slope = np.bincount(flat, miss[row], SLOTS) + ridge * weights
            squares += slope * slope
            weights -= 0.3 * slope / np.sqrt(squares)
    return Classifier(weights)


def fit(found: DataFrame) -> Classifier:
    """The classifier of all candidates: the label model from the counts of every vote pattern (at most kinds x 3^4 x 2), the weights from a sample."""
    each = found.select(F.explode("found").alias("f")).select("f.votes", "f.clues")
    rows = each.groupBy("votes").count().collect()
    soft = estimate({r["votes"]: r["count"] for r in rows})
    keys = each.groupBy(F.concat_ws("|", "votes", "clues").alias("key")).count()
    some = keys.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).collect()
    return train({r["key"]: r["count"] for r in some}, soft)


def judged(found: DataFrame, classifier: Classifier) -> DataFrame:
    """Per document: base counts and hash, and the spans that are base or that the classifier accepts."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known: dict[str, bool] = {}

        def good(c: dict) -> bool:
            key = f"{c['votes']}|{c['clues']}"
            if key not in known:
                if len(known) >= SAMPLE:
                    known.clear()
                known[key] = classifier[key] >= THRESHOLD
            return known[key]

        for batch in batches:
            spans = [_joined([(c["start"], c["kind"], c["end"]) for c in own if c["base"] or good(c)]) if own else "" for own in batch.column("found").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.string())], names=[*batch.schema.names[:-1], "spans"])

    columns = ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "found"]
    kinds = ", ".join(f"{c} {found.schema[c].dataType.simpleString()}" for c in columns[:-1])
    return found.select(*columns).mapInArrow(run, f"{kinds}, spans string")


def report(docs: DataFrame) -> DataFrame:
    """Per document: base counts, base_sha256 and spans (base and added)."""
    found = written(candidates(docs), "pii")
    return judged(found, fit(found))
