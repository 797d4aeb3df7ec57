"""Personal data in texts: generators propose spans, boosted trees judge them, calibrated thresholds select.

Spans of the four base formats are always kept. Generators of high recall also propose looser forms (spelt-out e-mail
addresses, numbers without a plus sign, secrets), which may overlap; the trees judge each by its format and context.
They are trained on generated sentences, so the model is the same for every corpus.
"""

from __future__ import annotations

import hashlib
import ipaddress
import random
import re
from bisect import bisect_left, insort
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Boosted, threshold
from .shared import prepare, table, text_column

KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
#: Generated sentences to learn from, and the share of right ones among selected spans that thresholds ask for.
SENTENCES, PRECISION = 6000, 0.97
SEED = 11

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGIT = re.compile("[0-9]")
# a digit before would have begun the match there, so looking behind alters nothing but the time
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_AT = re.compile(r"\s?(?:\[at\]|\(at\)|\{at\}|\sat\s|\s@\s|@)\s?", re.I)
_BEFORE_AT = re.compile(r"(?<![\w.+-])[A-Za-z0-9._%+-]{1,64}$")
_AFTER_AT = re.compile(r"[A-Za-z0-9-]{1,63}+(?:(?:\s?(?:\[dot\]|\(dot\)|\{dot\}|\sdot\s)\s?|\.)[A-Za-z0-9-]{1,63}+){1,4}", re.I)
_IP4 = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\s\.|\.)\s?[0-9]{1,3}){3}(?![0-9A-Za-z])", re.I)
_IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{2,39}(?:(?<=:)[0-9.]{7,15})?(?![0-9A-Za-z:])")
_LOOSE = re.compile(r"(?<![0-9A-Za-z])\(?[0-9][0-9()\x20._/-]{5,30}[0-9](?![0-9A-Za-z])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _octet(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255


def _emails(text: str):
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        after = m.end() if m else at + 1
        at = text.find("@", after)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base formats, by start and then kind as listed."""
    out = [(*x, "email") for x in _emails(text)]
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
        out += [(*m.span(), "card") for m in _CARD.finditer(text) if 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(out, key=_order)


def _order(span):
    return span[0], KINDS.index(span[2]), span[1]


def _is_ip6(text: str) -> bool:
    try:
        return ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def candidates(text: str) -> list[tuple[int, int, str]]:
    """Spans of looser forms; they may overlap each other and base spans."""
    out = []
    for m in _AT.finditer(text):
        name, host = _BEFORE_AT.search(text[max(0, m.start() - 65) : m.start()]), _AFTER_AT.match(text, m.end())
        if name and host:
            out.append((m.start() - len(name[0]), host.end(), "email"))
    if ":" in text:
        out += [(*m.span(), "ip") for m in _IP6.finditer(text) if _is_ip6(m[0])]
    if _DIGIT.search(text):
        out += [(*m.span(), "ip") for m in _IP4.finditer(text) if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0]))]
        for m in _LOOSE.finditer(text):
            n = len(_digits(m[0]))
            if 7 <= n <= 15:
                out.append((*m.span(), "phone"))
            if 12 <= n <= 19:
                out.append((*m.span(), "card"))
        out += [(*m.span(), "secret") for m in _SECRET.finditer(text) if _DIGIT.search(m[0])]
    return out


#: Fixed words of contexts, lower case: those that speak for a kind, and those that speak against any.
_FOR = {"email": ("mail", "contact", "write", "reach"), "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "credit", "pay"), "phone": ("phone", "call", "tel", "fax", "mobile", "dial"), "secret": ("token", "key", "secret", "password", "passwd", "api")}
_ENDS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "uk", "eu")
_AGAINST = ("order", "invoice", "version", "isbn", "sha", "commit", "checksum", "page", "item", "serial", "part", "volume", "digest", "hash")


def features(text: str, start: int, end: int, kind: str) -> list[float]:
    span, before = text[start:end], text[max(0, start - 32) : start].lower()
    digits = _digits(span)
    n = max(1, len(span))
    edge = lambda c: 0 if not c or c.isspace() else 1 if c in ".,;:!?()\"'" else 2
    words = re.findall(r"[a-z]+", before)
    return [
        *(float(kind == k) for k in KINDS), n, len(digits), len(digits) / n, len(set(span)) / n, len(re.findall(r"[\x20()./-]+", span)),
        float(span.startswith("(")), float(luhn(digits)) if kind == "card" and digits else 0.0, float(bool(re.search(r"(?i)[\[({]at[\])}]", span))), float("dot" in span.lower() or "." in span), float(span.count(":")), float(" " in span), float(bool(re.search(rf"(?i)(?:[.\s)}}\]])(?:{'|'.join(_ENDS)})$", span))),
        edge(text[start - 1 : start]), edge(text[end : end + 1]), float(any(w.startswith(_FOR[kind]) for w in words)), float(any(w.startswith(_AGAINST) for w in words)),
        float(bool(re.search(r"[=:]\s?[\"']?$", before))), float(any(c.islower() for c in span)), float(any(c.isupper() for c in span)), float("/" in span),
    ]


def _sentence(r: random.Random) -> tuple[str, int, int, str, int]:
    """A text with one span: (text, start, end, kind, whether it is personal)."""
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    prose = lambda: " ".join(word() for _ in range(r.randint(1, 6)))
    kind, good = r.choice(KINDS), int(r.random() < 0.5)
    # what stands before speaks for the kind in most good cases, and in some bad ones too
    lead = r.choice(_FOR[kind]) if r.random() < (0.6 if good else 0.15) else r.choice(_AGAINST) if r.random() < (0.05 if good else 0.5) else word()
    if kind == "email":
        at, dot = r.choice([(" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" AT ", " DOT "), (" at ", "."), (" at ", " dot "), (" @ ", ".")])
        span = f"{word()}{at}{word()}{dot}{r.choice(_ENDS)}" if good else f"{word()} at {word()}{r.choice(['.', '.', ' dot '])}{r.choice([word().title(), word()])}"
    elif kind == "ip":
        if good:
            parts = [str(r.randint(0, 255)) for _ in range(4)]
            whole = ":".join(f"{r.getrandbits(16):x}" for _ in range(8))
            span = r.choice([r.choice(["[.]", " . ", "(.)", "[dot]"]).join(parts), whole, f"{r.getrandbits(16):x}:{r.getrandbits(16):x}::{r.getrandbits(16):x}", f"fe80::{r.getrandbits(16):x}:{r.getrandbits(16):x}"])
        else:
            span = r.choice([f"{r.randint(1, 9)} . {r.randint(0, 20)} . {r.randint(0, 20)} . {r.randint(0, 9)}", "::", f"{r.randint(1, 9)}::{r.randint(1, 9)}"])
    elif kind == "card":
        while True:  # separators that the base format lacks; right ones pass Luhn, wrong ones don't
            span = num(16)
            if luhn(span) == bool(good):
                break
        mark = r.choice("/./._")
        span = mark.join(span[i : i + 4] for i in range(0, 16, 4)) if good or r.random() < 0.7 else num(r.choice([12, 13, 17]))
    elif kind == "phone":
        span = r.choice([f"({num(3)}) 555-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"0{num(3)} {num(6)}", f"0{num(2)}/{num(7)}"]) if good else r.choice([num(r.randint(7, 15)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{num(4)}", f"{num(4)} {num(4)}"])
    else:
        alphabet = r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        span = "".join(r.choice(alphabet) for _ in range(r.choice([32, 40, 24, 36, 64, 120, 260]))) if good or r.random() < 0.6 else f"{word()}-{word()}-{word()}_{num(4)}-{word()}"
    tie = r.choice([' = "', ": ", "=", ' = ', " "]) if kind == "secret" and good else r.choice([": ", " ", ", "])
    head = f"{prose()} {lead}{tie}"
    return f"{head}{span}{r.choice(['.', ' ', ', ', chr(34)])}{prose()}", len(head), len(head) + len(span), kind, good


def sentences(seed: int, n: int = SENTENCES) -> list[tuple]:
    r = random.Random(seed)
    return [_sentence(r) for _ in range(n)]


def measured(seed: int, n: int = SENTENCES) -> dict[str, tuple[float, float]]:
    """(precision, recall) of selected spans by kind, on generated sentences of another seed than the model's."""
    trees, limits = model()
    rows = sentences(seed, n)
    p, y, kinds = trees.probability(np.array([features(*x[:4]) for x in rows])), np.array([x[4] for x in rows]), np.array([x[3] for x in rows])
    out = {}
    for k in KINDS:
        taken, own = (p >= limits[k])[kinds == k], y[kinds == k]
        out[k] = float(own[taken].mean()), float(taken[own == 1].mean())
    return out


@lru_cache(1)
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees and a threshold for each kind, fitted on generated sentences: half learn, a quarter each calibrate and select."""
    rows = sentences(SEED)
    x = np.array([features(*row[:4]) for row in rows])
    y = np.array([row[4] for row in rows], float)
    a, b = SENTENCES // 2, 3 * SENTENCES // 4
    trees = Boosted().fit(x[:a], y[:a]).calibrate(x[a:b], y[a:b])
    p, kinds = trees.probability(x[b:]), np.array([row[3] for row in rows[b:]])
    return trees, {k: max(0.5, threshold(p[kinds == k], y[b:][kinds == k], PRECISION)) for k in KINDS if (kinds == k).any()}


def _joined_up(spans) -> list[tuple[int, int]]:
    """The stretches that sorted spans cover, apart from each other."""
    out: list[tuple[int, int]] = []
    for s, e, _ in spans:
        if out and s < out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], e)
        else:
            out.append((s, e))
    return out


def _meets(covered: list[tuple[int, int]], start: int, end: int) -> bool:
    at = bisect_left(covered, (end,))
    return at > 0 and covered[at - 1][1] > start


def select(texts: list[str], judge) -> list[tuple[list, list]]:
    """Per text its base spans and all its spans: the base ones, and selected others that overlap none chosen before, best first."""
    trees, limits = judge
    base = [base_spans(t) for t in texts]
    covered = [_joined_up(b) for b in base]
    asked = [(i, *s) for i, t in enumerate(texts) for s in candidates(t) if not _meets(covered[i], s[0], s[1])]
    taken = [list(b) for b in base]
    if asked:
        p = trees.probability(np.array([features(texts[i], s, e, k) for i, s, e, k in asked]))
        for j in np.argsort(-p, kind="stable"):
            i, s, e, k = asked[j]
            if p[j] >= limits.get(k, 1.1) and not _meets(covered[i], s, e):
                taken[i].append((s, e, k))
                insort(covered[i], (s, e))
    return list(zip(base, (sorted(x, key=_order) for x in taken)))


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _digests(judge, batches):
    for b in batches:
        got = select(b.column(1).to_pylist(), judge)
        counts = [pa.array([sum(s[2] == k for s in base) for base, _ in got], pa.int64()) for k in BASE]
        shas = [hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]
        columns = [b.column(0), *counts, pa.array(shas, pa.string()), pa.array([joined(s) for _, s in got], pa.string()), pa.array([len(s) for _, s in got], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_spans"])


def find(docs: DataFrame) -> DataFrame:
    """documents to (doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_spans), one row for each row.

    The counts and base_sha256 are of base spans; spans has all of them as kind:start:end in code points, n_spans says how many. An empty table gives no rows. Null and empty
    texts have none. Repeated and null ids stay; other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_column(docs).alias("text"))
    return rows.mapInArrow(partial(_digests, model()), f"doc_id long, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_spans long")


def _redacted(judge, batches):
    for b in batches:
        texts = b.column("text").to_pylist()
        out = []
        for text, (_, spans) in zip(texts, select([t or "" for t in texts], judge)):
            at, parts = 0, []
            for s, e, k in spans:
                if e > at:
                    parts += [text[at : max(at, s)], f"<{k.upper()}>"]
                    at = e
            out.append(text if not spans else "".join([*parts, text[at:]]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else b.column(n) for n in b.schema.names], names=b.schema.names)


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of personal data replaced by its kind in angle brackets; all rows and columns stay, null texts too."""
    prepare(docs.sparkSession)
    rows = docs.withColumn("text", F.col("text").cast("string"))
    return rows.mapInArrow(partial(_redacted, model()), rows.schema)


def op2_pii(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
