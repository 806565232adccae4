"""Personal data: fixed formats, and further spans found by candidate gradient boosting.

Emails, addresses, card numbers and phone numbers in their fixed formats are always spans. High-recall
generators propose other writings of them (spelled-out at and dot, other separators, missing prefixes),
which may overlap; boosted trees score each from its format and context; a threshold per kind, set for
precision on held-back examples, and best-first choice without overlaps decide. The examples come from
the corpus: fixed-format spans of a bounded sample rewritten in other writings are positive, everyday
numbers and phrases put in their places are negative, and so are proposals in the sample that a rule proves
harmless (``harmless``). All other proposals of the sample stay unlabelled, since they may be data.

Defined results: a null text is empty and has no span; places count code points, ends are exclusive; a
corpus without fixed-format spans gives no model and so no added span; equal scores are chosen by place;
repeated rows repeat their result; input columns with a result's name are replaced. Texts are read whole,
in time linear in their length.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import boosting
from tidemark.llm.common import bounded_sample, slices, tidy, with_text_columns

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]+")
DIGIT = re.compile(r"[0-9]")
GROUP = re.compile(r"[0-9]+")

TRAIN_DOCS = 30_000  # bound of the sample the examples come from
EXAMPLES_PER_DOC = 6  # bound of a document's examples of each sort
PRECISION = 0.98
WINDOW = 28
PART_BYTES = 4 << 20  # text that a task holds at once

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    """Leftmost matches, found from their ``@``: the local part is the run before it."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = text[floor:at]
        size = len(before) - len(before.rstrip(LOCAL))
        found = DOMAIN.match(text, at + 1) if size else None
        if found:
            yield "email", at - size, found.end()
            floor, at = found.end(), text.find("@", found.end())
        else:
            floor, at = at + 1, text.find("@", at + 1)


def addresses(text: str) -> Iterator[Span]:
    """Four parts at a time of each dotted run of numbers; a part above 255 drops its four."""
    for run in DOTTED.finditer(text):
        parts = run.group().split(".")
        start = run.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                yield "ip", start, end
            start = end + 1


def cards(text: str) -> Iterator[Span]:
    for run in DIGITS.finditer(text):
        digits = NOT_DIGIT.sub("", run.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield "card", run.start(), run.end()


def phones(text: str) -> Iterator[Span]:
    for run in PLUS.finditer(text):
        if 9 <= len(NOT_DIGIT.sub("", run.group())) <= 15:
            yield "phone", run.start(), run.end()


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed formats, by kind and place."""
    found = list(emails(text)) if "@" in text else []
    if DIGIT.search(text):
        found += [*addresses(text), *cards(text)]
        if "+" in text:
            found += phones(text)
    return found


AT = r"(?i:\s?[\[({<]\s?(?:at|@)\s?[\])}>]\s?|\s?@\s|\s@|\sat\s|@)"
DOT = r"(?i:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\.)"
ANCHOR = re.compile(AT)
NAME = re.compile(r"[\w.+-]{1,64}\Z")
HOST = re.compile(rf"[\w-]{{1,63}}(?:{DOT}[\w-]{{1,63}}){{1,6}}")
PROPOSALS = {
    "ip": (
        re.compile(r"(?<![\w.])[0-9]{1,3}(?:\s?(?:\[\.\]|\(\.\)|\[dot\]|\(dot\)|\s\.\s|,)\s?[0-9]{1,3}){3}(?!\w)"),
        re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{1,4}(?![\w:])"),
    ),
    "card": (re.compile(r"(?<!\w)[0-9](?:[ ._/ –-]{0,2}[0-9]){12,18}(?!\w)"),),
    "phone": (re.compile(r"(?<![\w+])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ ./ -]{1,2}(?:\(?[0-9]{2,4}\)?[ ./ -]){0,4}[0-9]{2,5}(?!\w)"),),
}


def inside_dropped(text: str) -> Iterator[Span]:
    """Parts of fixed-format matches that failed their digit test, as when two numbers stand side by side."""
    for run in DIGITS.finditer(text):
        groups = [(m.start() + run.start(), m.end() + run.start()) for m in GROUP.finditer(run.group())]
        if len(groups) > 1 and not next(cards(run.group()), None):
            for i, (a, _) in enumerate(groups):
                size = 0
                for x, b in groups[i:]:
                    size += b - x
                    if size > 19:
                        break
                    if size >= 13:
                        yield "card", a, b
    for run in PLUS.finditer(text) if "+" in text else ():
        size = 0
        groups = [(m.start() + run.start(), m.end() + run.start()) for m in GROUP.finditer(run.group())]
        if sum(b - a for a, b in groups) > 15:
            for a, b in groups:
                size += b - a
                if size > 15:
                    break
                if size >= 9:
                    yield "phone", run.start(), b


def proposals(text: str, taken: list[Span]) -> list[Span]:
    """High-recall spans that meet no span of ``taken``; they may meet each other."""
    found: list[Span] = []
    for at in ANCHOR.finditer(text):
        host = HOST.match(text, at.end())
        name = NAME.search(text[max(0, at.start() - 64) : at.start()]) if host else None
        if name:
            found.append(("email", at.start() - len(name.group()), host.end()))
    if DIGIT.search(text):
        for kind, patterns in PROPOSALS.items():
            for pattern in patterns:
                found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if kind != "phone" or 7 <= len(NOT_DIGIT.sub("", m.group())) <= 15]
        found += inside_dropped(text)
    edges = sorted((a, b) for _, a, b in taken)
    starts, ends = np.array([a for a, _ in edges]), np.maximum.accumulate([b for _, b in edges]) if edges else np.array([])
    free = []
    for kind, a, b in found:
        i = int(np.searchsorted(starts, b)) - 1 if edges else -1  # the last taken span that starts before b
        if i < 0 or ends[i] <= a:
            free.append((kind, a, b))
    return free


#: Words before a span that speak for its kind, as features only.
CUES = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("tel", "phone", "call", "fax", "mobile", "contact", "whatsapp"),
}
SEPARATORS = " .-/():,[_ –"
FEATURES = len(KINDS) * 2 + len(SEPARATORS) + 16


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    body = text[a:b]
    before, after = text[max(0, a - WINDOW) : a].lower(), text[b : b + WINDOW]
    groups = [len(g) for g in GROUP.findall(body)]
    digits = NOT_DIGIT.sub("", body)
    tail = re.split(r"[^A-Za-z]+", body.rstrip())[-1]
    one_hot = [float(kind == k) for k in KINDS]
    cues = [float(any(c in before for c in CUES[k])) for k in KINDS]
    own = [
        len(body),
        len(digits),
        len(digits) / len(body),
        len(groups),
        max(groups, default=0),
        min(groups, default=0),
        groups[0] if groups else 0,
        groups[-1] if groups else 0,
        float(13 <= len(digits) <= 19 and luhn(digits)),
        sum(c in "abcdefABCDEF" for c in body),
        len(tail),
        float(bool(re.search(r"(?i)[\[({<]\s?(?:at|@|dot|\.)", body))),
        len(set(NOT_DIGIT.findall(body))),
        float(not before or before[-1].isspace()),
        float(not after or after[0] in " \n\t.,;:)!?"),
        len(DIGIT.findall(before)) + len(DIGIT.findall(after)),
    ]
    return one_hot + cues + [float(body.count(c)) for c in SEPARATORS] + [float(x) for x in own]


YEAR = "(?:19|20)[0-9]{2}"
MONTH, DAY = "(?:0?[1-9]|1[0-2])", "(?:0?[1-9]|[12][0-9]|3[01])"
PLAIN = {
    "ip": re.compile(r"(?:[01]?[0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]"),
    "phone": re.compile(rf"{YEAR}([-/. ]){MONTH}\1{DAY}|{DAY}([-/. ]){MONTH}\2{YEAR}|{YEAR}[-/]{YEAR}|[1-9][0-9]?(?: [0-9]{{3}}){{2,}}"),
}


def harmless(text: str, span: Span) -> bool:
    """Whether a proposal is no data for certain: a time, a date, years, grouped thousands, parts above 255, a failed Luhn digit.

    A cue of the kind before it leaves it open.
    """
    kind, a, b = span
    body = text[a:b]
    if any(c in text[max(0, a - WINDOW) : a].lower() for c in CUES[kind]):
        return False
    if kind == "card":
        return not luhn(NOT_DIGIT.sub("", body))
    if kind == "ip" and ":" not in body and any(int(g) > 255 for g in GROUP.findall(body)):
        return True
    return kind in PLAIN and bool(PLAIN[kind].fullmatch(body))


def rewritten(kind: str, body: str, rng: random.Random) -> str:
    """A fixed-format span in another writing."""
    if kind == "email":
        name, _, host = body.partition("@")
        at, dot = rng.choice([(" [at] ", " [dot] "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "."), (" @ ", "."), ("{at}", "."), (" AT ", " DOT ")])
        return name + at + host.replace(".", dot)
    digits = NOT_DIGIT.sub("", body)
    if kind == "ip":
        if rng.random() < 0.4:
            return ":".join(f"{int(rng.random() * 65536):x}" for _ in range(8))
        return body.replace(".", rng.choice(["[.]", "(.)", "[dot]"]))
    if kind == "card":
        return rng.choice([".", "/", "_", "  ", " "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    last = digits[-10:]
    a, b, c = last[:-7], last[-7:-4], last[-4:]
    form = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}", "({}) {} {}", "({}){}-{}".replace("){", ") {"), "{}/{}-{}"])
    return rng.choice(["", "", "", "1-", "001 "]) + form.format(a or "555", b, c)


def everyday(kind: str, rng: random.Random) -> str:
    """Text that a generator may propose but that is no personal data."""
    n = lambda low, high: rng.randint(low, high)
    if kind == "email":
        return rng.choice(["{} at {} dot {}", "{} @ {}.{}", "{} at {}. {}"]).format(*rng.sample(["look", "five", "noon", "point", "home", "matrix", "line", "once", "last", "them"], 3))
    if kind == "ip":
        return rng.choice([f"{n(0, 23):02}:{n(0, 59):02}:{n(0, 59):02}", f"{n(1, 9)}:{n(1, 9)}:{n(1, 9)}:{n(1, 9)}", f"{n(1, 999)}, {n(1, 999)}, {n(1, 999)}, {n(1, 999)}", f"{n(1, 99)},{n(100, 999)},{n(100, 999)},{n(100, 999)}"])
    if kind == "card":
        while luhn(digits := "".join(str(n(0, 9)) for _ in range(n(13, 19)))):
            pass
        sep = rng.choice([".", "/", "_", "  ", ""])
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    year = n(1900, 2099)
    return rng.choice(
        [
            f"{year}-{n(1, 12):02}-{n(1, 28):02}",
            f"{n(1, 28):02}.{n(1, 12):02}.{year}",
            f"{n(1, 28):02}/{n(1, 12):02}/{year}",
            f"{n(10, 999)} {n(100, 999)} {n(100, 999)}",
            f"{year}-{n(1900, 2099)}",
            f"{n(10, 99)}-{n(10, 99)}-{n(10, 99)}-{n(10, 99)}",
            f"{year}/{n(10, 99)}/{n(1000, 99999)}",
            f"{n(1000, 9999)} {n(1000, 9999)}",
            f"{n(10, 99)}.{n(1000, 9999)}.{n(10, 9999)}",
            f"{year} {n(1900, 2099)} {n(1900, 2099)}",
        ]
    )


def side_by_side(kind: str, body: str, rng: random.Random) -> tuple[str, list[Span]]:
    """A fixed-format phone and card with only a blank between them, so that both fail their digit tests."""
    number = "".join(str(rng.randint(0, 9)) for _ in range(15))
    card = next(number + c for c in "0123456789" if luhn(number + c))
    card = rng.choice([card, card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))])
    phone = f"+{rng.choice([1, 1, 33, 44, 49])} ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04}"
    phone, card = (body, card) if kind == "phone" else (phone, body)
    return f"{phone} {card}", [("phone", 0, len(phone)), ("card", len(phone) + 1, len(phone) + 1 + len(card))]


def examples(text: str) -> Iterator[tuple[int, list[float]]]:
    """Positive and negative feature rows of one text of the sample."""
    taken = base_spans(text)
    for kind, a, b in taken[:EXAMPLES_PER_DOC]:
        rng = random.Random(text[max(0, a - 8) : b])
        made = [("new", rewritten(kind, text[a:b], rng), None), ("new", rewritten(kind, text[a:b], rng), None), ("not", everyday(kind, rng), []), ("not", everyday(kind, rng), [])]
        if kind in ("card", "phone"):
            made += [("two", *side_by_side(kind, text[a:b], rng)) for _ in range(2)]
        for sort, body, true in made:
            cues = ("on", "no.", "order", "version", "total", "page") if sort == "not" else CUES[kind]
            lead = f"{rng.choice(cues)}{rng.choice([':', ''])} " if rng.random() < 0.4 else ""
            left = text[max(0, a - WINDOW) : a] + lead
            left = left if not left or left[-1].isspace() else left + " "
            whole = f"{left}{body}{rng.choice([' ', '. ', ', ', chr(10)])}{text[b : b + WINDOW].lstrip()}"
            start, end = len(left), len(left) + len(body)
            exact = None if true is None else {(k, x + start, y + start) for k, x, y in true}
            for span in proposals(whole, []):
                if span[1] < end and span[2] > start:
                    right = span in exact if exact is not None else span[1] == start and span[2] >= end and span[0] == kind
                    yield int(right), features(whole, span)
    # Of the text's own proposals only the harmless ones have a known label.
    unsure = list(inside_dropped(text))
    proven = [p for p in proposals(text, taken) if harmless(text, p)]
    for span in proven[:EXAMPLES_PER_DOC]:
        if not any(span[1] < b and span[2] > a for _, a, b in unsure):
            yield 0, features(text, span)


@dataclass
class Detector:
    trees: boosting.Trees
    thresholds: dict[str, float]


def fit(docs: DataFrame, text: str = "text", key: str = "doc_id", bound: int = TRAIN_DOCS) -> Detector | None:
    """Trees and thresholds from a bounded sample; None if it holds no fixed-format span."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, PART_BYTES):
                rows = [r for t in part.column(0).to_pylist() for r in examples(t)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in rows], pa.int32()), pa.array([np.array(r[1], np.float32).tobytes() for r in rows], pa.binary())], names=["label", "row"]
                )

    some = docs.select(key, text).where(f"`{text}` IS NOT NULL AND `{text}` RLIKE '[0-9@]'")
    table = bounded_sample(some, key, bound, "pii").select(text).mapInArrow(tidy(collect), "label int, row binary").distinct().toArrow()
    rows = sorted(zip(table.column("row").to_pylist(), table.column("label").to_pylist(), strict=True), key=lambda r: hashlib.md5(r[0]).digest())
    return fit_rows(np.frombuffer(b"".join(r[0] for r in rows), np.float32).reshape(-1, FEATURES), np.array([r[1] for r in rows], float))


def fit_rows(x: np.ndarray, y: np.ndarray) -> Detector | None:
    if len(set(y)) < 2:
        return None
    held = np.arange(len(y)) % 3 == 2
    trees = boosting.fit(x[~held], y[~held], rounds=50, depth=5)
    score, truth = trees.score(x[held]), y[held]
    thresholds = {}
    for k, kind in enumerate(KINDS):
        own = x[held][:, k] == 1
        order = np.argsort(-score[own])
        right = np.cumsum(truth[own][order])
        good = np.flatnonzero((right >= PRECISION * np.arange(1, len(order) + 1)) & (right > 0))
        thresholds[kind] = max(0.5, float(score[own][order][good[-1]])) if len(good) else 1.1
    return Detector(trees, thresholds)


def added_spans(text: str, taken: list[Span], detector: Detector | None) -> list[Span]:
    """Proposals above their kind's threshold, best first, without overlaps."""
    found = proposals(text, taken) if detector else []
    if not found:
        return []
    score = detector.trees.score(np.array([features(text, s) for s in found]))
    chosen: list[Span] = []
    ordered = sorted((-p, -(s[2] - s[1]), s[1], s) for p, s in zip(score, found, strict=True) if p >= detector.thresholds[s[0]])
    cover = bytearray(len(text)) if ordered else b""
    for *_, (kind, a, b) in ordered:
        if not any(cover[a:b]):
            chosen.append((kind, a, b))
            cover[a:b] = b"\x01" * (b - a)
    return chosen


def joined(spans: list[Span]) -> str:
    ordered = sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in ordered)


def find(docs: DataFrame, detector: Detector | None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds counts of fixed-format spans per kind, their digest, all spans, and how many were added."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        def search(texts: list[str]) -> dict:
            base = [base_spans(t) for t in texts]
            more = [added_spans(t, b, sent.value) for t, b in zip(texts, base, strict=True)]
            out = {f"n_{k}": [sum(s[0] == k for s in b) for b in base] for k in KINDS}
            return out | {
                "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
                "spans": [joined(b + m) for b, m in zip(base, more, strict=True)],
                "n_added": [len(m) for m in more],
            }

        return search

    fields = ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_added long"
    return with_text_columns(docs, make, fields, text, keep, PART_BYTES)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, detector: Detector | None, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with all spans replaced, and ``length`` (if such a column exists) counted anew. Null texts stay."""
    sent = docs.sparkSession.sparkContext.broadcast(detector)

    def make():
        def clean(texts: list[str]) -> dict:
            done = []
            for t in texts:
                base = base_spans(t)
                spans = base + added_spans(t, base, sent.value)
                done.append(redacted(t, spans) if spans else t)
            return {"_clean": done}

        return clean

    out = with_text_columns(docs, make, "_clean string", text, chunk_bytes=PART_BYTES)
    made = {text: f"IF(`{text}` IS NULL, NULL, _clean)"}
    if length in docs.columns:
        kind = docs.schema[length].dataType.simpleString()
        made[length] = f"IF(`{text}` IS NULL, `{length}`, CAST(length(_clean) AS {kind}))"
    return out.selectExpr(*[f"{made[c]} AS `{c}`" if c in made else f"`{c}`" for c in docs.columns])
