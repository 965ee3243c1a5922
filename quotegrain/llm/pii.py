"""Personal data by candidate gradient boosting.

Generators with high recall propose overlapping spans per kind: the plain formats, and looser ones (spelled-out addresses, numbers
inside longer runs, national phone formats). Boosted trees score each proposal from its format and context. Thresholds per
kind are set on calibrated scores of held-out rows. Spans of the plain formats always stay; the trees add to them.

The trees learn from real texts of a bounded sample into which made-up personal data and look-alikes are written at random
places, so that the truth is known.
"""

from __future__ import annotations

import hashlib
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quotegrain.llm.boosting import BoostedTrees
from quotegrain.llm.common import each_batch, hash_share, texts

KINDS = ("email", "ip", "card", "phone")
#: About how many documents teach, and the share of right spans that a threshold must reach on held-out rows.
SAMPLE, PRECISION = 600, 0.99
#: Filler texts that teach beside the sample.
FILLERS = 60
#: Insertions into each of them.
INSERTIONS = 40

# The plain formats are fixed by contract.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SPELLED = re.compile(r"[A-Za-z0-9._%+-]+\s?(?:@|\(at\)|\[at\]|\bat\b)\s?[A-Za-z0-9-]+(?:\s?(?:\.|\(dot\)|\[dot\]|\bdot\b)\s?[A-Za-z0-9-]+)+", re.I)
#: A full stop after which a spelled-out address may be over.
STOP = re.compile(r"\.\s")
DOTTED = re.compile(r"[0-9]{1,3}(?=((?:[.,][0-9]{1,3}){3}))")
GROUPS = re.compile(r"[0-9]+(?:[\x20./-][0-9]+)*")
NATIONAL = re.compile(r"(?:\([0-9]{2,5}\)|\b[0-9]{2,5})[\x20./-]{0,2}[0-9]{3,4}[\x20./-][0-9]{3,5}\b|\b00[0-9](?:[\x20().-]{0,2}[0-9]){7,13}\b")
HINTS = {
    "email": ("mail", "contact", "write", "address"), "ip": ("ip", "host", "server", "login", "address"),
    "card": ("card", "visa", "credit", "pay", "account"), "phone": ("phone", "tel", "call", "fax", "mobile", "dial"),
}
AGAINST = ("version", "v", "order", "isbn", "id", "invoice", "page", "section", "build", "release", "ref", "token", "password", "key", "sha")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if k % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _byte_part(part: str) -> bool:
    bare = part.lstrip("0")
    return len(bare) <= 3 and int(bare or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the plain formats, by kind and start. Leftmost and not overlapping per kind; failing matches are dropped without a retry."""
    out = []
    if "@" in text:
        out += [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    if DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(map(_byte_part, m[0].split(".")))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", m.start(), m.end()))
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


DIGIT = re.compile("[0-9]")
#: What every spelled-out address holds.
AT = re.compile(r"@|\bat\b|[(\[]at[)\]]", re.I)
PROMPT = re.compile(rf"[0-9]|{AT.pattern}", re.I)


def proposals(text: str) -> list[tuple[str, int, int]]:
    """Candidate spans of every kind, overlapping, besides those of the plain formats."""
    out = set()
    if AT.search(text):
        for m in SPELLED.finditer(text):
            out.add(("email", m.start(), m.end()))
            end = STOP.search(text, m.start(), m.end())
            if end and SPELLED.fullmatch(text, m.start(), end.start()):
                out.add(("email", m.start(), end.start()))
    if not DIGIT.search(text):
        return sorted(out)
    for m in DOTTED.finditer(text):
        out.add(("ip", m.start(), m.end(1)))
    for m in GROUPS.finditer(text):
        if sum(c.isdigit() for c in m[0]) < 13:
            continue
        cuts = [(g.start() + m.start(), g.end() + m.start()) for g in DIGITS.finditer(m[0])]
        for i, (a, _) in enumerate(cuts):
            n = 0
            for s, b in cuts[i:]:
                n += b - s
                if n > 19:
                    break
                if n >= 13:
                    out.add(("card", a, b))
    out |= {("phone", m.start(), m.end()) for m in NATIONAL.finditer(text)}
    return sorted(out)


DIGITS = re.compile("[0-9]+")


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[a:b]
    digits = _digits(s)
    seps = [c for c in s if not c.isalnum()]
    before, after = text[max(0, a - 1) : a], text[b : b + 1]
    context = re.findall(r"[a-z]+", text[max(0, a - 32) : a].lower())[-3:]
    groups = [len(g) for g in DIGITS.findall(s)]
    low = s.lower()
    return [
        *(float(kind == k) for k in KINDS), len(s), len(digits), len(seps), len(set(seps)), len(groups), max(groups, default=0), min(groups, default=0),
        float(bool(digits) and luhn(digits)), float(kind == "ip" and all(_byte_part(p) for p in re.split("[.,]", s))), float("," in s),
        float(s[:1] == "("), float(s[:2] == "00"), float("@" in s), float("(at)" in low or "[at]" in low), float("(dot)" in low or "[dot]" in low or " dot " in low),
        float(before.isalnum()), float(after.isalnum()), float(before in ".,-+/=#_" and before != ""), float(after in "-/=_@" and after != ""),
        float(after in "." and text[b + 1 : b + 2].isdigit()), float(before == "." and text[max(0, a - 2) : a - 1].isdigit()),
        float(any(h in w for w in context for h in HINTS[kind])), float(any(w in AGAINST for w in context)), float(digits[:1] in ("3", "4", "5", "6")),
        float(len(s.rsplit(".", 1)[-1]) if kind == "email" else 0), float(bool(STOP.search(s))),
    ]


# Made-up material for the labelled texts.
_HOSTS = ("mail", "example", "post", "web", "inbox", "corp")
_ENDS = ("com", "org", "net", "de", "fr", "es", "io")


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghiklmnoprstuv") for _ in range(r.randint(3, 8)))


def _card(r: random.Random, right: bool) -> str:
    body = r.choice("3456") + "".join(r.choice("0123456789") for _ in range(r.choice((14, 14, 13, 12, 15))))
    good = next(c for c in "0123456789" if luhn(body + c))
    full = body + (good if right else r.choice([c for c in "0123456789" if c != good]))
    sep = r.choice(("", "", " ", "-", ".", "/"))
    return sep.join(full[k : k + 4] for k in range(0, len(full), 4)) if sep else full


def _written(r: random.Random) -> tuple[str, str, str | None]:
    """(text before, inserted, kind or None): personal data, or a look-alike with None."""
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    parts = lambda top: ".".join(str(r.randint(0, top)) for _ in range(4))
    hint = lambda kind: r.choice(("", "", f"{r.choice(HINTS[kind])} ", f"{r.choice(HINTS[kind])}: "))
    against = lambda: r.choice(("", f"{r.choice(AGAINST)} ", f"{r.choice(AGAINST)}="))
    at, dot = r.choice((("@", "."), (" (at) ", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) "), (" at ", " dot "), ("@ ", ".")))
    choice = r.randrange(12)
    if choice == 0:
        return hint("email"), f"{_name(r)}{r.choice(('', '.' + _name(r), n(2)))}{at}{r.choice(_HOSTS)}{dot}{r.choice(_ENDS)}", "email"
    if choice == 1:
        return hint("ip"), parts(255), "ip"
    if choice == 2:
        return hint("card"), _card(r, True), "card"
    if choice == 3:
        return hint("card") + n(r.randint(1, 3)) + " ", _card(r, True), "card"
    if choice == 4:
        sep = r.choice(" -.")
        return hint("phone"), r.choice((f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}{sep}{n(3)}{sep}{n(4)}", f"0{n(3)}/{n(3)}-{n(4)}", f"00{r.randint(1, 9)}{n(1)} {n(3)} {n(6)}")), "phone"
    if choice == 5:
        return against(), _card(r, False), None
    if choice == 6:
        return against(), n(r.randint(5, 24)), None
    if choice == 7:
        return against(), ".".join(str(r.randint(0, 40)) for _ in range(r.choice((2, 3, 5, 6)))), None
    if choice == 8:
        return against(), ".".join(str(r.randint(200, 999)) for _ in range(4)), None
    if choice == 9:
        return against(), "".join(r.choice("0123456789abcdef") for _ in range(r.choice((20, 32, 40)))), None
    if choice == 10:
        return "", f"{_name(r)} at {_name(r)}" + r.choice((".", f". {_name(r).title()}", f" dot {_name(r)}?")), None
    return against(), r.choice((f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}.{n(2)}.{n(4)} {n(2)}:{n(2)}", f"{n(2)}/{n(3)}", f"{n(3)}-{n(1)}-{n(2)}-{n(6)}-{n(1)}", f"{n(1)},{n(3)},{n(3)},{n(3)}")), None


def labelled(text: str, seed: int, times: int = INSERTIONS) -> tuple[str, set[tuple[str, int, int]]]:
    """The text with ``times`` insertions between its words, and the spans of the personal data in it, plain formats included."""
    r = random.Random(seed)
    words = text.split() or [""]
    places = sorted(r.randrange(len(words)) for _ in range(times))
    out, truth, size, k = [], set(), 0, 0
    for place in places:
        piece = " ".join(words[k:place]) + " "
        lead, body, kind = _written(r)
        at = size + len(piece) + len(lead)
        if kind:
            truth.add((kind, at, at + len(body)))
        piece += lead + body + r.choice((" ", ". ", ", ", "\n"))
        out.append(piece)
        size += len(piece)
        k = place
    made = "".join(out) + " ".join(words[k:])
    return made, truth | set(base_spans(made))


@dataclass
class Detector:
    trees: BoostedTrees
    thresholds: dict[str, float]

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """All spans, by kind and start: the plain formats, then proposals above their threshold, best first, that overlap none of their kind."""
        found = base_spans(text)
        if not PROMPT.search(text):
            return found
        taken = {k: [(a, b) for kind, a, b in found if kind == k] for k in KINDS}
        open_ = [c for c in proposals(text) if not any(a < c[2] and c[1] < b for a, b in taken[c[0]])] if found else proposals(text)
        if open_:
            p = self.trees.probability(np.array([describe(text, *c) for c in open_]))
            for q, (kind, a, b) in sorted(zip(p.tolist(), open_, strict=True), key=lambda x: (-x[0], x[1])):
                if q >= self.thresholds[kind] and not any(x < b and a < y for x, y in taken[kind]):
                    taken[kind].append((a, b))
        return [(k, a, b) for k in KINDS for a, b in sorted(taken[k])]


def fit(docs: DataFrame, sample: int = SAMPLE) -> Detector:
    """Train on about ``sample`` documents, chosen by a hash of the id. Tasks write the insertions and describe the candidates.

    Plain filler texts with insertions teach beside them, at every size of the table, so that a small or empty one has a detector too.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [r for doc, text in zip(batch["doc_id"].to_pylist(), texts(batch["text"]), strict=True) for r in lessons(text, doc or 0)]
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.bool_()), pa.array([r[1] for r in rows], pa.list_(pa.float32())), pa.array([r[2] for r in rows], pa.float32())],
            names=["held", "x", "y"])

    rows = hash_share(docs.where("text is not null").select("doc_id", "text"), docs.select("doc_id"), None, sample)
    found = rows.mapInArrow(each_batch(run), "held boolean, x array<float>, y float").toArrow()
    taught = [(h, x, y) for h, x, y in zip(*(c.to_pylist() for c in found.columns), strict=True)]
    return train(sorted(taught) + [r for k in range(FILLERS) for r in lessons("a b c " * 200, k)])


def lessons(text: str, seed: int) -> list[tuple[bool, list[float], float]]:
    """(held out, description, 1 if right) of every candidate of a text with insertions; a third of the texts is held out."""
    made, truth = labelled(text, seed)
    return [(seed % 3 == 2, describe(made, *c), float(c in truth)) for c in proposals(made)]


def train(taught: list[tuple[bool, list[float], float]]) -> Detector:
    """Two thirds grow the trees, the held-out third sets calibration and thresholds."""
    grown, held = ([], []), ([], [])
    for out, described, right in taught:
        x, y = held if out else grown
        x.append(described)
        y.append(right)
    x, y = np.array(grown[0]), np.array(grown[1])
    trees = BoostedTrees().fit(x, y)
    x, y = np.array(held[0]), np.array(held[1])
    trees.calibrate(x, y)
    p = trees.probability(x)
    thresholds = {}
    for j, kind in enumerate(KINDS):
        own = x[:, j] == 1
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(right >= PRECISION)
        thresholds[kind] = max(0.5, float(p[own][order][ok[-1]])) if len(ok) else 1.1
    return Detector(trees, thresholds)


def detect(docs: DataFrame, detector: Detector) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) per row of ``docs``(doc_id, text)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in texts(batch["text"]):
            base = base_spans(text)
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(written(base).encode()).hexdigest(), written(detector.spans(text))))
        names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
        return pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(c) for c in zip(*rows, strict=True))], names=["doc_id", *names])

    return docs.mapInArrow(each_batch(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span as its kind in brackets; spans that overlap become one, named after the first."""
    out, end = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join(out) + text[end:]


def personal_data(docs: DataFrame) -> DataFrame:
    """Spans of personal data per row of ``docs``(doc_id, text), in code points, end exclusive.

    Null or empty text: no spans and the hash of the empty text. Repeated rows and ids stay. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return detect(rows, fit(rows))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind; ``n_chars``, where there is one, follows. Null texts stay null."""
    detector = fit(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    names = docs.columns

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        before = batch["text"].to_pylist()
        after = [t and redacted(t, detector.spans(t)) for t in before]
        cols = dict(zip(names, batch.columns, strict=True))
        cols["text"] = pa.array(after, batch["text"].type)
        if "n_chars" in cols:
            sizes = [n if a == b else len(b) for n, a, b in zip(cols["n_chars"].to_pylist(), before, after, strict=True)]
            cols["n_chars"] = pa.array(sizes, cols["n_chars"].type)
        return pa.RecordBatch.from_arrays(list(cols.values()), names=names)

    return docs.mapInArrow(each_batch(run), docs.schema)
