"""Problem 4 - personal information inside free text.

Method: candidate gradient boosting.  High-recall generators propose overlapping spans of five
kinds; format and context features of each span go to boosted trees, one set a kind; calibrated
thresholds select spans; of overlapping ones the likeliest stays; what stays is replaced by a
typed placeholder.

The trees are fitted on ``SAMPLE_TEXTS`` invented labelled texts (the bound of the sample) made
from a fixed seed and the given name words; a quarter of them, of sentence frames of their own, is
held out for calibration.

Result for the unusual cases
* null or empty text: no finding, text unchanged (null stays null).
* a text of any length is searched whole.  Repeated findings of a kind: one row.
* no name words: names are found by form and context alone.
"""

from __future__ import annotations

import random
import re
import unicodedata
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.gbdt import BoostedTrees

KINDS = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
SAMPLE_TEXTS = 6_000
SEED = 7

#: fixed values: words that introduce or follow a kind, and words of machines, products and streets
CUES = {
    "phone": "call phone tel telephone telefon mobile cell handy fax dial ring number text sms voicemail appelez llama",
    "id_number": "ssn social security passport insurance national ni nino tax tin steuer id identity",
    "address": "live lives lived living moved ship deliver home address street send visit post resident flat apt office",
    "name": "regards thanks cheers yours sincerely wishes name mr mrs ms dr prof dear hi hello from by with met ask tell",
    "email": "write mail mailto email contact reply cc mailbox",
}
MACHINE = set("job build port host commit version run ticket trace sha node log release tag rev lane root".split())
PRODUCT = set("ledger studio board pilot harbor notes atlas canvas desk relay console compass cloud ci mesh inc ltd llc gmbh labs team group api hub core queue index server service store worker".split())
#: a product word with letters in the wrong order is that word still
PRODUCT_LETTERS = {"".join(sorted(w)) for w in PRODUCT}
TITLES = set("mr mrs ms miss dr prof herr frau mme mlle sr sra".split())
STREET = "street st avenue ave road rd lane ln close drive dr court ct way place pl boulevard blvd terrace square sq crescent row grove".split()
COMMON = set(
    "the a an we i it our my next for ask in on at by if is are was be to of and or so as please can could should would will whenever without between according setting since because after before"
    " lane host ticket commit log trace see this that these those your you he she they remember text call contact account payroll new hire ship write forwarded regards thanks dear hello hi re fwd note"
    " flat apt number no passport ssn id tax national insurance social security form mail email phone tel der die das und wir nous le la les el los las une un une peux kannst merk rappelle recuerda"
    " with from their there here what when why how not do does did has have had monday tuesday wednesday thursday friday saturday sunday january february march april may june july august"
    " september october november december street avenue road close drive rue calle observers during".split()
)
#: fixed values: function words
SMALL = set("a an the and or but of to in on at by for from with about that is was has had will can if as when who de la le von zu und et y con para".split())
CUE_SETS = {k: set(v.split()) for k, v in CUES.items()}

_AT = r"(?:@|\s*[(\[{<]\s*at\s*[)\]}>]\s*|\s+at\s+)"
_DOT = r"(?:\.|\s*[(\[{<]\s*dot\s*[)\]}>]\s*|\s+dot\s+)"
EMAIL = re.compile(rf"(?<![\w.+-])(?:mailto:)?[\w][\w.+%-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)*", re.I)
NUMBER = re.compile(r"(?<![\w.@/-])(?:\+\s?|\(\+?)?\d[\d().\-/ \t]{5,22}\d(?:\s*(?:ext\.?|x|extension)\s*\d{1,5})?(?![\w])", re.I)
IDENT = re.compile(r"(?<![\w@/.-])(?:[A-Z]{1,2}[ -]?(?:\d[ -]?){5,9}[A-Z]?|\d{3}[- ]?\d{2}[- ]?\d{4}|\d{8,12}|\d{2,3}(?:[ .]\d{3}){2,3}|[A-Z0-9]{8,12}(?<=\d))(?![\w-])")
_CAP = r"[^\W\d_][\w'’-]*"
ADDRESS = re.compile(
    rf"(?:\b(?:flat|apt|unit|suite)\.?\s*\d+\w?,\s*)?\b\d+\s?[a-z]?,?\s+(?:(?:rue|avenue|boulevard|place|chemin|impasse)\s+(?:d\w*[ '’]\s*(?:la\s+|les\s+)?)?{_CAP}|{_CAP}(?:\s{_CAP})?\s(?:{'|'.join(STREET)})\b\.?)"
    rf"|\bP\.?\s?O\.?\s?Box\s+\d+"
    rf"|\b(?:calle|avenida|plaza|paseo|camino|via|rua)\s+(?:de\s+)?(?:la\s+)?{_CAP},?\s+\d+\w?"
    rf"|\b{_CAP}(?:weg|straße|strasse|str\.|gasse|allee|platz|ufer|damm)\s+\d+\w?"
    rf"|\b(?:{'|'.join(STREET)})\.?\s+\d[\d.]*\b",
    re.I,
)
_TOKEN = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_WORD = re.compile(r"[^\W_]+")


@cache
def _plain_table() -> dict[int, str]:
    """One-to-one compatibility forms and blanks, so that places in the text stay the same."""
    out = {}
    for c in [*range(0x00A0, 0x0250), *range(0x2000, 0x2070), *range(0x3000, 0x3100), *range(0xFF00, 0xFFF0)]:
        n = unicodedata.normalize("NFKC", chr(c))
        if len(n) == 1 and n != chr(c):
            out[c] = n
    return out


def plain(text: str) -> str:
    return text if text.isascii() else text.translate(_plain_table())


@dataclass(frozen=True)
class NameWords:
    given: frozenset[str]
    family: frozenset[str]
    endings: tuple[str, ...]

    @staticmethod
    def of(rows: list[tuple[str | None, str | None]]) -> NameWords:
        given = frozenset(t.lower() for t, k in rows if t and k == "given")
        family = frozenset(t.lower() for t, k in rows if t and k == "family")
        ends = Counter(w[-n:] for w in family if len(w) > 6 for n in (3, 4, 5, 6) if len(w) > n + 2 and (n > 3 or w[-3] in 'aeiouy' or w[-1] in 'aeiouy'))
        common = [e for e, n in ends.items() if n >= max(3, 0.03 * len(family))]
        # an ending that is nearly always the tail of one longer ending says nothing by itself
        common = [e for e in common if not any(len(x) == len(e) + 1 and x.endswith(e) and n >= 0.8 * ends[e] for x, n in ends.items())]
        return NameWords(given, family, tuple(sorted(common, key=lambda e: (-len(e), e))))


def name_spans(text: str, names: NameWords) -> list[tuple[int, int, list[tuple[str, int]]]]:
    """Runs of tokens that may be a person's name: (start, end, tokens with classes).

    Classes are bits: 1 given, 2 family, 4 family ending, 8 capital first, 16 all capitals,
    32 initial, 64 title.
    """
    tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    marks = []
    for t, a, b in tokens:
        low = t.lower()
        c = (1 if low in names.given else 0) | (2 if low in names.family else 0)
        if not c and len(low) > 5 and low.endswith(names.endings):
            c |= 4
        if t[0].isupper():
            c |= 16 if len(t) > 1 and t.isupper() else 8
            if len(t) == 1 and low != "i" and text[b : b + 1] == ".":
                c |= 32
        if low in TITLES and t[0].isupper():
            c |= 64
        if low in COMMON and not c & 71 or not c & 7 and (low in PRODUCT or len(low) > 4 and "".join(sorted(low)) in PRODUCT_LETTERS):
            c = 0
        before = text[a - 1] if a else " "
        if before in "-/_\\#" or text[b : b + 1] in ("-", "/", "_") or (before == "." and a > 1 and text[a - 2].isalnum()) or (before == "@" and a > 1 and text[a - 2].isalnum()) or before.isdigit() or text[b : b + 1].isdigit():
            c = 0
        marks.append(c)
    out, k, n = [], 0, len(tokens)
    while k < n:
        if not marks[k]:
            k += 1
            continue
        j, lower = k, not marks[k] & 24
        while j + 1 < n and j - k < 4 and marks[j + 1]:
            gap = text[tokens[j][2] : tokens[j + 1][1]]
            if not (gap == " " or gap == ". " and marks[j] & 96 or gap == ", " and j == k and (marks[j] & 6 or marks[j + 1] & 1) or gap == "’"):
                break
            if (not marks[j + 1] & 24) != lower and not (marks[k] & 64):
                break
            j += 1
        seeded = any(m & 7 for m in marks[k : j + 1])
        shouted = all(m & 16 for m in marks[k : j + 1])
        if seeded or j > k and not shouted:
            if j == k and not marks[k] & 27:
                k += 1
                continue  # one small word with a mere family ending
            out.append((tokens[k][1], tokens[j][2], [(tokens[i][0], marks[i]) for i in range(k, j + 1)]))
        k = j + 1
    return out


def _around(text: str, a: int, b: int) -> tuple[list[str], list[str]]:
    left = [w.lower() for w in _WORD.findall(text[max(0, a - 48) : a])][-5:]
    right = [w.lower() for w in _WORD.findall(text[b : b + 48])][:5]
    return left, right


def _context(text: str, a: int, b: int, kind: str) -> list[float]:
    left, right = _around(text, a, b)
    last, nxt = (left[-1] if left else ""), (right[0] if right else "")
    before, after = text[a - 1 : a] or "\n", text[b : b + 1] or "\n"
    near = [w for w in left[-3:]]
    out = [len(CUE_SETS[k].intersection(near)) for k in KINDS]
    out += [last in CUE_SETS[kind], nxt in CUE_SETS[kind], len(CUE_SETS[kind].intersection(right[:2]))]
    out += [len(MACHINE.intersection(left[-2:])), nxt in MACHINE, nxt in PRODUCT]
    out += ["\n@(<[|,:;.#-/ =\"".find(before), "\n)>]|,:;.#-/ =\"(".find(after)]
    return [float(v) for v in out]


def _number_form(s: str) -> list[float]:
    groups = re.findall(r"\d+", s)
    digits = "".join(groups)
    lens = [len(g) for g in groups[:5]] + [0] * (5 - min(5, len(groups)))
    return [len(s), len(digits), len(groups), *lens, s[:1] == "+", digits[:2] == "00", digits[:1] == "0", "(" in s, s.count("."), s.count("-"), s.count(" "), "/" in s,
            sum(c.isalpha() for c in s), s[:1].isalpha(), s[-1:].isalpha(), "ext" in s.lower() or "x" in s.lower(), sum(int(g) > 255 for g in groups)]


def candidates(text: str, names: NameWords) -> list[tuple[str, int, int, list[float]]]:
    """(kind, start, end, features) of every proposed span of a folded text."""
    out = []
    low = text.lower()
    if "@" in text or " at" in low or "(at" in low or "[at" in low:
        for m in EMAIL.finditer(text):
            s = m.group()
            local, _, domain = re.sub(_AT, "@", s, count=1, flags=re.I).partition("@")
            parts = re.split(_DOT, domain, flags=re.I)
            if len(parts[-1]) < 2:
                continue  # no top-level domain has one letter
            form = [len(s), len(parts), len(parts[-1]), parts[-1].isalpha(), any(p.isdigit() for p in parts), parts[0][:1].isdigit(), "@" in s, "dot" in s.lower(), bool(re.search(r"[(\[{<]\s*at", s, re.I)),
                    bool(re.search(r"\sat\s", s, re.I)), len(local), s.lower().startswith("mailto"), any(c in local for c in "._+-"), any(c.isdigit() for c in local), text[max(0, m.start() - 1) : m.start()] in ("/", "@")]
            out.append(("email", m.start(), m.end(), [float(v) for v in form] + _context(text, m.start(), m.end(), "email")))
    if any(c.isdigit() for c in text):
        for m in NUMBER.finditer(text):
            n = sum(c.isdigit() for c in m.group())
            if 7 <= n <= 20:
                out.append(("phone", m.start(), m.end(), [float(v) for v in _number_form(m.group())] + _context(text, m.start(), m.end(), "phone")))
        for m in IDENT.finditer(text):
            out.append(("id_number", m.start(), m.end(), [float(v) for v in _number_form(m.group())] + _context(text, m.start(), m.end(), "id_number")))
        for m in ADDRESS.finditer(text):
            s = m.group()
            w = s.split()
            tail = text[m.end() : m.end() + 40]
            form = [len(s), len(w), s[:1].isdigit(), w[0].lower().rstrip(".") in STREET, w[-1].lower().rstrip(".") in STREET, any(x.lower().rstrip(".,") in STREET for x in w), w[-1][:1].isdigit(), "rue" in s.lower(), "calle" in s.lower(),
                    bool(re.search(r"weg|str|gasse|allee|platz", s, re.I)), "box" in s.lower(), sum(x[:1].isupper() for x in w), bool(re.match(r"\.?,? *\d{4,5}\b", tail)), bool(re.match(r"\.?, *(?:Apt|Flat|[A-Z]\w+)", tail)), tail.startswith(" of "),
                    "." in s]
            out.append(("address", m.start(), m.end(), [float(v) for v in form] + _context(text, m.start(), m.end(), "address")))
    for a, b, toks in name_spans(text, names):
        marks = [c for _, c in toks]
        before = text[max(0, a - 2) : a]
        tail = text[b : b + 60]
        form = [len(toks), sum(c & 1 for c in marks), sum(c >> 1 & 1 for c in marks), sum(c >> 2 & 1 for c in marks), sum(c >> 3 & 1 for c in marks), sum(c >> 4 & 1 for c in marks), sum(c >> 5 & 1 for c in marks),
                sum(c >> 6 & 1 for c in marks), not any(c & 24 for c in marks), "," in text[a:b], before.endswith("@"), before in (". ", "? ", "! ", "") or before.endswith("\n"),
                "@" in tail, bool(re.search(r"\d{3}", tail)), bool(re.match(r" [|(<]", tail)), bool(re.match(r",? \d+", tail)), "/" in tail[:12], any(t.lower() in COMMON for t, _ in toks), max(len(t) for t, _ in toks),
                marks[-1] & 6 > 0, marks[0] & 1, "-" in text[a:b]]
        around = [ch for ch in text[max(0, a - 30) : a] + text[b : b + 30] if ch.isalpha()]
        form.append(sum(ch.isupper() for ch in around) / max(1, len(around)))
        left, right = _around(text, a, b)
        # a function word beside it, or the next word small: what a sentence has around a person
        form += [bool(left) and left[-1] in SMALL, bool(right) and right[0] in SMALL, tail[:2].strip()[:1].islower(), not left, not right]
        out.append(("name", a, b, [float(v) for v in form] + _context(text, a, b, "name")))
    return out


class Redactor:
    """Generators plus fitted trees of the five kinds."""

    def __init__(self, names: NameWords, models: dict[str, BoostedTrees]):
        self.names, self.models = names, models

    def findings(self, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
        """Selected spans (start, end, kind) of each text, in order, without overlap."""
        spans: dict[str, list[tuple[int, int, int]]] = {k: [] for k in KINDS}
        rows: dict[str, list[list[float]]] = {k: [] for k in KINDS}
        for i, t in enumerate(texts):
            if t:
                for kind, a, b, x in candidates(plain(t), self.names):
                    spans[kind].append((i, a, b))
                    rows[kind].append(x)
        taken: list[list[tuple[float, int, int, str]]] = [[] for _ in texts]
        for kind in KINDS:
            if rows[kind]:
                m = self.models[kind]
                p = m.probability(np.array(rows[kind]))
                for (i, a, b), q in zip(spans[kind], p):
                    if q >= m.threshold:
                        taken[i].append((q + (kind == "email"), a, b, kind))
        out = []
        for found in taken:
            kept: list[tuple[int, int, str]] = []
            for _, a, b, kind in sorted(found, key=lambda s: (-s[0], s[1] - s[2], s[1])):
                if all(b <= x or a >= y for x, y, _ in kept):
                    kept.append((a, b, kind))
            out.append(sorted(kept))
        return out

    def redact(self, text: str | None, found: list[tuple[int, int, str]]) -> str | None:
        if not text or not found:
            return text
        out, at = [], 0
        for a, b, kind in found:
            out += [text[at:a], PLACEHOLDER[kind]]
            at = b
        return "".join(out) + text[at:]


def _examples(names: NameWords, texts: int, rng: random.Random, part: int | None) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """Features and labels of the candidates of invented texts, by kind."""
    from palimpsest.llm.pii_samples import labelled_texts

    xs: dict[str, list] = {k: [] for k in KINDS}
    ys: dict[str, list] = {k: [] for k in KINDS}
    for text, spans in labelled_texts(names, texts, rng, part):
        for kind, a, b, x in candidates(plain(text), names):
            xs[kind].append(x)
            ys[kind].append(float(any(k == kind and a < e and s < b and min(b, e) - max(a, s) >= 0.5 * min(b - a, e - s) for s, e, k in spans)))
    return {k: np.array(v) for k, v in xs.items()}, {k: np.array(v) for k, v in ys.items()}


def train(names: NameWords, texts: int = SAMPLE_TEXTS, seed: int = SEED) -> tuple[Redactor, dict[str, tuple[float, float]]]:
    """A redactor fitted on invented labelled texts, and its precision and recall by kind.

    Thresholds are calibrated, and the figures measured, on a quarter of the texts whose sentence
    frames occur in no text the trees are fitted on.
    """
    rng = random.Random(seed)
    (x, y), (held_x, held_y) = _examples(names, texts - texts // 4, rng, 0), _examples(names, texts // 4, rng, 1)
    models, quality = {}, {}
    for kind in KINDS:
        m = BoostedTrees().fit(x[kind], y[kind]).calibrate(held_x[kind], held_y[kind])
        hit, true = m.probability(held_x[kind]) >= m.threshold, held_y[kind] > 0
        quality[kind] = (float(true[hit].mean()) if hit.any() else 0.0, float(hit[true].mean()))
        models[kind] = m
    return Redactor(names, models), quality


def find(rows: DataFrame, name_parts: DataFrame, texts: int = SAMPLE_TEXTS) -> DataFrame:
    """``rows(tier, id, content)`` -> (tier, id, kinds, redacted), a row for each row with an id."""
    spark = rows.sparkSession
    words = [tuple(r) for r in name_parts.select("name_token", "token_kind").collect()]  # a reference list of fixed size
    redactor = spark.sparkContext.broadcast(train(NameWords.of(words), texts)[0])

    def run(batches):
        for batch in batches:
            content = batch.column("content").to_pylist()
            found = redactor.value.findings(content)
            kinds = [sorted({k for _, _, k in f}) for f in found]
            clean = [redactor.value.redact(t, f) for t, f in zip(content, found)]
            yield pa.RecordBatch.from_arrays([batch.column("tier"), batch.column("id"), pa.array(kinds, pa.list_(pa.string())), pa.array(clean, pa.string())], names=["tier", "id", "kinds", "redacted"])

    return rows.where(F.col("id").isNotNull()).select("tier", "id", "content").mapInArrow(run, "tier string, id string, kinds array<string>, redacted string")
