"""Invented labelled texts for the personal-information trees.

Sentences with personal data in many formats and contexts, and sentences with what looks alike
(builds, versions, hosts, tickets, product names), joined to short texts with known spans.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

ONSETS = "b br c cl d dr f fl g gr h j k kl l m n p pl qu r s sk st t tr v w z".split()
VOWELS = "a e i o u ae ei".split()
CODAS = "l m n r s st th rn x sh lk nd".split()
NOUNS = "window buffer report ledger draft index topic review sprint budget planner socket session billing rollout checklist gateway digest".split()
PRODUCTS = "Studio Board Pilot Harbor Notes Atlas Canvas Desk Relay Console Compass Cloud Labs Ledger".split()
VERBS = "moved drained merged paused rotated halved measured restored profiled".split()
STREETS = "Street St. St Avenue Ave Ave. Road Rd Lane Close Drive Court Way".split()
TAILS = "son berg ford ley ini ova wick mere quist bourne hagen mann sen elli".split()


class Maker:
    def __init__(self, names, rng: random.Random):
        self.r, self.names = rng, names
        self.given, self.family = sorted(names.given) or ["ana", "tom"], sorted(names.family) or ["smithson", "bergley"]

    def word(self, n: int = 2) -> str:
        return "".join(self.r.choice(ONSETS) + self.r.choice(VOWELS) + (self.r.choice(CODAS) if self.r.random() < 0.6 else "") for _ in range(n))

    def digits(self, n: int) -> str:
        return "".join(self.r.choice("0123456789") for _ in range(n))

    def given_name(self) -> str:
        w = self.r.choice(self.given) if self.r.random() < 0.8 else self.word()
        if self.r.random() < 0.06:
            w = w.replace("o", "ö", 1).replace("e", "ë", 1)
        return w.capitalize()

    def family_name(self) -> str:
        if self.r.random() < 0.06:
            return f"{self.word().capitalize()}-{self.word().capitalize()}"
        w = self.r.choice(self.family) if self.r.random() < 0.6 else self.word(self.r.choice((1, 2))) + self.r.choice(TAILS)
        return w.capitalize()

    def name(self) -> str:
        g, f, k = self.given_name(), self.family_name(), self.r.random()
        if k < 0.45:
            out = f"{g} {f}"
        elif k < 0.55:
            out = f"{f}, {g}"
        elif k < 0.65:
            out = f"{g[0]}. {f}"
        elif k < 0.75:
            out = f"{self.r.choice(('Mr.', 'Ms.', 'Mrs.', 'Dr.', 'Prof.'))} {f}"
        elif k < 0.83:
            out = f"{g} {self.r.choice('ABCDEFGHKLMNPRST')}. {f}"
        elif k < 0.91:
            out = f"{g} {f}".upper()
        else:
            out = f"{g} {f}".lower()
        return out

    def email(self) -> str:
        g, f = self.given_name().lower(), self.family_name().lower()
        local = self.r.choice((f"{g}.{f}", f"{f}_{g}", f"{g}{self.r.randint(1, 99)}", f"{g[0]}{f}", f"{g}+mem", f"{f}-{g[:3]}"))
        domain = self.word() + self.r.choice((".test", ".example", ".invalid", "-mail.example", ".com", ".org", ".de"))
        if self.r.random() < 0.3:
            domain = self.r.choice(("mail.", "post.", "desk.", "eu.")) + domain
        k = self.r.random()
        if k < 0.1:
            return f"{local} (at) {domain.replace('.', ' (dot) ')}"
        if k < 0.18:
            return f"{local} [at] {domain}"
        if k < 0.24:
            return f"{local} at {domain.replace('.', ' dot ')}"
        if k < 0.32:
            return f"{local}@{domain}".upper()
        if k < 0.4:
            return f"mailto:{local}@{domain}"
        return f"{local}@{domain}"

    def phone(self) -> str:
        d = self.digits
        a = self.r.choice("23456789") + d(2)
        forms = (f"({a}) 555-{d(4)}", f"{a}-555-{d(4)}", f"{a}.555.{d(4)}", f"+1 {a} 555 {d(4)}", f"+1{a}555{d(4)}", f"{a}-555-{d(4)} ext. {d(3)}", f"07{d(3)} {d(6)}", f"+44 7{d(3)} {d(3)} {d(3)}",
                 f"0044-7{d(3)}-{d(6)}", f"020 {d(4)} {d(4)}", f"0{self.r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+33 {self.r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", f"+49 {d(3)} {d(7)}", f"0{d(3)}/{d(7)}")
        return self.r.choice(forms)

    def id_number(self) -> tuple[str, str]:
        """Label (may be empty) and number."""
        d, r = self.digits, self.r
        k = r.random()
        if k < 0.35:
            n = r.choice((f"9{d(2)}-{d(2)}-{d(4)}", f"{d(3)}-{d(2)}-{d(4)}", f"{d(3)} {d(2)} {d(4)}"))
            return r.choice(("SSN ", "ssn: ", "social security number ", "" if "-" in n else "SSN ")), n
        if k < 0.6:
            a, z = r.choice(("QQ", "AB", "JK", "PW")), r.choice("ABCD")
            n = r.choice((f"{a}{d(6)}{z}", f"{a} {d(2)} {d(2)} {d(2)} {z}"))
            return r.choice(("NI number ", "national insurance ", "NINO ", "")), n
        if k < 0.8:
            return r.choice(("passport ", "passport no. ", "Passport #", "passport number ")), f"{r.choice('ABCXZL')}{d(8)}"
        return r.choice(("tax id ", "Steuer-ID ", "national ID ", "TIN ", "Tax ID: ")), r.choice((d(11), f"00{d(9)}"))

    def address(self) -> str:
        r, n = self.r, self.r.randint(1, 240)
        s, city, code = self.word().capitalize(), self.word().capitalize() + r.choice(("mouth", "haven", "stead", "burgh", "minster")), self.digits(5)
        k = r.random()
        if k > 0.95:
            return f"{r.choice(('P.O. Box', 'PO Box', 'P. O. Box'))} {self.digits(r.randint(2, 5))}{r.choice(('', f', {city}', f', {city} {code}'))}"
        if k < 0.5:
            num = f"{n}{r.choice(('', '', 'A', 'B', 'C'))}"
            flat = f"Flat {r.randint(1, 40)}, " if r.random() < 0.2 else ""
            apt = f", Apt {r.randint(1, 60)}" if r.random() < 0.3 else ""
            end = r.choice(("", f", {city}", f", {city} {code}"))
            return f"{flat}{num} {s}{r.choice(('', 'gate', 'field', 'mill', 'thorn'))} {r.choice(STREETS)}{apt}{end}"
        if k < 0.67:
            return f"{n} rue {r.choice(('de ', 'du ', 'des '))}{s}, {code} {city}"
        if k < 0.83:
            return f"calle {s} {n}, {code} {city}"
        return f"{s}{r.choice(('weg', 'straße', 'gasse', 'allee'))} {n}, {code} {city}"

    def piece(self, slot: str) -> tuple[str, str | None]:
        """The text of a slot of a frame, and its kind if it is personal."""
        r, d, w = self.r, self.digits, self.word
        if slot in ("email", "phone", "address"):
            return getattr(self, slot)(), slot
        if slot == "name":
            return self.name(), "name"
        if slot == "handle":
            return self.name().title(), "name"
        if slot == "number":
            return self.label_and_number[1], "id_number"
        if slot == "label":
            return self.label_and_number[0], None
        word = w() if r.random() < 0.8 else r.choice(self.given + self.family)
        plain = {
            "noun": lambda: r.choice(NOUNS), "verb": lambda: r.choice(VERBS), "word": lambda: word, "Word": lambda: word.capitalize(), "WORD": lambda: w()[:3].upper(),
            "prod": lambda: f"{word.capitalize()} {r.choice(PRODUCTS)}", "svc": lambda: f"{w()}-{r.choice(('hub', 'api', 'core', 'queue', 'lens'))}", "hex": lambda: f"{r.getrandbits(28):07x}",
            "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "ver": lambda: f"{r.randint(0, 9)}.{r.randint(0, 30)}.{r.randint(0, 30)}", **{f"d{n}": lambda n=n: str(r.randint(1, 9)) + d(n - 1) for n in (2, 3, 4, 5)},
            "big": lambda: str(r.randint(1, 9)) + d(r.randint(6, 11)), "run": lambda: f"{d(4)}-{d(2)}-{d(3)}", "time": lambda: f"20{r.randint(10, 29)}-{r.randint(10, 12)}-{r.randint(10, 28)}T{r.randint(10, 23)}:{r.randint(10, 59)}Z",
        }
        return plain[slot](), None

    def sentence(self, frame: str) -> list[tuple[str, str | None]]:
        """Pieces of a frame, each with its kind or None."""
        self.label_and_number = self.id_number()
        parts = re.split(r"{(\w+)}", frame)
        return [self.piece(p) if k % 2 else (p, None) for k, p in enumerate(parts) if k % 2 or p]


#: frames with personal data; slots are filled by ``Maker.piece``
PERSONAL = (
    "Yours, {name}", "Cheers, {name}", "-- {name}", "Best wishes\n{name}", "{name} called twice about the {noun}.", "Yesterday {name} explained why {svc} stalls.", "I owe {name} a coffee.",
    "Is {name} back from leave?", "Our accountant is {name}, reachable at {email}.", "@{handle} can you look at the {noun}?", "Thank you @{handle} for the quick help.", "{name} <{email}>", "From: {name} ({email})",
    "{name}, {phone}, {email}", "{name} - {phone}", "Meeting with {name} at four.", "According to {name} the {noun} was never {verb}.", "Let us ask whether {name} still owns {svc}.", "My sister {name} rents {address}.",
    "Dear {name}, your {noun} has been {verb}.", "Hello {name}, welcome aboard.", "{name} has moved to {address} with the kids.", "Patient: {name}, {label}{number}", "{name} signed, {label}{number}.", "Reviewed by {name} on Tuesday.",
    "{name} said yes, {name} said no.", "Drop a note to {email} once {svc} is up.", "Invite {email} and {email} as well.", "address for replies: {email}", "{email} bounced again.", "Her mailbox, {email}, is full.",
    "{phone} is good all week.", "we wrote down {phone} for {name}", "the front desk has {phone} now", "{name} / {phone} / {email}", "is {phone} still right?", "{phone} rings but no one is there", "leave {phone} with the driver", "{name} gave me {phone} and {address}",
    "{name}: {phone}", "since June it is {phone}", "{email}, {phone}", "say {phone} if they ask", "{phone}", "My new number: {phone}", "Tel. {phone}", "Fax {phone}, or phone {phone} at night.", "If nobody answers try {phone}.", "On call today: {phone}", "voicemail left at {phone} by {name}", "Mobile {phone}, office {phone}.",
    "Our flat is at {address}, second floor.", "Billing address: {address}", "The workshop on {address} closes at noon.", "Come by {address} tonight.", "She lives at {address}.", "write to us at {address}", "Parcel returned from {address}.", "Registered office {address}",
    "{label}{number} was printed on the letter.", "They typed {label}{number} into the chat.", "applicant with {label}{number}", "copy of {label}{number} attached", "Please check {label}{number} against the file.",
    "Kontakt: {name}, {email}", "Merci de prévenir {name} au {phone}.", "Wohnhaft {address}", "Vive en {address} desde mayo.", "Llama a {name}: {phone}",
)

#: frames with what looks alike
HARMLESS = (
    "ssh deploy@{word} -p {d4}", "{word}@{svc}:~$ tail -n {d3} {noun}.log", "git@{word}:{word}/{svc}", "user admin@{word} may restart run {run}", "npm i @{word}/{word}@{ver}", "bump @{word}/{svc} to {ver}, see {WORD}-{d5}",
    "ping {ip} took {d3} ms", "{ip} and {ip} answer, {ip} does not", "listening on {ip}:{d4}", "upgrade {svc} from {ver} to {ver}", "v{ver} broke the {noun} of {word}", "revert {hex}, keep {hex}", "{svc}#{hex} {verb} {d4} keys",
    "pipeline {run} failed at {time}", "job {run} of {Word} {noun} used {d4} MB", "{time} {svc} {verb} {d3} of {d4} rows", "from {time} until {time} nothing was {verb}", "{WORD}-{d5} duplicates {WORD}-{d5}",
    "{prod} now reads {noun} files", "we bought {prod} instead of {prod}", "is {prod} faster than {Word}?", "{Word} {noun} grew by {d2} percent", "the {noun} called {word} was {verb} twice", "{word} and {word} share one {noun}",
    "order {big} is paid", "tracking code {big}", "error {d4}: {noun} {big} not found", "offset {big} of partition {d2}", "size {d3} {d3} {d3} bytes", "{d4} {d4} {d4} samples in {word}", "ratio {d2}.{d3} after {d4} steps",
    "lines {d3}-{d3} and {d3}-{d4}", "{d2}/{d2}/{d4} {d2}:{d2} backup done", "the {Word} branch was {verb}", "new cluster: {word}{d2}, zone {word}-{d2}", "{Word} wrote nothing to disk", "({Word}, {Word}, {word}js)", "{Word} CI is green",
    "kubectl get pod {svc}-{hex} on {word}", "{svc} answers at {word} today", "look at noon, stop at {word}", "the {noun} was {verb} at {time} by {svc}", "{word} {verb} at {time}", "seen at {d2}:{d2} at {svc}", "{verb} at {time}, {verb} at {time}", "it {verb} at {d2} rows", "alert at {time} for {word}", "Class{Word} extends {Word}Base", "row {d5}, column {d3}: {noun}", "set {word}_{noun}={d4}", "trace {hex} {word} {WORD}-{d5}",
    "retry {d2} of {d3} in queue {word}", "way {d2} through the {noun}", "road {d2} of the {prod} plan", "drive {d2} of {svc} is full", "Drive {d3} at {ip} was {verb}", "close {d4} {noun}s", "row {d4} of {Word} {noun}", "Court {d2} of {prod}", "square {d2}, square {d3}", "lane {d2} is slower than lane {d2}.{d2}", "{Word} {noun} and {Word} {noun} were {verb}", "uses {d4} {Word} {noun}s a day", "shard {d4} {verb} {Word} for {prod}",
    "without {word} the {noun} {verb} {d4} times", "since {word} left {svc} at {ver}", "it seems that {word} {verb} {d3} {noun}s", "{prod}, {prod} and {prod} are equal here", "place {d2} went to {prod}", "{Word} has {d4} open {noun}s",
)


def jumbled(sentence: str, rng: random.Random) -> str:
    """The sentence with a third of its words in other places."""
    w = sentence.split(" ")
    for _ in range(len(w) // 3):
        a, b = rng.randrange(len(w)), rng.randrange(len(w))
        w[a], w[b] = w[b], w[a]
    return " ".join(w)


def labelled_texts(names, count: int, rng: random.Random, part: int | None = None) -> Iterator[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with their spans.  ``part`` 0 has three quarters of the frames, 1 the others, None all."""
    m = Maker(names, rng)
    personal, harmless = ([f for k, f in enumerate(frames) if part is None or (k % 4 == 3) == bool(part)] for frames in (PERSONAL, HARMLESS))
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.choice((1, 2, 2, 3))):
            if text:
                text += rng.choice((" ", " ", "\n", " -- ", ". ", ", "))
            if rng.random() < 0.5:
                for piece, kind in m.sentence(rng.choice(personal)):
                    if kind:
                        spans.append((len(text), len(text) + len(piece), kind))
                    text += piece
            else:
                plain = "".join(p for p, _ in m.sentence(rng.choice(harmless)))
                if rng.random() < 0.5:
                    plain = plain[:1].upper() + plain[1:] + "."
                text += rng.choice((plain, plain, plain, plain, plain, plain, plain.upper(), plain.replace(" ", "  "), jumbled(plain, rng)))
        yield text, spans
