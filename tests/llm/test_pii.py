import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import pii
from palimpsest.llm.gbdt import BoostedTrees
from palimpsest.llm.pii_samples import labelled_texts

PARTS = [(g, "given") for g in "Anselm Brida Corvin Delphine Edrik Fenna Gisbert Hanno Ilse Joris".split()] + [(f, "family") for f in "Aldersford Brinkley Cornwick Dunmere Elquist Farrowson Grimberg Holtini Ivarsova Jetford Kellson Lindberg Marwick Normere".split()]


@pytest.fixture(scope="module")
def names():
    return pii.NameWords.of(PARTS)


@pytest.fixture(scope="module")
def redactor(names):
    return pii.train(names, 2_500)[0]


def test_held_out_accuracy(names):
    """Texts of sentence frames that the trees were not fitted on."""
    _, quality = pii.train(names, 4_000)
    for kind, (precision, recall) in quality.items():
        assert precision >= 0.9 and recall >= 0.88, (kind, quality)


#: by hand, in no frame of the sample maker; _x_ marks what is personal
UNSEEN = [
    ("Could somebody forward the slides to _anselm.dunmere@paperboat.example_ before lunch?", "email"),
    ("the old account was brida_k@example, no wait, _brida_k@harbourmail.test_", "email"),
    ("You reach the editor through _corvin (at) lighthouse (dot) example_ these days.", "email"),
    ("I am stuck on the train, so phone me: _(415) 555-0134_", "phone"),
    ("The vet closes at six but _020 7946 0123_ is answered all night", "phone"),
    ("Grandma got a new landline last week, it is _+49 302 5550123_.", "phone"),
    ("+33 numbers cost extra, so please use _01 99 00 44 17_ instead.", "phone"),
    ("On page two I have to fill in my social security number _912-44-7781_, is that safe?", "id_number"),
    ("The clerk misread passport _C81422071_ at the gate", "id_number"),
    ("Her national insurance code, _QQ 12 34 56 C_, expired last spring.", "id_number"),
    ("We finally found the bakery, it is _27 Millfield Road_ right behind the church.", "address"),
    ("Deliveries for the studio belong to _Flat 9, 112 Thornmill Avenue_, not here.", "address"),
    ("Nous habitons _14 rue des Lilas, 75011 Paris_ depuis mars.", "address"),
    ("Mon colis est parti de _calle Mayor 21, 28013 Madrid_ hier", "address"),
    ("Last night _Delphine Aldersford_ won the chess club evening.", "name"),
    ("I think _Brinkley, Hanno_ has the keys to the shed.", "name"),
    ("Nobody told _ILSE KELLSON_ that the class was cancelled!", "name"),
    ("The speech by _Prof. Marwick_ went on for two hours", "name"),
    ("please thank _joris lindberg_ for feeding the cats", "name"),
    ("Would @_Fenna Holtini_ like the window seat?", "name"),
]
CLEAN = [
    "The build on host corvin-lens finished after 812 seconds, 20 tests skipped.", "Upgrade @marwick/parser to 4.12.0 and rerun shard 7.", "scp report.txt deploy@bastion:/srv/data", "Error 500123: partition 8841002 not found on 10.4.7.19",
    "Aldersford Studio exports faster than Brinkley Desk since v2.9.1.", "Commit 9fe21ab touched 14 files, see OPS-20413.", "The train leaves at 18:45 from platform 9, car 12.", "We sold 1200 tickets in 36 hours, 250 of them online.",
    "Pour the water at 93 degrees, wait 30 seconds, stir twice.", "Chapter 12 covers pages 200-245, skip table 7.", "Invoice 20250117 over 1,250.00 EUR is still open.", "Run 4471-20-118 started at 2025-11-02T08:15Z and drained in 40 minutes.",
]


def test_unseen_sentences_by_hand(names):
    redactor = pii.train(names)[0]
    texts = [t.replace("_brida_k@harbourmail.test_", "\x00brida_k@harbourmail.test\x00") if "harbourmail" in t else t.replace("_", "\x00") for t, _ in UNSEEN]
    spans = []
    for t in texts:
        a, b = t.index("\x00"), t.rindex("\x00") - 1
        spans.append((a, b))
    plain = [t.replace("\x00", "") for t in texts]
    hit = missed = extra = 0
    for (a, b), (_, kind), found in zip(spans, UNSEEN, redactor.findings(plain)):
        right = [f for f in found if f[2] == kind and f[0] < b and f[1] > a]
        hit, missed, extra = hit + bool(right), missed + (not right), extra + len(found) - len(right)
    wrong = [(t, f) for t, f in zip(CLEAN, redactor.findings(CLEAN)) if f]
    print(f"unseen by hand: found {hit} of {hit + missed}, {extra} wrong beside them, {len(wrong)} of {len(CLEAN)} clean sentences touched")
    assert hit >= 0.85 * len(UNSEEN) and extra <= 2 and len(wrong) <= 1, (hit, extra, wrong)


def test_redaction_is_readable(redactor):
    t = "Regards, Anselm Brinkley | (212) 555-0143 | anselm.brinkley@corvin.example"
    found = redactor.findings([t])[0]
    assert redactor.redact(t, found) == "Regards, [NAME] | [PHONE] | [EMAIL]"


@pytest.mark.parametrize("t", ["Log in as root@cornwick on port 8080, run job 8349-14-970.", "Our queue uses @corvin/hub@3.11 now.", "Host 10.104.45.176 logged 3 reads.", "Lane 780 of Corvin topic at 10.83.99.57 moved.", "Ticket OPS-58252 is at v2.31.8.", "", " ", "--"])
def test_look_alikes(redactor, t):
    assert redactor.findings([t]) == [[]]


def test_frame_with_nulls_long_and_repeated(spark):
    mail = "write to joris_dunmere@mail.corvin.test please"
    rows = [("episode", "1", mail), ("episode", "1", mail), ("episode", "2", None), ("episode", "3", ""), ("semantic", "4", "plain words. " * 20_000 + mail), ("semantic", None, mail)]
    df = spark.createDataFrame(rows, "tier string, id string, content string").withColumns({"kinds": F.lit(1), "redacted": F.lit("x")})
    parts = spark.createDataFrame(PARTS, "name_token string, token_kind string")
    got = {(r["tier"], r["id"]): (r["kinds"], r["redacted"]) for r in pii.find(df, parts, 1_500).collect()}
    assert got[("episode", "1")] == (["email"], "write to [EMAIL] please")
    assert got[("episode", "2")] == ([], None) and got[("episode", "3")] == ([], "")
    assert got[("semantic", "4")][0] == ["email"] and len(got) == 4
    assert pii.find(df.limit(0), parts.limit(0), 600).count() == 0


def test_boosted_trees_learn_a_rule():
    r = np.random.default_rng(0)
    x = r.normal(size=(2000, 5))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    m = BoostedTrees().fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:])
    assert ((m.probability(x[1500:]) >= m.threshold) == (y[1500:] > 0)).mean() > 0.97
