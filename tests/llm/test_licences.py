"""Held-out accuracy of the licence model, and scans of odd texts."""

import random

import pytest

from quillspark.llm import licences as L
from quillspark.llm.common import prepared

WORDS = "river stone window letter morning carry small yellow under because they walked along road with bread water".split()


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    return L.trained([" ".join(r.choices(WORDS, k=r.randint(3, 60))) for _ in range(400)])


def test_disturbed_notices_are_named_and_other_text_is_not(model):
    r = random.Random(77)
    right = total = 0
    for family, templates in L.TEMPLATES.items():
        for t in templates:
            for _ in range(10):
                words = [w for w in t.split() if r.random() > 0.03]
                right += model.predict(" ".join(r.choices(WORDS, k=4) + words + r.choices(WORDS, k=4)))[0] == family
                total += 1
    assert right >= 0.95 * total
    assert [model.predict(s)[0] for s in L.NEAR_MISSES] == [L.UNKNOWN] * len(L.NEAR_MISSES)
    assert all(model.predict(" ".join(r.choices(WORDS, k=40)))[0] == L.UNKNOWN for _ in range(200))


def test_places_wrapping_and_confirmation(model):
    text = "First line.\nReleased under the MIT License.\nLast."
    (one,) = L.findings(text, model)
    assert (text[one["begin"] : one["end"]], one["family"], one["confirmed"]) == ("Released under the MIT License.", "MIT", True)
    clause = L.TEMPLATES["BSD"][3] + "."
    words, lines = clause.split(), []
    while words:
        line = words.pop(0)
        while words and len(line) + len(words[0]) < 70:
            line += " " + words.pop(0)
        lines.append(line)
    wrapped = "\n".join(lines)
    assert len(lines) > 1 and [f["family"] for f in L.findings(wrapped, model)] == ["BSD"]
    deep = "stone " * 40_000 + "Licensed under the Apache License, Version 2.0. " + "river " * 40_000
    assert [(f["family"], f["confirmed"]) for f in L.findings(deep, model)] == [("Apache-2.0", True)]


def test_every_template_is_found_in_a_text(model):
    for family, templates in L.TEMPLATES.items():
        for t in templates:
            text = f"The river was yellow.\n\n{t}\n\nThey walked along the road."
            assert [(f["family"], f["confirmed"]) for f in L.findings(text, model)] == [(family, True)], t
    # no word of licensing in them
    assert [f["family"] for f in L.findings("GNU GPL version 3", model)] == ["GPL"]
    assert [f["family"] for f in L.findings("Lizenziert unter der Apache-Lizenz, Version 2.0.", model)] == ["Apache-2.0"]


def test_several_notices_in_prose_without_line_breaks(model):
    def prose(n):
        return " ".join(r.choices(WORDS, k=n)).capitalize() + "."

    r = random.Random(8)
    both = "Released under the MIT License. Licensed under CC BY-NC 4.0."
    assert {(f["family"], f["confirmed"]) for f in L.findings(both, model)} == {("MIT", True), ("CC-BY-NC", True)}
    hit = total = wrong = 0
    for gap in (1, 5, 25, 60, 130, 400):
        for _ in range(8):
            want = r.sample([(f, t) for f, ts in L.TEMPLATES.items() for t in ts], 5)
            text = prose(300)
            places = []
            for f, t in want:
                text += " " + prose(gap + r.randint(0, gap)) + " "
                places.append((len(text), len(text) + len(t), f))
                text += t
            text += " " + prose(300)
            got = L.findings(text, model)
            ok = [any(g["begin"] < e and b < g["end"] and g["family"] == f and g["confirmed"] for g in got) for b, e, f in places]
            hit, total = hit + sum(ok), total + len(ok)
            wrong += sum(not any(g["begin"] < e and b < g["end"] and g["family"] == f for b, e, f in places) for g in got)
    assert hit >= 0.98 * total and wrong <= 0.02 * total


def test_no_window_is_skipped_that_the_model_names(model):
    r = random.Random(3)
    words = r.choices(WORDS, k=90)
    words[30:30] = L.TEMPLATES["ISC"][0].split()
    words[70:70] = L.TEMPLATES["CC-BY-SA"][1].split()
    c = L.codes(L._WORD.findall(" ".join(words)))
    words = [w for w, one in zip(L._WORD.findall(" ".join(words)), L.fresh(c), strict=True) if one]
    want = {(i, i + n): model.predict(" ".join(words[i : i + n]))[0] for n in (*L.WINDOWS, len(words)) for i in range(len(words) - n + 1)}
    b, e, f, *_ = L.windows(c[L.fresh(c)], [len(words)], model)
    got = {(int(x), int(y)): model.families[k] for x, y, k in zip(b, e, f, strict=True)}
    assert got == {k: v for k, v in want.items() if v != L.UNKNOWN} and got


def test_ends_of_long_texts_are_sampled(spark):
    text = "\n".join(f"Line {i} of the text." for i in range(5_000))
    docs = prepared(spark).createDataFrame([(i, f"{text} {i}") for i in range(40)], "doc_id long, text string")
    places = [int(p.split()[1]) for p in L.corpus_sample(docs)]
    assert len(places) == 40 * L.SAMPLE_PARAGRAPHS and min(places) < 1_000 and max(places) > 4_000
    cuts = [L.sample_of(" ".join(map(str, range(50_000))), seed)[0] for seed in range(20)]
    assert {len(c) for c in cuts} == {L.SAMPLE_CHARS} and len(set(cuts)) > 10


def test_odd_rows(spark, model):
    rows = [(1, None, "a"), (None, "", "b"), (2, "\n\n", "c"), (2, "All rights reserved.", "d"), (2, "All rights reserved.", "d")]
    df = prepared(spark).createDataFrame(rows, "doc_id long, text string, licences string")
    got = sorted((str(r.doc_id), [f.family for f in r.licences]) for r in L.scanned(df, model).collect())
    assert got == [("1", []), ("2", []), ("2", ["Proprietary"]), ("2", ["Proprietary"]), ("None", [])]
    assert L.scanned(df.limit(0), model).count() == 0
    assert L.corpus_sample(df.limit(0)) == []
    assert L.trained([]).predict("Released under the MIT License.")[0] == "MIT"
