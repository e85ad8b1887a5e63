"""Footnotes: answers made from the grammar of markers, and what must become of them."""

import hashlib
import random

import pytest

from quillspark.operators import cite


def paper(name: str) -> str:
    return hashlib.sha1(name.encode()).hexdigest()


def chunk(name: str, no: int) -> str:
    return f"chunk-{paper(name)}-{no:06d}"


PAPERS = {"moss": ("Moss on northern roofs", ["Iversen K", "Bao L"], "1998", "Roofs", "10.5555/moss"), "tides": ("Tides without a moon.", ["Quist M"], "2005", "Sea Notes", None)}
#: handle -> chunk; the last one is of a paper without metadata.
REFS = {"C1": ("moss", 3), "C2": ("tides", 1), "C3": ("moss", 8), "C4": ("moss", 20), "C5": ("lost", 1)}
OPEN, SHUT = "[【［", "]】］"


def marker(r: random.Random, handle: str) -> str:
    """A handle or its chunk's id, in some bracket and case."""
    i = r.randrange(3)
    name, no = REFS.get(handle, ("none", 1))
    inside = r.choice([handle, handle.lower(), chunk(name, no), f"chunk-{paper(name).upper()}-{no:06d}"])
    return OPEN[i] + inside + SHUT[i]


def expected(cited: list[list[str]], words: list[str]) -> str:
    """Plain reading of the rules: ``cited`` are the handles behind each word."""
    known = [h for run in cited for h in run if h in REFS and REFS[h][0] in PAPERS]
    papers = list(dict.fromkeys(REFS[h][0] for h in known))
    chunks = {p: list(dict.fromkeys(h for h in known if REFS[h][0] == p)) for p in papers}

    def label(h: str) -> tuple[int, ...]:
        p = REFS[h][0]
        own = (papers.index(p) + 1,)
        return own if len(chunks[p]) == 1 else (*own, chunks[p].index(h) + 1)

    out = []
    for word, run in zip(words, cited, strict=True):
        marks = [label(h) for h in run if h in known]
        marks = sorted(set(marks)) if len(marks) > 1 else marks
        out.append(word + " " + "".join(f"[^{'-'.join(map(str, m))}]" for m in marks))
    return ". ".join(out) + "."


def cases() -> list[tuple[str, str]]:
    r, out = random.Random(31), []
    for _ in range(60):
        words = [f"Claim {r.randrange(1000)} stands" for _ in range(r.randint(1, 4))]
        cited = [[r.choice([*REFS, "C77"]) for _ in range(r.randint(0, 4))] for _ in words]
        text = []
        for word, run in zip(words, cited, strict=True):
            if len(run) > 1 and r.random() < 0.4:  # several handles in one bracket
                text.append(f"{word} [{r.choice([', ', '; ', ',']).join(run)}]")
            else:
                text.append(word + " " + "".join(marker(r, h) for h in run))
        out.append((". ".join(text) + ".", expected(cited, words)))
    return out


CASES = [*cases(), ("See 【Plate 4】 and [7].", "See 【Plate 4】 and [7]."), ("Nothing is cited.", "Nothing is cited.")]


@pytest.fixture(scope="module")
def answers(spark):
    texts = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "answer_id int, text string")
    rows = [(i, chunk(*c), h, f"Passage of {h}.") for i in range(len(CASES)) for h, c in REFS.items()]
    rows += [(i, None, "C77", "no id") for i in range(len(CASES))] + [(i, chunk("moss", 99), None, "no handle") for i in range(len(CASES))]
    refs = spark.createDataFrame(rows, "answer_id int, id string, handle string, content string")
    papers = spark.createDataFrame([(paper(k), *v) for k, v in PAPERS.items()], "paper_id string, title string, authors array<string>, year string, journal string, doi string")
    return {r.answer_id: r.text for r in cite.resolved(texts, refs, papers).collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_bodies(answers, i):
    assert answers[i].split("\n\n[^")[0].rstrip() == CASES[i][1].rstrip()


def test_definitions(answers):
    for i, (_, body) in enumerate(CASES):
        notes = answers[i].split("\n\n")[1:]
        labels = [n[2 : n.index("]")] for n in notes]
        assert sorted(labels) == sorted({m.split("]")[0] for m in body.split("[^")[1:]})
        assert labels == sorted(labels, key=lambda x: [int(n) for n in x.split("-")])
        for n in notes:
            assert n.split(": ", 1)[1].startswith(("Iversen K, Bao L (1998). Moss on northern roofs. *Roofs*. https://doi.org/10.5555/moss\n    > ", "Quist M (2005). Tides without a moon. *Sea Notes*\n    > "))


def test_labels_of_many_chunks_sort_as_numbers(spark):
    df = spark.createDataFrame([("2",), ("1-10",), ("1-9",), ("10-1",), ("1",)], "label string")
    assert [r.label for r in df.orderBy(cite.label_key(df["label"])).collect()] == ["1", "1-9", "1-10", "2", "10-1"]


def test_a_group_of_any_size_is_split(spark):
    many = ", ".join(f"C{i}" for i in range(1, 200))
    df = spark.createDataFrame([(f"x [{many}] y [see C1, C2] C1, C2] [ C3 ;c4]",)], "t string")
    got = df.select(cite.tidy_markers(df["t"])).first()[0]
    assert got == "x " + "".join(f"[C{i}]" for i in range(1, 200)) + " y [see C1, C2] C1, C2] [C3][C4]"


def test_union_typed_metadata(spark):
    rows = [('[{"family":"Iversen","given":"K"},{"name":"Bao L"}]', "Roofs"), ('["Quist M","N"]', '{"name":"Sea Notes"}'), ("Alone", None)]
    df = spark.createDataFrame(rows, "authors string, journal string")
    got = [(r.a, r.j) for r in df.select(cite.names(df["authors"]).alias("a"), cite.journal_name(df["journal"]).alias("j")).collect()]
    assert got == [(["Iversen K", "Bao L"], "Roofs"), (["Quist M", "N"], "Sea Notes"), (["Alone"], None)]
