import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarryset.llm import p6_tokens, p7_leaks, p8_truncated
from quarryset.runtime import Scratch

ENC = p6_tokens.encoding()


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab  \n\t.,'sé日本。1​🙂<")), max_size=400))
def test_cut_texts_encode_as_whole_ones(text):
    parts = p6_tokens.pieces(text, 10)
    assert "".join(parts) == text
    assert [i for p in parts for i in ENC.encode_ordinary(p)] == ENC.encode_ordinary(text)
    assert p6_tokens.decode(ENC.encode_ordinary(text), ENC) == text.encode()


def test_ids_agree_with_the_other_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(p6_tokens.PATH.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    texts = ["Hello world's end", "", None, "  \n\n x <|endoftext|> 日本語、テスト。", "a" * 70_000 + " b" * 60_000, "é​﻿🙂"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in p6_tokens.with_ids(df, "doc_id", "text").collect()}
    for i, text in enumerate(texts):
        assert got[i] == (t.encode(text, add_special_tokens=False).ids if text else [])
    back = {r.doc_id: bytes(r.bytes) for r in p6_tokens.with_text(p6_tokens.with_ids(df, "doc_id", "text"), "doc_id").collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate(texts))
    assert p6_tokens.with_ids(df.limit(0), "doc_id", "text").count() == 0


WORDS = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def test_normalise():
    n = p7_leaks.normalise
    assert n("Caf&eacute; — L'Été­​s  ZŁOTY") == "cafe l etes zloty"
    assert n(None) == "" and n("&#72;i&amp;amp;") == "hi"
    texts = ["a &am", "p; B", None, "", "x\x1ey", "Ünï"]
    assert p7_leaks.normalise_all(texts) == [n(t) for t in texts]


def test_leaks_against_brute_force(spark):
    rng = random.Random(3)
    passages = {i: sentence(rng, 40) for i in range(12)}
    passages[50] = passages[3]  # in two suites
    items = [*passages.items(), (60, None), (61, "too short"), (62, "")]
    docs, exact = [], set()
    for d in range(60):
        text, kind = sentence(rng, 80).split(), rng.randrange(4)
        if kind:
            item = rng.randrange(12)
            n = {1: 11, 2: 12, 3: 40}[kind]
            at = rng.randrange(41 - n)
            piece = passages[item].split()[at : at + n]
            text[30:30] = [w.upper() if rng.random() < 0.3 else w + rng.choice(["", ",", "​", "!\n"]) for w in piece]
        docs.append((d, " ".join(text)))
    docs += [(90, None), (91, ""), (92, ("x " * 40_000) + passages[1])]
    for d, t in docs:
        w = p7_leaks.normalise(t).split()
        for i, p in items:
            q = p7_leaks.normalise(p).split()
            mine = {tuple(q[j : j + 12]) for j in range(len(q) - 11)}
            if any(tuple(w[j : j + 12]) in mine for j in range(len(w) - 11)):
                exact.add((d, i))
    dd = spark.createDataFrame(docs, "doc_id long, text string")
    ii = spark.createDataFrame(items, "item_id long, passage string")
    got = p7_leaks.leaks(dd, ii).collect()
    assert {(r.doc_id, r.item_id) for r in got if r.exact} == exact and exact
    assert p7_leaks.leaks(dd, ii.limit(0)).count() == 0 and p7_leaks.leaks(dd.limit(0), ii).count() == 0


def test_few_edits_are_found_but_not_exact(spark):
    p = sentence(random.Random(5), 12)
    changed = p.replace(p.split()[6], p.split()[6] + "x", 1)
    dd = spark.createDataFrame([(1, "before it " + changed + " after it"), (2, sentence(random.Random(6), 30))], "doc_id long, text string")
    ii = spark.createDataFrame([(7, p)], "item_id long, passage string")
    got = p7_leaks.leaks(dd, ii).collect()
    assert [(r.doc_id, r.edits, r.exact) for r in got] == [(1, 1, False)]


@pytest.mark.parametrize("at", range(2, 14))
def test_a_near_match_is_found_wherever_it_lies_and_whatever_else_is_in_its_batch(at):
    p = sentence(random.Random(5), 12)
    changed = p[:40] + "x" + p[40:]  # neither side alone has as many q-grams as the lemma demands
    text = "z" * (at - 1) + " " + changed + " after it"
    index = p7_leaks.Passages({p: [7]})
    assert [x.tolist() for x in p7_leaks.search([text], index)] == [[0], [0], [0], [1]]
    assert [x.tolist() for x in p7_leaks.search([text, p], index)] == [[0, 1], [0, 0], [0, 0], [1, 0]]


@pytest.mark.parametrize(
    ("text", "state"),
    [
        (None, "none"),
        (" \n​", "none"),
        ("All is said.", "closed"),
        ("He said “all is done.”", "closed"),
        ("One is done. …", "closed"),
        ("One is done. Two is", "several"),
        ("One is done. Two is…", "marked"),
        ("One is done. Two is &am", "marked"),
        ("One is done. Two is <p", "marked"),
        ("One is done. Two is https://exa", "marked"),
        ("One is done. Two i�", "marked"),
        ("He said “all is", "bracket"),
        ("A heading", "single"),
        ("1. Two is", "element"),
        ("Home | About", "element"),
        ("https://example.test/next/1", "element"),
        ("mail: a@b.example", "element"),
        ('{"k": 1}', "element"),
        ("© 2026 us", "element"),
        ("More: what comes next", "element"),
    ],
)
def test_endings(text, state):
    assert p8_truncated.ending(text)[0] == state


def corpus():
    rng = random.Random(11)
    nouns, rows, cut = ["mill", "river", "garden", "tower", "valve"], [], set()

    def said():
        a, b = rng.choice(nouns), rng.choice(nouns)
        return f"The {rng.choice(['old', 'new', 'small'])} {a} {rng.choice(['opened', 'closed', 'moved'])} every {b}."

    for d in range(300):
        source = "limited.example" if d % 3 == 0 else "free.example"
        body = "\n".join(" ".join(said() for _ in range(rng.randrange(3, 7))) for _ in range(4))
        text = f"Home\nNews\nContact\nA {rng.choice(nouns)} opened\n{body}\nBack to top\nImprint | Terms"
        if source.startswith("limited"):
            full, text = text, text[:400]
            if len(full) > 400 and not text.rstrip().endswith("."):
                cut.add(d)
        elif d % 7 == 1:
            text = text[: rng.randrange(150, 350)]
            last = text.split("\n")[-1]
            if not text.rstrip().endswith("."):
                cut.add(d) if "." in last or last.split()[-1:] == ["The"] else rows.append((1000 + d, source, ""))
        rows.append((d, source, text))
    return [*rows, (2000, None, None), (2001, "x", ""), (2002, None, "Only a heading")], cut


def test_truncated_texts(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id for r in p8_truncated.truncated(df, Scratch(spark, "t")).filter("cut").collect()}
    missed, wrong = cut - got, got - cut
    assert len(missed) <= 0.03 * len(cut) and len(wrong) <= 0.08 * len(cut), (missed, wrong)
    assert not got & {2000, 2001}
    assert p8_truncated.truncated(df.limit(0), Scratch(spark, "t")).count() == 0


@pytest.mark.parametrize("tasks", [1, 20])
def test_a_footer_is_an_element_however_often_it_occurs(spark, tasks):
    rng, rows = random.Random(12), []
    for d in range(60):
        said = " ".join(f"The {rng.choice(WORDS)} opened the {rng.choice(WORDS)}." for _ in range(3 + d % 9))
        rows.append((d, "pages.example", f"{said}\nBack to where it began"))
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(tasks)
    assert p8_truncated.truncated(df, Scratch(spark, "t")).filter("cut").count() == 0
