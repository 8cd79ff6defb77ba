"""Merkle fingerprints: plain versions of the tree and of the order, edits, and odd rows."""

import hashlib
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from orgloom.llm.merkle import Fingerprint, compared_with_next, differing, fingerprints, likeness, located

TEXT = st.text(st.sampled_from("ab cdé\n\t#.\U0001f600"), max_size=200)


def prose(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(1, 9))) for _ in range(2000)]
    return " ".join(rng.choice(words) + ("\n" if rng.random() < 0.05 else ".\n\n" if rng.random() < 0.02 else "") for _ in range(n))


def leaf_texts(text):
    """The leaves through the places that ``located`` gives, one by one."""
    n = len(Fingerprint.of(text).leaves)
    return [text[a:b] for i in range(n) for a, b in located(text, [i])]


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=6))
def test_texts_cut_together_are_as_if_alone(texts):
    assert Fingerprint.of_all(texts) == [Fingerprint.of(x) for x in texts]
    for x in texts:
        f = Fingerprint.of(x)
        assert Fingerprint.parse(str(f)) == f
        assert "".join(leaf_texts(x)) == x
        assert len(f.paragraphs) == len(re.findall(r"[^\n]*\n|[^\n]+", x))
        assert likeness(f, f) == 1.0


@settings(max_examples=150, deadline=None)
@given(TEXT, TEXT)
def test_equal_roots_and_likeness(a, b):
    x, y = Fingerprint.of(a), Fingerprint.of(b)
    assert (x.root == y.root) == (a == b) and (str(x) == str(y)) == (a == b)
    near = likeness(x, y)
    assert near == likeness(y, x) and 0 <= near <= 1 and (near == 1) == (a == b)


def test_likeness_is_the_share_of_equal_leaves():
    """As opening every branch, matched or not, would give: pieces of a few words that both texts have."""
    a = prose(3000, 1)
    b = a[:4000] + prose(300, 2) + a[6000:]
    x, y = Fingerprint.of(a), Fingerprint.of(b)
    shared = sum((Counter(leaf_texts(a)) & Counter(leaf_texts(b))).values())
    assert abs(likeness(x, y) - 2 * shared / (len(x.leaves) + len(y.leaves))) < 0.01
    assert 0.75 < likeness(x, y) < 0.95
    assert likeness(x, Fingerprint.of(prose(3000, 9))) < 0.1  # blank lines are alike


def test_edits_are_located():
    text = prose(4000, 3)
    at = len(text) // 2
    edited = text[:at] + " changed here " + text[at + 30 :]
    gone, new = differing(Fingerprint.of(text), Fingerprint.of(edited))
    spans = located(text, gone)
    assert spans[0][0] <= at <= spans[-1][1] and sum(b - a for a, b in spans) < 300
    assert "changed here" in "".join(edited[a:b] for a, b in located(edited, new))
    assert differing(Fingerprint.of(text), Fingerprint.of(text)) == ([], [])


def test_sections_move_whole():
    one, two = "head\n" + prose(200, 4).replace("\n\n", "\n") + "\n\n", "# next\n" + prose(200, 5).replace("\n\n", "\n") + "\n\n"
    x, y = Fingerprint.of(one + two), Fingerprint.of(two + one)
    assert len(x.sections) == 2 and sorted(x.sections) == sorted(y.sections)
    assert x.root != y.root and 0.99 < likeness(x, y) < 1 and differing(x, y) == ([], [])


ROWS = [(7, "seven words of text are in here"), (3, None), (2**53 + 1, "large id"), (2**53 + 3, "larger id"), (None, "no id b"), (None, "no id a"), (5, ""), (5, "twice"), (4, "x" * 300_000), (9, prose(20_000, 6)), (10, "copy\n"), (11, "copy\n"), (-2, "ä ö\n" * 50)]


def by_plain_python(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = []
    for (doc_id, text), (_, after) in zip(order, order[1:] + order[:1]):
        text, after = text or "", after or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, made, other = map(Fingerprint.of, (text, edited, after))
        gone = differing(own, made)[0]
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), str(own), str(made), likeness(own, made), likeness(own, other), located(text, gone[:1])[0][0] if gone else None))
    return sorted(out, key=str)


def test_compared_with_the_next_by_id(spark):
    for rows in (ROWS, ROWS * 2, ROWS[:1], ROWS[4:6], [(i, f"text {i % 7}") for i in range(500)]):
        docs = spark.createDataFrame([(t, i, 1, True) for i, t in rows], "text string, doc_id long, slot int, tail boolean").repartition(3)
        assert sorted(map(tuple, compared_with_next(docs).collect()), key=str) == by_plain_python(rows)
        got = sorted(map(tuple, fingerprints(docs).collect()), key=str)
        assert got == sorted(((i, len(t or ""), str(Fingerprint.of(t or ""))) for i, t in rows), key=str)
    assert compared_with_next(docs.limit(0)).collect() == [] and fingerprints(docs.limit(0)).collect() == []
