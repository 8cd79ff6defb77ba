"""Skip edges of the personal-data field between numbers written in groups."""

import time

import numpy as np

from orgloom.llm import pii


def linked(text):
    """The pairs of tokens that skip edges join, by place."""
    n = pii.nodes_of([text], [pii.base_spans(text)])
    return {(text[n.start[i] : n.end[i]], text[n.start[j] : n.end[j]]) for i, j in n.skip.tolist()}


def test_equal_and_similar_numbers_share_skips():
    card = ["4111", "1111", "1111", "1111"]
    phone = "call +49 30 1234 5678 or then"
    assert linked(f"{phone} 49 30 1234 5678 now") >= {("+49", "49"), ("30", "30"), ("1234", "1234"), ("5678", "5678")}
    assert linked(f"{phone} 0049 30 1234 5678 now") >= {("+49", "0049"), ("5678", "5678")}
    assert linked(f"{phone} 030 1234 5678 now") >= {("30", "030"), ("5678", "5678")}
    assert linked(f"pay {' '.join(card)} and later 4111 1111 1112 1111 too") >= {("1111", "1112"), ("4111", "4111")}
    assert linked(f"pay {' '.join(card)} and later 12 {' '.join(card)} 3 too") >= {("4111", "4111")}
    assert linked(f"pay {' '.join(card)} and later {''.join(card)} too") >= {(x, "".join(card)) for x in card}
    assert linked("host 10.0.0.1 and 10.0.0.1 up") == {("10.0.0.1", "10.0.0.1")}
    assert linked("from a.b@c.de to <A.B@c.de> ok") == {("a.b@c.de", "<A.B@c.de>")}
    assert linked("year 2020 and 2021 or 12 34") == set()


def test_a_repeat_that_patterns_miss_is_found():
    text = "call +49 30 1234 5678 or then 49 30 1234 5678 now"
    nodes = pii.nodes_of([text], [pii.base_spans(text)])
    emission = np.zeros((pii.BUCKETS + 1, pii.LABELS))
    emission[list(set(nodes.features[0].tolist()) - set(nodes.features[1:].ravel().tolist()) - {pii.BUCKETS}), 4] = 9.0  # the plus
    field = pii.SkipChainField(emission, np.zeros((pii.LABELS, pii.LABELS)), 9.0 * np.eye(pii.LABELS))
    base, full = pii.all_spans([text], field)
    assert base == [[(3, 5, 21)]] and (3, 30, 45) in full[0]  # all of it


def planted(field, text, kind, piece):
    """Whether the field adds spans of the kind over most of a piece of text that no pattern finds."""
    base, full = pii.all_spans([text], field)
    a = text.index(piece, text.index("later"))
    assert not any(s < a + len(piece) and a < e for _, s, e in base[0])
    return sum(e - s for k, s, e in full[0] if k == kind and (k, s, e) not in base[0] and a <= s and e <= a + len(piece)) >= 0.6 * len(piece)


def test_planted_variants_are_found():
    words = "the river and green table walk".split()
    numbers = [f"{a} {4111111111111111} {a}, {b} 10.1.2.{i} {b} +1 (434) 555-{1000 + i} {a} an.{i:02}@mail.example.com {2 * i} {a} {5500001111220000 + 7 * i} {b}" for i, (a, b) in enumerate(zip(words * 20, words[1:] * 24))]
    field = pii.train(pii.nodes_of(numbers, [pii.base_spans(x) for x in numbers]))
    for text, kind, piece in (
        ("call +1 (434) 555-2368 or later 1 434 555 2368 too", 3, "1 434 555 2368"), ("call +1 (434) 555-2368 or later 434.555.2368 too", 3, "434.555.2368"),
        ("pay 4111111111111111 or later 4111.1111.1111.1111 too", 2, "4111.1111.1111.1111"), ("pay 4111111111111111 or later 4111111122221111 too", 2, "4111111122221111"),
        ("mail jo.smith@example.com or later jo.smith too", 0, "jo.smith"), ("mail jo.smith@example.com or later (Jo.Smith) too", 0, "Jo.Smith"),
    ):
        assert planted(field, text, kind, piece), piece
    clean = "in 2020 and 2021 all 434 of 1 555 went, 5500001111222233 too, jo smith said; mail jo.smith@example.com or +1 (434) 555-2368"
    assert pii.all_spans([clean], field)[0] == pii.all_spans([clean], field)[1]


def test_long_runs_take_linear_time():
    at = time.time()
    for text in ("a" * 1_000_000 + " 1", "." * 1_000_000 + "1", "a." * 500_000 + " a@b.de", "1" + "é" * 1_000_000, " ".join(["ab.cd"] * 100_000) + " ab.cd@e.de"):
        pii.nodes_of([text], [pii.base_spans(text)])
    assert time.time() - at < 10


def test_long_numbers_take_linear_time():
    for text in ("1" * 300_000, "1." * 100_000, "12 " * 100_000 + "+49 30 1234 5678", "1 +4930 12345678 " * 5_000):
        pii.nodes_of([text], [pii.base_spans(text)])
