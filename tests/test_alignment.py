"""Common subsequences and partial ratios against the textbook table."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from assayer.operators import alignment


def table(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [v for v in _next(row, x, b)]
    return row[-1]


def _next(row, x, b):
    last = 0
    for j, y in enumerate(b, 1):
        last = max(last, row[j], row[j - 1] + (x == y))
        yield last


def plain_ratio(a, b):
    if not a or not b:
        return 100.0 if a == b == "" else 0.0
    best = 0.0
    for s, t in {(a, b), (b, a)} if len(a) == len(b) else {tuple(sorted((a, b), key=len))}:
        m = len(s)
        stretches = [t[i : i + m] for i in range(len(t) - m + 1)] + [t[:j] for j in range(1, m)] + [t[-j:] for j in range(1, m)]
        best = max(best, *(200 * table(s, w) / (m + len(w)) for w in stretches if w))
    return best


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40), st.lists(st.integers(0, 4), max_size=40))
def test_bit_parallel_lengths(a, b):
    assert alignment.lcs_length(a, b) == table(a, b)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abé ", max_size=12), st.text("abé ", max_size=30)), max_size=12))
def test_partial_ratios_of_all_stretches(pairs):
    assert alignment.partial_ratios([a for a, _ in pairs], [b for _, b in pairs]) == pytest.approx([plain_ratio(a, b) for a, b in pairs])


def test_windows_of_texts():
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abcdef ") for _ in range(n))
    pairs = [(text(rng.randint(0, 45)), text(rng.choice([0, 3, 20, 30, 31, 80, 130]))) for _ in range(60)]
    pairs += [(p[1][17:35], p[1]) for p in pairs if len(p[1]) > 60] + [("x" * 70, "y" * 90), ("xyz", "abcabc"), ("", "a"), ("a", "")]
    got = alignment.best_windows([a for a, _ in pairs], [b for _, b in pairs], 30, 7)
    least = alignment.best_windows([a for a, _ in pairs], [b for _, b in pairs], 30, 7, 60.0)
    for (a, b), (start, score), (start_60, score_60) in zip(pairs, got, least, strict=True):
        starts = range(0, len(b) - 30 + 1, 7) if len(b) > 30 else [0]
        scores = [plain_ratio(a, b[i : i + 30]) if a and b else 0.0 for i in starts]
        assert score == pytest.approx(max(scores)) and scores[list(starts).index(start)] == pytest.approx(max(scores))
        assert (score_60 == score and start_60 == start) or (score < 60 and score_60 == 0)


def test_sentences_of_many_rows_are_combed_side_by_side(monkeypatch):
    rng, calls, comb = random.Random(8), [], alignment.comb
    monkeypatch.setattr(alignment, "comb", lambda a, b: calls.append(len(a)) or comb(a, b))
    text = lambda n: "".join(rng.choice("abcdef é\U0001f600") for _ in range(n))
    rows, texts = [[text(rng.randint(20, 24)) for _ in range(i % 4)] for i in range(300)], [text(rng.randint(70, 90)) for _ in range(300)]
    got = list(alignment.windows_of_rows(rows, texts, 30, 7))
    assert len(calls) < 10 and sum(calls) == sum(map(len, rows))
    assert got == [alignment.best_windows(own, [t] * len(own), 30, 7) for own, t in zip(rows, texts, strict=True)]
    assert [len(x) for x in alignment.windows_of_rows([["abc"] * 5000, [], ["abc"]], ["xabcx"] * 3, 30, 7)] == [5000, 0, 1]
