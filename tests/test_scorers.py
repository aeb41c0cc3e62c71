import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from samewise.errors import MatchingError
from samewise.functions import scorers as S

TEXT = st.text(alphabet="abcé ", max_size=12)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(TEXT, TEXT)
def test_lcs(a, b):
    assert S.lcs(a, b) == slow_lcs(a, b)


@settings(max_examples=300)
@given(TEXT, TEXT)
def test_partial_ratio_is_the_best_window(a, b):
    s, t = sorted((a, b), key=len)
    if not s:
        assert S.partial_ratio(a, b) == (100.0 if not t else 0.0)
        return

    def best(s, t):
        m = len(s)
        cuts = [t[i : i + m] for i in range(len(t) - m + 1)] + [t[:k] for k in range(1, m)] + [t[-k:] for k in range(1, m)]
        return max(S.ratio(s, w) for w in cuts)

    want = max(best(s, t), best(t, s)) if len(s) == len(t) else best(s, t)
    assert S.partial_ratio(a, b) == pytest.approx(want)


GOLD = [  # hand-checked values of ratio, token sort, token set
    ("apple inc.", "apple incorporated", 64.2857, 64.2857, 66.6667), ("apple inc.", "alphabet inc.", 69.5652, 69.5652, 69.5652),
    ("microsoft corporation", "microsoft corp", 80.0, 80.0, 80.0), ("apple inc.", "tesla inc.", 60.0, 40.0, 60.0),
    ("mcdonald's corporation", "mcdonalds corp.", 75.6757, 75.6757, 75.6757), ("société générale", "societe generale", 75.0, 75.0, 75.0), ("müller & co", "mueller & company", 71.4286, 71.4286, 71.4286),
]


@pytest.mark.parametrize(("a", "b", "r", "ts", "tset"), GOLD)
def test_gold(a, b, r, ts, tset):
    assert (S.ratio(a, b), S.token_sort_ratio(a, b), S.token_set_ratio(a, b)) == pytest.approx((r, ts, tset), abs=1e-4)
    assert S.ratio("microsoft corporation", "microsoft corp") == 80.0  # exactly


def test_jaro():
    assert S.jaro("martha", "marhta") == pytest.approx(0.944444, abs=1e-6)
    assert S.jaro_winkler("martha", "marhta") == pytest.approx(0.961111, abs=1e-6)
    assert S.jaro("dixon", "dicksonx") == pytest.approx(0.766667, abs=1e-6)
    assert S.jaro("", "") == 1.0 and S.jaro("a", "") == 0.0


def test_properties():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rnd.choice("ab c") for _ in range(rnd.randint(0, 9))) for _ in range(2))
        for name, f in S.SCORERS.items():
            assert f(a, b) == pytest.approx(f(b, a)), name
            assert 0 <= f(a, b) <= 100
    assert S.wratio("new york mets", "new york mets") == 100.0 and S.wratio("", "x") == 0.0
    with pytest.raises(MatchingError):
        S.scorer("nothing")
