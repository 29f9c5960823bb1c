"""Values to entries: distances, dress, misses and blocks."""

import pytest

from strataclaim.llm.canonical import Matcher, deletions, map_values, plain, reference_entries, weighted_distance

ROWS = [(1, "dopaminergic plasticity", '["dopaminergic rewiring", "DOPL"]', 9), (2, "cortical arousal", None, 5), (3, "rural migration", "[]", 4), (4, "hierarchical fine-tuning", "broken", 3), (5, "urban heat flux", "[]", 2), (6, "cortical sleep pressure", '["CSP"]', 2), (7, "boreal arousal", "[]", 1)]


@pytest.fixture(scope="module")
def match():
    entries = reference_entries(ROWS)
    return Matcher(entries, frozenset(w for e in entries for w in plain(e.name).split()))


@pytest.mark.parametrize("value, found", [
    ("Dopaminergic Plasticity", 1), ("DOPAMINERGIC_PLASTICITY", 1), ("DopaminergicPlasticity", 1), ("dopaminergicplasticity", 1), ("dopaminergic rewiring", 1), ("dopl", 1), ("plasticity, dopaminergic", 1), ("plasticity that is dopaminergic", 1), ("plasticity (dopaminergic)", 1),
    ("increased dopaminergic plasticity", 1), ("dopaminergic plasticity level", 1), ("dopaminergic plasticity [see text]", 1), ("dopaminergic plasticities", 1), ("dopamnergic plasticty", 1), ("dopaminergic palsticity", 1), ("dopam. plasticity", 1), ("cortiсal arousal", 2), ("córtical arousal", 2),
    ("cortical arou...", 2), ("rugal migration", 3), ("hierarchical fine tuning", 4), ("hierarchical fine-", 4), ("urban  heat\u00a0flux", 5), ("CSP", 6), ("urban plasticity", 0), ("rural arousal", 0), ("", 0), ("   ", 0), ("n/a", 0), ("???", 0), ("we", 0), ("12.5", 0), ("How dopaminergic plasticity weakens the balanced rate by abo", 0), ("quiet contrast update", 0), ("x" * 5000, 0),
])
def test_values(match, value, found):
    assert match(value)[0] == found


def test_distance():
    assert weighted_distance("abc", "abc") == 0 and weighted_distance("abcd", "abdc") == 0.9 and weighted_distance("abbc", "abc") == 0.6
    assert weighted_distance("abcdef", "uvwxyz", 2) == float("inf") and "ac" in deletions("abc", 1)


def test_operator(spark):
    ref = spark.createDataFrame(ROWS, "id long, n string, a string, f int")
    values = spark.createDataFrame([("t", 1, "f", "cortical arousal"), ("t", 2, "f", None), ("t", 3, "f", " "), ("t", 4, "f", "Cortical arosal"), ("t", 4, "f", "Cortical arosal"), ("t", 5, "g", "nothing")], "tab string, row_id long, field string, value string").selectExpr("*", "1 as concept_id")
    want = [("t", 3, "f", 0), ("t", 4, "f", 2), ("t", 4, "f", 2), ("t", 5, "g", 0)]
    assert sorted(tuple(r)[:4] for r in map_values(values, ref, "id", "n", "a", "f").collect()) == want
    # in blocks of two entries the same entries are found; equal rows come out once
    assert sorted({tuple(r)[:4] for r in map_values(values, ref, "id", "n", "a", "f", max_entries=2).collect()}) == sorted(set(want))


@pytest.mark.parametrize("max_entries, hot_share", [(20_000, 1000), (2, 1000), (20_000, 3), (2, 1)])
def test_repeated_rows_in_blocks(spark, monkeypatch, max_entries, hot_share):
    """Repeated rows, and rows of one key with other values, come out alike however long the list is."""
    ref = spark.createDataFrame(ROWS, "id long, n string, a string, f int")
    rows = [("t", 1, "f", "Cortical arosal")] * 3 + [("t", 1, "f", "urban heat fluxx"), ("t", 1, "f", "rural arousal")] + [("t", k, "g", "CSP ") for k in range(20)]
    values = spark.createDataFrame(rows, "tab string, row_id long, field string, value string")
    from strataclaim import session

    # with and without a broadcast of what values mean
    for most in (session.BROADCAST_ROWS, 0):
        monkeypatch.setattr("strataclaim.llm.canonical.broadcast_checked", lambda df, most=most: session.broadcast_checked(df, most))
        got = sorted(tuple(r)[:4] for r in map_values(values, ref, "id", "n", "a", "f", max_entries, hot_share).collect())
        assert got == sorted([("t", 1, "f", 2)] * 3 + [("t", 1, "f", 5), ("t", 1, "f", 0)] + [("t", k, "g", 6) for k in range(20)])


@pytest.mark.parametrize("n", [30, 74, 300])
def test_long_names(n):
    """Names of any length are met with a wrong, missing or turned letter, and not with five."""
    from strataclaim.llm.canonical import Entry

    name = " ".join(f"word{'abcdefghij'[k % 10] * 3}{'klmnopqrst'[k // 10 % 10]}" for k in range(n // 8))
    m = Matcher([Entry(7, name, (), 1.0)], frozenset(name.split()))
    at = len(name) // 2
    while not name[at - 1 : at + 1].isalpha() or name[at - 1] == name[at]:
        at += 1
    for value in (name[:at] + "x" + name[at + 1 :], name[:at] + name[at + 1 :], name[: at - 1] + name[at] + name[at - 1] + name[at + 1 :], name):
        assert m(value)[0] == 7, value
    assert m(name[:at] + "zzzzz" + name[at:])[0] == 0 and m(name + " " + name)[0] == 0
    words = [f"token{k}" for k in range(9)]
    many = Matcher([Entry(3, " ".join(words), (), 1.0)], frozenset(words))
    assert many(f"{' '.join(words[7:])}, {' '.join(words[:7]).replace('token3', 'tokn3')}")[0] == 3


def test_distance_in_a_band():
    """The band gives what the whole table gives."""
    import random

    rnd = random.Random(3)
    for _ in range(3000):
        a = "".join(rnd.choice("abe") for _ in range(rnd.randrange(1, 12)))
        b = list(a)
        for _ in range(rnd.randrange(4)):
            k = rnd.randrange(len(b) + 1)
            b[k : k + rnd.randrange(2)] = rnd.choice(["", "a", "b", "e"])
            if len(b) > 1 and rnd.random() < 0.3:
                k = rnd.randrange(len(b) - 1)
                b[k], b[k + 1] = b[k + 1], b[k]
        b = "".join(b) or "a"
        assert weighted_distance(a, b, 2.25) == pytest.approx(whole_table(a, b, 2.25)), (a, b)


def whole_table(a, b, most):
    inf, vowels = float("inf"), set("aeiouy")
    t = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if not i and not j:
                t[0][0] = 0.0
                continue
            way = []
            if i:
                way.append(t[i - 1][j] + (0.6 if i > 1 and a[i - 1] == a[i - 2] else 1.0))
            if j:
                way.append(t[i][j - 1] + (0.6 if j > 1 and b[j - 1] == b[j - 2] else 1.0))
            if i and j:
                x, y = a[i - 1], b[j - 1]
                way.append(t[i - 1][j - 1] + (0 if x == y else (0.8 if x in vowels and y in vowels else 1.0) + (0.2 if i == 1 or j == 1 else 0.0)))
                if i > 1 and j > 1 and x != y and x == b[j - 2] and a[i - 2] == y:
                    way.append(t[i - 2][j - 2] + 0.9)
            t[i][j] = min(way)
    return t[-1][-1] if t[-1][-1] <= most + 1e-12 else inf
