"""The similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from cinelake.functions.text import ratio_of_keys, similarity
from cinelake.operators.similar import Bounds, keyed, similar_keys


def _titles(seed):
    r = random.Random(seed)
    words = ["the", "silver", "moon", "night", "bus", "golden", "été", "ไทย", "2001", "x", "aaaa"]
    out = [" ".join(r.choice(words) for _ in range(r.randint(1, 5))) for _ in range(60)]
    for t in out[:40]:
        own = list(t)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(own) + 1)
            own[k : k + r.randint(0, 1)] = r.choice(["", "q", "zz"])
        out.append("".join(own))
    return [*out, "", None, "!!", "The  SILVER moon", "the silver moon", "a", "ab", "b" * 300 + "c", "b" * 301 + "d", "the silver moon " * 30, "the silver moon " * 29 + "the golden moon "]


@pytest.mark.parametrize("least", [70, 85, 95, 100])
def test_all_similar_pairs(spark, least):
    left, right = _titles(1), _titles(1)[::2] + _titles(2)
    frame = lambda texts: keyed(spark.createDataFrame([(t, 1) for t in texts], "t string, node int"), "t")
    a, b = frame(left), frame(right)
    keys = [[r.key for r in df.select("key").distinct().collect()] for df in (a, b)]
    want = {(x, y): ratio_of_keys(x, y) for x in keys[0] for y in keys[1] if x and y and ratio_of_keys(x, y) >= least}
    found = similar_keys(a, b, least)
    got = found.collect()
    assert {(r.a, r.b): r.similarity for r in got} == want and len(got) == len(want) > 5
    assert similarity("The  SILVER moon!", "the silver moon") == 100 and all(similarity(x, y) == s for (x, y), s in want.items())
    if least == 95:
        plan = found._jdf.queryExecution().toString()
        assert "Cartesian" not in plan and "NestedLoop" not in plan
        assert similar_keys(a, b.limit(0), least).count() == 0 == similar_keys(a.limit(0), b, least).count()
        assert similar_keys(a.where(F.col("key") == ""), b, least).count() == 0


def test_bounds():
    for least in (70, 88, 99.5, 100):
        own = Bounds(least)
        for size in range(1, 400):
            length, need = own.segment(size)
            assert 1 <= need <= size // length
            low, high = own.partners(size)
            assert 2 * min(size, high + 1) / (size + high + 1) * 100 < least - 0.05 and (low == 1 or 2 * (low - 1) / (size + low - 1) * 100 < least - 0.05)
    with pytest.raises(ValueError):
        Bounds(60)


def test_no_window_gathers_a_title(spark):
    """Probable copies of a hot title: sets as a loop makes them, and no window in the plan."""
    from cinelake.operators.duplicates import same_film_groups

    r = random.Random(4)
    rows = [(k, r.choice(["hot film", "hot film", " hot film", "other one", "ab", ""]), r.choice(["", "1999", "2001"]) if k % 3 else "", r.choice([None, 0.0, 5400.0, 5419.0, 9000.0])) for k in range(400)]
    rows += [(900, "lonely", "", 1.0), (901, "two of", "1990", None), (902, "two of", "1990", 60.0), (903, "two of", "", None)]
    d = spark.createDataFrame(rows, "ord long, normalized_title string, filename_year string, duration_sec double")
    found = same_film_groups(d)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {}
    for x in found.collect():
        got.setdefault(x["_group"], set()).add(x.ord)
    titles = {}
    for k, t, y, s in rows:
        if len(t.strip()) >= 3:
            titles.setdefault(t.strip(), []).append((k, y, s or None))
    want = []
    for own in titles.values():
        apart, sets = len({y for _, y, _ in own if y}) > 1, {}
        for x in own:
            sets.setdefault((x[1] or "?") if apart else "*", []).append(x)
        for part in sets.values():
            known, buckets = [s for _, _, s in part if s], {}
            wide = bool(known) and max(known) - min(known) > 120
            for k, _, s in part:
                buckets.setdefault(0 if not wide else -1 if s is None else round(s / 120), set()).add(k)
            want += [b for b in buckets.values() if len(b) > 1]
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want)) and len(want) > 8 and sorted(got) == list(range(1, len(want) + 1))
    assert same_film_groups(d, number=False).count() == sum(map(len, want))


def test_short_texts_meet_by_what_they_share(spark, monkeypatch):
    """Names of few syllables: candidates grow with the pairs that are found, and no table goes through the driver."""
    from cinelake.operators import similar

    r, plans, sizes = random.Random(5), [], {}
    some = ["el", "jo", "ma", "vi", "an", "to"]
    names = sorted({f"{''.join(r.choices(some, k=3))} {''.join(r.choices(['ström', 'dal', 'ko', 'ham'], k=3))}" for _ in range(1_500)})
    names += ["a" * 31, "a" * 32, "a" * 33, "ab" * 15, "ab" * 16]  # on both sides of what counts as short

    def watched(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        out = spark_written(df, name)
        sizes[name] = out.count()
        return out

    spark_written = similar.written
    monkeypatch.setattr(similar, "written", watched)
    a = keyed(spark.createDataFrame([(n,) for n in names], "t string"), "t")
    found = similar_keys(a, a, 95)
    rows = found.collect()
    near = lambda x, y: abs(len(x) - len(y)) <= 3 and len(set(x) ^ set(y)) <= 3
    want = {(x, y): ratio_of_keys(x, y) for x in names for y in names if near(x, y) and ratio_of_keys(x, y) >= 95}
    assert {(x.a, x.b): x.similarity for x in rows} == want and len(rows) == len(want) > len(names)
    assert sizes["candidates"] < 2 * len(rows)
    assert not any("Broadcast" in p for p in [*plans, found._jdf.queryExecution().executedPlan().toString()])
