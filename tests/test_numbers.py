import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from umbel.operators import ranks, vocabulary
from umbel.runtime import broadcast_if_small, measured_bytes, side_by_side


def test_percentile_rank_equals_its_definition(spark):
    rnd = random.Random(3)
    # One value holds a third of all rows.
    values = [7] * 200 + [rnd.randint(0, 400) for _ in range(400)]
    df = spark.createDataFrame([(i, v, i % 10 != 0) for i, v in enumerate(values)], "id long, v long, ok boolean")
    got = {r["id"]: r["p"] for r in ranks.percentile_rank(df, "v", F.col("ok"), "p").collect()}
    pop = [v for i, v in enumerate(values) if i % 10 != 0]
    for i, v in enumerate(values):
        below, ties = sum(x < v for x in pop), sum(x == v for x in pop)
        want = int((below + ties * 0.5) / len(pop) * 1000 + 0.5) / 10 if i % 10 else None
        assert got[i] == want


@pytest.mark.parametrize("values", [[5], [1, 2], [0, 0, 0, 9], [1.5, 2.25, 9.75, -4.0, 3.0], list(range(1000))])
def test_distribution_equals_linear_quantiles(spark, values):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = ranks.distribution(df, "v").first()
    for name, q in (("q1", 25), ("median", 50), ("q3", 75)):
        assert got[name] == pytest.approx(np.percentile(values, q))
    assert got["n"] == len(values) and got["share_zero"] == pytest.approx(values.count(0) / len(values))


def test_distribution_of_nothing(spark):
    got = ranks.distribution(spark.createDataFrame([], "v double"), "v").first()
    assert (got["median"], got["q1"], got["q3"], got["share_zero"], got["n"]) == (0, 0, 0, 0, 0)


def test_row_index_over_one_hot_group(spark):
    df = spark.range(2000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"))
    got = ranks.row_index(df, ["id"], ["g"]).collect()
    for g in ("hot", "cold"):
        mine = sorted((r["id"], r["row_index"], r["total"]) for r in got if r["g"] == g)
        assert [m[1] for m in mine] == list(range(len(mine))) and mine[0][2] == len(mine)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def mutate(rnd, word, n):
    w = list(word)
    for _ in range(n):
        at = rnd.randrange(1, len(w))
        kind = rnd.choice("sid")
        if kind == "s":
            w[at] = rnd.choice("abc")
        elif kind == "i":
            w.insert(at, rnd.choice("abc"))
        else:
            del w[at]
    return "".join(w)


def test_misspellings_equal_brute_force_short_and_long(spark):
    rnd = random.Random(5)
    common = ["".join(rnd.choices("abc", k=k)) for k in [5, 6, 7, 8, 9, 10, 11, 12, 39, 40, 41, 42, 43, 60] for _ in range(4)]
    rare = [mutate(rnd, c, rnd.randint(1, 3)) for c in common for _ in range(4)]
    freq = {w: 10 + i % 5 for i, w in enumerate(dict.fromkeys(common))}
    freq.update({w: 1 + i % 2 for i, w in enumerate(dict.fromkeys(rare)) if w not in freq})
    df = spark.createDataFrame([(w, n, len(w)) for w, n in freq.items()], "token string, freq long, len int")
    got = {r["token"]: (r["neighbour"], r["dist"]) for r in vocabulary.misspelling_candidates(df, df).collect()}
    want = {}
    for w, n in freq.items():
        if len(w) < 6 or n > 2:
            continue
        cap = 2 if len(w) >= 9 else 1
        near = [(edits(w, c), -m, len(c), c) for c, m in freq.items() if m >= max(8, 4 * n) and c[0] == w[0] and c != w and abs(len(c) - len(w)) <= cap]
        near = [x for x in near if x[0] <= cap]
        if near:
            best = min(near)
            want[w] = (best[3], best[0])
    assert got == want and any(len(w) > 40 for w in want)


def test_sizes(spark):
    df = spark.createDataFrame([("abc",)], "s string")
    assert measured_bytes(df) > 0 and measured_bytes(df.limit(0)) == 0
    assert broadcast_if_small(df)[1] and not broadcast_if_small(df, 1)[1]
    row = side_by_side(df, spark.createDataFrame([(2, [1])], "n int, a array<int>")).first()
    assert (row["s"], row["n"], row["a"]) == ("abc", 2, [1])
