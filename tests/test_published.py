"""Published counts and probabilities: F1, adjusted p values and the counts that edits lead to."""

from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tessella.operators import dedup, edits, score, stats

# Tp, fp, fn and F1 in percent.
COUNTS = [
    (163, 628, 509, 22.28298017771702), (90, 278, 357, 22.085889570552148), (160, 647, 512, 21.636240703177823), (84, 284, 363, 20.61349693251534),
    (159, 643, 513, 21.57394843962008), (85, 283, 362, 20.858895705521473), (166, 303, 506, 29.09728308501315), (128, 240, 319, 31.41104294478528),
    (33, 187, 183, 15.137614678899084), (36, 161, 180, 17.433414043583532), (65, 112, 151, 33.078880407124686), (78, 74, 138, 42.391304347826086),
]
# Hits among 100,001, the p adjusted among these six, and among ten with 1/8192 and 1/64 twice each.
RAW = [16095, 9131, 212, 6403, 12430, 78]
HOLM_6 = [0.2739272607273927, 0.2739272607273927, 0.01059989400105999, 0.2561174388256117, 0.2739272607273927, 0.004679953200467995]
HOLM_10 = [0.2739272607273927, 0.2739272607273927, 0.014839851601483985, 0.2561174388256117, 0.2739272607273927, 0.006239937600623993]
# A stage's tp and fp, its edits (correct deleted, wrong deleted, correct added, wrong added), and the counts after them.
EDITS = [((36, 161), (0, 15, 1, 15), (37, 161)), ((36, 161), (0, 12, 1, 13), (37, 162)), ((78, 74), (0, 3, 22, 52), (100, 123)), ((78, 74), (1, 6, 18, 58), (95, 126))]


def test_f1(spark):
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(COUNTS)], "i int, tp long, fp long, fn long")
    for r in score.prf(df).collect():
        assert 100 * r["f1"] == pytest.approx(COUNTS[r["i"]][3], abs=1e-12)


def test_holm(spark):
    more = RAW + [None] * 4
    extra = [1 / 8192, 1 / 8192, 1 / 64, 1 / 64]
    rows = [("six", i, h / 100_001) for i, h in enumerate(RAW)] + [("ten", i, h / 100_001 if h is not None else extra[i - 6]) for i, h in enumerate(more)]
    got = {(r["f"], r["i"]): r["holm"] for r in stats.holm(spark.createDataFrame(rows, "f string, i int, p double"), ["f"], "p", "i").collect()}
    assert [got["six", i] for i in range(6)] == pytest.approx(HOLM_6, abs=1e-12)
    assert [got["ten", i] for i in range(6)] == pytest.approx(HOLM_10, abs=1e-12)
    assert [float(x) for x in stats.holm_exact([Fraction(h, 100_001) for h in RAW])] == pytest.approx(HOLM_6, abs=1e-12)


def test_edit_identity(spark):
    for (tp, fp), (cd, wd, ca, wa), after in EDITS:
        assert (tp + ca - cd, fp + wa - wd) == after
        fn = 216 - tp
        f1 = lambda t, p: Fraction(2 * t, 2 * t + p + 216 - t)
        gain = spark.range(1).select(edits.gain_numerator(*[F.lit(v) for v in (tp, fp, fn)], F.lit(after[0] + after[1] - tp - fp), F.lit(after[0] - tp))).first()[0]
        assert (gain > 0) == (f1(*after) > f1(tp, fp))


def test_near_duplicate_corpus(spark):
    """Word sequences with known overlaps: 16/20 and 72/80 and 73/79 are kept, 15/21 and 0/152 aren't."""
    base, edge = [f"word{i}" for i in range(80)], [f"boundary{i}" for i in range(22)]
    swap = base[40:] + base[:40]
    texts = {
        1: base, 2: [*base[:77], "x0", "x1", "x2"], 3: base, 201: swap, 6: base[::-1],
        5: edge, 105: [*edge[:20], "y0", "y1"], 106: [*edge[:19], "z0", "z1", "z2"], 9: [*edge[:19], "v0", "v1", "v2"],
    }
    rows = [(u, " ".join(w[i : i + 5])) for u, w in texts.items() for i in range(len(w) - 4)]
    got = {(r["left_uid"], r["right_uid"]): (r["intersection_count"], r["union_count"]) for r in dedup.near_pairs(spark.createDataFrame(rows, "uid int, gram string"), "uid", "gram").collect()}
    assert got[5, 105] == (16, 20) and got[3, 201] == (72, 80) and got[1, 2] == (73, 79) and got[1, 3] == (76, 76)
    assert not {(5, 106), (5, 9), (6, 201)} & set(got)
