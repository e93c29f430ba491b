from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.operators.shares import with_ratios

#: key, T, P, R, low, high, label for scopes of 9,878 and 8,828: fixed values.
GOLDEN = """
altermagnetism 660 414 1.42 1.26 1.62 rising
rhombohedral_multilayer_graphene 81 63 1.15 0.83 1.60 flat
cdw_nematic_excitonic 390 310 1.12 0.97 1.31 flat
ml_ai 115 93 1.11 0.84 1.45 flat
flat_band_quantum_geometry 297 243 1.09 0.92 1.30 flat
moire_twisted_2d 405 335 1.08 0.93 1.25 flat
quantum_many_body_theory 1181 988 1.07 0.98 1.17 flat
mott_hubbard_strange_metal 533 454 1.05 0.92 1.19 flat
cuprate_sc 223 192 1.04 0.85 1.26 flat
unclassified 982 856 1.03 0.93 1.13 flat
other_superconductivity 572 506 1.01 0.89 1.14 flat
hydride_high_pressure_sc 57 52 0.98 0.67 1.43 flat
heavy_fermion_kondo_qcp 162 151 0.96 0.77 1.20 flat
quantum_magnetism_ferroic_order 471 440 0.96 0.84 1.09 flat
nickelate_sc 222 211 0.94 0.78 1.14 flat
vdw_magnets_topological_magnetism 820 784 0.93 0.84 1.04 flat
ultrafast_floquet_noneq 136 131 0.93 0.73 1.18 flat
unconventional_topological_sc 717 693 0.92 0.83 1.03 flat
fractional_qah_chern 364 363 0.90 0.77 1.04 flat
iron_based_sc 117 117 0.89 0.69 1.16 flat
kagome 308 313 0.88 0.75 1.03 flat
topological_insulators_semimetals 678 712 0.85 0.76 0.95 declining
spin_liquid_frustrated 387 407 0.85 0.74 0.98 declining
"""

#: n, duplicate share, on-topic, sampled, rate, low, high, estimate.
WILSON = [(26, 0.0385, 10, 24, 0.4167, 0.245, 0.612, 10.4), (197, 0.2538, 12, 16, 0.75, 0.505, 0.898, 110.3), (55, 0.0545, 13, 24, 0.5417, 0.351, 0.721, 28.2), (2, 0.0, 0, 2, 0.0, 0.0, 0.658, 0.0), (1458, 0.0055, 5, 25, 0.2, 0.089, 0.391, 290.0), (123, 0.7805, 0, 7, 0.0, 0.0, 0.354, 0.0), (1437, 0.2978, 14, 19, 0.7368, 0.512, 0.882, 743.5)]


def test_golden_table(spark):
    rows = [r.split() for r in GOLDEN.split("\n") if r]
    df = spark.createDataFrame([(r[0], int(r[1]), int(r[2]), 9878, 8828) for r in rows], "key string, t long, p long, scope_t long, scope_p long")
    got = {r.key: r for r in with_ratios(df).collect()}
    for key, _, _, ratio, low, high, label in rows:
        r = got[key]
        assert (f"{r.ratio:.2f}", f"{r.ci_low:.2f}", f"{r.ci_high:.2f}", r.label) == (ratio, low, high, label)


def test_zero_counts(spark):
    df = spark.createDataFrame([("a", 0, 5, 10, 10), ("b", 5, 0, 10, 10), ("c", 0, 0, 0, 0)], "key string, t long, p long, scope_t long, scope_p long")
    for r in with_ratios(df).collect():
        assert r.ratio is None and r.ci_low is None and r.label == "flat"


def test_wilson_and_estimate(spark):
    df = spark.createDataFrame(WILSON, "n long, dup double, s long, k long, rate double, low double, high double, estimate double")
    low, high = stats.wilson_bounds(F.col("s"), F.col("k"))
    for r in df.withColumn("l", low).withColumn("h", high).withColumn("e", stats.unique_estimate(F.col("n"), F.col("dup"), F.col("s") / F.col("k"))).collect():
        assert (r.l, r.h) == (r.low, r.high)
        assert abs(r.e - r.estimate) <= 0.1


def test_ols_and_median(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 1.0), (5.0, 2.0)], "y double, x double")
    r = df.agg(*[c.alias(n) for n, c in stats.ols(F.col("y"), F.col("x")).items()]).first()
    assert abs(r.slope - 2) < 1e-12 and r.se == 0 and r.t == 0
    two = df.limit(2).agg(*[c.alias(n) for n, c in stats.ols(F.col("y"), F.col("x")).items()]).first()
    assert two.se is None
    assert spark.range(1).select(stats.upper_median(F.array(*map(F.lit, (4, 1, 3, 2)))).alias("m")).first().m == 3
