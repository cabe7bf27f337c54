"""Expected mass of masters with many likely pairs."""

import math

from linkmill.operators import decide


def test_the_chance_of_none_keeps_its_logarithm_when_it_is_too_small_for_a_double(spark):
    pairs = spark.createDataFrame([(i, 1, 0.99) for i in range(400)] + [(0, 2, 0.5)], "ri long, si long, p double")
    got = {r.si: r for r in decide.mass(pairs).collect()}
    assert math.isclose(got[1].log_p0, 400 * math.log(0.01), rel_tol=1e-9) and got[1].p0 == 0.0
    assert math.isclose(got[2].log_p0, math.log(0.5)) and math.isclose(got[2].p0, 0.5)
