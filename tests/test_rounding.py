from engines import both


def test_rates_round_as_their_sql_does(spark):
    """Ties of 0.3 and 0.6 times a share: the double below the tie rounds like the scaled product."""
    shares = [round(a / b, 6) for b in (16, 32, 80, 160, 400) for a in range(b // 2)]
    quality = [(i, q, s) for i, x in enumerate(shares) for q, s in (("maj", x), ("min", round(1 - x, 6)), ("dim", shares[-1 - i]), ("dom7", x))]
    one = lambda kind: ([(i, *kind) for i in range(len(shares))])
    got, want, _ = both(spark, "deep_harmony", of_chord_qualities=(quality, "song bigint, quality string, share double"), of_key_detect=(one(("C minor",)), "song bigint, key_name string"),
                        of_chord_functions=(one((0.1, 0.2, 0.3)), "song bigint, tonic_share double, subdominant_share double, dominant_share double"), of_tension_curve=(one((0.1, 0.2)), "song bigint, mean double, variance double"), of_voicing=(one((0.1, 0.2)), "song bigint, density double, spread double"))
    assert got == want and len(got) == len(shares)
