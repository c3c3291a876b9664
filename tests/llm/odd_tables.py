"""Small tables of the tests of vectors; folders of the given tables."""
import numpy as np

SF001 = "/root/testdata/sf0.001"


def odd_vectors(seed=3):
    """(vec_id, label, embedding) with nulls, non-finite and empty vectors, other lengths, ties, repeated rows and ids."""
    rng = np.random.default_rng(seed)
    f = lambda n: [float(np.float32(x)) for x in rng.normal(size=n).round(1)]
    rows = [(int(i), int(rng.integers(0, 4)), f(8)) for i in rng.permutation(320)]
    rows += [(400, 1, None), (401, 1, [1.0, None] * 4), (402, 2, [float("nan")] * 8), (403, 2, [float("inf")] + [0.0] * 7),
             (404, None, f(8)), (None, 2, f(8)), (None, None, f(8)), (405, 1, []), (500, 1, []), (406, 3, [0.0] * 8), (600, 3, [0.0] * 8)]
    rows += [(700 + 10 * i, i % 3, f(6)) for i in range(30)]            # another length
    rows += [rows[5], rows[5], (rows[7][0], rows[7][1], f(8)), (100, 2, f(8))]
    rows += [(1000 + i, 1, rows[9][2]) for i in range(25)]              # copies of a vector
    return rows
