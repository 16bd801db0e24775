"""Runs of words searched side by side."""

import numpy as np

from sceneframe.operators import chapters


def test_runs_side_by_side_are_cut_as_each_alone():
    rng = np.random.default_rng(5)
    runs = []
    for size in [0, 1, 2, 700, 35, 0, 90, 3, 250, 90]:
        marks = rng.choice([0, 0, 0, 1, 3, 7, 8, 15], size)
        marks[-1:] |= 3
        runs.append(np.stack([rng.choice([1, 4, 9, 300], size, p=[0.3, 0.4, 0.29, 0.01]), rng.choice([0, 2, 25, 45], size), marks], 1).astype(np.int64))
    for reach in (30, 246):
        together = chapters.cheapest_cuts(runs, reach)
        assert [len(c) for c in together[:1]] == [0]
        for run, cuts in zip(runs, together):
            assert np.array_equal(cuts, chapters.cheapest_cuts([run], reach)[0])
            assert not len(run) or cuts[-1] == len(run)
