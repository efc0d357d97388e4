"""Whole jobs: the default job, node graphs, partition grids, audit rows."""
