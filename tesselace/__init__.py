"""Tables of vectors, points, grids, graphs and reports as DataFrames; see README.md."""
