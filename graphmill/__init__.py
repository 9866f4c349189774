"""Spark jobs over large corpora of small graphs, and over the logs of solvers that study them."""
