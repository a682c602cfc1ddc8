"""weftgraph: a PySpark engine over a typed code graph, its source files and its text."""

__version__ = "0.1.0"
