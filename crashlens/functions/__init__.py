"""Column builders: no shuffles, no Python at run time."""
