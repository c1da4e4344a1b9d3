"""Helpers shared by the test modules."""


def rows(df, *order):
    """Collected rows as tuples, sorted by the given columns (or all)."""
    found = [tuple(r) for r in df.collect()]
    names = df.columns
    keys = [names.index(c) for c in order] or range(len(names))
    return sorted(found, key=lambda r: tuple((r[k] is None, r[k]) for k in keys))
