"""What several test files share."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *order):
    out = [tuple(r) for r in df.collect()]
    return sorted(out, key=str) if not order else out
