"""What several tests use."""

import os
from pathlib import Path

DATA = Path(os.environ.get("TEST_DATA", "/root/testdata"))


def same_rows(frame, relation):
    """Both sides as sorted rows of text, columns by name."""
    columns = sorted(frame.columns)
    names = [d[0] for d in relation.description]
    assert sorted(names) == columns
    ours = sorted(str(tuple(r[c] for c in columns)) for r in frame.collect())
    theirs = sorted(str(tuple(dict(zip(names, r, strict=True))[c] for c in columns)) for r in relation.fetchall())
    return ours == theirs
