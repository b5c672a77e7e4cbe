"""Entries of archives leave a task many at a time."""

import io
import zipfile

import pandas as pd


def test_entries_share_frames(monkeypatch):
    from tessera.sources import documents

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(50):
            z.writestr(f"{i}.json", "x" * 10)
    given = pd.DataFrame({"path": ["a", "b", "c", "d"], "content": [out.getvalue(), None, b"PK", out.getvalue()]})
    whole = list(documents._unzip([given]))
    assert len(whole) == 1 and len(whole[0]) == 102
    assert [tuple(r) for r in whole[0][whole[0]["problem"].notna()][["path", "problem"]].values] == [("b", "no content"), ("c", "File is not a zip file")]
    for limits, most in (((20, 1 << 20), 20), ((1000, 200), 22)):  # problems have no bytes
        monkeypatch.setattr(documents, "FRAME", limits)
        parts = list(documents._unzip([given]))
        plain = lambda f: f.astype(object).where(f.notna(), None).values.tolist()
        assert max(map(len, parts)) == most and sum(map(plain, parts), []) == plain(whole[0])
