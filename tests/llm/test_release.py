"""Memory that batches have freed goes back to the system."""

import pandas as pd

from auditlake.llm import secrets


def test_every_batch_begins_with_a_release(monkeypatch):
    seen = []
    monkeypatch.setattr(secrets, "release", lambda: seen.append(1))
    out = pd.concat(secrets._counts(iter([pd.DataFrame({"text": ["steel beams steel"]})] * 3)))
    assert len(seen) == 3 and dict(zip(out["word"], out["n"])) == {"steel": 6, "beams": 3}
