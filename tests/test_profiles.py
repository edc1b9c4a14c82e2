"""What a profile leaves open, and what it may not say."""

import json

import pytest

from auditlake.plans import files

GOOD = {"schema_version": "1.0", "name": "daily", "candidate_report": "new.json"}


def load(tmp_path, **more):
    (tmp_path / "p.json").write_text(json.dumps(GOOD | more))
    return files.load_profile(tmp_path / "p.json")


def test_alerts_need_a_match_where_there_is_a_catalog(tmp_path):
    assert load(tmp_path).alerts["require_applicability_match"] is False
    assert load(tmp_path, catalog="c.json").alerts["require_applicability_match"] is True
    assert load(tmp_path, catalog="c.json", alerts={"require_applicability_match": False}).alerts["require_applicability_match"] is False


@pytest.mark.parametrize(
    "wrong",
    [
        {"name": " "}, {"output": {"basename": "a/b"}}, {"output": {"basename": ""}}, {"output": {"formats": []}}, {"output": {"formats": ["pdf"]}}, {"alerts": {"min_level": "huge"}},
        {"alerts": {"require_applicability_match": "yes"}}, {"alerts": {"webhook": "http://x.org"}}, {"quality": {"language_mode": "x"}}, {"deduplication": {"threshold": 0.1}},
    ],
)
def test_profiles_that_are_refused(tmp_path, wrong):
    with pytest.raises(ValueError):
        load(tmp_path, **wrong)
