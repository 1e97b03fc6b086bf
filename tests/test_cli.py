import json
import os

import pytest

from lumengrid import cli, config

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")


def test_steps_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(config, "ALS_RANK", 4)
    monkeypatch.setattr(config, "ALS_ITERATIONS", 2)
    work = str(tmp_path)
    with pytest.raises(RuntimeError, match="ingest"):
        cli.main(["cf", "--work", work], spark)
    with pytest.raises(ValueError, match="unknown"):
        cli.main(["ingest", "--work", work, "--data", DATA, "--tables", "other"], spark)
    for step in ("ingest", "cf", "hydrate", "embed", "index", "eval"):
        assert cli.main([step, "--work", work, *(["--data", DATA] if step == "ingest" else [])], spark) == 0
    assert cli.main(["eval-gate", "--work", work]) == 2
    assert cli.main(["eval-gate", "--work", work, "--update-baseline"]) == 0 and cli.main(["eval-gate", "--work", work]) == 0
    result = json.loads(next((tmp_path / "results").glob("*.json")).read_text())
    assert result["mode"] == "full" and result["n_candidates"] > 50 and result["n_users_evaluated"] > 0
    marker = json.loads((tmp_path / "full/_done/cf.json").read_text())
    cli.main(["cf", "--work", work], spark)  # nothing has changed
    assert json.loads((tmp_path / "full/_done/cf.json").read_text()) == marker
