"""The stages and the command line on a small folder of cases."""

import json

import numpy as np
from test_volumes import nifti

from scoreloom import __main__ as command
from scoreloom.plans.stages import Stages

SAID = ["The right maxillary sinus shows mucosal thickening.", "Impacted tooth 48 is visible.", "Composite fillings are seen on teeth 36 and 46.", "The mandibular canals are regular."]


def test_run_all(spark, tmp_path, capsys):
    rng = np.random.default_rng(5)
    data, work = tmp_path / "data", str(tmp_path / "work")
    for k in range(12):
        case = data / f"{'PA'[k % 2]}{k:03d}"
        case.mkdir(parents=True)
        (case / "volume.nii").write_bytes(nifti(rng.integers(0, 900 + 90 * k, (6, 7, 8)).astype(np.float32), [0.8, 0.8, 0.8]))
        (case / "report_1.txt").write_text(" ".join(SAID[i] for i in range(4) if (k >> (i % 3)) & 1 or i == 3).replace("fi", "\ufb01" if k == 3 else "fi"), encoding="utf-8")
    s = Stages(spark, work, str(data), least=1, most=4, shape=[6, 6, 6])
    assert [(r["status"], r["cases"]) for r in s.inspect().collect()] == [("complete", 12)]
    scores = s.run_all(rounds=0).collect()
    assert len(scores) == 1 and 0 < scores[0]["captioning"] <= 1
    assert not any("\ufb01" in r for c in s.read("corpus").collect() for r in c["reports"])  # compatibility form
    assert s.read("corpus").count() == 12 and s.read("features").count() == 12 and s.read("bundle").count() == s.read("bank").count() > 0

    capsys.readouterr()
    assert command.main(["--work", work, "splits", "--strategy", "center"]) == 0
    rows = [json.loads(line) for line in capsys.readouterr().out.splitlines()]
    assert len(rows) == 12 and {(r["center"], r["fold"]) for r in rows} == {("A", 0), ("P", 1)}
    assert command.main(["--work", work, "prepare"]) == 2
    (data / "A001" / "volume.nii").write_bytes(b"broken")
    assert command.main(["--work", work, "--data", str(data), "prepare"]) == 2
