import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glmframe.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = local_session("*", shuffle_partitions=8)
    yield s
    s.stop()


@pytest.fixture
def write_lines(tmp_path):
    """Write text files into a fresh folder; returns the folder path."""
    counter = {"n": 0}

    def _write(*files: list[str]) -> str:
        counter["n"] += 1
        folder = tmp_path / f"in{counter['n']}"
        folder.mkdir()
        for i, lines in enumerate(files):
            (folder / f"part-{i:05d}.csv").write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(folder)

    return _write
