"""All queries of the library in driver time zones that are not the session's."""

import os
import subprocess
import sys

import pytest

from checks.oracle import ORACLE

from .conftest import SF_DIR


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Tokyo"])
def test_driver_zone_does_not_matter(zone):
    run = subprocess.run(
        [sys.executable, "-m", "checks.compare", SF_DIR, *ORACLE],
        cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))),
        env=os.environ | {"TZ": zone},
        capture_output=True,
        text=True,
    )
    assert run.returncode == 0, [line for line in run.stdout.splitlines() if "FAIL" in line]
