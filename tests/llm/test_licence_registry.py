"""Long licences by their digests, and the lines that name one."""

from __future__ import annotations

from pathlib import Path

import pytest

from tidewater.llm import licences
from tidewater.llm.licence_texts import DIGESTS, NOTICES

FOLDER = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0": "Artistic", "CC0-1.0": "CC0-1.0", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-3.0": "LGPL-3", "MPL-2.0": "MPL-2.0"}


def test_long_texts(spark):
    there = {k: FOLDER / f for k, f in FILES.items() if (FOLDER / f).is_file()}
    if not there:
        pytest.skip("no licence texts on this machine")
    rows = [(k, f.read_text()) for k, f in there.items()] + [("none", f.read_text() + " x") for f in there.values()]
    got = licences.licences(spark.createDataFrame(rows, "name string, text string")).select("name", "licence.licence").collect()
    assert sorted(map(tuple, got), key=str) == sorted([(k, k) for k in there] + [("none", None)] * len(there), key=str)
    assert set(there) <= set(DIGESTS)


def test_odd_rows(empty, odd):
    assert licences.licences(empty).count() == 0
    rows = licences.licences(odd).collect()
    assert len(rows) == 8 and all((r["licence"]["digest"] is None) == (r["text"] is None) for r in rows)
    assert all(list(r["licence"]["notices"]) == [] and r["licence"]["licence"] is None for r in rows)


def test_every_line_names_its_licence(spark):
    rows = [(k, v) for k, lines in NOTICES.items() for v in lines if "licen" in v.lower()]
    got = licences.licences(spark.createDataFrame(rows, "name string, text string")).select("name", "licence.notices").collect()
    assert [r["name"] for r in got if list(r["notices"]) != [r["name"]]] == []


def test_long_text_of_many_lines(spark):
    text = "Released under the MIT License.\n" * 30_000 + "Some words here.\n" * 200_000
    (row,) = licences.licences(spark.createDataFrame([(text,)], "text string")).collect()
    assert list(row["licence"]["notices"]) == ["MIT"]
