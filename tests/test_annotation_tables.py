"""Annotation tables: text, CSV and spreadsheets give equal periods."""

from __future__ import annotations

import zipfile
from xml.sax.saxutils import escape

import pytest

from echolith.sources.annotation_tables import annotation_table, sheet_rows

HEAD = ["Begin Date", "Begin Clock Time", "Begin Time (s)", "End Time (s)", "Delta Time (s)", "Call", "Species", "Low Freq (Hz)"]
ROWS = [
    ["2018-09-09", "21:00:00.5", "0", "2", "1.25", "S01", "KW", "500"],
    ["9/9/2018", "23:59:59", "10", "12", "", "S02", "KW", "600"],
    ["2018-09-10", "00:00:01", "13", "12", None, "S03", "KW", "7"],
    ["2018-09-10", "0:00:01", "13", "14", "", " ", "HW", "8"],
    ["2018-09-10", "0:00:01", "13", "14", "", None, None, "9"],
    ["", "0:00:01", "13", "14", "", "S05", None, "9"],
    ["2018-09-10", "12:30:00", "20", "25", "2", "drop me", "KW", "10"],
]
DAY = 1_536_451_200.0  # 2018-09-09
WANT = [("S01", DAY + 75_600.5, DAY + 75_601.75, "500"), ("S02", DAY + 86_399, DAY + 86_401, "600"), ("HW", DAY + 86_401, DAY + 86_402, "8")]


def _sheet(path, rows, numbers=False):
    """A spreadsheet as programs write it: shared texts, numbers, absent cells; dates and times as numbers if wanted."""
    texts, xml = [], []
    for i, row in enumerate(rows, 1):
        cells = []
        for j, v in enumerate(row):
            if v in (None, ""):
                continue
            at = f"{chr(65 + j)}{i}"
            if numbers and i > 1 and j == 0:
                v = {"2018-09-09": "43352", "9/9/2018": "43352", "2018-09-10": "43353"}[v]
            elif numbers and i > 1 and j == 1:
                h, m, s = v.split(":")
                v = repr((int(h) * 3600 + int(m) * 60 + float(s)) / 86_400)
            elif not v.replace(".", "").isdigit():
                texts.append(v)
                cells.append(f'<c r="{at}" t="s"><v>{len(texts) - 1}</v></c>')
                continue
            cells.append(f'<c r="{at}"><v>{v}</v></c>')
        xml.append(f'<row r="{i}">{"".join(cells)}</row>')
    ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="one" sheetId="1" r:id="rId7"/><sheet name="two" sheetId="2" r:id="rId8"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId7" Target="worksheets/sheet1.xml"/><Relationship Id="rId8" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}">' + "".join(f"<si><r><t>{escape(t[:1])}</t></r><r><t>{escape(t[1:])}</t></r></si>" for t in texts) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData>{"".join(xml)}</sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c t="inlineStr"><is><t>x</t></is></c></row></sheetData></worksheet>')


def _text(path, sep):
    path.write_text("\n".join(sep.join(v or "" for v in r) for r in [HEAD, *ROWS]) + "\n")


@pytest.mark.parametrize("kind", ["txt", "csv", "xlsx", "numbers.xlsx"])
def test_kinds_give_equal_periods(spark, tmp_path, kind):
    """Clock times, durations before ends, midnight, first label that is given, a parser that drops, kept columns."""
    path = tmp_path / f"site 1+2.{kind}"
    if kind.endswith("xlsx"):
        _sheet(path, [HEAD, *(r for r in ROWS if r[0] or kind == "xlsx")], kind.startswith("numbers"))
    else:
        _text(path, "," if kind == "csv" else "\t")
    got = annotation_table(spark, str(path), ["Call", "Species"], keep_cols=("Low Freq (Hz)", "absent"), label_parser=lambda x: None if x.startswith("drop") else x)
    rows = sorted((r.label, r.start, r.end, r["Low Freq (Hz)"]) for r in got.collect())
    assert [(a, pytest.approx(s, abs=1e-4), pytest.approx(e, abs=1e-4), f) for a, s, e, f in sorted(WANT)] == rows
    assert {r.event_id for r in got.collect()} == {f"site 1+2.{kind}".rsplit(".", 1)[0]} and got.columns[-1] == "absent"


def test_times_in_a_recording(spark, tmp_path):
    """Seconds after the start; events from a column or given; several files together."""
    for n in "ab":
        _text(tmp_path / f"{n}.txt", "\t")
    paths = [str(tmp_path / f"{n}.txt") for n in "ab"]
    got = annotation_table(spark, paths, "Call", recording_start="2018-09-09 21:00:00", event_id="Species").collect()
    assert len(got) == 8 and {r.event_id for r in got} == {"KW", None}
    assert min(r.start for r in got) == DAY + 75_600 and {r.label for r in got} == {"S01", "S02", "S05", "drop me"}
    assert {r.event_id for r in annotation_table(spark, paths, "Call", recording_start="2018-09-09", event_id="mine").collect()} == {"mine"}
    with pytest.raises(ValueError, match="neither a date"):
        annotation_table(spark, paths, "Call", clock_col="nothing")


def test_sheets(tmp_path):
    _sheet(tmp_path / "x.xlsx", [["A", None, "C"], [None, "1", "t<&>"]])
    content = (tmp_path / "x.xlsx").read_bytes()
    assert list(sheet_rows(content)) == [{0: "A", 2: "C"}, {1: "1", 2: "t<&>"}]
    assert list(sheet_rows(content, 1)) == [{0: "x"}]
