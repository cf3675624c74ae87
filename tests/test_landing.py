"""First tracks over a stream against the batch form, and workbooks against their CSV twins."""

import io
import zipfile

import numpy as np
import pytest

from cytoframe.sources import tables, workbook
from cytoframe.streaming import sampling


def test_stream_and_batch_keep_the_same_tracks(spark, tmp_path):
    random = np.random.default_rng(4)
    kind = "ploidy string, track_id long, arrival long"
    parts = []
    for b in range(4):
        parts.append([(str(random.choice(["2N", "4N"])) if random.random() < 0.95 else None, int(random.integers(0, 12)) if random.random() < 0.95 else None, int(random.integers(0, 50))) for _ in range(15)])
    every = spark.createDataFrame([(*r, b) for b, rows in enumerate(parts) for r in rows], f"{kind}, batch int")
    for n in (0, 3, 7, 100):
        want = sorted(map(tuple, sampling.first_tracks(every, ["ploidy"], n).select("ploidy", "track_id", "place").collect()), key=repr)
        landing, name = tmp_path / f"landing{n}", f"kept_{n}"
        landing.mkdir()
        stream = sampling.first_tracks_stream(spark.readStream.schema(kind).parquet(str(landing)), ["ploidy"], n)
        for b, rows in enumerate(parts):
            spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(landing))
            query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
            query.awaitTermination()
        got = sorted(map(tuple, spark.read.schema("ploidy string, track_id long, place int").parquet(f"{tmp_path}/{name}").collect()), key=repr)
        assert got == want and (n != 7 or len(got) > 14)


def book(grid, path, shared=True):
    """A workbook of one sheet from a grid of texts and numbers, None for no cell."""
    strings, rows = [], []
    for r, line in enumerate(grid, 1):
        cells = ""
        for c, v in enumerate(line):
            at = f"{chr(65 + c)}{r}"
            if v is None:
                continue
            if isinstance(v, str) and shared:
                if v not in strings:
                    strings.append(v)
                cells += f'<c r="{at}" t="s"><v>{strings.index(v)}</v></c>'
            elif isinstance(v, str):
                cells += f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>'
            else:
                cells += f'<c r="{at}"><v>{v}</v></c>'
        rows.append(f'<row r="{r}">{cells}</row>')
    main, rel = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="{rel}"><sheets><sheet name="Plate 1" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{''.join(rows)}</sheetData></worksheet>")
        if shared:
            items = "".join(f"<si><r><t>{s[:2]}</t></r><r><t>{s[2:]}</t></r></si>" for s in strings)
            z.writestr("xl/sharedStrings.xml", f"<sst {main}>{items}</sst>")
    path.write_bytes(out.getvalue())


@pytest.mark.parametrize("shared", [True, False])
def test_a_workbook_equals_its_csv_twin(spark, tmp_path, shared):
    grid = [[None, 1, 2, 3.0, "note"], ["A", "2N: 0 nM", "4N: 12.5 nM", None, "x"], ["B", " 2N: 100 nM ", "media", 7, None], ["row", "y", None, None, None]]
    book(grid, tmp_path / "plate.xlsx", shared)
    cells = workbook.read_cells(spark, f"{tmp_path}/*.xlsx")
    assert {(r.sheet, r.row, r.col, r.value) for r in cells.collect()} == {("Plate 1", r, c, str(int(v)) if isinstance(v, float) else str(v)) for r, line in enumerate(grid, 1) for c, v in enumerate(line, 1) if v is not None}
    got = {r.well: (r.treatment, r.ploidy, r.dose, r.condition_id) for r in workbook.plate_map(cells).collect()}
    assert got == {"A1": ("2N: 0 nM", "2N", 0.0, "2N_gem_0nM"), "A2": ("4N: 12.5 nM", "4N", 12.5, "4N_gem_12p5nM"), "A3": (None,) * 4, "B1": ("2N: 100 nM", "2N", 100.0, "2N_gem_100nM"), "B2": ("media", None, None, None), "B3": ("7", None, None, None)}
    (tmp_path / "twin.csv").write_text("row,1,2,3\nA,2N: 0 nM,4N: 12.5 nM,\nB, 2N: 100 nM ,media,7\n")
    twin = tables.melt_plate(spark.read.csv(f"{tmp_path}/twin.csv", header=True), "row")
    assert {(r.well, r.value.strip()) for r in twin.collect()} == {(w, t[0]) for w, t in got.items() if t[0] is not None}
    with pytest.raises(Exception):
        (tmp_path / "no.xlsx").write_bytes(b"not a zip")
        workbook.read_cells(spark, f"{tmp_path}/no.xlsx").collect()
