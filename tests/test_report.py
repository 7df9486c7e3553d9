"""What the screen's page and the plots of each crystal hold."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from densika import api
from densika.operators import report


def test_a_page_with_files_and_surroundings():
    row = {
        "stem": "x1", "opia": 0.9, "badge": "green", "model": "/d/x 1/m#.pdb", "reflections": None, "scored": "/d/x1_scored.pdb", "snr_maps": ["/d/a.ccp4", "/d/b.ccp4"], "mean_maps": ["/d/c.ccp4"],
        "neighbours": [{"chain": "A", "resname": "ALA", "resnum": 7, "category": "protein"}, {"chain": "B", "resname": "H<H", "resnum": 1, "category": "water"}],
        "n_protein": 1, "n_water": 1, "n_other": None, "atoms": [{"atom_id": 3, "score": 0.4, "colour": "#FF9896", "chain": "L", "resnum": 1, "atom": "C1"}, {"atom_id": 4, "score": None, "colour": None}],
    }
    page = list(report.html_pages(["stem", "opia"], [row, {"stem": "x2", "opia": None}]))
    assert len(page) == 4 and page[1].count("\n") == 1
    assert re.findall("href='([^']*)'", page[1]) == [f"file:///d/{n}" for n in ("x%201/m%23.pdb", "x1_scored.pdb", "a.ccp4", "b.ccp4", "c.ccp4")]
    assert "snr map 2" in page[1] and ">mean map<" in page[1] and "1 protein" in page[1] and "0 other" in page[1] and "H&lt;H" in page[1]
    assert "L 1 C1</td><td style='background:#FF9896'>0.4000" in page[1] and ">4</td><td style='background:#FFFFFF'>N/A" in page[1]
    assert "details" not in page[2] and "href" not in page[2]


def test_plots_of_each_crystal(spark, tmp_path):
    residues = spark.createDataFrame([("x1", "B", 1, "", 0.2), ("x1", "A", 9, "", 0.9), ("x1", "A", 10, "", 0.5), ("x2", "A", 1, "", 0.1)], "stem string, chain string, resnum int, icode string, residue_score double")
    atoms = spark.createDataFrame([("x1", 1, 0.9, True), ("x1", 2, 0.1, True), ("x1", 3, 0.8, False), ("x2", 1, 0.3, False)], "stem string, atom_id long, score double, is_water boolean")
    summary = spark.createDataFrame([("x1", 0.5), ("x2", None)], "stem string, threshold double")
    folders = spark.createDataFrame([(s, f"{tmp_path}/{s}") for s in ("x1", "x2")], "stem string, folder string")
    api.plots({"residues": residues, "atoms": atoms, "summary": summary}, folders, str(tmp_path))
    assert sorted(p.name for p in tmp_path.rglob("*.svg")) == ["x1_profile.svg", "x1_waters.svg", "x2_profile.svg"]
    line = ET.parse(tmp_path / "x1/x1_profile.svg").find("{*}polyline").get("points").split()
    heights = [float(p.split(",")[1]) for p in line]
    assert len(line) == 3 and heights[0] < heights[1] < heights[2]  # A 9, A 10, B 1
    page = ET.parse(tmp_path / "x1/x1_waters.svg").getroot()
    assert "keep 1, remove 1" in "".join(page.itertext()) and len(page.findall("{*}circle")) == 2


def test_ranges_rank_as_one_partition_does(spark, monkeypatch):
    """Ties, nulls and infinities too, and no window over all rows."""
    rows = [(f"s{n * 37 % 500:03d}", None if n % 7 == 0 else float("-inf") if n % 11 == 0 else (n * 13 % 23) / 23) for n in range(500)]
    df = spark.createDataFrame(rows, "stem string, opia double").repartition(5)
    plain = {r.stem: r["rank"] for r in report.screen_rank(df).collect()}
    monkeypatch.setattr(report, "RANK_ROWS", 40)
    got = report.screen_rank(df)
    assert {r.stem: r["rank"] for r in got.collect()} == plain and sorted(plain.values()) == list(range(1, 501))
    assert got.schema["rank"].dataType.simpleString() == "int" and "SinglePartition" not in got._jdf.queryExecution().executedPlan().toString()


def test_a_large_screen_has_several_pages(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(report, "PAGE_ROWS", 20)
    df = spark.createDataFrame([(f"x{n}", None if n == 3 else n / 100, n if n % 2 else None, ["/a.ccp4"], [{"chain": "A", "resname": "ALA", "resnum": n, "category": "protein"}]) for n in range(50)], "stem string, opia double, n int, snr_maps array<string>, neighbours array<struct<chain:string,resname:string,resnum:int,category:string>>")
    (tmp_path / "index_4.html").write_text("of a larger screen")
    report.write_html(report.screen_rank(df), tmp_path / "index.html")
    assert sorted(p.name for p in tmp_path.glob("*.html")) == ["index.html", "index_2.html", "index_3.html"]
    text = [(tmp_path / n).read_text() for n in ("index.html", "index_2.html", "index_3.html")]
    found = [re.findall("<tr class='(?:green|yellow|red|none)'><td>(x[0-9]+)</td>", t) for t in text]
    assert [len(f) for f in found] == [20, 20, 10] and sum(found, []) == [r.stem for r in report.screen_rank(df).orderBy("rank").collect()]
    assert "href='index_2.html'" in text[0] and "href='index.html'" in text[1] and "href='index_3.html'" in text[1] and "index_4" not in text[2]
    assert "<td>x49</td><td>0.4900</td><td>49</td>" in text[0] and "<td>x3</td><td>N/A</td><td>3</td>" in text[2] and ">snr map<" in text[0]
    report.write_html(report.screen_rank(df.where("false")), tmp_path / "none.html")
    assert (tmp_path / "none.html").read_text().count("<tr>") == 1
