"""Workbooks, tables of places, and split datasets."""

import json
import zipfile

import pytest

from skylot.sources import places, sinks, workbook

_HEAD = '<?xml version="1.0" encoding="UTF-8"?>'
_MAIN = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'


def written(path, sheets):
    """A small XLSX file: texts as shared or inline strings, numbers as such."""
    shared, parts = [], {}
    for i, (name, rows) in enumerate(sheets.items(), 1):
        out = []
        for r, row in enumerate(rows, 1):
            cells = []
            for c, v in enumerate(row):
                at = f"{'ABCDEFGHIJ'[c]}{r}"
                if v is None:
                    continue
                if isinstance(v, (int, float)):
                    cells.append(f'<c r="{at}"><v>{v}</v></c>')
                elif c % 2:
                    cells.append(f'<c r="{at}" t="inlineStr"><is><t>{v}</t></is></c>')
                else:
                    shared.append(v)
                    cells.append(f'<c r="{at}" t="s"><v>{len(shared) - 1}</v></c>')
            out.append(f'<row r="{r}">{"".join(cells)}</row>')
        parts[f"xl/worksheets/sheet{i}.xml"] = f'{_HEAD}<worksheet {_MAIN}><sheetData>{"".join(out)}</sheetData></worksheet>'
    named = "".join(f'<sheet name="{n}" sheetId="{i}" r:id="r{i}"/>' for i, n in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'{_HEAD}<workbook {_MAIN} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{named}</sheets></workbook>'
    rels = "".join(f'<Relationship Id="r{i}" Type="x" Target="{"/xl/" if i % 2 else ""}worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    parts["xl/sharedStrings.xml"] = f'{_HEAD}<sst {_MAIN}>{"".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in shared)}</sst>'
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return str(path)


SF = [["航站名称", "城市", "纬度", "经度", "运营方", "服务时间", "备注", None],
      ["深大研究院航站(东区)", "深圳", 22.5, 113.9, "顺丰丰翼", "2023年1月2日-2024年3月4日？", "测试站", "10.24时搜不到了"], ["R&amp;D A区-2期", "X", 22, 114, "Other", 44000, None, None]]
SF[1][0], SF[2][0] = "研究院航站", "A区-2 期 (  x )"
MEITUAN = [["城市", "站点名", "平台", "开通时间", "备注", "纬度", "经度"], ["北京", "美团无人机收餐点", "美团", None, "已关闭？", 39.9, 116.4]]


def test_sheets_are_partitions_of_texts(spark, tmp_path):
    path = written(tmp_path / "a.xlsx", {"one": [["a", None, 1.5], [None], [7, "b"]], "two": [["c"]]})
    rows = workbook.sheets(spark, path)
    assert rows.rdd.getNumPartitions() == 2
    assert sorted(map(tuple, rows.collect())) == [("one", 1, ["a", None, "1.5"]), ("one", 3, ["7", "b"]), ("two", 1, ["c"])]


def test_stations_of_all_sheets_in_one_form(spark, tmp_path):
    path = written(tmp_path / "s.xlsx", {"顺丰": SF, "美团": MEITUAN, "空": [["城市"]]})
    found = places.stations(spark, path)
    assert found.schema.simpleString() == "struct<" + ",".join(c.replace(" ", ":") for c in places.STATION.split(", ")) + ">"
    a, b, c = sorted(found.collect(), key=lambda r: r["latitude"], reverse=True)
    assert tuple(a) == ("meituan", 39.9, 116.4, "Meituan Drone Meal Pickup Point", "Beijing", "Meituan", "possibly_closed", "", "", "", False, False)
    assert tuple(b) == ("sf_express", 22.5, 113.9, "Research Institute Air Station", "Shenzhen", "SF Express Fengyi", "test_site", "not_found_when_checked_on_oct_24", "2023-01-02", "2024-03-04", False, True)
    assert tuple(c)[3:] == ("A District - Phase 2 (x)", "X", "Other", "", "", "2020-06-18", "", False, False)


def test_a_table_of_stations_is_checked(spark, tmp_path):
    names = [c.split()[0] for c in places.STATION.split(", ")]
    (tmp_path / "s.csv").write_text(",".join(names) + "\nmeituan,22.5,113.9,One,Shenzhen,Meituan,,,2020-06-18,,false,true\n")
    assert tuple(places.stations(spark, str(tmp_path / "s.csv")).first()) == ("meituan", 22.5, 113.9, "One", "Shenzhen", "Meituan", "", "", "2020-06-18", "", False, True)
    (tmp_path / "t.csv").write_text(",".join(names[1:]) + "\n22.5,113.9,One,Shenzhen,Meituan,,,2020-06-18,,false,true\n")
    with pytest.raises(ValueError, match="source_sheet"):
        places.stations(spark, str(tmp_path / "t.csv"))
    with pytest.raises(ValueError):
        places.stations(spark, "x.txt")
    for sheet in ({"顺丰": [SF[0], ["未知站", *SF[1][1:]]]}, {"顺丰": [SF[0], [*SF[1][:5], "soon", None]]}, {"顺丰": [["城市"], ["深圳"]]}):
        with pytest.raises(Exception, match="translated|date of service|lacks"):
            places.stations(spark, written(tmp_path / "bad.xlsx", sheet)).collect()
    with pytest.raises(ValueError, match="no sheet"):
        places.stations(spark, written(tmp_path / "empty.xlsx", {"顺丰": [SF[0]]}))


BUILT = [["wkt_geom", "fid", "Height", "roof_area", "type", "province", "city", "DEM高度", "求和高度", "经度", "纬度"],
         ["P", 1, 30.5, 100, "医疗卫生用地", "广东省", "深圳市", 5, 35.5, 113, 22], ["Q", 2, 9, 50, "residential_land", "Guangdong Province", "Shenzhen City", 1, 10, 113, 22], ["R", 3, 9, 50, "工业用地", "Guangdong", "Shenzhen", 1, 10, 113, 22]]


def test_buildings_and_their_land_uses(spark, tmp_path):
    lines = "\n".join(",".join(map(str, r)) for r in BUILT)
    (tmp_path / "b.csv").write_text(lines + "\n")
    for path in (str(tmp_path / "b.csv"),):
        hospitals, residences, every = places.partitions(places.buildings(spark, path))
        assert [r["feature_id"] for r in hospitals.collect()] == [1.0] and [r["feature_id"] for r in residences.collect()] == [2.0] and every.count() == 3
        assert {(r["province"], r["city"]) for r in every.collect()} == {("Guangdong", "Shenzhen")}
        assert every.columns == [c.split()[0] for c in places.BUILDING.split(", ")]
    (tmp_path / "c.csv").write_text(lines.replace("工业用地", "住宅") + "\n")
    with pytest.raises(Exception, match="translated"):
        places.buildings(spark, str(tmp_path / "c.csv")).collect()
    (tmp_path / "d.csv").write_text(lines.replace("30.5", "tall") + "\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        places.buildings(spark, str(tmp_path / "d.csv")).collect()
    (tmp_path / "e.csv").write_text(lines.replace("roof_area", "roof") + "\n")
    with pytest.raises(ValueError, match="roof_area_sqm"):
        places.buildings(spark, str(tmp_path / "e.csv"))


def test_a_split_is_counted_where_it_is_written(spark, tmp_path):
    rows = spark.createDataFrame([(f"w{i}", "tie" if i % 3 else "mixed") for i in range(10)], "time_window string, subset string")
    spark.sparkContext.setJobGroup("split", "split")
    made = sinks.split_json(rows, str(tmp_path / "s"), "subset", ("tie", "mixed", "other"), "in.jsonl")
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("split")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert len(jobs) == 1 and made["counts"] == {"tie": 6, "mixed": 4, "other": 0} and made["total_windows"] == 10
    assert json.loads((tmp_path / "s" / "manifest.json").read_text()) == made
    back = spark.read.json(str(tmp_path / "s" / "subset=tie"))
    assert back.count() == 6 and back.columns == ["time_window"]
    with pytest.raises(ValueError, match="subset"):
        sinks.split_json(rows, str(tmp_path / "t"), "subset", ("tie",))
    assert not (tmp_path / "t" / "manifest.json").exists()
