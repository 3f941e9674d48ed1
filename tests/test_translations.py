"""Translated folders of many files: one listing, one more scan, the rows of reading file by file."""

import json

import pytest

from dimlens import query
from dimlens.plans.query import _scans
from dimlens.sources.manifest import Translations, open_folder
from dimlens.sources.tables import header_lines
from tests.company import explained, found
from tests.test_sources import jobs, write

LANGUAGE = "nl-nl"


def folder(tmp_path, files, columns=("place", "anno", "name", "note")):
    """A folder of datapoint files and their translations: {name: (rows, translated text or None)}."""
    resources = []
    for name, (rows, translated) in files.items():
        write(tmp_path / f"{name}.csv", ",".join(columns) + "\n" + rows)
        if translated is not None:
            write(tmp_path / "lang" / LANGUAGE / f"{name}.csv", translated)
        resources.append({"name": name, "path": f"{name}.csv", "dialect": {"delimiter": ","},
                          "schema": {"primaryKey": ["place", "anno"],
                                     "fields": [{"name": n} for n in columns]}})
    write(tmp_path / "c.csv", "concept,concept_type\nplace,entity_domain\nanno,time\nname,string\nnote,string\n")
    resources.append({"name": "c", "path": "c.csv", "schema": {"primaryKey": "concept"}})
    names = list(files)
    manifest = {"resources": resources, "translations": [{"id": LANGUAGE}], "ddfSchema": {
        "concepts": [{"primaryKey": ["concept"], "value": "concept_type", "resources": ["c"]}], "entities": [],
        "datapoints": [{"primaryKey": ["place", "anno"], "value": v, "resources": names} for v in ("name", "note")]}}
    return json.dumps(manifest)


def rows_of(spark, tmp_path, manifest, language=LANGUAGE, **options):
    dataset = open_folder(spark, str(tmp_path), manifest=manifest)
    return query(dataset, "datapoints", ["place", "anno"], ["name", "note"], language=language, **options)


def test_each_file_is_translated_by_its_own(spark, tmp_path):
    manifest = folder(tmp_path, {
        "a": ("x,2000,ex,n1\ny,2000,why,\nx,2000,ex2,n2\n", "place,anno,name\nx,2000,iks\nz,2001,zet\n"),
        "b": ("x,2000,over,\n", None),
        "d e": ("y,2000,,n3\n", "note,anno,place\nnota,2000,y\n,2000,x\n"),
        "f": ("q,2002,koe,\n", "place,anno,name,note\nq,2002,,\n"),
    })
    # The file b overwrites the translated cells of a; d has only an empty name for y.
    assert found(rows_of(spark, tmp_path, manifest)) == [
        ("q", "2002", "koe", None), ("x", "2000", None, None), ("y", "2000", None, "nota"),
        ("z", "2001", "zet", None)]
    assert found(rows_of(spark, tmp_path, manifest, None)) == [
        ("q", "2002", "koe", None), ("x", "2000", "over", None), ("y", "2000", None, "n3")]


def test_scan_equals_files_one_by_one(spark, tmp_path):
    files = {}
    for i in range(6):
        rows = "".join(f"p{j},{2000 + i // 2},base{i}{j},{'' if j % 2 else i}\n" for j in range(4))
        header = "place,anno,name\n" if i % 2 else "anno,place,note\n"
        cells = ["{p},{t},n{i}{p}\n", "{t},{p},m{i}{p}\n"][(i + 1) % 2]
        translated = header + "".join(cells.format(p=f"p{j}", t=2000 + i // 2, i=i) for j in range(1, 6, 2))
        files[f"f{i}"] = (rows, None if i == 3 else translated)
    manifest = folder(tmp_path, files)
    together = found(rows_of(spark, tmp_path, manifest))
    alone = json.loads(manifest)
    for r in alone["resources"]:  # without columns a file is read by itself
        r["schema"].pop("fields", None)
    assert found(rows_of(spark, tmp_path, json.dumps(alone))) == together
    assert any(r[2].startswith("n") for r in together if r[2])


def test_three_hundred_files_are_two_scans(spark, tmp_path):
    files = {f"f{i}": (f"x,2000,base{i},\np{i},2000,b,\n", f"place,anno,name\np{i},2000,t{i}\n") for i in range(300)}
    manifest = folder(tmp_path, files)
    held = []
    started = jobs(spark, "translated", lambda: held.append(
        rows_of(spark, tmp_path, manifest, where={"anno": "2000"})))
    plain = rows_of(spark, tmp_path, manifest, None, where={"anno": "2000"})
    assert explained(held[0]).count("Location: ") == explained(plain).count("Location: ") + 1
    assert explained(held[0]).count("EqualTo(anno,2000)") == 2
    assert started < 14
    rows = {r.place: r.name for r in held[0].collect()}
    assert rows["x"] == "base299" and rows["p7"] == "t7" and len(rows) == 301


def test_part_files_line_breaks_and_no_folder(spark, tmp_path):
    manifest = folder(tmp_path, {"a": ("x,2000,ex,\ny,2000,why,\n", None), "b": ("z,2000,zed,\n", None)})
    assert found(rows_of(spark, tmp_path, manifest)) == found(rows_of(spark, tmp_path, manifest, None))
    assert header_lines(spark, f"{tmp_path}/lang/{LANGUAGE}") == {}
    lang = tmp_path / "lang" / LANGUAGE / "a.csv"
    write(lang / "part-0.csv", 'place,anno,name\nx,2000,"one\ntwo"\n')
    write(lang / "part-1.csv", "place,anno,name\ny,2000,waarom\n")
    assert found(rows_of(spark, tmp_path, manifest)) == [
        ("x", "2000", "one\ntwo", None), ("y", "2000", "waarom", None), ("z", "2000", "zed", None)]
    table = Translations(spark, str(tmp_path)).table(LANGUAGE, "a.csv", ",", True)
    assert table.count() == 2 and Translations(spark, str(tmp_path)).table(LANGUAGE, "b.csv", ",", True) is None


def test_places_follow_the_resources(spark, tmp_path):
    manifest = folder(tmp_path, {"a": ("x,2000,ex,\n", None), "b": ("y,2000,why,\n", None)})
    dataset = open_folder(spark, str(tmp_path), manifest=manifest)
    groups = list(_scans([dataset.resources[n] for n in ("b", "c", "a")]))
    assert [([r.name for r in group], own) for group, own in groups] == [(["b", "a"], [0, 2]), (["c"], [1])]


@pytest.mark.parametrize("wanted", [["name"], ["note"]])
def test_only_wanted_cells_are_read(spark, tmp_path, wanted):
    manifest = folder(tmp_path, {"a": ("x,2000,ex,n\n", "place,anno,name,note\nx,2000,iks,nota\n"),
                                 "b": ("y,2000,why,m\n", "place,anno,name,note\ny,2000,ypsilon,\n")})
    dataset = open_folder(spark, str(tmp_path), manifest=manifest)
    rows = query(dataset, "datapoints", ["place", "anno"], wanted, language=LANGUAGE)
    assert found(rows) == {"name": [("x", "2000", "iks"), ("y", "2000", "ypsilon")],
                           "note": [("x", "2000", "nota"), ("y", "2000", "m")]}[wanted[0]]
