import json
import pathlib

import pytest
from pyspark.sql import functions as F

from dimlens import DatasetError, IndexEntry, Reader, Version, open_folder, open_version, query
from dimlens.functions.concepts import concept_class
from dimlens.functions.cells import is_identifier
from dimlens.operators.merge import last_rows
from dimlens.operators.normalize import normalize_cells
from dimlens.session import shared_folder
from dimlens.sources.assets import get_asset, get_binary_asset
from dimlens.sources.catalog import (
    catalog_aliases,
    catalog_issues,
    flatten_catalog,
    read_registry,
    registry_from,
    registry_json,
    resolve_version,
)
from dimlens.sources.sinks import tabular, write_csv, write_folder, write_json, write_parquet
from dimlens.sources.tables import header_delimiter, read_table, row_number_in_file
from tests.company import explained, found

VERSIONS = {
    "shop": {"master": ["c3", "c2", "c1"], "develop": ["d1"]},
    "farm": {"master": ["e1"], "stage": []},
}
DEFAULT = Version("shop", "master", "c2")


def write(path: pathlib.Path, text: str):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


@pytest.fixture
def folder(spark, firms, tmp_path):
    path = str(tmp_path / "firms")
    write_folder(firms, path, languages=["nl-nl"])
    return path


def test_folder_gives_the_same_answers(spark, firms, folder):
    stored = open_folder(spark, folder)
    for args in (
        ("datapoints", ["company", "anno"], ["company_size", "lines_of_code"]),
        ("datapoints", ["foundation", "project"], ["num_users", "latitude"]),
        ("entities", ["company"], ["name", "full_name", "is--foundation"]),
        ("entities", ["company"]),
        ("concepts", ["concept"], ["concept_type", "domain"]),
    ):
        assert found(query(stored, *args)) == found(query(firms, *args))
    translated = query(stored, "entities", ["company"], ["name", "country"], language="nl-nl")
    assert found(translated) == found(
        query(firms, "entities", ["company"], ["name", "country"], language="nl-nl"))


def test_hand_written_folder(spark, tmp_path):
    """Text key in the manifest, guessed delimiter, quotes, blank lines, repeated keys."""
    write(tmp_path / "datapackage.json", """{
      "resources": [
        {"name": "c", "path": "c.csv", "schema": {"primaryKey": "concept"}},
        {"name": "a", "path": "a.csv", "schema": {"primaryKey": ["place", "anno"]}},
        {"name": "b", "path": "b.csv", "schema": {"primaryKey": ["place", "anno"]}}],
      "translations": [{"id": "fr"}],
      "ddfSchema": {
        "concepts": [{"primaryKey": ["concept"], "value": "concept_type", "resources": ["c"]},
                     {"primaryKey": ["concept"], "value": "domain", "resources": ["c"]},
                     {"primaryKey": ["concept"], "value": "rank", "resources": ["c"]}],
        "entities": [],
        "datapoints": [
          {"primaryKey": ["place", "anno"], "value": "v", "resources": ["a", "b"]},
          {"primaryKey": ["anno", "place"], "value": "note", "resources": ["a"]}]}}""")
    write(tmp_path / "c.csv", "concept,concept_type,domain,rank\nplace,entity_domain,,1st\n"
          "anno,time,,\nv,measure,,2\n\nnote,string,,3.5 of 4\nrank,measure,,-1\n")
    write(tmp_path / "a.csv", '﻿place;anno;v;note\nx;2000;1;"say ""hi"";\nthere"\n'
          "x;2001;oops;\n\ny;2000;-2.5e1;\n")
    write(tmp_path / "b.csv", "place\tanno\tv\nx\t2000\t5\nx\t2000\t6\nz\t2002\t\n")
    dataset = open_folder(spark, str(tmp_path))
    assert found(query(dataset, "datapoints", ["place", "anno"], ["v"])) == [
        ("x", "2000", 6.0), ("x", "2001", None), ("y", "2000", -25.0), ("z", "2002", None)]
    notes = query(dataset, "datapoints", ["place", "anno"], ["note"], where={"note": {"$ne": None}})
    assert found(notes) == [("x", "2000", 'say "hi";\nthere')]
    ranks = query(dataset, "concepts", ["concept"], ["rank"])
    assert found(ranks) == [("anno", None), ("note", 3.5), ("place", 1.0), ("rank", -1.0), ("v", 2.0)]
    french = query(dataset, "datapoints", ["place", "anno"], ["v"], language="fr")
    assert french.count() == 4


@pytest.mark.parametrize("line, delimiter", [
    ("a,b,c", ","), ("a\tb", "\t"), ("a|b", "|"), ("a;b;c", ";"), ("a\x1eb", "\x1e"), ("a", ","),
    ('"a;b",c', ",")])
def test_delimiters(line, delimiter):
    assert header_delimiter(line) == delimiter


def test_ambiguous_header():
    with pytest.raises(DatasetError, match="several delimiters"):
        header_delimiter("a,b;c")


def test_quoted_descriptions(spark, tmp_path):
    rows = "".join(f'c{i},"one, two, first; second; third"\n' for i in range(12))
    write(tmp_path / "t.csv", "concept,description\n" + rows)
    table = read_table(spark, str(tmp_path / "t.csv"))
    assert table.columns == ["concept", "description"] and table.count() == 12
    assert table.first().description == "one, two, first; second; third"


def jobs(spark, group, work):
    """How many jobs some work starts."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        work()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_many_files_are_one_scan(spark, tmp_path):
    """Three hundred files of one key plan with a fixed number of jobs; the last one wins."""
    fields = [{"name": n} for n in ("place", "anno", "v")]
    resources = []
    for i in range(300):
        write(tmp_path / "data" / f"f {i}.csv", f"place,anno,v\nx,2000,{i}\np{i},2000,{i}\n")
        resources.append({"name": f"f{i}", "path": f"data/f {i}.csv", "dialect": {"delimiter": ","},
                          "schema": {"primaryKey": ["place", "anno"], "fields": fields}})
    write(tmp_path / "c.csv", "concept,concept_type\nplace,entity_domain\nanno,time\nv,measure\n")
    resources.append({"name": "c", "path": "c.csv", "schema": {"primaryKey": "concept"}})
    manifest = json.dumps({"resources": resources, "translations": [], "ddfSchema": {
        "concepts": [{"primaryKey": ["concept"], "value": "concept_type", "resources": ["c"]}],
        "entities": [],
        "datapoints": [{"primaryKey": ["place", "anno"], "value": "v",
                        "resources": [f"f{i}" for i in range(300)]}]}})
    few = json.loads(manifest)
    few["resources"] = few["resources"][:3] + few["resources"][-1:]
    few["ddfSchema"]["datapoints"][0]["resources"] = ["f0", "f1", "f2"]
    held = []

    def plan(manifest):
        dataset = open_folder(spark, str(tmp_path), manifest=manifest)
        held.append(query(dataset, "datapoints", ["place", "anno"], ["v"], where={"anno": "2000"}))

    started = jobs(spark, "many files", lambda: plan(manifest))
    few_started = jobs(spark, "few files", lambda: plan(json.dumps(few)))
    assert started <= few_started + 2 < 12  # Spark lists many paths by a job of its own
    assert explained(held[0]).count("Location: ") == 1
    assert "PushedFilters: [IsNotNull(anno), EqualTo(anno,2000)]" in explained(held[0])
    rows = {r.place: r.v for r in held[0].collect()}
    assert rows["x"] == 299 and rows["p7"] == 7 and len(rows) == 301


def test_partitioned_resource_is_pruned(spark, tmp_path):
    frame = spark.createDataFrame([("x", "2000", 1.0), ("y", "2000", 2.0), ("x", "2001", 3.0)],
                                  "place string, anno string, v double")
    write_parquet(frame, str(tmp_path / "data.parquet"), ["place"])
    write(tmp_path / "c.csv", "concept,concept_type\nplace,entity_domain\nanno,time\nv,measure\n")
    manifest = json.dumps({"resources": [
        {"name": "d", "path": "data.parquet", "format": "parquet",
         "schema": {"primaryKey": ["place", "anno"]}},
        {"name": "c", "path": "c.csv", "schema": {"primaryKey": "concept"}}], "translations": [],
        "ddfSchema": {"concepts": [{"primaryKey": ["concept"], "value": "concept_type", "resources": ["c"]}],
                      "entities": [], "datapoints": [
                          {"primaryKey": ["place", "anno"], "value": "v", "resources": ["d"]}]}})
    dataset = open_folder(spark, str(tmp_path), manifest=manifest, unique_keys=True)
    rows = query(dataset, "datapoints", ["place", "anno"], ["v"], where={"place": "x"})
    assert "PartitionFilters: [isnotnull(place" in explained(rows)
    assert found(rows) == [("x", "2000", 1.0), ("x", "2001", 3.0)]


def test_part_files_keep_their_order(spark, tmp_path):
    """The later part file wins, however small it is."""
    folder = tmp_path / "t.csv"
    write(folder / "part-0.csv", "k,v\na,old\n")
    write(folder / "part-1.csv", "k,v\na,new\n" + "".join(f"{i},x\n" for i in range(3000)))
    rows = read_table(spark, str(folder), ",", columns=["k", "v"])
    last = last_rows(rows.withColumn("n", row_number_in_file()), ["k"], ["n"])
    assert last.filter("k = 'a'").first().v == "new"


def test_files_without_line_breaks_are_split(spark, tmp_path):
    plain = "k,v\n" + "".join(f'k{i},"say ""{i}"""\n' for i in range(2000))
    write(tmp_path / "plain.csv", plain)
    write(tmp_path / "broken.csv", plain + 'last,"one\ntwo"\n')
    small_splits = {"spark.sql.files.maxPartitionBytes": "4000",
                    "spark.sql.files.openCostInBytes": "1000"}
    for name, value in small_splits.items():
        spark.conf.set(name, value)
    try:
        split = read_table(spark, str(tmp_path / "plain.csv"), multiline=False)
        whole = read_table(spark, str(tmp_path / "broken.csv"))
        assert split.rdd.getNumPartitions() > 1 and whole.rdd.getNumPartitions() == 1
        assert found(split) == found(whole.filter("k <> 'last'"))
        assert found(whole.filter("k = 'last'")) == [("last", "one\ntwo")]
        order = split.select(row_number_in_file().alias("n"), "k").orderBy("n").collect()
        assert [r.k for r in order] == [f"k{i}" for i in range(2000)]
    finally:
        for name in small_splits:
            spark.conf.unset(name)


def test_versions(spark, firms, tmp_path):
    base = f"{tmp_path}"
    assert DEFAULT.path(base) == DEFAULT.path(base + "/") == f"{base}/shop/master-c2"
    write_folder(firms, DEFAULT.path(base))
    opened = open_version(spark, base, VERSIONS, DEFAULT)
    assert query(opened, "entities", ["region"]).count() == 2
    direct = open_version(spark, DEFAULT.path(base))
    assert query(direct, "entities", ["region"]).count() == 2
    catalog = flatten_catalog(registry_from(spark, VERSIONS), DEFAULT)
    assert resolve_version(catalog, DEFAULT, "farm", commit="e1") == Version("farm", "master", "e1")
    for options, problem in [
        (dict(dataset="mill"), "no dataset 'mill'"),
        (dict(branch="stage"), "no branch 'stage'"),
        (dict(commit="c9"), "no commit 'c9'"),
        (dict(dataset="farm"), "no default commit 'c2'"),
    ]:
        with pytest.raises(DatasetError, match=problem):
            resolve_version(catalog, DEFAULT, **options)
    with pytest.raises(DatasetError, match="no manifest"):
        open_version(spark, base)


def test_reader(spark, firms, tmp_path):
    base = f"{tmp_path}/"
    write_folder(firms, Version("shop", "develop", "d1").path(base))
    folder = pathlib.Path(DEFAULT.path(base))
    write_folder(firms, str(folder))
    write(folder / "assets" / "a.json", '{"id": 7}')
    reader = Reader(spark, base, VERSIONS, DEFAULT, lambda rows: rows.limit(1), unique_keys=True)
    request = {"from": "entities", "select": {"key": ["project"]}, "where": {"project": "suite"}}
    for version in ({}, {"dataset": "shop", "branch": "develop", "commit": "d1"}):
        rows = reader.read(request | version, {"project": F.upper})
        assert found(rows) == [("SUITE",)]
    assert reader.asset("assets/a.json").first().id == 7
    with pytest.raises(DatasetError, match="no dataset"):
        reader.read(request | {"dataset": "mill"})


def test_manifest_with_an_unlisted_resource(firms):
    broken = firms.with_index([IndexEntry("entities", ("region",), "full_name", ("gone",))])
    with pytest.raises(DatasetError, match="no resource gone"):
        broken.resolve(["region"], ["full_name"])


def test_catalog(spark, tmp_path):
    write(tmp_path / "registry.json", registry_json(VERSIONS, DEFAULT))
    registry, default = read_registry(spark, str(tmp_path / "registry.json"))
    assert default == DEFAULT
    assert found(flatten_catalog(registry, default)) == [
        ("farm", "master", "e1", True, False), ("shop", "develop", "d1", True, False),
        ("shop", "master", "c1", False, False), ("shop", "master", "c2", False, True),
        ("shop", "master", "c3", True, False)]
    aliases = {r[0]: r[1:] for r in found(catalog_aliases(registry, default))}
    assert aliases["default"] == ("shop", "master", "c2")
    assert aliases["shop"] == ("shop", "master", "c1")
    assert aliases["shop/master"] == aliases["shop/master/HEAD"] == ("shop", "master", "c3")
    assert aliases["shop/develop/d1"] == ("shop", "develop", "d1")
    assert "farm/stage" not in aliases
    assert catalog_issues(flatten_catalog(registry, default)).count() == 0
    bad = spark.createDataFrame(
        [("a", True), ("a", True), ("b", True), (None, False), ("", True)],
        "repo string, is_default boolean")
    assert found(catalog_issues(bad)) == [
        ("more than one default", "a", 2), ("repository name is empty", None, 2)]


def test_assets(spark, tmp_path):
    write(tmp_path / "assets" / "note.txt", "one\ntwo\n")
    write(tmp_path / "assets" / "deep" / "shape.json", '{"id": "x",\n "points": [1, 2]}')
    folder = str(tmp_path)
    assert get_asset(spark, folder, "assets/note.txt").first().value == "one\ntwo\n"
    assert get_asset(spark, folder, "/assets/deep/shape.json").first().points == [1, 2]
    assert get_binary_asset(spark, folder, "assets/note.txt").first().length == 8
    for path in ("secret.txt", "assets", "assets/../secret.txt", "assets/./x", "assets//x"):
        with pytest.raises(DatasetError):
            get_asset(spark, folder, path)


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5, None), ("b", None, 'x,"y"')],
                                 "k string, v double, w string")
    result = tabular(rows, ["k"], ["k", "v", "gone"])
    assert result.columns == ["k", "v", "gone"]
    write_json(result, str(tmp_path / "json"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "json")).collect()) == [
        '{"k":"a","v":1.5,"gone":null}', '{"k":"b","v":null,"gone":null}']
    write_csv(rows, str(tmp_path / "csv"))
    assert found(read_table(spark, str(tmp_path / "csv"))) == [
        ("a", "1.5", None), ("b", None, 'x,"y"')]
    write_parquet(rows, str(tmp_path / "parquet"), ["k"])
    assert spark.read.parquet(str(tmp_path / "parquet")).filter("k = 'a'").count() == 1


def test_normalize(spark):
    rows = spark.createDataFrame([
        ("1,234", "x", "7", ["1", "2.5", ""], "", "-1"), ("", "5", "1.2.3", ["3"], None, "2")],
        "a string, b string, c string, d array<string>, e string, f string")
    assert found(normalize_cells(rows)) == [
        (1.0, "x", 7.0, [1.0, 2.5, None], None, "-1"), (None, "5", 1.2, [3.0], None, "2")]
    odd = spark.createDataFrame([(".", ",5", ".5"), ("1", "2", "3")], "a string, b string, c string")
    assert found(normalize_cells(odd)) == [(".", ",5", 0.5), ("1", "2", 3.0)]
    named = normalize_cells(rows, {"b": F.upper}, numeric=["a"])
    assert found(named.select("a", "b", "c", "d")) == [
        (1.0, "X", "7", ["1", "2.5", None]), (None, "5", "1.2.3", ["3"])]


def test_classes_and_identifiers(spark):
    rows = spark.createDataFrame([("time", "a_1"), ("measure", "A"), ("odd", "")], "t string, i string")
    assert found(rows.select(concept_class(F.col("t")), is_identifier(F.col("i")))) == [
        ("continuous", False), ("discrete", True), (None, True)]


def test_shared_folder_comes_from_the_session(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(f"{base}/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
