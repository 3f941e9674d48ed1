"""Files laid out along a curve, and quantiles from stored sketches."""

import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from dimlens import Dataset, Resource
from dimlens.operators.quantiles import quantiles, value_sketches
from dimlens.sources.sinks import write_clustered
from tests.company import found


def read_files(folder, keep):
    """Files whose minima and maxima leave room for a condition, by column and value."""
    kept, files = 0, sorted(folder.glob("part-*.parquet"))
    for file in files:
        group = pq.ParquetFile(file).metadata.row_group(0)
        spans = {group.column(i).path_in_schema: group.column(i).statistics for i in range(group.num_columns)}
        kept += all(spans[c].min <= v <= spans[c].max for c, v in keep.items())
    return kept, len(files)


@pytest.mark.parametrize("dimensions", [3, 4])
def test_a_filter_on_any_dimension_skips_most_files(spark, tmp_path, dimensions):
    chance = random.Random(dimensions)
    names = ["place", "anno", "kind", "size"][:dimensions]
    rows = [(f"p{chance.randrange(64):02}", 1950 + chance.randrange(64), f"k{chance.randrange(16):02}",
             chance.random(), i) for i in range(8000)]
    frame = spark.createDataFrame([(*r[:dimensions], r[4]) for r in rows], ", ".join(
        f"{n} {t}" for n, t in zip(names, ["string", "int", "string", "double"], strict=False)) + ", v int")
    folder = tmp_path / "clustered"
    write_clustered(frame, str(folder), names, rows_per_file=40)
    stored = spark.read.parquet(str(folder))
    assert stored.columns == frame.columns and found(stored) == found(frame)
    for name, value in zip(names, rows[5], strict=False):
        kept, files = read_files(folder, {name: value})
        assert files > 150 and kept < files * 0.5, name
    kept, files = read_files(folder, dict(zip(names[:2], rows[5], strict=False)))
    assert kept < files * 0.25


def test_places_that_many_rows_share_are_split(spark, tmp_path):
    frame = spark.createDataFrame([("a", 1, i) for i in range(900)] + [(None, None, i) for i in range(100)],
                                  "place string, anno int, v int")
    write_clustered(frame, str(tmp_path / "c"), ["place", "anno"], rows_per_file=300)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1000
    write_clustered(frame.limit(0), str(tmp_path / "none"), ["place", "anno"])
    assert spark.read.schema(frame.schema).parquet(str(tmp_path / "none")).count() == 0


def test_quantiles_of_merged_sketches(spark, tmp_path):
    chance = random.Random(2)
    concepts = spark.createDataFrame(
        [("place", "entity_domain", None), ("city", "entity_set", "place"), ("anno", "time", None),
         ("v", "measure", None), ("w", "string", None)], "concept string, concept_type string, domain string")
    places = spark.createDataFrame([(f"p{i}", i % 2 == 0) for i in range(6)], "place string, `is--city` boolean")
    rows = [(f"p{chance.randrange(6)}", f"{i}", None if i % 10 == 0 else chance.gauss(0, 1), "x") for i in range(9000)]
    frame = spark.createDataFrame(rows, "place string, anno string, v double, w string")
    facts = Resource("facts", ("place", "anno"), frame)
    dataset = Dataset(spark, [Resource("concepts", ("concept",), concepts), Resource("places", ("place",), places), facts],
                      disjoint=True)
    parts = []
    for i in range(3):  # three files, each of which costs only itself
        value_sketches(dataset, facts, frame.filter(F.col("anno").cast("int") % 3 == i)).write.parquet(str(tmp_path / str(i)))
        parts.append(spark.read.parquet(str(tmp_path / str(i))))
    fractions = [0, 0.1, 0.5, 0.9, 1]
    got = {tuple(r.key): r for r in quantiles(dataset, facts, parts, fractions).collect()}
    assert set(got) == {("anno", "place"), ("anno", "city")} and {r.value for r in got.values()} == {"v"}
    for key, keep in ((("anno", "place"), range(6)), (("anno", "city"), (0, 2, 4))):
        cells = sorted(v for p, _, v, _ in rows if v is not None and int(p[1:]) in keep)
        assert got[key].n == len(cells)
        low, *middle, high = got[key].quantiles
        assert (low, high) == (cells[0], cells[-1])
        for fraction, value in zip(fractions[1:-1], middle, strict=True):
            assert abs(sum(c <= value for c in cells) / len(cells) - fraction) < 0.03
