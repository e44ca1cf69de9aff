"""Types inferred from a CSV's values: those that pandas finds in the same file."""

import itertools

import pandas as pd
import pytest

from ridelens.sources import csv as csv_io
from ridelens.sources import infer

KIND_OF = {"int64": "bigint", "float64": "double", "bool": "boolean", "object": "string", "str": "string"}
VALUES = ["", "-7", "1.5", "1e3", "x", "True", "false", "NA", "+4", "inf", " 5", "9223372036854775807",
          ".5", "2.", "1_000"]


def write(tmp_path, name, frame):
    path = tmp_path / name
    path.mkdir()
    frame.to_csv(path / "part.csv", index=False)
    return str(path)


def pandas_kinds(path):
    return {c: KIND_OF[str(t)] for c, t in pd.read_csv(f"{path}/part.csv").dtypes.items()}


def test_every_pair_of_values_gives_the_type_pandas_gives(spark, tmp_path):
    pairs = list(itertools.combinations_with_replacement(range(len(VALUES)), 2))
    frame = pd.DataFrame({f"c{a}_{b}": [VALUES[a], VALUES[b]] for a, b in pairs})
    path = write(tmp_path, "pairs", frame)
    got = {r["column"]: r["type"] for r in infer.inferred_types(infer.read_csv_texts(spark, path)).collect()}
    want = pandas_kinds(path)
    told = {c: (got[c], want[c], [VALUES[int(i)] for i in c[1:].split("_")]) for c in want if got[c] != want[c]}
    assert not told


def test_values_of_a_quoted_multi_line_file_equal_pandas(spark, tmp_path):
    frame = pd.DataFrame({
        "n": [1, 2, 3, 4], "holes": ["1", "", "3", "NA"], "share": ["0.5", "1", "-2e-3", ""],
        "flag": ["True", "False", "true", "FALSE"],
        "text": ['say "hi", twice', "two\nlines, and \"quotes\"", "", " blank ends "], "empty": [None] * 4})
    path = write(tmp_path, "quoted", frame)
    found = infer.read_csv_inferred(spark, path)
    want = pd.read_csv(f"{path}/part.csv")
    assert dict(found.dtypes) == {c: KIND_OF[str(t)] for c, t in want.dtypes.items()}
    got = [tuple(r) for r in found.orderBy("n").collect()]
    want = [tuple(None if pd.isna(v) else v for v in row) for row in want.itertuples(index=False)]
    assert got == want


def test_kinds_of_many_files_are_merged(spark, tmp_path):
    """One value decides a column's type, whichever of many files holds it."""
    df = spark.range(500).selectExpr("CAST(id AS STRING) AS whole",
                                     "CASE WHEN id = 377 THEN 'x' ELSE CAST(id AS STRING) END AS odd",
                                     "CASE WHEN id = 12 THEN '0.5' ELSE CAST(id AS STRING) END AS part").repartition(20)
    path = csv_io.write_csv(df, str(tmp_path / "many"))
    found = infer.read_csv_inferred(spark, path)
    assert dict(found.dtypes) == {"whole": "bigint", "odd": "string", "part": "double"}
    assert found.selectExpr("sum(whole) AS s").first().s == sum(range(500))


def test_numbers_beyond_64_bits_are_text(spark, tmp_path):
    frame = pd.DataFrame({"a": ["99999999999999999999", "1"], "b": ["1.5", "99999999999999999999"]})
    found = infer.read_csv_inferred(spark, write(tmp_path, "huge", frame))
    assert dict(found.dtypes) == {"a": "string", "b": "string"}


@pytest.mark.parametrize("rows", [[], [(None, None)]])
def test_no_values(spark, tmp_path, rows):
    path = csv_io.write_csv(spark.createDataFrame(rows, "a STRING, b STRING").coalesce(1), str(tmp_path / "none"))
    found = infer.read_csv_inferred(spark, path, ["a", "b"])
    assert dict(found.dtypes) == dict.fromkeys("ab", "double" if rows else "string") and found.count() == len(rows)
