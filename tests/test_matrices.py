"""Matrix and dictionary files; base forms by checked detachment; grids over many tasks."""

import numpy as np
import pytest

from tessera.functions import fixed
from tessera.operators import fuzzy
from tessera.operators import vectors as V
from tessera.sources import matrices


@pytest.mark.parametrize("kind, order", [("<f8", "C"), ("<f4", "C"), (">i4", "C"), ("<f8", "F"), ("|u1", "F")])
def test_a_matrix_in_ranges_of_rows(spark, tmp_path, kind, order):
    values = np.asarray(np.random.default_rng(1).integers(0, 200, (1_003, 7)), dtype=kind, order=order)
    path = str(tmp_path / "m.npy")
    np.save(path, values)
    size = 100 * 7 * values.dtype.itemsize
    read = matrices.read_matrix(spark, path, size=size)
    assert read.rdd.getNumPartitions() == 11
    got = {r.row: r["values"] for r in read.collect()}
    assert np.array_equal([got[k] for k in range(1_003)], values.astype(float))
    some = matrices.read_matrix(spark, f"file://{path}", columns=(5, 0), size=size)
    got = {r.row: r["values"] for r in some.collect()}
    assert np.array_equal([got[k] for k in range(1_003)], values[:, [5, 0]].astype(float))


def test_odd_matrices(spark, tmp_path):
    path = str(tmp_path / "m.npy")
    np.save(path, np.arange(5.0))
    assert sorted((r.row, r["values"]) for r in matrices.read_matrix(spark, path).collect()) == [(k, [float(k)]) for k in range(5)]
    np.save(path, np.zeros((0, 3)))
    assert matrices.read_matrix(spark, path).count() == 0
    np.save(path, np.array(["a"], dtype=object), allow_pickle=True)
    with pytest.raises(ValueError):
        matrices.read_header(path)
    with open(path, "wb") as f:
        f.write(b"no matrix at all")
    with pytest.raises(ValueError):
        matrices.read_header(path)
    np.save(path, np.ones((100, 4)))
    with open(path, "rb+") as f:
        f.truncate(1_000)
    with pytest.raises(Exception, match="reshape|buffer"):
        matrices.read_matrix(spark, path).collect()


def test_dictionaries_and_vectors(spark, tmp_path):
    (tmp_path / "d.txt").write_text("3\n0\tcat\t2\n1\té t\t1\n")
    assert sorted(map(tuple, matrices.read_dictionary(spark, str(tmp_path / "d.txt")).collect())) == [(0, "cat", 2), (1, "é t", 1)]
    (tmp_path / "v.txt").write_text("  1.5 -2e3,\t7\n\n8\n")
    assert [tuple(r) for r in matrices.read_vectors(spark, str(tmp_path / "v.txt")).orderBy("position").collect()] == [(0, 1.5), (1, -2000.0), (2, 7.0), (3, 8.0)]


def test_bases_are_known_words(spark):
    words = ["cats", "glasses", "bus", "churches", "wolves", "men", "cities", "news", "running", "hoped", "hopped", "thing", "es", "axes", "dies", "was"]
    known = ["cat", "glass", "bus", "church", "wolf", "man", "city", "hope", "hop", "hopp", "ax", "axe", "thing", "th", "die", "dy", "was", "wa"]
    table = lambda x: spark.createDataFrame([(w,) for w in x], "term string")
    got = dict(map(tuple, V.bases(table(words + words), table(known), fixed.NOUN_DETACHMENTS, spark.createDataFrame([("men", "human"), ("men", "zed")], "term string, base string"), ("was",)).collect()))
    want = {"cats": "cat", "glasses": "glass", "bus": "bus", "churches": "church", "wolves": "wolf", "men": "human", "cities": "city", "news": "news", "axes": "ax", "dies": "dy", "was": "was"}
    assert {k: got[k] for k in want} == want and len(got) == len(set(words))
    verbs = dict(map(tuple, V.bases(table(words), table(known), fixed.VERB_DETACHMENTS).collect()))
    assert (verbs["running"], verbs["hoped"], verbs["hopped"], verbs["thing"], verbs["es"]) == ("running", "hop", "hopp", "th", "es")
    rows = spark.createDataFrame([(1, "cats", 2), (2, "cat", 1)], "doc_id int, term string, tf int")
    assert sorted(map(tuple, V.with_bases(rows, table(known)).collect())) == [(1, "cat", 2), (2, "cat", 1)]


def test_a_grid_lies_in_many_partitions(spark):
    rows = fuzzy.grid(spark, {"a": (0.0, 1.0, 5), "b": (-2.0, 2.0, 3), "c": (0.0, 10.0, 11)})
    got = [tuple(r) for r in rows.collect()]
    assert got == [(a / 4, -2.0 + 2 * b, float(c)) for a in range(5) for b in range(3) for c in range(11)]
    sizes = rows.rdd.glom().map(len).collect()
    assert len(sizes) >= 4 and max(sizes) < 60


def test_shared_levels_give_the_same_values(spark):
    v = next(x for x in fuzzy.VARIABLES if x.name == "hvac")
    rng = np.random.default_rng(2)
    levels = rng.integers(0, 3, (500, len(v.sets))) / 2
    rows = spark.createDataFrame([tuple(map(float, r)) for r in levels], ", ".join(f"l{k} double" for k in range(levels.shape[1])))
    got = [r[0] for r in rows.select(fuzzy.defuzzifier(v, "centroid")(*rows.columns)).collect()]
    assert np.allclose(np.array(got, dtype=float), fuzzy.defuzzify(levels, v), equal_nan=True)
