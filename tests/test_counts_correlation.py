import numpy as np
import pandas as pd
import pytest

from furrow.operators import correlation, counts
from furrow.queries import inputs
from furrow.sources import tables


def _matrix(seed=0, samples=23, taxa=17, negative=False):
    rng = np.random.default_rng(seed)
    m = rng.integers(-3 if negative else 0, 6, (samples, taxa)) * (rng.random((samples, taxa)) < 0.5)
    m[:, 0] = 0
    m[:, 1] = 4
    return pd.DataFrame(m.astype(float), columns=[f"t{j:02d}" for j in range(taxa)])


def _long(spark, wide, keep_zeros):
    rows = [
        (f"s{i}", t, float(v)) for i, row in wide.iterrows() for t, v in row.items() if keep_zeros or v != 0
    ]
    # One taxon-less row would lose a sample of zeros only, so list every sample.
    rows += [(f"s{i}", "t00", 0.0) for i in wide.index if not keep_zeros]
    return spark.createDataFrame(rows, "sample string, taxon string, n double")


@pytest.mark.parametrize("method", ["pearson", "spearman"])
@pytest.mark.parametrize("tiny_tiles", [False, True])
@pytest.mark.parametrize("keep_zeros", [False, True])
def test_correlations_equal_pandas(spark, monkeypatch, method, tiny_tiles, keep_zeros):
    if tiny_tiles:
        monkeypatch.setattr(correlation, "BLOCK_TAXA", 3)
        monkeypatch.setattr(correlation, "SLICE_SAMPLES", 8)
        monkeypatch.setattr(correlation, "DENSE_SAMPLES", 3)
        monkeypatch.setattr(correlation, "HOT_ROWS", 5)
    wide = _matrix(negative=not keep_zeros)
    pairs, taxa = correlation.correlations(_long(spark, wide, keep_zeros), method)
    want = (wide.rank() if method == "spearman" else wide).corr()
    varying = [c for c in wide if wide[c].nunique() > 1]
    assert sorted(r["taxon"] for r in taxa.collect()) == varying
    got = {(r["t1"], r["t2"]): r["r"] for r in pairs.collect()}
    assert set(got) == {(a, b) for a in varying for b in varying if a < b}
    for (a, b), r in got.items():
        assert r == pytest.approx(want.loc[a, b], abs=1e-12)


def test_pairs_that_never_meet_are_listed(spark, monkeypatch):
    monkeypatch.setattr(correlation, "SLICE_SAMPLES", 1)
    rows = [("s1", "a", 1.0), ("s2", "b", 1.0), ("s3", "c", 2.0), ("s3", "d", 2.0)]
    pairs, _ = correlation.correlations(spark.createDataFrame(rows, "sample string, taxon string, n double"), "pearson")
    got = {(r["t1"], r["t2"]): r["r"] for r in pairs.collect()}
    assert got["a", "b"] == pytest.approx(-0.5) and got["c", "d"] == pytest.approx(1.0) and len(got) == 6


def test_strong_edges(spark):
    pairs = spark.createDataFrame([("a", "b", -0.5), ("a", "c", 0.4999999999), ("b", "c", 0.0)], "t1 string, t2 string, r double")
    assert [tuple(r) for r in correlation.strong_edges(pairs, 0.5).orderBy("dst").collect()] == [
        ("a", "b", 0.5), ("a", "c", 0.5),
    ]
    assert correlation.strong_edges(pairs, 0.0).count() == 2


@pytest.mark.parametrize("method", ["spearman", "pearson"])
@pytest.mark.parametrize("tiny_tiles", [False, True])
def test_strong_pairs_equal_all_pairs(spark, monkeypatch, method, tiny_tiles):
    if tiny_tiles:
        for name, value in (("BLOCK_TAXA", 4), ("SLICE_SAMPLES", 9), ("DENSE_SAMPLES", 5)):
            monkeypatch.setattr(correlation, name, value)
    rng = np.random.default_rng(6)
    base = rng.integers(0, 9, (60, 4))
    wide = {f"t{k:02d}": base[:, k % 4] * (1 + k % 3) + rng.integers(0, 2 + 4 * (k % 5), 60) for k in range(12)}
    wide |= {"mirror": 20 - wide["t00"], "half": np.where(np.arange(60) < 30, 7, 0), "other": np.where(np.arange(60) < 30, 0, 3), "flat": np.full(60, 2)}
    rows = [(f"s{i}", t, float(v)) for t, vs in wide.items() for i, v in enumerate(vs) if v or i == 0]
    table = spark.createDataFrame(rows, "sample string, taxon string, n double")
    for threshold in (0.5, 0.95, 0.0):
        edges, taxa = correlation.strong_pairs(table, method, threshold)
        pairs, same = correlation.correlations(table, method)
        got, want = (sorted(map(tuple, df.collect())) for df in (edges, correlation.strong_edges(pairs, threshold)))
        assert [e[:2] for e in got] == [e[:2] for e in want] and [e[2] for e in got] == pytest.approx([e[2] for e in want], abs=1e-8)
        assert len(got) >= 2 and sorted(taxa.collect()) == sorted(same.collect())
    assert {("half", "other"), ("mirror", "t00")} <= {e[:2] for e in got}


def test_slices_name_few_candidates():
    """Unrelated taxa are ruled out slice by slice; related ones are named on each."""
    rng = np.random.default_rng(2)
    count, taxa = 4000, 40
    values = rng.poisson(3, (count, taxa)).astype(float)
    values[:, 1] = values[:, 0] + rng.poisson(1, count)
    facts = pd.DataFrame({"sums": [values.sum(0)], "squares": [(values**2).sum(0)], "block": 0})
    cells = pd.DataFrame({"sample": range(2000), "block": 0, "columns": [np.arange(taxa)] * 2000, "values": list(values[:2000])})
    pick = correlation._tile_candidates(taxa, 512, count, {0: 2000, 1: 2000}, 0.5)
    got = pick((0, 0, 0), pd.concat([cells, facts], ignore_index=True))
    assert list(zip(got["i"], got["j"])) == [(0, 1)]


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        correlation.correlations(spark.createDataFrame([("s", "a", 1.0)], "sample string, taxon string, n double"), "MIC")


def test_melt_matrix(spark):
    wide = spark.createDataFrame([("a", 1.0, 0.4), ("b", 0.4, -1.0)], "var1 string, a double, b double")
    assert sorted(tuple(r) for r in correlation.melt_matrix(wide).collect()) == [
        ("a", "a", 1.0), ("a", "b", 0.4), ("b", "a", 0.4),
    ]


def test_csv_pair_with_a_missing_column(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,x,y\ns1,1,2\ns2,,4\n")
    (tmp_path / "b.csv").write_text("id,x,z.1\ns3,5,6\n")
    a = tables.read_matrix(spark, str(tmp_path / "a.csv"), "A")
    b = tables.read_matrix(spark, str(tmp_path / "b.csv"), "B")
    both = counts.stack(a, b)
    got = {(r["condition"], r["sample_id"], r["taxon"]): r["n"] for r in both.collect()}
    assert got == {
        ("A", "s1", "x"): 1.0, ("A", "s1", "y"): 2.0, ("A", "s2", "x"): 0.0, ("A", "s2", "y"): 4.0,
        ("B", "s3", "x"): 5.0, ("B", "s3", "z.1"): 6.0,
    }
    profile = {r["taxon"]: (r["a"], r["b"]) for r in counts.profiles(both, "A", "B").collect()}
    assert profile == {"x": (1.0, 5.0), "y": (6.0, 0.0), "z.1": (0.0, 6.0)}
    wide = counts.stack(spark.createDataFrame([(1, 2)], "p int, q int"), spark.createDataFrame([(3,)], "p int"))
    assert sorted(tuple(r) for r in wide.collect()) == [(1, 2), (3, None)]


def test_prune_and_align(spark):
    rows = [("A", "s1", "x", 3.0), ("A", "s2", "x", 4.0), ("B", "s1", "y", 3.0)]
    df = spark.createDataFrame(rows, "condition string, sample_id string, taxon string, n double")
    kept = counts.prune_taxa(df, 3)
    assert {r["taxon"] for r in kept.collect()} == {"x"} and kept.count() == 2
    assert counts.align(counts.profiles(df, "A", "B"), kept).count() == 1


def test_smoothing(spark):
    rows = [(s, t, float(v)) for t, vs in {"x": (1, 0, 5), "y": (2, 2, 2)}.items() for s, v in zip("abc", vs)]
    df = spark.createDataFrame(rows, "sample string, taxon string, n double")
    b = counts.smooth_matrix(df, ["sample"], "b").groupBy("taxon").sum("smoothed").collect()
    assert [r[1] for r in b] == pytest.approx([1.0, 1.0])
    a = {(r["sample"], r["taxon"]): r["smoothed"] for r in counts.smooth_matrix(df, ["sample"], "a").collect()}
    assert a["a", "x"] == pytest.approx(2 / 6) and a["c", "y"] == pytest.approx(3 / 6)
    profile = spark.createDataFrame([("x", 1.0, 9.0), ("y", 4.0, 0.0)], "taxon string, a double, b double")
    s = {r["taxon"]: (r["a"], r["b"]) for r in counts.smooth_profiles(profile).collect()}
    assert s["x"] == pytest.approx((2 / 7, 10 / 11)) and sum(v[0] for v in s.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        counts.smooth_matrix(df, ["sample"], "c")


def test_count_inputs_hold_bounded_lines(spark, monkeypatch):
    """Lines are dealt by their number, before they are summed; a sample's lines too."""
    sf_dir = "/root/testdata/sf0.001"
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    spark.read.parquet(f"{sf_dir}/part.parquet").createOrReplaceTempView("part_of_lines")
    lines.createOrReplaceTempView("lines")
    monkeypatch.setattr(inputs, "TASK_LINES", 100, raising=False)
    joined = "from lines join part_of_lines on l_partkey = p_partkey"
    plain = {
        inputs.counts: "array(p_brand)",
        inputs.fine_counts: "array(p_brand || '/' || p_size)",
        inputs.linked_counts: "array(p_brand, 'group of 2/' || floor(substr(p_brand, 7) / 2), 'group of 3/' || floor(substr(p_brand, 7) / 3))",
        inputs.linked_fine_counts: "array(p_brand || '/' || p_size, 'group of 2/' || floor((substr(p_brand, 7) * 100 + p_size) / 2))",
    }
    for made, taxa in plain.items():
        rows = made(spark, sf_dir)
        assert rows.rdd.getNumPartitions() >= lines.count() / 100
        named = f"select l_linestatus, l_suppkey, explode({taxa}) as taxon, l_quantity {joined}"
        wanted = spark.sql(f"select l_linestatus, l_suppkey, taxon, sum(l_quantity) from ({named}) group by 1, 2, 3")
        assert sorted(map(tuple, rows.select("condition", "sample_id", "taxon", "n").collect())) == sorted(map(tuple, wanted.collect()))


def test_tiles_send_each_cell_once(spark):
    """A thousand taxa and more are one block: no cell is dealt twice, and no list of a sample's cells is sorted for."""
    cells = spark.range(6000).selectExpr(
        "concat('s', id % 20) as sample", "concat('t', lpad(id div 4, 4, '0')) as taxon", "cast(id % 7 + 1 as double) as n"
    )
    held = correlation._packed(cells, "pearson", False)
    assert held.blocks == 1 and held.rows.filter("sample is not null").count() == 6000
    assert "collect_list" not in held.rows._jdf.queryExecution().toString()


def test_gathered_cells():
    rows = pd.DataFrame(
        [("b", 3, 1.0, 0.0, False), ("a", 0, 2.0, 0.0, False), ("b", 0, 4.0, 0.0, False), (None, 1, 5.0, 0.0, False),
         (None, 3, 7.0, 70.0, True), (None, 0, 6.0, 60.0, True), (None, 1, 8.0, 80.0, True)],
        columns=["sample", "id", "n", "q", "fact"],
    )
    got = correlation._gathered(rows, 2)
    lists = [(r["block"], list(r["columns"]), list(r["values"])) for _, r in got[got["columns"].notna()].iterrows()]
    assert lists == [(0, [0], [4.0]), (1, [1], [1.0]), (0, [0], [2.0])]
    facts = [(r["block"], list(r["sums"]), list(r["squares"])) for _, r in got[got["sums"].notna()].iterrows()]
    assert facts == [(0, [6.0, 8.0], [60.0, 80.0]), (1, [7.0], [70.0])]
    assert not len(correlation._gathered(rows[:0], 2))
