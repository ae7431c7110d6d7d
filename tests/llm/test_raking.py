import numpy as np
import pytest

from furrow.llm import raking as op
from oracle_check import difference, duck


def test_rake_meets_targets():
    rng = np.random.default_rng(3)
    codes = np.array([(a, b) for a in range(3) for b in range(4)])
    mass = rng.uniform(1, 100, 12)
    targets = [np.array([0.5, 0.3, 0.2]), np.array([0.1, 0.2, 0.3, 0.4])]
    scaled = mass * op.rake(mass, codes, targets, 60)
    for d, t in enumerate(targets):
        assert np.allclose(np.bincount(codes[:, d], scaled) / scaled.sum(), t)
    assert np.isclose(scaled.sum(), mass.sum())


def test_probabilities_meet_the_budget():
    mass, weight = np.array([10.0, 20, 30, 0]), np.array([5.0, 1, 0.1, 1])
    p = op.probabilities(mass, weight, 20)
    assert np.isclose((mass * p).sum(), 20) and p.max() <= 1 and p[0] == 1
    assert op.probabilities(mass, weight, 1000).tolist() == [1, 1, 1, 1]
    assert op.probabilities(mass, weight, 0).max() == 0
    assert op.probabilities(mass, np.zeros(4), 5).tolist() == [0, 0, 0, 0]


def shares_of(mass, codes, p):
    return [np.bincount(codes[:, d], mass * p) / (mass * p).sum() for d in range(codes.shape[1])]


def test_bounded_probabilities_meet_the_targets():
    """Clipped cells leave the margins short unless the others are raked again."""
    codes = np.array([(a, b) for a in range(2) for b in range(3)])
    mass, targets = np.array([16.0, 60, 40, 16, 40, 28]), [np.array([0.35, 0.65]), np.array([0.3, 0.3, 0.4])]
    clipped = op.probabilities(mass, op.rake(mass, codes, targets, 200), 100)
    assert max(abs(s - t).max() for s, t in zip(shares_of(mass, codes, clipped), targets)) > 0.01
    p = op.bounded_probabilities(mass, codes, targets, 100)
    assert np.isclose((mass * p).sum(), 100) and p.max() <= 1 and p.min() > 0
    assert all(np.allclose(s, t, atol=1e-5) for s, t in zip(shares_of(mass, codes, p), targets))


def test_unreachable_targets_are_taken_whole_and_logged(frame, caplog):
    rows = [(i, "rare" if i % 20 == 0 else "common", "en" if i % 4 else "de", 10) for i in range(2000)]
    docs = frame(rows, "doc_id long, topic string, lang string, tokens long")
    got = op.mix(docs, {"topic": {"rare": 0.3, "common": 0.7}, "lang": {"en": 0.5, "de": 0.5}}, 0.4).toPandas()
    taken = got.tokens * got.probability
    assert np.isclose(taken.sum(), 0.4 * got.tokens.sum())
    assert np.allclose(got[got.topic == "rare"].probability, 1, atol=1e-4)
    assert np.isclose(taken[got.lang == "de"].sum() / taken.sum(), 0.5, atol=1e-4)
    assert "topic" in caplog.text and "rare" in caplog.text and "lang" not in caplog.text


ROWS = [(i, f"s{i % 3}", "en" if i % 4 else None, i % 7, 1.0) for i in range(3000)] + [(None, "s0", "en", None, 1.0), (7, "s1", "en", 0, 1.0), (7, "s1", "en", 0, 1.0)]
TARGETS = {"source": {"s0": 0.6, "s1": 0.2, "zz": 0.1}, "lang": {"en": 0.9}}


def test_table(frame):
    docs = frame(ROWS, "doc_id long, source string, lang string, tokens long, weight double")
    out = op.mix(docs, TARGETS, 0.4)
    assert out.columns == ["doc_id", "source", "lang", "tokens", "weight", "probability", "kept"] and out.count() == len(ROWS)
    got = out.toPandas()
    expected = (got.tokens.fillna(0) * got.probability).sum()
    assert np.isclose(expected, 0.4 * got.tokens.fillna(0).sum())
    assert np.isclose((got.tokens * got.weight)[got.source == "s0"].sum() / (got.tokens * got.weight).sum(), 0.6 / 0.9, atol=1e-3)
    assert abs((got.tokens * got.kept).sum() / expected - 1) < 0.1
    assert len(got[got.doc_id == 7].kept.unique()) == 1
    assert op.mix(docs.where("false"), TARGETS, 0.4).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_equals_sql(spark, sf):
    from furrow.llm import queries

    path = f"/root/testdata/{sf}"
    assert difference(queries.op2_raking(spark, path).toPandas(), duck(path).sql(queries.OP2_SQL).df()) is None
