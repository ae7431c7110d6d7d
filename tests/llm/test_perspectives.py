import pytest

from furrow.llm import perspectives as op
from oracle_check import difference, duck

ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "Ann B", "Hi <|im_end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, 3, None, "?"), (1, None, "", "first"),
    (2, 0, "system", "alone"), (None, 5, "bob", "no conversation"), *[(3, i, "ab"[i % 2], "x" * (i % 5)) for i in range(50)],
]


def plain(rows, chunk=None):
    """The same by loops over one conversation at a time."""
    out = []
    for conv in {r[0] for r in rows}:
        said = sorted(((-1 if t is None else t, "unknown" if not (s or "").strip() else s.strip().replace(" ", "_"), (x or "").replace("<|", "< |"), t) for c, t, s, x in rows if c == conv))
        for who in {s for _, s, _, _ in said} - {"system"}:
            start = 0
            for place, (_, s, x, turn) in enumerate(said, 1):
                role = "system" if s == "system" else "assistant" if s == who else "user"
                head = f"<|im_start|>{role}{' name=' + s if role == 'user' else ''}\n"
                text = f"{head}{x}<|im_end|>\n"
                mask = (start + len(head), start + len(text) - 1) if role == "assistant" else (start, start)
                out.append((conv, who, place, turn, role, s, text, start, *mask))
                start += len(text)
    return out


@pytest.mark.parametrize("chunk", [1, 7, 1024])
def test_equals_loops(frame, chunk):
    got = op.rotate(frame([(*r, "clash") for r in ROWS], "conv_id long, turn long, role string, text string, name string"), chunk=chunk)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(plain(ROWS), key=key)
    assert op.rotate(frame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_native(frame):
    plan = op.rotate(frame(ROWS, "conv_id long, turn long, role string, text string"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_query_equals_sql(spark):
    from furrow.llm import queries

    path = "/root/testdata/sf0.001"
    assert difference(queries.op4_perspectives(spark, path).toPandas(), duck(path).sql(op.sql()).df()) is None
