"""Every corpus query runs over the smallest tables."""

import pytest

import __spark_entry__ as contract

NAMES = [n for n in contract.queries() if n.startswith("op") or n == "pipeline"]
NAMES = [n for n in NAMES if n == "pipeline" or n[2].isdigit()]


@pytest.mark.parametrize("name", NAMES)
def test_runs(spark, sf_dir, name):
    df = contract.queries()[name](spark, sf_dir)
    rows = df.collect()
    if name == "op8_chat_format":
        assert len(rows) == len({r.conv_id for r in rows}) > 1
    elif name == "pipeline":
        assert 0 < len(rows) < 200 and all(len(r.ids) == 4 * r.n_tokens for r in rows)
    elif name == "op11_whitening":
        assert sorted((r.vec_id, r.component) for r in rows) == [(v, c) for v in range(500) for c in range(1, 33)]
        assert {r.identity_error for r in rows} == {rows[0].identity_error} and rows[0].identity_error < 1e-4
    elif name == "op13_packing":
        assert {r.doc_id for r in rows if r.piece == 0} == set(range(200)) and len({(r.doc_id, r.piece) for r in rows}) == len(rows)
    else:
        assert sorted(r.doc_id for r in rows) == list(range(200))
