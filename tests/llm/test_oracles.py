"""The queries of this subpackage against their SQL."""

import pytest

from tests.compare import check, tables
from weftline.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return tables(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    check(spark, con, QUERIES[name], ORACLES[name], SF)


def test_every_operator_is_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in QUERIES)] == [] and "pipeline" in QUERIES


def test_nothing_else_imports_this_subpackage():
    import pathlib

    root = pathlib.Path(__file__).parents[2]
    for path in [*root.glob("weftline/**/*.py"), *root.glob("tests/*.py"), root / "bench.py"]:
        if "llm" not in path.relative_to(root).parts:
            assert "weftline.llm" not in path.read_text(), path
