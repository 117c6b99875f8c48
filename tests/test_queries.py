"""Every query of the library against its SQL."""

from __future__ import annotations

import pytest

from lodestrata.plans import catalog
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, duck, name):
    same(catalog.QUERIES[name](spark, sf), duck.execute(catalog.ORACLE[name]))


def test_without_sql():
    """What SQL cannot express is held against an exact way elsewhere."""
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"knn_multi_indexed"}
