"""Queries of the subpackage that SQL can express, against their SQL."""

from __future__ import annotations

import pytest

from lodestrata.llm import queries
from tests.helpers import same


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query(spark, sf, duck, name):
    same(queries.QUERIES[name](spark, sf), duck.execute(queries.ORACLE[name]))
