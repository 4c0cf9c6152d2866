"""Each query against its SQL twin."""

import pytest
from compare import same

from siltstone.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(name, spark, data, duck):
    df = catalog.queries()[name](spark, data)
    if sql := catalog.oracles().get(name):
        same(df, duck, sql)
    else:
        df.collect()
