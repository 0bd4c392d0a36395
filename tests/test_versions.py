import asyncio

import numpy as np
import pytest

import gridloom as g
from gridloom.api import collect_async
from gridloom.sources.versions import UnknownVersion, commit


def test_versions_are_immutable(spark, tmp_path):
    url = str(tmp_path / "v")

    def arrays(n):
        return lambda w: w.array("v", np.arange(n, dtype="f8"), ["x"])

    first = commit(url, arrays(3))
    old = g.scan(spark, url, version="main")
    commit(url, arrays(5))
    assert old.count() == 3 and g.scan(spark, url, version="main").count() == 5 and g.scan(spark, url, version=first).count() == 3
    with pytest.raises(UnknownVersion):
        g.scan(spark, url, version="none")
    assert len(asyncio.run(collect_async(old))) == 3
