import os
import sys

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import pytest  # noqa: E402
import samples  # noqa: E402

from pvflow.llm.common import tuned  # noqa: E402


@pytest.fixture(scope="session")
def llm(spark):
    return tuned(spark)


@pytest.fixture(scope="session")
def docs(llm):
    df = samples.table(llm).repartition(3).cache()
    df.count()
    return df


@pytest.fixture(scope="session")
def empty(llm):
    return samples.table(llm, [])
