import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from broadsheet.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", 8)


@pytest.fixture
def plan_of():
    def text(df) -> str:
        return df._jdf.queryExecution().executedPlan().toString()

    return text
