from __future__ import annotations

import pytest

from tests.session import session


@pytest.fixture(scope="session")
def spark():
    yield session()
