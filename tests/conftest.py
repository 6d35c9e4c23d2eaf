import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from factloom.functions.registry import Registry  # noqa: E402
from factloom.operators.providers import default_providers  # noqa: E402
from factloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def registry():
    return Registry(default_providers())


def cmp(key, op, value=None):
    return {"type": "cmp", "key": key, "op": op, "value": value}


def agg(key, op, kind, arg=None):
    return {"type": "agg_cmp", "key": key, "op": op, "agg": kind, "agg_arg": arg}


def group(kind, *children):
    return {"type": kind, "children": list(children)}


def negate(child):
    return {"type": "not", "child": child}
