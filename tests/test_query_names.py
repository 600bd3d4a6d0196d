"""Names of the queries' module."""

import ast
import collections
from pathlib import Path

from waynet.plans import queries


def test_no_function_is_defined_twice():
    """A second function of one name takes the place of the first in the queries above it."""
    names = collections.Counter(n.name for n in ast.parse(Path(queries.__file__).read_text()).body if isinstance(n, ast.FunctionDef))
    assert [n for n, times in names.items() if times > 1] == []
