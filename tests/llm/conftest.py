import pytest

pytest.importorskip("lectern.llm")
