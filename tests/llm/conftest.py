import pytest

pytest.importorskip("lodestone.llm")
