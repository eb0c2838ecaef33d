"""Python workers hold no more than they need."""

import re
from pathlib import Path

import pyarrow as pa
import pytest

from sondage.llm.batches import tidy


def held() -> float:
    """MB of this process that are no files."""
    return int(re.search(r"RssAnon:\s+(\d+)", Path("/proc/self/status").read_text())[1]) / 1024


@pytest.mark.skipif(not Path("/proc/self/status").exists(), reason="needs Linux")
def test_freed_memory_goes_back_after_a_batch():
    """200 MB in pieces too small to be mapped, with what stays between them: freeing alone gives nothing back."""
    batches = [pa.record_batch({"x": [1]}), pa.record_batch({"x": [2]})]
    stays, seen, most = [], [], 0
    for batch in tidy(batches):
        body = []
        for _ in range(2000):
            body.append(bytearray(100_000))
            stays.append(bytearray(1000))
        most = max(most, held())
        del body
        seen.append(batch.column(0)[0].as_py())
    assert seen == [1, 2]
    assert held() < most - 150
