import pytest

from inferlake import JobSpec, SpecError


def spec(**over):
    given = dict(task="embeddings", dataset="t", model="m", output="/tmp/out")
    return JobSpec(**{**given, **over})


@pytest.mark.parametrize("limit,size,rows", [
    (None, 64, 1), (None, 7, 1), (129, 128, 2), (5, 4_000_001, 1), (0, 640, 10), (0, 0, None)])
def test_denominators(limit, size, rows):
    assert spec(limit=limit, num_examples=size).expected_rows == rows


@pytest.mark.parametrize("bad", [
    {"world": 0}, {"batch": 0}, {"max_tokens": 0}, {"temperature": -0.1}, {"task": "translation"},
    {"task": "generation", "batch": 2}, {"task": "ocr"},
    {"task": "ocr", "dataset": "/scans/*.PDF"}, {"task": "ocr", "dataset": "/s/*.png", "batch": 3}])
def test_rules(bad):
    with pytest.raises(SpecError):
        spec(**bad)


def test_batch_defaults():
    assert spec().batch == 64
    assert spec(task="generation").batch == 1
    assert spec(task="ocr", dataset="/scans/**/*.png").batch == 1
