"""Executors that do not have the package on their path can still run the models."""

import os
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from inferlake.models import REGISTRY, build
from inferlake.operators import inference

LOAD = """
import pickle, sys
answers, float_lists, factory, requests = pickle.load(open(sys.argv[1], "rb"))
print([error for _, error in answers(factory(), requests)], len(float_lists([[[1.0]], None])))
"""
PAGE = [{"type": "image_url", "image_url": {"url": "data:image/png;base64,PHA+"}}]
REQUESTS = {"hash-embedder": [{"input": ["a b", "c"]}] * 10, "faulty": [{"input": ["a"]}],
            "echo": [{"messages": [{"content": "hi"}]}],
            "tag-stripper": [{"messages": [{"content": PAGE}]}]}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_models_travel_by_value(name, tmp_path):
    path = tmp_path / "job.pkl"
    path.write_bytes(cloudpickle.dumps((inference._answers, inference._float_lists, build(name),
                                        REQUESTS[name])))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", LOAD, str(path)], cwd=tmp_path, env=env,
                         capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
    assert out.stdout.strip() == f"{[None] * len(REQUESTS[name])} 2"
