"""Run a model over every row of a table with Spark, and keep the output
resumable, auditable and publishable."""

import sys

from pyspark import cloudpickle

# Executors unpickle our small Arrow functions without the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


from inferlake.plans.runs import (  # noqa: E402
    Run, RunPlan, compile, embed, generate, launch, ocr, status,
)
from inferlake.spec import JobSpec, SpecError  # noqa: E402

__all__ = [
    "JobSpec", "Run", "RunPlan", "SpecError", "compile", "embed", "generate",
    "launch", "ocr", "status",
]
