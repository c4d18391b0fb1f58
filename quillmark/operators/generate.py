"""Generated texts from injected models: functions from a list of prompts to a list of texts, tried in order.

A model may answer some prompts with nothing, time out, or fail.  Prompts without an answer go to the next model; a call that times
out is made again a bounded number of times; a model that fails in any other way, or times out for good, is not called again by the
task.  What no model answers is null with the last error beside it.  A stage of a plan: models run on Arrow batches in the tasks, and
a lost task is run anew, so that models should answer equal prompts alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Prompts of one call, and calls that are made again after a timeout.
TOGETHER, RETRIES = 32, 2


@dataclass(frozen=True)
class Model:
    """A name and a function from prompts to texts, None where it has none."""

    name: str
    call: Callable[[list[str]], list[str | None]]


@dataclass
class Client:
    """The models as one task sees them."""

    models: Sequence[Model]
    retries: int = RETRIES
    failed: set[str] = field(default_factory=set)

    def ask(self, prompts: list[str]) -> list[tuple[str | None, str | None, int, str | None]]:
        """(text, model, calls, error) of each prompt."""
        out: list = [(None, None, 0, "no model")] * len(prompts)
        left = list(range(len(prompts)))
        for model in self.models:
            if not left:
                break
            if model.name in self.failed:
                continue
            calls, answers, error = self.call(model, [prompts[i] for i in left])
            for i, answer in zip(left, answers, strict=True):
                out[i] = (answer, model.name, out[i][2] + calls, None) if answer else (None, None, out[i][2] + calls, error or f"{model.name}: no answer")
            left = [i for i in left if out[i][0] is None]
        return out

    def call(self, model: Model, prompts: list[str]) -> tuple[int, list[str | None], str | None]:
        """(calls made, answers, error) of one model."""
        for n in range(1, self.retries + 2):
            try:
                answers = model.call(prompts)
                if len(answers) != len(prompts):
                    raise ValueError(f"{len(answers)} answers to {len(prompts)} prompts")
                return n, answers, None
            except TimeoutError as problem:
                error = f"{model.name}: timed out {problem}".rstrip()
            except Exception as problem:  # noqa: BLE001 - whatever a model raises is a failure of that model
                error = f"{model.name}: {type(problem).__name__}: {problem}"
                break
        self.failed.add(model.name)
        return n, [None] * len(prompts), error


def generate(df: DataFrame, prompt: Column, models: Sequence[Model], retries: int = RETRIES, together: int = TOGETHER) -> DataFrame:
    """`df` with (generated, model, calls, error) behind its columns; null and empty prompts are not sent."""
    names = df.columns
    own = [f"c{i}" for i in range(len(names))]
    inner = df.select(*names, prompt.cast("string")).toDF(*own, "prompt")
    types = dict(inner.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = Client(models, retries)
        for batch in batches:
            prompts = batch.column("prompt").to_pylist()
            out: list = [(None, None, 0, None)] * len(prompts)
            some = [i for i, p in enumerate(prompts) if p]
            for k in range(0, len(some), together):
                few = some[k : k + together]
                for i, got in zip(few, client.ask([prompts[i] for i in few]), strict=True):
                    out[i] = got
            text, model, calls, error = zip(*out, strict=True) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(text, pa.string()), pa.array(model, pa.string()), pa.array(calls, pa.int32()), pa.array(error, pa.string())], [*own, "generated", "model", "calls", "error"])

    schema = ", ".join(f"{c} {types[c]}" for c in own) + ", generated string, model string, calls int, error string"
    return inner.mapInArrow(run, schema).toDF(*names, "generated", "model", "calls", "error")
