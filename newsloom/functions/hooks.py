"""Hooks: a user's model over a column, in batches, loaded once by each Python worker.

Spark keeps its Python workers between tasks (``spark.python.worker.reuse``), so a model that a worker has loaded serves
all later tasks there. A batch that fails is tried again; if it goes on failing it is cut in two, down to the one text
that is at fault, whose row gets the error in place of a result. So one bad text costs some calls, not the job.
"""

import os
import time
import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[[Sequence[str]], Sequence]
#: The models that this worker has loaded, by hook.
_LOADED: dict[str, Model] = {}


def _model(name: str, load: Callable[[], Model]) -> Model:
    if name not in _LOADED:
        _LOADED[name] = load()
    return _LOADED[name]


def answers(model: Model, texts: list[str], retries: int, wait: float) -> list[tuple]:
    """``(result, error)`` of each text; a call gets all texts, or after ``retries`` more failures halves of them."""
    error = ""
    for attempt in range(retries + 1):
        try:
            got = list(model(texts))
            if len(got) != len(texts):
                raise ValueError(f"{len(got)} results for {len(texts)} texts")  # noqa: TRY301
        except Exception as e:  # noqa: BLE001
            error = f"{type(e).__name__}: {e}"[:500]
            if attempt < retries:
                time.sleep(wait * 2**attempt)
        else:
            return [(x, None) for x in got]
    if len(texts) == 1:
        return [(None, error)]
    half = len(texts) // 2
    return answers(model, texts[:half], retries, wait) + answers(model, texts[half:], retries, wait)


class Hook:
    def __init__(self, load: Callable[[], Model], returns: str = "string", batch: int = 32, retries: int = 1, wait: float = 0.1):
        """``load`` gives the model, a function of some texts to as many results of the type ``returns``."""
        self.load, self.returns, self.batch, self.retries, self.wait = load, returns, batch, retries, wait
        self.name = uuid.uuid4().hex

    def __call__(self, text: Column) -> Column:
        """A struct of ``result``, ``error`` and ``worker``, the process that answered. A null text has neither result nor error."""
        name, load, batch, retries, wait = self.name, self.load, self.batch, self.retries, self.wait

        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            model = None
            for texts in batches:
                here = [(i, x) for i, x in enumerate(texts) if x is not None]
                out: list[tuple] = [(None, None)] * len(texts)
                for k in range(0, len(here), batch):
                    model = model or _model(name, load)
                    part = here[k : k + batch]
                    for (i, _), one in zip(part, answers(model, [x for _, x in part], retries, wait), strict=True):
                        out[i] = one
                yield pd.DataFrame({"result": pd.Series([r for r, _ in out], dtype=object), "error": pd.Series([e for _, e in out], dtype=object), "worker": os.getpid()})

        return F.pandas_udf(run, f"result {self.returns}, error string, worker long")(text)

    def apply(self, rows: DataFrame, text: str, into: str) -> DataFrame:
        """``rows`` with the results in column ``into`` and what failed in ``{into}_error``; the model runs once a row."""
        held = f"_{into}_{self.name[:8]}"
        done = rows.withColumn(held, self(F.col(text)))
        return done.withColumns({into: F.col(f"{held}.result"), f"{into}_error": F.col(f"{held}.error")}).drop(held)
