from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from veilframe.llm import common, langid


def test_language_id_drops_what_the_operator_before_holds():
    seen = {}
    docs = SimpleNamespace(schema=T.StructType([T.StructField("text", T.StringType())]), mapInArrow=lambda run, schema: seen.update(run=run))
    docs.drop = lambda *names: docs
    langid.identify(docs, langid.Mixture(["a", "b"], np.ones((1 << langid.BITS, 2))))
    made = []
    make = lambda: made.append(1) or len(made)
    common.per_worker(("caches",), make)
    [out] = seen["run"](iter([pa.RecordBatch.from_pydict({"text": ["some words", None]})]))
    assert out.column("lang_pred").to_pylist()[1] == langid.UNKNOWN
    assert common.per_worker(("caches",), make) == 2
