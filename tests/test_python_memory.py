"""What is sent to Python, and what Python holds of it."""

import sys
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from parlance.functions import text as tx
from parlance.operators import dense


def test_vectors_are_held_as_32_bit_floats():
    got = dense.vectors_of(pd.Series(["one two", None, "three"], index=[5, 6, 7]), dense.EMBEDDERS["hashed"][0])
    assert list(got.index) == [5, 6, 7] and all(v.dtype == np.float32 and v.shape == (256,) for v in got)
    assert all(np.array_equal(v, np.float32(dense.hashed_vector(t))) for v, t in zip(got, ["one two", None, "three"], strict=True))
    assert sum(sys.getsizeof(v) for v in got) < 3 * 1500  # a list of 256 numbers takes 8 KB and more


def test_only_text_that_may_not_be_normal_goes_to_python(spark):
    plain = ["plain words", "Gr\u00fc\u00dfe \u00e0 l'\u00e9cole \u2013 \u00ab\u00e9l\u00bb", "\u043f\u0440\u0438\u0432\u0435\u0442 \u0439", ""]
    unsure = ["\ufb01ne", "\u00b2 \u00bd", "e\u0301te\u0301", "\u0438\u0306", "\uff57\uff49\uff44\uff45", "\u1112\u1161", "a\u00a0b"]
    texts = [*plain, *unsure, None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    got = [r[0] for r in rows.orderBy("i").select(tx.normal(F.col("text"))).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]
    assert [r[0] for r in rows.where(F.col("text").rlike(tx._UNSURE)).orderBy("i").select("text").collect()] == unsure
