"""Built-in table procedures: (inputs, outputs, arguments -> array of structs)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import DOUBLE, STRING

BUILT_IN = {
    "db.info": ([], {"version": STRING}, lambda: F.array(F.struct(F.lit("2.0.0").alias("version")))),
    "math.add": (["a", "b"], {"result": DOUBLE}, lambda a, b: F.array(F.struct((a.cast("double") + b.cast("double")).alias("result")))),
}
