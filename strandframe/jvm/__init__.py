"""Kernels in Java: compiled once per application by the compiler that Spark generates its own code with, and sent to the executors as a jar."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import zipfile

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Functions of ``Alignments.java`` and what they return.
KERNELS = {"Progressive": "array<string>", "Refined": "array<string>", "BestMove": "array<double>", "Updated": "array<struct<member: bigint, a: string>>"}


def _loader(sc):
    """Class loader with the compiled kernels; the executors get them from a jar."""
    if getattr(sc, "_strandframe_kernels", None) is None:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__name__, "Alignments.java").decode())
        jar = os.path.join(tempfile.mkdtemp(prefix="strandframe-jar-"), "strandframe-kernels.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(name.replace(".", "/") + ".class", bytes(code))
        sc._jsc.sc().addJar(jar)
        sc._strandframe_kernels = compiler.getClassLoader()
    return sc._strandframe_kernels


def kernel(spark: SparkSession, name: str, *args: Column) -> Column:
    """Call of a kernel."""
    sc = spark.sparkContext
    function = f"strandframe_{name.lower()}"
    if not spark._jsparkSession.catalog().functionExists(function):
        new = _loader(sc).loadClass(f"strandframe.Alignments${name}").getDeclaredConstructor(sc._gateway.new_array(sc._jvm.java.lang.Class, 0))
        returned = sc._jvm.org.apache.spark.sql.types.DataType.fromDDL(KERNELS[name])
        spark._jsparkSession.udf().register(function, new.newInstance(sc._gateway.new_array(sc._jvm.java.lang.Object, 0)), returned)
    return F.call_function(function, *args)


def costs(matrix: np.ndarray, v: float, u: float) -> Column:
    """Scores of letters and of gaps as a kernel takes them."""
    return F.lit(bytearray(np.append(np.asarray(matrix, "<f8").ravel(), [v, u]).astype("<f8").tobytes()))


def dealt(rows: DataFrame, cost: float, each: float) -> DataFrame:
    """Rows of alignments dealt out by ``msa_id``: a task for each ``each`` of ``cost``, and four per core at least."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism * 4, int(cost / each) + 1, 1), "msa_id")
