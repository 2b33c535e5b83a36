"""Functions written in Java, compiled by the compiler that Spark brings for its own plans (Janino).

The classes go to the executors as a jar, as `ADD JAR` sends it; nothing but Spark is needed on any machine.
"""

from __future__ import annotations

import os
import uuid
import zipfile
from collections.abc import Callable

from py4j.java_gateway import JavaObject
from pyspark.sql import Column, SparkSession

_loaders: dict[tuple[str, str], JavaObject] = {}


def _loader(spark: SparkSession, source: str) -> JavaObject:
    """The class loader that knows the classes of a source file beside this one; each application compiles it once."""
    sc = spark.sparkContext
    held = (sc.applicationId, source)
    if held not in _loaders:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.setParentClassLoader(sc._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        with open(os.path.join(os.path.dirname(os.path.abspath(__file__)), source), encoding="utf-8") as f:
            compiler.cook(f.read())
        classes = compiler.getBytecodes()
        # Spark's own temporary folder, which goes when the application ends.
        jar = os.path.join(sc._temp_dir, f"{source.removesuffix('.java')}-{uuid.uuid4().hex[:12]}.jar")
        with zipfile.ZipFile(jar, "w") as out:
            for name in classes:
                out.writestr(name.replace(".", "/") + ".class", bytes(classes[name]))
        spark.sql(f"ADD JAR '{jar}'")
        _loaders[held] = spark._jsparkSession.sharedState().jarClassLoader()
    return _loaders[held]


def java_function(spark: SparkSession, source: str, name: str, returns: str, *args: object) -> Callable[..., Column]:
    """The public class `name` of a source file, made with `args`, as a function of columns."""
    from pyspark.sql.classic.column import Column as Made
    from pyspark.sql.classic.column import _to_java_column, _to_seq

    sc = spark.sparkContext
    given = sc._gateway.new_array(sc._jvm.java.lang.Object, len(args))
    for i, arg in enumerate(args):
        given[i] = arg
    made = _loader(spark, source).loadClass(name).getConstructors()[0].newInstance(given)
    kind = spark._jsparkSession.parseDataType(_json(returns))
    # The gateway would take functions.udf for any object, not that for the interface.
    known = sc._jvm.java.lang.Class.forName
    kinds, values = sc._gateway.new_array(sc._jvm.java.lang.Class, 2), sc._gateway.new_array(sc._jvm.java.lang.Object, 2)
    kinds[0], kinds[1] = next(i for i in made.getClass().getInterfaces() if ".java.UDF" in i.getName()), known("org.apache.spark.sql.types.DataType")
    values[0], values[1] = made, kind
    # Never worked out twice for one row, whatever the plan makes of it.
    udf = known("org.apache.spark.sql.functions").getMethod("udf", kinds).invoke(None, values).asNondeterministic()
    return lambda *columns: Made(udf.apply(_to_seq(sc, columns, _to_java_column)))


def _json(returns: str) -> str:
    from pyspark.sql.types import DataType

    return DataType.fromDDL(returns).json()
