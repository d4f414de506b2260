"""Mixer.java as a function of a Spark session: compiled by the compiler that Spark compiles its own plans with."""

from __future__ import annotations

import os
import pkgutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

#: The class by the application that has it: one jar an application.
_CLASSES: dict = {}


def _class(spark: SparkSession):
    """The compiled class; a jar with it goes to all executors, later ones too."""
    key = spark.sparkContext.applicationId
    if key not in _CLASSES:
        compiler = spark._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(pkgutil.get_data(__package__, "Mixer.java").decode())
        codes = compiler.getBytecodes()
        jar = os.path.join(os.path.realpath(tempfile.mkdtemp()), f"mixer-{uuid.uuid4().hex}.jar")
        with zipfile.ZipFile(jar, "w") as z:
            for name in codes:
                z.writestr(name.replace(".", "/") + ".class", bytes(codes[name]))
        spark.sparkContext._jsc.addJar(jar)
        _CLASSES.clear()
        _CLASSES[key] = compiler.getClassLoader().loadClass("evigraph.llm.Mixer")
    return _CLASSES[key]


def registered(spark: SparkSession, constants: list) -> str:
    """The name of a function from packed texts to their scores, an array of doubles."""
    given = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    given[0] = ",".join(map(repr, constants))
    types = spark._jvm.org.apache.spark.sql.types.DataTypes
    spark._jsparkSession.udf().register("evigraph_mixer", _class(spark).getConstructors()[0].newInstance(given), types.createArrayType(types.DoubleType, False))
    return "evigraph_mixer"
