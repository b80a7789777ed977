"""Java functions for Spark SQL: a source beside the package is compiled by the driver's JDK when it is first needed.

The jar is added to the running session, which hands it to the executors. Without a compiler ``register`` raises.
"""

from __future__ import annotations

import os
import subprocess
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql.types import DataType

_JARS: dict[Path, str] = {}


def _built(source: Path) -> str:
    if source not in _JARS:
        import pyspark

        home = Path(os.environ.get("SPARK_HOME") or Path(pyspark.__file__).parent)
        out = Path(tempfile.mkdtemp(prefix="landgrid-java-"))
        jar = out / f"landgrid-{source.stem.lower()}.jar"
        try:
            subprocess.run(["javac", "-nowarn", "-cp", f"{home}/jars/*", "-d", str(out / "classes"), str(source)], check=True, capture_output=True, text=True)
            subprocess.run(["jar", "cf", str(jar), "-C", str(out / "classes"), "."], check=True, capture_output=True, text=True)
        except FileNotFoundError as e:
            raise RuntimeError(f"{source.name} needs a JDK (javac, jar) where the driver runs") from e
        except subprocess.CalledProcessError as e:
            raise RuntimeError(f"{source.name} did not compile: {e.stderr}") from e
        _JARS[source] = str(jar)
    return _JARS[source]


def register(spark: SparkSession, source: Path, functions: dict[str, tuple[str, DataType | str]]) -> None:
    """SQL name -> (class, return type); once a session."""
    if spark.catalog.functionExists(next(iter(functions))):
        return
    spark.sql(f"ADD JAR '{_built(source)}'")
    for name, (cls, kind) in functions.items():
        spark.udf.registerJavaFunction(name, cls, kind)
