"""Spark-native factor analytics: non-negative factorisation and the questions asked of its factors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

_shipped: set[str] = set()


def ship(spark) -> None:
    """Send this package's code to the executors of a session, once; workers then need no installation."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="factorloom-")  # served to executors as long as the driver lives
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "factorloom_code.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    out.write(os.path.join(top, name), os.path.join("factorloom", os.path.relpath(os.path.join(top, name), here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)
