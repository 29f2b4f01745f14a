"""Capability analytics over bundles of instructions and scripts, as DataFrame plans."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Give the executors' Python workers this package, once per application, for clusters on which it isn't installed."""
    sc = spark.sparkContext
    if getattr(sc, "_capledger_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in sorted(os.walk(here)):
            for f in sorted(files):
                if not f.endswith(".pyc"):
                    path = os.path.join(folder, f)
                    z.write(path, os.path.join("capledger", os.path.relpath(path, here)))
    path = os.path.join(tempfile.mkdtemp(prefix="capledger-zip-"), "capledger.zip")
    with open(path, "wb") as f:
        f.write(buf.getvalue())
    sc.addPyFile(path)  # goes to every executor through Spark's own file server
    sc._capledger_shipped = True
