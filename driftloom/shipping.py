"""Getting this package to the executors, where it may not be installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame

_sent: set[str] = set()


def shipped(df: DataFrame) -> DataFrame:
    """``df``, once its application's Python workers can import this package.

    The package goes out as one small archive, once for each application.
    """
    context = df.sparkSession.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        here = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(here):
            archive = os.path.join(tempfile.mkdtemp(prefix="driftloom-"), "driftloom_package")
            context.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(here), os.path.basename(here)))
    return df
