"""Vector and full-text retrieval, and the evaluation of retrieval, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers carry their code along, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from nearfield.session import get_session, work_dir  # noqa: E402

__all__ = ["get_session", "work_dir"]
