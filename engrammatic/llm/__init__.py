"""Training-data pipeline operators.

Nothing outside this subpackage imports it; ``__spark_entry__.py`` adds its queries only when it is there.

Code that runs in Python workers is pickled by value, so that executors need no copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
