"""Training-data operators over the document tables.

One module per operator, each with a general DataFrame interface; ``registry``
derives the digest rows of the registered queries from them.  Functions are
shipped to the executors by value, so a cluster needs no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
