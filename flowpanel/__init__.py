"""flowpanel: PySpark analytics for high-resolution meter time series.

Every operator takes DataFrames and returns DataFrames. The plans stay in the
DataFrame API; Arrow functions are used only for dynamic time warping and for
reverse sampling, which have no relational form.
"""

from pyspark import cloudpickle

from flowpanel.functions import kernels

# Executors need not have this package installed: the Arrow kernels travel with the task.
cloudpickle.register_pickle_by_value(kernels)
