"""flockscope: audience and issue-public analytics as Spark jobs."""

import os

# Spark already runs one task per core and the driver only solves p x p
# systems; a multithreaded BLAS competing with the JVM for the same cores was
# seen to stall a 108 x 108 inverse on the driver, so BLAS runs single-threaded
# (set before numpy is first imported; an explicit setting wins).
for _var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_var, "1")
