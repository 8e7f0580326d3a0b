"""Operations of a training-data pipeline. Nothing else in the package imports this."""

import os

# Many small products: more than one thread each makes them slower, and tasks share the cores.
for _name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "RAYON_NUM_THREADS"):
    os.environ.setdefault(_name, "1")
