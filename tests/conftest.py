import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from adherence.schemas import SAMPLES  # noqa: E402
from adherence.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    shared = {"spark.checkpoint.dir": tempfile.mkdtemp(prefix="adherence-tests-")}
    session = local_session(app="adherence-tests", cpus=4, shuffle_partitions=4, extra=shared)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def make_samples(spark):
    """Samples from (response, [(inst_id, kwargs)]) pairs."""

    def make(*rows):
        data = [
            ("run", n, n, "prompt", response, [i for i, _ in insts], [k for _, k in insts])
            for n, (response, insts) in enumerate(rows)
        ]
        return spark.createDataFrame(data, SAMPLES)

    return make
