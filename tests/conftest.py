import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from tessera.session import ensure_checkpoint_dir, local_session
    s = local_session(4, shuffle_partitions=4, driver_memory="4g", app="tessera-tests")
    ensure_checkpoint_dir(s)  # tests are local: a /tmp checkpoint folder is fine here
    yield s
    s.stop()
