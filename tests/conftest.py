import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from fojas.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "tests", cores=4, shuffle_partitions=4, checkpoint_dir=str(tmp_path_factory.mktemp("checkpoints"))
    )
    yield session
    session.stop()
