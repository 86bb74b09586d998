"""Workers need Spark's own dependencies only, and a cluster must name its shared folder."""

import elsewhere
import pytest

from tidemark.llm import common


def test_models_run_without_the_package_on_executors(tmp_path, sf_dir):
    """The pipeline begins with language identification (op6)."""
    said = elsewhere.run(tmp_path, f"""
        for name in ("op2_toxicity", "pipeline"):
            print(name, entry.queries()[name](spark, {sf_dir!r}).count() > 100)
    """)
    assert said.split() == ["op2_toxicity", "True", "pipeline", "True"]


class Session:
    """As much of a session as ``shared_dir`` asks for."""

    def __init__(self, master):
        self.master, self.conf, self.sparkContext, self._jsc = master, self, self, self

    def get(self, key, default):
        return default

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return False


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]"])
def test_a_cluster_without_a_shared_folder_is_refused(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session(master))
