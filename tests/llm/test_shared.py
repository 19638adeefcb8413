import pytest

from spanloom.llm import shared
from spanloom.sources.tables import shared_dir


class Session:
    """As much of a session as shared_dir() looks at."""

    def __init__(self, master, folder=None):
        self.sparkContext, self.conf, self.master, self.folder = self, self, master, folder

    def get(self, name, default=None):
        return self.folder

    def set(self, name, value):
        self.folder = value

    def getConf(self):  # noqa: N802  Spark's name
        return self


@pytest.mark.parametrize("master", ["local-cluster[3,2,1024]", "spark://host:7077", "yarn", "k8s://https://host"])
def test_a_cluster_needs_a_shared_folder(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session(master))
    assert shared_dir(Session(master, "hdfs://x/y/")) == "hdfs://x/y"


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_one_machine_makes_its_own(master):
    own = shared_dir(Session(master))
    assert own.startswith("file:///")


def test_semi_is_the_same_either_way(spark, monkeypatch):
    df = spark.range(1000).selectExpr("id", "id % 7 as k")
    keys = shared.settle(spark.createDataFrame([(1,), (4,)], "k bigint"), "keys")
    want = sorted(r["id"] for r in shared.semi(df, keys, "k").collect())
    monkeypatch.setattr(shared, "BROADCAST_KEYS", 0)
    plan = shared.semi(df, keys, "k")
    assert sorted(r["id"] for r in plan.collect()) == want == [i for i in range(1000) if i % 7 in (1, 4)]
    assert "BroadcastHashJoin" not in plan._jdf.queryExecution().executedPlan().toString()


def test_a_worker_keeps_the_words_of_one_operator():
    from spanloom.llm import packing, quality

    quality.look(b"some words here")
    words = packing.word_ids(packing.public_tokenizer())
    words.ids(b"other words here")
    assert quality._WORDS and words.known
    shared.keep_words_of("quality")
    assert quality._WORDS and not words.known
    words.ids(b"other words here")
    shared.keep_words_of("near duplicates")
    assert not quality._WORDS and not words.known
