from types import SimpleNamespace

import pytest

from quillspan.sources.scratch import materialize, scratch_dir, temporary


def session(setting, master="local[2]", checkpoint=None):
    context = SimpleNamespace(applicationId=f"app-{master}", master=master, getCheckpointDir=lambda: checkpoint)
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: setting), sparkContext=context)


def test_the_sessions_folder_comes_first():
    assert scratch_dir(session("hdfs://shared/tmp/")) == "hdfs://shared/tmp"
    own = scratch_dir(session(None))
    assert own.startswith("file://") and scratch_dir(session(None)) == own
    assert scratch_dir(session(None, "spark://host", "hdfs://shared/checkpoints")) == "hdfs://shared/checkpoints"
    with pytest.raises(RuntimeError):
        scratch_dir(session(None, "spark://host"))


def test_materialize_reads_back(spark):
    df = materialize(spark.range(5), "five")
    assert df.count() == 5 and df._scratch_path.startswith(scratch_dir(spark))


def test_temporary_tables_go(spark):
    with temporary(spark) as keep:
        inner = materialize(spark.range(3), "inner")
        out = keep(materialize(inner.where("id > 0"), "out"))
    assert out.count() == 2
    with pytest.raises(Exception, match="(?i)not.?exist|not.?found"):
        spark.read.parquet(inner._scratch_path)


def test_compaction_leaves_no_index(spark):
    from quillspan.queries import QUERIES
    from quillspan.sources.store import Files

    rows = QUERIES["compaction_level_three"](spark, "/root/testdata/sf0.001")
    assert rows.count() == 12
    assert not [name for name in Files(spark, scratch_dir(spark)).names("") if name.startswith("three-")]
