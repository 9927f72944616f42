from corpusloom.llm import common


def test_shared_folder(spark, tmp_path, monkeypatch):
    assert common.shared_dir(spark).startswith("file:///")
    monkeypatch.setattr(common, "_set_dir", lambda spark: str(tmp_path))
    assert common.shared_dir(spark) == f"file://{tmp_path}"
    t = common.written(spark.range(3), "t")
    assert t.count() == 3
    common.drop_written(t)
    assert not list(tmp_path.iterdir())


def test_publish_twice(tmp_path):
    from pyarrow.fs import LocalFileSystem

    store = LocalFileSystem()
    for attempt in (1, 2):
        (tmp_path / f".{attempt}").write_bytes(b"same")
        common.publish(store, f"{tmp_path}/.{attempt}", f"{tmp_path}/whole")
    assert [p.name for p in tmp_path.iterdir()] == ["whole"]


def test_no_local_folder_on_a_cluster(monkeypatch):
    import pytest

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()

    monkeypatch.setattr(common, "_set_dir", lambda spark: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Session())
