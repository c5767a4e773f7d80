import pytest

from textweave import session


def test_tables_of_a_run_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda spark: str(tmp_path))
    table = session.materialise(spark.range(5), "numbers")
    assert table.count() == 5 and list(tmp_path.glob("textweave/numbers-*"))
    session.remove_tables(spark)
    assert not list(tmp_path.glob("textweave/*"))


@pytest.mark.parametrize(("master", "allowed"), [("local", True), ("local[4]", True), ("local[*]", True), ("local-cluster[2,1,512]", False), ("yarn", False)])
def test_only_one_process_goes_without_a_shared_folder(master, allowed, tmp_path):
    class Context:
        folder = None

        def __init__(self):
            self.master = master

        def getCheckpointDir(self):
            return self.folder

        def setCheckpointDir(self, path):
            self.folder = path

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda name, default: default)

    if allowed:
        assert session.shared_folder(Session())
    else:
        with pytest.raises(RuntimeError):
            session.shared_folder(Session())
