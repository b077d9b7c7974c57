"""The entry module without its optional part, and the folder for tables on the way."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from daybook import storage

ROOT = Path(__file__).resolve().parents[1]


def test_core_queries_without_the_optional_part(tmp_path):
    """A leftover folder of byte code where the package stood must not break the core."""
    shutil.copytree(ROOT / "daybook", tmp_path / "daybook", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "daybook/llm/__pycache__").mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(x.startswith(('op', 'pipeline')) for x in e.queries()))"
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    n, sql, extra = said.stdout.split()[-3:]
    assert int(n) > 100 and int(sql) > 100 and extra == "False"


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Elsewhere:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: None)})
        sparkContext = Elsewhere

    with pytest.raises(ValueError):
        storage.shared_folder(Session)


def test_written_tables_can_be_removed(spark):
    first, second = storage.written(spark.range(5), "numbers"), storage.written(spark.range(7), "numbers")
    one, two = storage.written_paths()[-2:]
    assert first.count() == 5
    storage.remove_paths(spark, [one])
    assert second.count() == 7 and not Path(one.removeprefix("file:")).exists() and Path(two.removeprefix("file:")).exists()
    assert storage.written_paths()[-1] == two and one not in storage.written_paths()


def test_threads_keep_their_tables(spark):
    """What one thread removes is its own."""
    import threading

    mine = storage.written(spark.range(3), "mine")
    seen = []

    def other():
        storage.written(spark.range(4), "other")
        seen.append(storage.written_paths())
        storage.remove_written(spark)

    t = threading.Thread(target=other)
    t.start()
    t.join()
    assert len(seen[0]) == 1 and "/other-" in seen[0][0] and mine.count() == 3
