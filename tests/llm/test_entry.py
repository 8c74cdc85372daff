import subprocess
import sys

from ledgerlens.llm.queries import ORACLES, QUERIES


def test_each_operator_has_one_query():
    import __spark_entry__ as E

    names = list(E.queries())
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


def test_every_oracle_is_sql():
    import __spark_entry__ as E

    assert all(isinstance(sql, str) for sql in E.oracle_sql().values())


def test_library_imports_without_this_package():
    """The rest of the library never imports ``llm``."""
    code = ("import sys; sys.modules['ledgerlens.llm'] = None\n"
            "import ledgerlens.plans.catalog, ledgerlens.plans.oracles, ledgerlens.streaming.inbox\n"
            "import __spark_entry__ as E; print(len(E.queries()), 'pipeline' in E.queries())")
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    assert out.stdout.split()[-1] == "False"
